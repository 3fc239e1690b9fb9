"""N-gram join and components against brute force."""
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

from corpusflow.llm import ngram_join
from corpusflow.llm.common import Scratch
from corpusflow.llm.components import components
from corpusflow.llm.suffix_array import pack


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, key string, n int, component_id int")


def corpus(seed):
    """Families of copies with more and more changes, shared passages, short and repeated texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4)))
    passage = [word() for _ in range(30)]
    rows = [None, "", "  \n", "one", "One", "one two", "a a a a a a a a", "a a a a a a"]
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([4, 9, 15, 40, 120]))]
        for _ in range(8):
            now = list(base)
            for _ in range(rnd.randint(0, 4)):
                now[rnd.randrange(len(now))] = word()
            if rnd.random() < 0.3:
                now[rnd.randrange(len(now)):0] = passage
            rows.append(rnd.choice([" ", "\t", "  "]).join(now))
    rnd.shuffle(rows)
    ids = rnd.sample(range(1000), len(rows))
    return list(zip(ids, rows)) + [(ids[0], rows[0]), (ids[1], "another text of that id")]


@pytest.mark.parametrize("n,num,den,tile", [(3, 90, 100, 10 ** 6), (5, 8, 10, 10 ** 6), (3, 8, 10, 300), (1, 7, 10, 200)])
def test_components_equal_brute_force(spark, n, num, den, tile):
    rows = corpus(n + tile)
    out = sorted(map(tuple, ngram_join.join(wide(spark, rows), n, num, den, tile=tile).collect()))
    assert out == sorted(brute.near(rows, n, num, den))


def test_chains_of_links_are_one_component(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[i:i + 100])) for i in range(0, 40, 2)]
    out = ngram_join.join(wide(spark, rows), 1, 9, 10).collect()
    assert {r.component_id for r in out} == {0}
    assert not np.intersect1d(*ngram_join.ngram_sets([rows[0][1], rows[-1][1]], 1)).size == 100


def test_keep_one_keeps_columns_and_the_smallest_id(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(4, text), (2, text + " more"), (9, "other words are here now"), (None, text), (5, None), (2, text + " more")]
    out = ngram_join.keep_one(wide(spark, rows))
    assert out.columns == wide(spark, []).columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "2", "5", "9", "None"]
    assert ngram_join.join(wide(spark, [])).count() == 0


def test_every_linked_pair_shares_a_key():
    rnd = np.random.default_rng(2)
    for num, den in ((9, 10), (8, 10), (1, 2)):
        bands = ngram_join.Bands(num, den)
        for _ in range(150):
            size = int(rnd.integers(1, 400))
            base = rnd.integers(0, 2 ** 63, size + 400, dtype=np.uint64)
            apart = int(rnd.integers(0, max(1, bands.unshared(2 * size)) + 1))
            lost = int(rnd.integers(0, apart + 1))
            a, b = np.unique(base[:size]), np.unique(np.concatenate((base[lost:size], base[size:size + apart - lost])))
            common = len(np.intersect1d(a, b))
            if len(b) and den * common >= num * (len(a) + len(b) - common):
                (x, least), (y, most) = ngram_join.part_keys(a, bands), ngram_join.part_keys(b, bands)
                assert len(set(x) & set(y)) >= least and len(set(x) & set(y)) >= most


def test_bit_counts_bound_the_overlap_from_above():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 2 ** 63, k, dtype=np.uint64)) for k in (3, 50, 400)]
    sets += [np.unique(np.concatenate((s[: len(s) // 2], sets[0]))) for s in sets]
    marks = ngram_join._bitmaps(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = int(np.bitwise_count(marks[i] ^ marks[j]).sum())
            assert apart <= len(np.setxor1d(a, b))


def test_components_of_paths_stars_and_cycles(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(9, 9)]
    edges = [rnd.choice([(a, b), (b, a)]) for a, b in edges] * 2
    out = dict(components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"), "roots").collect())
    assert {out[i] for i in range(100, 161)} == {100} and {out[i] for i in range(500, 560)} == {500} and {out[i] for i in range(200, 207)} == {200}
    assert 9 not in out and components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test"), "roots").count() == 0


def test_a_key_that_many_classes_share_is_split_over_tasks(spark):
    rows = [([i], i) for i in range(1, 2000)] + [([5000], 7), ([5001, 5001], 8)]
    nodes = [n for (n, *_), _ in rows]
    keys = [[77] if n < 5000 else [78, n] for n in nodes]
    units = [(k // 100, pack(np.array(nodes[k:k + 100]), np.ones(len(nodes[k:k + 100]), np.uint8), np.array([len(x) for x in keys[k:k + 100]]),
                             np.array(sum(keys[k:k + 100], [])))) for k in range(0, len(nodes), 100)]
    found = spark.createDataFrame(units, "unit long, load binary")
    out = dict(ngram_join._groups(found, Scratch(spark, "test")).collect())
    assert {out[i] for i in range(1, 2000)} == {1} and out[5000] == out[5001] == 5000
