"""Exact dedup, decontamination, licences and quality on hand-made and random rows."""
import hashlib
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

from corpusflow.llm import decontaminate, exact_dedup, licences, quality

DOCS = "doc_id long, text string, digest int, kept string, hit_words string, score int, labels string"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def wide(spark, rows):
    return frame(spark, [(i, t, 1, "x", "y", 2, "z") for i, t in rows], DOCS)


# exact dedup

def test_dedup_keeps_the_largest_id_of_equal_texts(spark):
    rows = [(1, "Abc"), (5, "aBC"), (3, "abc"), (2, None), (4, ""), (7, "Éa"), (8, "éa"), (9, "x" * 300_000)]
    docs = wide(spark, rows)
    out = {r.doc_id: r for r in exact_dedup.dedup(docs, exact_dedup.fresh_index(spark, docs.schema["doc_id"].dataType)).collect()}
    assert {i for i, r in out.items() if r.kept} == {4, 5, 7, 8, 9}
    assert (out[1].keep_id, out[1].group_size, out[2].keep_id) == (5, 3, 4)
    assert all(out[i].text_sha256 == brute.digest(t) for i, t in rows)


def test_dedup_repeated_rows_and_null_ids_keep_exactly_one(spark):
    docs = wide(spark, [(1, "a"), (1, "a"), (1, "A"), (None, "b"), (None, "b"), (2, "c"), (None, "c")])
    out = exact_dedup.dedup(docs, exact_dedup.fresh_index(spark, docs.schema["doc_id"].dataType)).collect()
    assert sum(r.kept for r in out) == 3 and len(out) == 7
    kept = exact_dedup.drop_duplicates(docs, exact_dedup.fresh_index(spark, docs.schema["doc_id"].dataType))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept.collect()) == [("1", "a"), ("2", "c"), ("None", "b")]


def test_index_remembers_earlier_batches(spark):
    first, second = frame(spark, [(1, "a"), (2, "b")]), frame(spark, [(9, "A"), (10, "c"), (11, "c")])
    index = exact_dedup.fresh_index(spark, first.schema["doc_id"].dataType, buckets=4)
    assert exact_dedup.drop_duplicates(first, index).count() == 2
    out = {r.doc_id: r for r in exact_dedup.dedup(second, index).collect()}
    assert (out[9].kept, out[9].keep_id) == (False, 1) and out[11].kept and not out[10].kept
    assert index.read().count() == 3
    plan = second.join(index.read().hint("merge"), F.unhex(F.lit("00")) == F.col("digest"))  # readable as a table
    assert plan.count() == 0
    assert exact_dedup.drop_duplicates(second, index).count() == 0


def test_dedup_of_an_empty_table(spark):
    docs = wide(spark, [])
    index = exact_dedup.fresh_index(spark, docs.schema["doc_id"].dataType)
    assert exact_dedup.dedup(docs, index).count() == 0 and index.read().count() == 0
    assert exact_dedup.drop_duplicates(docs, index).columns == docs.columns


def test_dedup_runs_no_python_and_index_side_is_not_shuffled(spark):
    docs = frame(spark, [(1, "a"), (2, "A")])
    index = exact_dedup.fresh_index(spark, docs.schema["doc_id"].dataType)
    plan = exact_dedup.dedup(docs, index)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Bucketed: true" in plan


# decontamination

ITEMS = "item_id string, text string"


def test_windows_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["a", "B", "ç", "d1", "e"]
    say = lambda n: rnd.choice([" ", ", ", "-"]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(str(i), say(rnd.randint(1, 9))) for i in range(12)] + [("12", None), ("13", "!!"), (None, say(5)), ("3", say(4))]
    docs = [(i, say(rnd.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (61, items[0][1]), (None, items[1][1])]
    for n in (3, 5, 10):
        out = decontaminate.scan(wide(spark, docs), frame(spark, items, ITEMS), n)
        got = sorted(((r.doc_id, r.text, r.n_words, sorted(r.hit_words), list(r["items"])) for r in out.collect()), key=repr)
        want = []
        for d, t in docs:
            count, hit, found = brute.hits(t, items, n)
            want.append((d, t, count, sorted(hit), found))
        assert got == sorted(want, key=repr)


def test_a_benchmark_of_several_blocks_gives_the_same(spark, monkeypatch):
    items = [(str(i), f"alpha{i % 7} beta{i} gamma delta{i % 3}") for i in range(40)]
    docs = frame(spark, [(i, f"x alpha{i % 7} beta{i} gamma delta{i % 3} y gamma") for i in range(50)])
    one = decontaminate.report(decontaminate.scan(docs, frame(spark, items, ITEMS), 3))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    many = decontaminate.report(decontaminate.scan(docs, frame(spark, items, ITEMS), 3))
    assert sorted(one.collect()) == sorted(many.collect())


def test_spans_are_offsets_of_the_original_text(spark):
    text = "Größe é: The QUICK, brown-fox\njumps! end"
    out = decontaminate.scan(frame(spark, [(1, text)]), frame(spark, [("7", "the quick brown fox jumps")], ITEMS), 4).first()
    assert [text[s.start:s.end] for s in out.spans] == ["The QUICK, brown-fox\njumps"]


def test_clean_keeps_columns_and_drops_only_hits(spark):
    docs = wide(spark, [(1, "one two three four"), (2, "two one"), (3, None), (4, "x one two three")])
    out = decontaminate.clean(docs, frame(spark, [("1", "One two THREE")], ITEMS))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {2, 3}
    assert decontaminate.clean(docs, frame(spark, [], ITEMS)).count() == 4
    assert decontaminate.report(decontaminate.scan(wide(spark, []), frame(spark, [], ITEMS))).count() == 0


# licences

def test_base_phrases_against_brute_force(spark):
    rnd = random.Random(6)
    parts = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "General Public License", "x", "é"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(200)] + [(200, None), (201, "")]
    out = {r.doc_id: r for r in licences.scan(wide(spark, rows)).collect()}
    for i, t in rows:
        w = brute.words(t)
        at = sorted((k, label) for p, label in licences.BASE.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        r = out[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_need_their_key_phrases(spark):
    rows = [(1, "Intro. Licensed under the Apache License, Version 2.0. More."), (2, "Released under the MIT License."),
            (3, "Licensed under CC BY-NC 4.0."), (4, "licensed under the terms of no license version at all"), (5, "apache version license"),
            (6, "x " * 50_000 + "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License")]
    docs = frame(spark, rows + [(100 + i, "plain words of the text") for i in range(50)])
    out = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [out[i].labels for i in range(1, 7)] == ["apache-2.0", "mit", "cc-by,cc-by-nc", "", "", "gpl"]
    assert out[6].matches[0].first_word == 50_000 and out[100].score == 0
    assert licences.scan(wide(spark, [])).count() == 0


def aligned_by_brute_force(words, index):
    """Accepted (label, template, offset) -> share, trying every template at every offset."""
    out = {}
    for t, (label, template, keys) in enumerate(index.templates):
        for offset in range(1 - len(template), len(words)):
            inside = [w for q, w in enumerate(template) if 0 <= offset + q < len(words) and words[offset + q] == w]
            share = sum(index.weight[w] for w in inside) / index.total[t]
            stretch = b" " + b" ".join(words[max(0, offset):max(0, offset + len(template))]) + b" "
            if len(set(inside)) >= licences.AGREE and share >= licences.SHARE and all(b" " + b" ".join(k) + b" " in stretch for k in keys):
                out[label, t, offset] = share
    return out


def test_no_word_of_a_text_hides_a_licence(spark):
    prose = "any associated charge copy documentation files free granted hereby obtaining permission person software "
    apache = "Licensed under the Apache License, Version 2.0"
    rows = [(1, f"{licences.TEMPLATES[2][1]} x {apache}"), (2, prose + apache), (3, prose * 300 + "Licensed under CC BY-NC 4.0 y Released under the MIT License")]
    # the words of the MIT notice are the rarest of all
    docs = frame(spark, rows + [(100 + i, "apache license version 2 0 licensed cc by nc 4 mit released") for i in range(30)])
    out = {r.doc_id: r.labels for r in licences.scan(docs).collect()}
    assert [out[i] for i in (1, 2, 3)] == ["apache-2.0,mit", "apache-2.0", "cc-by,cc-by-nc,mit"]


def test_every_accepted_place_is_a_match(spark):
    apache = licences.TEMPLATES[0][1]
    rows = [(1, f"{apache} xx " * 10), (2, f"{licences.TEMPLATES[1][1]} y {licences.TEMPLATES[2][1]}")]
    out = {r.doc_id: r for r in licences.scan(frame(spark, rows + [(100 + i, "plain words") for i in range(50)])).collect()}
    assert [(m.label, m.template, m.first_word) for m in out[1].matches] == [("apache-2.0", 0, 9 * i) for i in range(10)]
    assert [(m.label, m.template, m.first_word) for m in out[2].matches] == [("mit", 1, 0), ("mit", 2, 6)]
    assert [(out[i].labels, out[i].score) for i in (1, 2)] == [("apache-2.0", 1.0), ("mit", 1.0)]


def test_licences_against_every_alignment():
    rnd = random.Random(11)
    index = licences.Index()
    index = licences.Index({w: rnd.randint(0, 500) for w in sorted(index.vocabulary)}, 1000)
    vocabulary = sorted(index.vocabulary)
    several = 0
    for _ in range(150):
        words = []
        for _ in range(rnd.randint(0, 6)):
            notice = [w if rnd.random() < 0.93 else rnd.choice(vocabulary) for w in rnd.choice(index.templates)[1]]
            words += notice[rnd.choice([0, 0, 1]):] + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 15))]
        want = {}
        for (label, _, _), share in aligned_by_brute_force(words, index).items():
            want[label] = max(share, want.get(label, 0))
        got = {}
        for label, share, *_ in licences.scan_words(words, index)["matches"]:
            got[label] = max(share, got.get(label, 0))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        several += len(want) > 2
    assert several > 10


# quality

def test_quality_on_held_out_rows(spark):
    rnd = random.Random(7)
    good = lambda: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(20, 200))) + "."
    junk = lambda: rnd.choice([lambda: "spam " * rnd.randint(30, 200), lambda: "BUY!! " * 50 + "".join(rnd.choice("#$%") for _ in range(90))])()
    rows = [(i, junk() if i % 4 == 0 else good()) for i in range(600)]
    docs, labels = frame(spark, rows), frame(spark, [(i, int(i % 4 != 0)) for i in range(600)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    import zlib
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    held = [i for i, _ in rows if out[i].held_out]
    assert sum(out[i].predicted == int(i % 4 != 0) for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    kept = quality.keep_good(wide(spark, rows), labels)
    assert kept.columns == wide(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i in out if out[i].predicted}
    # held-out labels change nothing
    other = frame(spark, [(i, int(i % 4 != 0) if not out[i].held_out else 0) for i in range(600)], "doc_id long, quality int")
    assert sorted((r.doc_id, round(r.score, 9)) for r in quality.judge(docs, other).collect()) == sorted((i, round(r.score, 9)) for i, r in out.items())


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (2, None), (None, 0)], 1.0), ([(1, 0), (3, 0)], 0.0)])
def test_quality_without_two_classes(spark, labels, score):
    docs = wide(spark, [(1, "a"), (2, None), (3, ""), (3, ""), (None, "b" * 200_000)])
    known = frame(spark, [x for x in labels], "doc_id long, quality int")
    out = quality.judge(docs, known).collect()
    learned = [q for d, q in labels if q is not None and d in (1, 2, 3) and not _held(d)]
    assert len(out) == 5 and all(r.score == (score if learned else 0.5) for r in out)
    assert quality.judge(wide(spark, []), known).count() == 0


def _held(i):
    import zlib
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_scores_equal_the_normal_densities(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    size = len(quality.STATISTICS)
    rows = {0: rng.normal(0, 1, (200, size)), 1: rng.normal(1, 2, (300, size))}
    model = quality.fit({c: (len(x), x.sum(0), x.T @ x) for c, x in rows.items()})
    x = rng.normal(0.5, 1, (20, size))
    logs = []
    for mean, factor, offset in zip(model.means, model.factors, model.offsets):
        cov = factor @ factor.T
        d = x - mean
        logs.append(offset + np.log(np.diag(factor)).sum() - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(1))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_items_digest(spark):
    out = decontaminate.report(decontaminate.scan(frame(spark, [(1, "a b c"), (2, "")]), frame(spark, [("10", "a b"), ("9", "b c")], ITEMS)))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and rows[1].n_items == 2
    assert rows[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not rows[2].contaminated
