"""Hard negatives against plain loops, with ties, hot vectors and rows that take no part."""
import math
import random

import numpy as np
from pyspark.sql import types as T

from corpusflow.llm import hard_negatives as hn

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("rank", T.StringType())])


def plain(rows, every=100, k=5):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        seen[i] = min(seen.get(i, row), row)
    out = []
    for a, (la, qa) in seen.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, label) for i, (label, q) in seen.items() if i != a and len(q) == len(qa))
        for s, p, _ in [x for x in scored if x[2] == la][:k]:
            window = [(-t, n) for t, n, label in scored if label != la and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, r + 1, n, -s, t) for r, (t, n) in enumerate(window[:k])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    out = hn.mine(hn.relabelled(df), **kw)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect())


def vectors(seed, n, kinds):
    rng = random.Random(seed)
    pool = [[rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)] for _ in range(kinds)]
    return [(i, rng.choice(pool), rng.choice([1, 1, 1, 2, 3])) for i in range(n)]


def test_many_ties_equal_plain_loops(spark):
    rows = vectors(1, 700, 25)
    assert mined(spark, rows) == plain(rows) != []


def test_one_hot_vector_and_label(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCKS", 3)
    rows = [(i, [0.5, 0.25], 1 if i % 3 else 2) for i in range(400)] + [(i, [0.5, 0.2], i % 10) for i in range(400, 520)]
    assert mined(spark, rows) == plain(rows) != []


def test_rows_that_take_no_part_and_repeated_ids(spark):
    rows = vectors(2, 120, 12) + [(None, [0.5] * 6, 1), (200, None, 1), (300, [0.5] * 6, None), (400, [0.5, None, 0.0, 0.0, 0.0, 0.0], 1),
                                  (500, [float("nan")] * 6, 1), (600, [float("inf")] * 6, 2), (700, [], 1), (800, [], 2), (900, [0.5], 3),
                                  (-100, [0.5] * 6, 1), (-3, [0.5] * 6, 2), (100, [0.25] * 6, 1), (100, [0.25] * 6, 0)]
    assert mined(spark, rows) == plain(rows)


def test_slots_hold_every_overlapping_window():
    anchors = hn.Block({"ids": np.array([0]).tobytes(), "labels": np.array([1]).tobytes(), "q": np.array([1]).tobytes(), "dim": 1,
                        "limits": np.array([100, 90, 50]).tobytes()})
    values = np.array([101, 100, 100, 95, 91, 90, 90, 60, 50, 41, 40, 39, 5])
    rows = hn.Block({"ids": np.arange(1, 14).tobytes(), "labels": np.zeros(13, int).tobytes(), "q": values.tobytes(), "dim": 1, "limits": b""})
    _, slot, ids, score = hn.best(anchors, rows, 2, False, 80, 100)
    assert list(zip(slot.tolist(), score.tolist(), ids.tolist())) == [(0, 100, 2), (0, 100, 3), (1, 90, 6), (1, 90, 7), (2, 50, 9), (2, 41, 10)]


def test_scores_are_exact_in_every_width():
    for big in (7, 5_000_000, 1 << 29, 1 << 40):
        a, b = np.array([[big, -1], [big - 1, 3]]), np.array([[big, 1], [1, -big]])
        exact = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
        limit = (1 << 63) - 1
        assert hn.scores(a, b, 2 * big * big).tolist() == [[max(-limit, min(limit, x)) for x in r] for r in exact]


def test_empty_tables_and_no_anchor(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []
