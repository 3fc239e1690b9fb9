"""Hard negatives by slots: other-label rows that score almost as high as an anchor's positives.

Anchors are a stated query set.  Rows are cut into blocks, anchors into chunks; each chunk is sent once to each
block, and a block is multiplied with the chunks as they stream by.  Scores never leave the task, only the best few
of each anchor do.

A first pass finds the positives.  Their scores are the upper limits of the windows; sorted, they split the score
axis into disjoint slots, (next limit, limit], the last one down to the lowest window's end.  A second pass keeps the
best ``k`` rows of each (anchor, slot): in the task, then again over all blocks.  A window is its own slot and those
below it, cut at its lower end, and the rows above that end come first.  So the first ``k`` of the merged lower slots
answer every window, however the windows overlap.

Bounds: a task holds one block (``ROWS`` rows at most), one chunk and ``k`` rows per slot of that chunk.  Anchors are
copied once per block; blocks are a fixed number for small tables and grow with the rows beyond that.

Defined results
  Rows with a NULL id, a NULL label, a NULL vector or a NULL or non-finite component take no part.
  Of rows with one id the one of smallest label, then smallest vector, takes part.
  Vectors of different lengths have no score with each other.  Empty vectors score 0 with each other.
  Ties of scores go to the smaller id.  A positive whose score is negative has an empty window.
  Scores are exact integers; beyond 64 bits the reported score is the nearest one that fits.
  An empty table, or one without anchors, gives no rows.  Extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import Scratch, stored

#: Rows of a block at most, and the least number of blocks.
ROWS, BLOCKS = 1 << 16, 24
#: Anchors that meet a block together, and rows of the block that they meet at once (fewer at first, to learn thresholds).
CHUNK, STEP = 256, 16_384
LONG = np.iinfo(np.int64)

PACKED = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("ids", T.BinaryType()),
                       T.StructField("labels", T.BinaryType()), T.StructField("q", T.BinaryType()), T.StructField("limits", T.BinaryType())])
FOUND = T.StructType([T.StructField("anchor_id", T.LongType()), T.StructField("slot", T.IntegerType()),
                      T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
FOUND_ARROW = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def prepared(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, label, q, dim``: rows that take part, one per id, components scaled and floored."""
    vec = F.col(vec_col)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(vec, lambda x: F.floor(x.cast("double") * scale)).alias("q"))
            .groupBy("id").agg(F.min(F.struct("label", "q")).alias("r"))
            .select("id", "r.label", "r.q", F.size("r.q").alias("dim")))


def _pack(group: pa.Table) -> pa.Table:
    """Rows of one (dim, block) as arrays, by ascending id."""
    group = group.sort_by("id")
    dim = group.column("dim")[0].as_py()
    flat = group.column("q").combine_chunks()
    q = (flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy(zero_copy_only=False).astype(np.int64)
    limits = b""
    if "limits" in group.column_names:
        # at most five values, missing ones far below every score
        lists = group.column("limits").to_pylist()
        table = np.full((len(lists), max(map(len, lists))), LONG.min, np.int64)
        for i, x in enumerate(lists):
            table[i, :len(x)] = x
        limits = table.tobytes()
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([group.column("block")[0].as_py()], pa.int64()),
                     "ids": pa.array([group.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     "labels": pa.array([group.column("label").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     "q": pa.array([q.tobytes()], pa.binary()), "limits": pa.array([limits], pa.binary())})


def _packed(rows: DataFrame, block) -> DataFrame:
    return rows.withColumn("block", block).groupBy("dim", "block").applyInArrow(_pack, PACKED)


class Block:
    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.q = np.frombuffer(row["q"], np.int64).reshape(len(self.ids), row["dim"])
        self.limits = np.frombuffer(row["limits"], np.int64).reshape(len(self.ids), -1) if row["limits"] else None
        self.most = int(max(self.q.max(initial=0), -int(self.q.min(initial=0))))


def scores(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Inner products as exact integers, by the fastest arithmetic that holds ``bound`` exactly."""
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LONG.min + 1, LONG.max).astype(np.int64)


def _steps(n: int):
    start, size = 0, 512
    while start < n:
        yield start, min(n, start + size)
        start, size = start + size, min(STEP, size * 8)


def best(anchors: Block, rows: Block, k: int, same: bool, floor_num: int = 0, floor_den: int = 1) -> tuple[np.ndarray, ...]:
    """The best ``k`` rows of each (anchor, slot): anchor's index, slot, id, score.

    ``same``: one slot, rows of the anchor's label but not the anchor.  Else rows of other labels, slots by the
    anchors' limits, down to ``floor_num / floor_den`` of the lowest limit that is not negative.
    """
    if same:
        slots = 1
    else:
        slots = anchors.limits.shape[1]
        lowest = np.where(anchors.limits >= 0, anchors.limits, LONG.max).min(axis=1)
        # integers from this one on are in some window
        least = np.array([-(-floor_num * int(x) // floor_den) for x in lowest], np.int64)
    held = [np.empty(0, np.int64)] * 4
    least_held = np.full((len(anchors.ids), slots), LONG.min, np.int64)
    bound = max(1, anchors.most) * max(1, rows.most) * max(1, rows.q.shape[1])
    for start, stop in _steps(len(rows.ids)):
        found = scores(anchors.q, rows.q[start:stop], bound)
        alike = anchors.labels[:, None] == rows.labels[None, start:stop]
        if same:
            i, j = np.nonzero(alike & (found > least_held) & (anchors.ids[:, None] != rows.ids[None, start:stop]))
            value, slot = found[i, j], np.zeros(len(i), np.int64)
        else:
            i, j = np.nonzero(~alike & (found <= anchors.limits[:, :1]) & (found >= least[:, None]))
            value = found[i, j]
            slot = (anchors.limits[i] >= value[:, None]).sum(axis=1) - 1
            # rows come by ascending id, so a later row needs a higher score
            better = value > least_held[i, slot]
            i, j, value, slot = i[better], j[better], value[better], slot[better]
        if not len(i):
            continue
        who, where, ids, value = (np.concatenate((h, x)) for h, x in zip(held, (i, slot, rows.ids[start:stop][j], value)))
        order = np.lexsort((ids, -value, where, who))
        who, where, ids, value = who[order], where[order], ids[order], value[order]
        key = who * slots + where
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate((first, [len(key)]))))
        keep = place < k
        held = [who[keep], where[keep], ids[keep], value[keep]]
        last = place == k - 1
        least_held[who[last], where[last]] = value[last]
    return tuple(held)


def _meet(batches, k: int, same: bool, num: int, den: int):
    """Blocks and, after each, the chunks of anchors that meet it."""
    block = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["tag"] == 0:
                block = Block(row)
                continue
            anchors = Block(row)
            who, slot, ids, value = best(anchors, block, k, same, num, den)
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[who]), pa.array(slot.astype(np.int32)), pa.array(ids), pa.array(value)],
                                                 schema=FOUND_ARROW)


def _over_all(blocks: DataFrame, anchors: DataFrame, k: int, same: bool, num: int = 0, den: int = 1) -> DataFrame:
    """``anchor_id, slot, id, score, place``: the best ``k`` of each (anchor, slot) over all blocks."""
    here = blocks.select(F.lit(0).alias("tag"), "*")
    # chunks go to the blocks there are
    sent = (anchors.drop("block").join(blocks.select("dim", "block"), "dim")
            .select(F.lit(1).alias("tag"), *[F.col(c) for c in PACKED.names]))
    met = (here.unionByName(sent).repartition("dim", "block").sortWithinPartitions("dim", "block", "tag")
           .mapInArrow(lambda b: _meet(b, k, same, num, den), FOUND))
    place = F.row_number().over(W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id"))
    return met.withColumn("place", place).filter(F.col("place") <= k)


def mine(rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, den: int = 100,
         scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Negatives of a positive of score p have scores from ``low / den`` of p to p; the first ``negatives`` by
    descending score, then ascending id.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    ready = scratch.keep(prepared(rows, id_col, label_col, vec_col, scale), "rows")
    n = ready.count()
    asking = ready.filter(F.col("id") % anchor_every == 0)
    chunks = max(1, -(-asking.count() // CHUNK))
    blocks = scratch.keep(_packed(ready, F.pmod(F.xxhash64("id"), F.lit(max(BLOCKS, -(-n // ROWS))))), "blocks")
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks))
    anchors = scratch.keep(_packed(asking, chunk), "anchors")
    near = scratch.keep(_over_all(blocks, anchors, positives, True).select("anchor_id", "id", "score"), "positives")
    # the distinct scores of an anchor's positives, highest first, are the limits of its slots
    limits = near.groupBy("anchor_id").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits")).filter(F.col("limits")[0] >= 0)
    limited = scratch.keep(_packed(asking.join(limits, asking["id"] == limits["anchor_id"]).drop("anchor_id"), chunk), "limited")
    slots = _over_all(blocks, limited, negatives, False, low, den)
    merged = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id", "slot"))).alias("all"))
    own = near.join(limits, "anchor_id").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                                                 (F.array_position("limits", F.col("score")) - 1).alias("own"))
    first = F.slice(F.filter("all", lambda e: e["slot"] >= F.col("own")), 1, negatives)
    high = F.filter(first, lambda e: (F.col("positive_score") * low).cast("decimal(38,0)") <= (-e["down"]).cast("decimal(38,0)") * den)
    out = (own.join(merged, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(high).alias("at", "e"))
           .select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("negative_id"),
                   "positive_score", (-F.col("e.down")).alias("negative_score")))
    result = stored(out, "hard-negatives-found")
    scratch.close()
    return result


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose id is divisible by ``every`` get the next label; a row without an id keeps its own."""
    shifted = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.withColumn("label", shifted.cast(rows.schema["label"].dataType))
