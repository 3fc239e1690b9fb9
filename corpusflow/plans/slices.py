"""Ordered computations that never put one key in one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so a
key that holds a third of the table is one straggler.  Here the rows are first
range-partitioned on (key, order), which splits a hot key over as many tasks as
its size asks for.  Each slice is then handled on its own and only one summary
row per (key, slice) travels between slices.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .durable import durable

SLICE = "_slice"


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    # spark_partition_id() is only stable once the range-partitioned rows are stored.
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    return durable(ranged.withColumn(SLICE, F.spark_partition_id()))


def _inside(keys, order) -> W:
    return W.partitionBy(*keys, SLICE).orderBy(*order)


def _between(keys) -> W:
    # one row per (key, slice): bounded by the number of partitions
    return W.partitionBy(*keys).orderBy(SLICE) if keys else W.orderBy(SLICE)


def _same(left: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, SLICE]]


def _attach(df: DataFrame, summary: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return (df.alias("l").join(summary.alias("r"), _same(df, keys), "left")
              .select("l.*", *[F.col(f"r.{c}") for c in cols]))


def number_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based position of each row inside its key (whole table when ``keys`` is empty)."""
    rows = _sliced(df, keys, order)
    offset = (rows.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
                  .withColumn("_before", F.coalesce(
                      F.sum("_n").over(_between(keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    return (_attach(rows, offset, keys, ["_before"])
            .withColumn(name, F.row_number().over(_inside(keys, order)) + F.col("_before"))
            .drop(SLICE, "_before"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Inclusive running total of ``value`` inside each key."""
    rows = _sliced(df, keys, order)
    offset = (rows.groupBy(*keys, SLICE).agg(F.sum(value).alias("_n"))
                  .withColumn("_before", F.coalesce(
                      F.sum("_n").over(_between(keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    inside = F.sum(value).over(_inside(keys, order).rowsBetween(W.unboundedPreceding, 0))
    return (_attach(rows, offset, keys, ["_before"])
            .withColumn(name, inside + F.col("_before")).drop(SLICE, "_before"))


def lag_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
               prefix: str = "prev_") -> DataFrame:
    """Columns of the row just before this one inside its key (NULL for the first)."""
    rows = _sliced(df, keys, order)
    pack = F.struct(*[F.col(c) for c in cols])
    last = (rows.groupBy(*keys, SLICE)
                .agg(F.max_by(pack, F.struct(*[F.col(c) for c in order])).alias("_last"))
                .withColumn("_carry", F.lag("_last").over(_between(keys))))
    out = (_attach(rows, last, keys, ["_carry"])
           .withColumn("_prev", F.coalesce(F.lag(pack).over(_inside(keys, order)), F.col("_carry"))))
    for c in cols:
        out = out.withColumn(prefix + c, F.col(f"_prev.{c}"))
    return out.drop(SLICE, "_carry", "_prev")


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Last non-NULL ``value`` at or before each row inside its key (as-of, nearest preceding)."""
    rows = _sliced(df, keys, order)
    last = (rows.filter(F.col(value).isNotNull()).groupBy(*keys, SLICE)
                .agg(F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias("_last")))
    # every (key, slice) pair needs a carry, also those without a value of their own
    pairs = _attach(rows.select(*keys, SLICE).distinct(), last, keys, ["_last"])
    carry = pairs.withColumn("_carry", F.last("_last", ignorenulls=True).over(
        _between(keys).rowsBetween(W.unboundedPreceding, -1)))
    inside = F.last(value, ignorenulls=True).over(
        _inside(keys, order).rowsBetween(W.unboundedPreceding, 0))
    return (_attach(rows, carry, keys, ["_carry"])
            .withColumn(name, F.coalesce(inside, F.col("_carry"))).drop(SLICE, "_carry"))
