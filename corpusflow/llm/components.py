"""Connected components of a graph too large for one machine.

Alternating star steps: every node hands its larger neighbours to the smallest neighbour it knows
(large star), then its smaller neighbours (small star), until nothing changes.  Each step is a
map-side combined minimum and an equi-join; edges only ever decrease to stars.  Minima are grouped by a
struct of the node, so both sides of the join come out of shuffles of its own and AQE splits the partition
of a hub.  Rounds grow with the logarithm of the longest path.  Every round is written to the shared folder
in place of the one before, so a lost executor costs one round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """``u, m``: the smaller of a node and its neighbours; hubs are combined before the shuffle."""
    return (edges.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m"))
            .select(F.col("k.u").alias("u"), F.least("k.u", "m").alias("m")))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), "u")
    return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    joined = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``edges`` (u, v of any one ordered type) -> ``node, root``, kept as ``name``: every node of an edge with the
    smallest of its component."""
    work = f"{name}-edges"
    edges = scratch.keep(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), work)
    mark = _mark(edges)
    while mark[0]:
        edges = scratch.keep(_small(_large(edges)).filter(F.col("u") != F.col("v")).distinct(), work)
        mark, before = _mark(edges), mark
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    out = scratch.keep(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), name)
    scratch.drop(work)
    return out
