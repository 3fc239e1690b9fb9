"""Lineage cuts that outlive a lost executor.

Only reliable checkpoints are used: the blocks go to the shared folder the
cluster names in ``spark.checkpoint.dir``.  A machine-local folder is chosen
only for a local master where nothing is configured, as in tests.
"""
from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not wanted:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        wanted = tempfile.mkdtemp(prefix="corpusflow-checkpoint-")
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


#: Shuffle files of a query go when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: A join accepts tables that are laid out by some of its keys, alike on both sides.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Plans that change while they run do not tell how their rows are laid out.
ADAPTIVE = "spark.sql.adaptive.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession):
    """Queries run inside leave no shuffle files behind; for writes, after which nothing reads those again."""
    return _setting(spark, CLEANUP, "true")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder; its shuffle files go at once."""
    checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        # a plan takes the setting when it is made
        return df.select("*").checkpoint(eager=True)


def laid_out(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out by the hash of ``by``.  Tables laid out alike, and unions of them, meet on keys that contain
    ``by`` without moving, as long as ``durable_in_place`` stores what is made of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


@contextmanager
def in_place(spark: SparkSession):
    """Plans made inside know how the tables they read are laid out, and leave them there."""
    with _setting(spark, ALL_KEYS, "false"), _setting(spark, ADAPTIVE, "false"):
        yield


def durable_in_place(df: DataFrame) -> DataFrame:
    """``durable`` for what is made of tables that are laid out."""
    with in_place(df.sparkSession):
        return durable(df)
