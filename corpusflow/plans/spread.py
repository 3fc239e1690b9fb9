"""Use all cores on an input that is too small to arrive in enough pieces."""
from __future__ import annotations

from pyspark.sql import DataFrame

#: Above this estimate the input already comes as several row groups and is not moved for the sake of cores.
SMALL_BYTES = 256 * 1024 ** 2


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate; a session that does not tell counts as large."""
    plan = getattr(df, "_jdf", None)
    return SMALL_BYTES if plan is None else int(plan.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """Repartition a small input over the cores; a large one keeps its file splits, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and estimated_bytes(df) < SMALL_BYTES else df
