"""Small tables whose size is known before planning."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A dimension is broadcast only below this row count; above it the join is left to AQE.
BROADCAST_ROWS = 20_000


def dimension(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    """DataFrame over driver-side rows, hinted for broadcast when it is provably small."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df
