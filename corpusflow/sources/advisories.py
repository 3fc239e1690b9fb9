"""Advisory dumps: one folder of JSON documents per ecosystem."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import ADVISORY


def read_advisories(spark: SparkSession, root: str) -> DataFrame:
    """``root/<ecosystem>/**/*.json``; a broken document is skipped, the rest are kept."""
    schema = T.StructType([*ADVISORY.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("recursiveFileLookup", True).json(root)
           .withColumn("_path", F.col("_metadata.file_path")))
    base = root.rstrip("/").rsplit("/", 1)[-1]
    eco = F.url_decode(F.regexp_extract("_path", rf"/{base}/([^/]+)/", 1))
    return raw.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).withColumn(
        "ecosystem", eco).drop("_corrupt_record", "_path")
