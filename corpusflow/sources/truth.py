"""Labelled corpora: truth from a CSV, from paths, or from case manifests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identity import file_stem

TRUTH = "name string, category string, is_real boolean"


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """name,category,true|false,...; lines starting with # are skipped."""
    raw = spark.read.schema("name string, category string, flag string, rest string").option("comment", "#").csv(path)
    return raw.select(F.trim("name").alias("name"), F.trim("category").alias("category"),
                      (F.lower(F.trim("flag")) == "true").alias("is_real"))


def from_paths(files: DataFrame) -> DataFrame:
    """The path is the answer: a CWE_* folder and a safe / unsafe folder."""
    parts = F.split("file", "/")
    cwe = F.filter(parts, lambda p: F.startswith(p, F.lit("CWE_")))
    labelled = files.filter(F.col("file").rlike(r"\.php$") & (F.size(cwe) > 0)
                            & F.arrays_overlap(parts, F.array(F.lit("safe"), F.lit("unsafe"))))
    return labelled.select(file_stem(F.col("file")).alias("name"), F.element_at(cwe, 1).alias("category"),
                           F.array_contains(parts, "unsafe").alias("is_real"))


def from_manifests(spark: SparkSession, root: str) -> DataFrame:
    """``<case>/manifest.sarif`` tells the state, ``<case>/src/*.cs`` the names and categories."""
    manifests = (spark.read.option("multiLine", True).schema("runs array<struct<properties:struct<state:string>>>")
                 .option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.sarif").json(root)
                 .select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/manifest\.sarif$", 1).alias("case_dir"),
                         (F.element_at("runs", 1)["properties"]["state"] == "bad").alias("is_real")))
    sources = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
               .option("pathGlobFilter", "*.cs").load(root)
               .select(F.regexp_extract("path", r"([^/]+)/src/[^/]+\.cs$", 1).alias("case_dir"),
                       file_stem(F.col("path")).alias("name")))
    return sources.join(manifests, "case_dir").select(
        "name", F.substring_index("name", "__", 1).alias("category"), F.coalesce("is_real", F.lit(False)).alias("is_real"))


def camel_key(stem: Column) -> Column:
    """``benchmark_test_00178`` -> ``BenchmarkTest00178``; the last part keeps its case."""
    parts = F.split(stem, "_")
    head = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1),
                       lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))))
    return F.concat(F.array_join(head, ""), F.element_at(parts, -1))
