"""Schemas of the hub tables."""
from __future__ import annotations

from pyspark.sql import types as T

STEP = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("code", T.StringType()),
    T.StructField("uncertain", T.BooleanType()),
])

FINDING = T.StructType([
    T.StructField("scan_id", T.LongType()),
    T.StructField("idx", T.LongType()),
    T.StructField("project", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("owasp", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("steps", T.ArrayType(STEP)),
    T.StructField("verdict", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("triage_reason", T.StringType()),
    T.StructField("triage_provider", T.StringType()),
    T.StructField("precision", T.StringType()),
    T.StructField("fp_hint", T.BooleanType()),
    T.StructField("matched_value", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("uncertain", T.BooleanType()),
    T.StructField("fp", T.StringType()),
])

PATTERN_RULE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("owasp", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("pattern", T.StringType()),
    T.StructField("excludes", T.ArrayType(T.StringType())),
    T.StructField("skip_comments", T.BooleanType()),
    T.StructField("validator", T.StringType()),
    T.StructField("mask", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("all_files", T.BooleanType()),
    T.StructField("grp", T.IntegerType()),
    T.StructField("file_exts", T.ArrayType(T.StringType())),
])

EVENT = T.StructType([
    T.StructField("introduced", T.StringType()),
    T.StructField("fixed", T.StringType()),
    T.StructField("last_affected", T.StringType()),
])
RANGE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("events", T.ArrayType(EVENT)),
])
ADVISORY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("severity", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("score", T.StringType())]))),
    T.StructField("database_specific", T.StructType([T.StructField("severity", T.StringType())])),
    T.StructField("affected", T.ArrayType(T.StructType([
        T.StructField("package", T.StructType([
            T.StructField("ecosystem", T.StringType()), T.StructField("name", T.StringType())])),
        T.StructField("versions", T.ArrayType(T.StringType())),
        T.StructField("ranges", T.ArrayType(RANGE)),
    ]))),
])

COMPONENT = T.StructType([
    T.StructField("ecosystem", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("license", T.StringType()),
])
