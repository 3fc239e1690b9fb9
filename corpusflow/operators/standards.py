"""Checklist coverage: findings meet checklist items through their CWE."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identity import strip
from ..plans import dimension
from ..tables import checklists, remedies

ITEM = ("std string, std_ord int, item_ord int, code string, name string, grp string, cwes array<string>")


def items(spark: SparkSession, *names: str) -> DataFrame:
    return dimension(spark, checklists.rows(*names), ITEM)


def normal_cwe(cwe: Column) -> Column:
    return F.upper(strip(F.coalesce(cwe, F.lit(""))))


def cwe_counts(findings: DataFrame, *keys: str) -> DataFrame:
    cwe = normal_cwe(F.col("cwe"))
    return (findings.select(*keys, cwe.alias("cwe")).filter(F.col("cwe") != "")
            .groupBy(*keys, "cwe").agg(F.count(F.lit(1)).alias("n")))


def rule_cwes(*rule_tables: DataFrame) -> DataFrame:
    """Every CWE some loaded rule can detect."""
    out = None
    for t in rule_tables:
        one = t.select(F.col("cwe")).filter(F.coalesce("cwe", F.lit("")) != "")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def first_item(checks: DataFrame) -> DataFrame:
    """CWE -> the first item that lists it in each checklist."""
    return (checks.withColumn("cwe", F.explode("cwes")).groupBy("std", "std_ord", "cwe")
            .agg(F.min_by(F.struct("code", "name", "grp"), "item_ord").alias("item")))


def standard_map(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds standard, group and weakness name: first checklist in order that knows the CWE, else the rule id.

    The map has one row per CWE, so the join neither multiplies rows nor depends on how
    often a CWE occurs.
    """
    best = (first_item(checks).groupBy("cwe").agg(F.min_by(F.struct("std", "item"), "std_ord").alias("b"))
            .select(F.col("cwe").alias("_cwe"), F.col("b.std").alias("standard"), F.col("b.item.grp").alias("grp"),
                    F.col("b.item.name").alias("weakness"), F.col("b.item.code").alias("item_code")))
    joined = findings.join(best, normal_cwe(F.col("cwe")) == F.col("_cwe"), "left").drop("_cwe")
    return (joined.withColumn("standard", F.coalesce("standard", F.lit("-")))
            .withColumn("grp", F.coalesce("grp", F.lit("-")))
            .withColumn("weakness", F.coalesce("weakness", F.col("rule_id"))))


def coverage(checks: DataFrame, counts: DataFrame, available: DataFrame) -> DataFrame:
    """Per item: findings, whether any rule can see it, verdict.  An unseen item is not a pass."""
    known = available.select("cwe").distinct().withColumn("_known", F.lit(True))
    per_cwe = checks.select("std", "item_ord", F.explode_outer("cwes").alias("cwe"))
    scored = (per_cwe.join(counts.select("cwe", "n"), "cwe", "left").join(known, "cwe", "left")
              .groupBy("std", "item_ord").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                                              F.coalesce(F.bool_or("_known"), F.lit(False)).alias("covered")))
    verdict = (F.when(F.col("n") > 0, F.lit("violated")).when(F.col("covered"), F.lit("pass"))
               .otherwise(F.lit("not_covered")))
    return (checks.join(scored, ["std", "item_ord"])
            .select("std", "item_ord", "code", "name", "grp", "n", "covered", verdict.alias("verdict")))


def unmapped(checks: DataFrame, counts: DataFrame) -> DataFrame:
    """CWE counts no item of the chosen checklists lists."""
    return counts.join(checks.select(F.explode("cwes").alias("cwe")).distinct(), "cwe", "left_anti")


def standard_summary(covered: DataFrame) -> DataFrame:
    return covered.groupBy("std").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("verdict") == "violated").alias("violated"),
        F.count_if(F.col("verdict") == "pass").alias("passed"),
        F.count_if(F.col("verdict") == "not_covered").alias("not_assessed"))


def standard_groups(checks: DataFrame) -> DataFrame:
    return checks.groupBy("std", "grp").agg(F.count(F.lit(1)).alias("n"))


def remediation_key(rule_id: Column) -> Column:
    """Explicit table, vendor prefix, first key inside the id, then prefix fallbacks."""
    explicit = F.create_map(*[F.lit(x) for kv in remedies.EXPLICIT.items() for x in kv])
    out = F.when(F.contains(rule_id, F.lit("sql")), F.lit("sqli")).otherwise(F.lit(""))
    out = F.when(F.startswith(rule_id, F.lit("pii")), F.lit("pii")).otherwise(out)
    out = F.when(F.contains(rule_id, F.lit("secret")), F.lit("secret")).otherwise(out)
    for key in reversed(remedies.KEYS):
        out = F.when(F.contains(rule_id, F.lit(key)), F.lit(key)).otherwise(out)
    out = F.when(F.startswith(rule_id, F.lit("vendor.")), F.lit("secret")).otherwise(out)
    return F.coalesce(F.element_at(explicit, rule_id), out)
