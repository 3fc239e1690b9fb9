"""Accuracy against labelled corpora."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import file_stem

# ---- fixed values: categories of third-party rules, graded test modules ------------------
CATEGORY_KEYWORDS = (
    ("sqli", ("sqli", "sql-injection", "sql_injection", "tainted-sql")),
    ("cmdi", ("command-injection", "cmdi", "process-builder", "runtime-exec", "tainted-cmd")),
    ("xss", ("xss", "cross-site-scripting", "no-direct-response-writer")),
    ("pathtraver", ("path-traversal", "pathtraver", "path_traversal", "file-traversal")),
    ("ldapi", ("ldap-injection", "ldapi", "ldap_injection", "tainted-ldap")),
    ("xpathi", ("xpath-injection", "xpathi", "xpath_injection", "tainted-xpath")),
)
LEVELS = ("low", "medium", "high", "impossible")
# ---- end of fixed values -----------------------------------------------------------------


def attribute_hits(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """A finding counts for every test file its trace touches: rules, findings, uncertain findings."""
    touched = (findings.select("scan_id", "idx", "rule_id", "uncertain", F.explode("steps").alias("s"))
               .withColumn("name", file_stem(F.col("s.file")))
               .select("scan_id", "idx", "rule_id", "uncertain", "name").distinct()
               .join(truth.select("name").distinct(), "name", "left_semi"))
    return touched.groupBy("name", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("uncertain", F.lit(False))).alias("n_uncertain"))


def confusion(truth: DataFrame, hits: DataFrame, category_rule: DataFrame) -> DataFrame:
    """TP / FN / FP / TN / total per category; a category without a rule only counts its total.

    ``truth(name, category, is_real)``, ``hits(name, rule_id)``, ``category_rule(category, rule_id)``.
    """
    want = truth.join(category_rule.select("category", F.col("rule_id").alias("want")), "category", "left")
    got = hits.select("name", F.col("rule_id").alias("want"), F.lit(True).alias("_hit")).distinct()
    rows = want.join(got, ["name", "want"], "left")
    hit, scored = F.col("_hit").isNotNull(), F.col("want").isNotNull()
    return rows.groupBy("category").agg(
        F.bool_or(scored).alias("scored"),
        F.count_if(scored & F.col("is_real") & hit).alias("tp"), F.count_if(scored & F.col("is_real") & ~hit).alias("fn"),
        F.count_if(scored & ~F.col("is_real") & hit).alias("fp"), F.count_if(scored & ~F.col("is_real") & ~hit).alias("tn"),
        F.count(F.lit(1)).alias("total"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def metrics(c: DataFrame) -> DataFrame:
    """Recall, precision, F1, false-positive rate and score; 0 where a denominator is empty."""
    out = (c.withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
           .withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
           .withColumn("fpr", _ratio(F.col("fp"), F.col("fp") + F.col("tn"))))
    out = out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("score", F.col("recall") - F.col("fpr"))


def metrics_overall(c: DataFrame) -> DataFrame:
    """Scored categories and their total in one roll-up."""
    total = (c.filter("scored").rollup("category").agg(*[F.sum(x).cast("long").alias(x) for x in ("tp", "fn", "fp", "tn", "total")])
             .withColumn("category", F.coalesce("category", F.lit("(overall)"))))
    return metrics(total)


def excluded_categories(c: DataFrame, known_gaps: DataFrame) -> DataFrame:
    """Categories left out of the score: known gaps apart from what is out of scope."""
    gap = known_gaps.select("category", F.lit(True).alias("_gap"))
    return c.filter(~F.col("scored")).join(gap, "category", "left").select(
        "category", "total", F.when(F.col("_gap").isNotNull(), F.lit("no_rule")).otherwise(F.lit("out_of_scope")).alias("reason"))


def uncertain_ratio(findings: DataFrame, *keys: str) -> DataFrame:
    n, u = F.count(F.lit(1)), F.count_if(F.coalesce("uncertain", F.lit(False)))
    return findings.groupBy(*keys).agg(n.alias("findings"), u.alias("uncertain"), (u / n).alias("ratio"))


def category_of(rule_id: Column) -> Column:
    """Category of a third-party rule id by the first keyword inside it; NULL when none fits."""
    low, out = F.lower(rule_id), F.lit(None).cast("string")
    for name, words in reversed(CATEGORY_KEYWORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def unmapped_rules(results: DataFrame) -> DataFrame:
    return results.filter(category_of(F.col("rule_id")).isNull()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def level_matrix(cases: DataFrame, hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Module x level: was the expected rule found?  NULL where the level has no case.

    ``cases(module, level, measurable)``, ``hits(module, level, rule_id)``, ``expected(module, rule_id)``.
    """
    got = hits.join(expected, ["module", "rule_id"], "left_semi").select("module", "level", F.lit(1).alias("_hit")).distinct()
    rows = cases.join(expected.select("module", F.lit(True).alias("covered")).distinct(), "module", "left").join(
        got, ["module", "level"], "left")
    flag = F.max(F.coalesce("_hit", F.lit(0)))
    return rows.groupBy("module", F.coalesce("covered", F.lit(False)).alias("covered")).agg(
        F.bool_or("measurable").alias("measurable"),
        *[F.max(F.when(F.col("level") == l, F.coalesce("_hit", F.lit(0)))).alias(l) for l in LEVELS])


def level_metrics(matrix: DataFrame) -> DataFrame:
    """Recall from the vulnerable level, false positives from the safe one, measurable modules only."""
    rows = matrix.filter(F.col("covered") & F.col("measurable"))
    hit = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    return metrics(rows.agg(F.count_if(hit("low")).alias("tp"), F.count_if(~hit("low")).alias("fn"),
                            F.count_if(hit("impossible")).alias("fp"), F.count_if(~hit("impossible")).alias("tn"),
                            F.count(F.lit(1)).alias("total")))


def result_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either run that the other lacks, counting repeats; empty when the runs are identical."""
    cols = ["rule_id", "file", "line"]
    n = a.groupBy(*cols).agg(F.count(F.lit(1)).alias("a")).join(
        b.groupBy(*cols).agg(F.count(F.lit(1)).alias("b")), cols, "full_outer").fillna(0, ["a", "b"])
    return n.filter(F.col("a") != F.col("b"))
