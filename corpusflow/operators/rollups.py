"""Counts, rankings, portfolio and consolidated tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.identity import SEVERITIES, severity_rank
from ..plans import durable, lag_in_key
from .lifecycle import CLOSED, is_open

#: List lengths of the review summary, page and trend sizes.
TOP_RULES, TOP_FILES, TOP_CWES = 15, 15, 12
PAGE = 50
TREND = 12
TOP_SHOWN = 8

#: Language labels and reasons of the consolidated tables.
LANGUAGE_NAME = {
    "javascript": "JavaScript", "typescript": "TypeScript", "php": "PHP", "python": "Python", "java": "Java",
    "kotlin": "Kotlin", "go": "Go", "ruby": "Ruby", "cpp": "C++", "c": "C", "swift": "Swift", "csharp": "C#"}
REASON = {"false_positive": "False positive", "deferred": "Excluded", "fixed": "Fixed"}


def severity_columns(where: Column | None = None, prefix: str = "sev_") -> list[Column]:
    cond = F.lit(True) if where is None else where
    return [F.count_if(cond & (F.col("severity") == s)).alias(prefix + s) for s in SEVERITIES]


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Fixed zero-filled columns per severity."""
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *severity_columns())


def counts_by(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def scan_summary(findings: DataFrame) -> DataFrame:
    """All lists of the review header from one grouping-sets pass, ranked per list.

    The rank limit of each list is pushed below the shuffle, so a scan with most of the
    findings sends only its leading rows.
    """
    axes = ["severity", "rule_id", "file", "category", "cwe", "verdict"]
    rows = findings.select("scan_id", *[F.coalesce(F.col(a), F.lit("")).alias(a) for a in axes])
    sets = rows.groupingSets([["scan_id"], *[["scan_id", a] for a in axes]], "scan_id", *axes).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(a).alias("_g_" + a) for a in axes])
    axis, value = F.lit("total"), F.lit("")
    for a in axes:
        axis = F.when(F.col("_g_" + a) == 0, F.lit(a)).otherwise(axis)
        value = F.when(F.col("_g_" + a) == 0, F.col(a)).otherwise(value)
    long = sets.select("scan_id", axis.alias("axis"), value.alias("value"), "n").filter(
        ~(F.col("axis").isin("category", "cwe", "verdict") & (F.col("value") == "")))
    w = W.partitionBy("scan_id", "axis").orderBy(F.col("n").desc(), "value")
    ranked = long.filter(F.col("axis").isin("rule_id", "file", "cwe")).withColumn("pos", F.row_number().over(w))
    ranked = ranked.filter(F.col("pos") <= max(TOP_RULES, TOP_FILES, TOP_CWES))
    ranked = ranked.filter((F.col("axis") != "cwe") | (F.col("pos") <= TOP_CWES)).drop("pos")
    return ranked.unionByName(long.filter(~F.col("axis").isin("rule_id", "file", "cwe")))


def integrity(files: DataFrame) -> DataFrame:
    """Can "no findings" be trusted?  ``files(project, lang, is_source, is_text, too_large, failed, partial, lines)``."""
    ok = F.col("is_source") & ~F.col("too_large") & ~F.col("failed")
    return files.groupBy("project").agg(
        F.count_if(ok).alias("scanned"), F.count_if(F.col("is_text")).alias("text_scanned"),
        F.sum(F.when(ok, F.col("lines")).otherwise(0)).cast("long").alias("code_lines"),
        F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("lang")))), ",").alias("languages"),
        F.count_if(F.col("too_large")).alias("skipped"), F.count_if(F.col("failed")).alias("failed"),
        F.count_if(F.col("partial")).alias("partial"),
        F.count_if(ok | F.col("too_large") | F.col("failed")).alias("total"),
        F.bool_and(~F.col("too_large") & ~F.col("failed") & ~F.col("partial")).alias("complete"))


def language_stats(files: DataFrame, findings: DataFrame, *keys: str) -> DataFrame:
    """Files, lines, issues and issues per 1 000 lines by language."""
    f = files.filter(F.col("lang").isNotNull()).groupBy(*keys, "lang").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").cast("long").alias("lines"))
    i = findings.filter(F.col("lang").isNotNull()).groupBy(*keys, "lang").agg(F.count(F.lit(1)).alias("issues"))
    out = f.join(i, [*keys, "lang"], "full_outer").fillna(0, ["files", "lines", "issues"])
    return out.withColumn("density", F.when(F.col("lines") > 0, F.bround(
        F.col("issues") / (F.col("lines") / 1000), 2)).otherwise(F.lit(0.0)))


def latest_per_project(scans: DataFrame) -> DataFrame:
    """Newest scan of each project (of each name where no project is set)."""
    key = F.when(F.coalesce("project", F.lit("")) != "", F.col("project")).otherwise(F.col("name"))
    row = F.struct(*scans.columns)
    return (scans.withColumn("_key", key).groupBy("_key")
            .agg(F.max_by(row, F.struct("created_at", "scan_id")).alias("s")).select("s.*"))


_SORTS = {"recent": ("created_at", True), "oldest": ("created_at", False), "name": ("project", False),
          "findings": ("total", True), "critical": ("sev_critical", True), "high": ("sev_high", True),
          "new": ("new_count", True)}


def portfolio(latest: DataFrame, query: str = "", severity: str = "", sort: str = "critical", page: int = 1,
              size: int = PAGE) -> DataFrame:
    """One page of projects; severity sorts fall back through high, medium and total."""
    rows = portfolio_filtered(latest, query, severity)
    col, desc = _SORTS.get(sort, _SORTS["critical"])
    if sort in ("critical", "high"):
        order = [F.col(c).desc() for c in ("sev_critical", "sev_high", "sev_medium", "total")]
    elif col == "project":
        order = [F.lower("project")]
    else:
        order = [F.col(col).desc() if desc else F.col(col)]
    return rows.orderBy(*order, "scan_id").offset((max(1, page) - 1) * size).limit(size)


def portfolio_filtered(latest: DataFrame, query: str = "", severity: str = "") -> DataFrame:
    rows = latest
    if query.strip():
        rows = rows.filter(F.contains(F.lower("project"), F.lit(query.strip().lower())))
    if severity in SEVERITIES:
        rows = rows.filter(F.col(f"sev_{severity}") > 0)
    return rows


def portfolio_totals(rows: DataFrame) -> DataFrame:
    """Header of the portfolio: over the filtered set, not the page."""
    return rows.agg(F.count(F.lit(1)).alias("projects"),
                    *[F.coalesce(F.sum(f"sev_{s}"), F.lit(0)).alias(f"sev_{s}") for s in SEVERITIES])


def dashboard(latest: DataFrame, n_scans: DataFrame, findings: DataFrame, top: int = TOP_SHOWN) -> DataFrame:
    """Header of the start page over the newest scans: totals, severity split and ``top_rules`` ``(rule_id, n)``, most hits first."""
    # read twice, for the totals and for the rules
    latest = durable(latest.select("scan_id", "total", "new_count", *[f"sev_{s}" for s in SEVERITIES]))
    totals = latest.agg(
        F.count(F.lit(1)).alias("projects"), F.sum("total").alias("total"), *[F.sum(f"sev_{s}").alias(f"sev_{s}") for s in SEVERITIES],
        F.sum(F.col("sev_critical") + F.col("sev_high")).alias("crit_high"), F.sum("new_count").alias("new_total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_order"), "rule_id", "n")))
    rules = dashboard_rules(findings, latest, top).agg(F.transform(ranked, lambda r: F.struct(r["rule_id"].alias("rule_id"), r["n"].alias("n"))).alias("top_rules"))
    return totals.withColumn("scans", n_scans.agg(F.count(F.lit(1)).alias("scans")).scalar()).withColumn("top_rules", rules.scalar())


def dashboard_rules(findings: DataFrame, latest: DataFrame, top: int = TOP_SHOWN) -> DataFrame:
    hit = findings.join(latest.select("scan_id"), "scan_id", "left_semi")
    return counts_by(hit, "rule_id").orderBy(F.col("n").desc(), "rule_id").limit(top)


def trend(scans: DataFrame, last: int = TREND) -> DataFrame:
    """Last scans of each project with the change against the one before."""
    w = W.partitionBy("project").orderBy(F.col("created_at").desc(), F.col("scan_id").desc())
    # one row more than shown gives the first shown row its predecessor
    recent = scans.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= last + 1)
    older = F.lead("total").over(W.partitionBy("project").orderBy("age"))
    return (recent.withColumn("risk_delta", F.coalesce(F.col("total") - older, F.lit(0)))
            .filter(F.col("age") <= last))


def rules_applied(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Every applied rule with its hits, also when there are none."""
    hits = counts_by(findings, "rule_id")
    return rules.join(hits, "rule_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# ---- consolidated report -----------------------------------------------------------------

def consolidated(scans: DataFrame, states: DataFrame, kept_only: bool) -> DataFrame:
    """Per project: size, total and severity split, before or after closed verdicts, with a totals row.

    ``scans(scan_id, project, files, lines, languages)``; ``states(scan_id, severity, state)`` per finding.
    """
    keep = is_open(F.col("state")) if kept_only else F.lit(True)
    per_scan = states.groupBy("scan_id").agg(F.count_if(keep).alias("total"), *severity_columns(keep))
    measures = ["files", "lines", "total", *[f"sev_{s}" for s in SEVERITIES]]
    rows = scans.join(per_scan, "scan_id", "left").fillna(0, measures)
    keys = ["project", "scan_id", "languages"]
    out = rows.groupingSets([keys, []], *keys).agg(
        *[F.sum(m).cast("long").alias(m) for m in measures], F.grouping("scan_id").alias("_g"))
    return (out.withColumn("project", F.when(F.col("_g") == 1, F.lit("(total)")).otherwise(F.col("project")))
            .withColumn("languages", F.coalesce("languages", F.lit("-"))).drop("_g"))


def language_label(codes: Column) -> Column:
    """Codes as display names in their order, ``-`` when there are none."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAME.items() for x in kv])
    text = F.array_join(F.transform(codes, lambda c: F.coalesce(F.element_at(names, c), c)), ", ")
    return F.when(text == "", F.lit("-")).otherwise(F.coalesce(text, F.lit("-")))


def weakness_breakdown(findings: DataFrame) -> DataFrame:
    """Open findings by (standard, group, weakness, severity) of each scan."""
    return (findings.filter(is_open(F.col("state")))
            .groupBy("scan_id", "standard", "grp", "weakness", "severity").agg(F.count(F.lit(1)).alias("n")))


def consolidated_review(findings: DataFrame) -> DataFrame:
    """Dropped findings by (weakness, severity, reason): count, first opinion, first project."""
    names = F.create_map(*[F.lit(x) for kv in REASON.items() for x in kv])
    order = F.struct("scan_order", "idx")
    opinion = F.trim(F.coalesce("note", F.lit("")))
    return (findings.filter(F.col("state").isin(list(CLOSED)))
            .withColumn("reason", F.element_at(names, F.col("state")))
            .groupBy("weakness", "severity", "reason")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.min_by(F.when(opinion != "", opinion), F.when(opinion != "", order)),
                            F.lit("")).alias("opinion"),
                 F.min_by("project", order).alias("project")))


def severity_order() -> Column:
    return severity_rank(F.col("severity"))
