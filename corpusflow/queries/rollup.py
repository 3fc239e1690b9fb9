"""Counts, portfolio, checklists and consolidated tables over the derived hub tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import query
from .inputs import (AUDIT, BRAND_CWE, FINDINGS, NOTES, SCANS, STATES, audit_notes, documents, findings, scans, table, with_sql)
from .lifecycle import CHAIN, COUNTS, DIFF, JUDGED, LAST, STORED, diff, judged
from ..functions.identity import SEVERITIES, file_ext
from ..operators import lifecycle, rollups, standards
from ..operators.patterns import shipped
from ..plans import dimension
from ..sources import corpus
from ..sources.rules import pattern_rule_table
from ..tables import checklists, remedies

_SEV = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS sev_{s}" for s in SEVERITIES)
SEV_COUNTS = f"sev AS (SELECT scan_id, count(*) AS total, {_SEV} FROM findings GROUP BY scan_id)"


@query("severity_counts", with_sql(FINDINGS, SEV_COUNTS, select="SELECT * FROM sev"))
def severity_counts(spark, sf):
    return rollups.severity_counts(findings(spark, sf), "scan_id")


def _by_project(spark, sf) -> DataFrame:
    """Findings with the project as scan key: few, large groups."""
    s = scans(spark, sf).select("scan_id", "segment")
    return findings(spark, sf).join(s, "scan_id").withColumn("scan_id", F.col("segment"))


_TOP = """SELECT scan_id, '{0}' AS axis, v AS value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, v) AS pos FROM (
    SELECT scan_id, {0} AS v, count(*) AS n FROM seg GROUP BY ALL) WHERE v <> '' OR '{0}' <> 'cwe') WHERE pos <= {1}"""


@query("scan_summary", with_sql(SCANS, FINDINGS, "seg AS (SELECT f.* REPLACE (segment AS scan_id) FROM findings f JOIN scans s ON s.scan_id = f.scan_id)",
       select="SELECT scan_id, 'total' AS axis, '' AS value, count(*) AS n FROM seg GROUP BY 1\nUNION ALL "
       + "\nUNION ALL ".join([_TOP.format("rule_id", 15), _TOP.format("file", 15), _TOP.format("cwe", 12)]
                             + [f"SELECT scan_id, '{a}', {a}, count(*) FROM seg WHERE {a} <> '' GROUP BY ALL" for a in ("severity", "category", "verdict")])))
def scan_summary(spark, sf):
    return rollups.scan_summary(_by_project(spark, sf))


@query("rule_counts", with_sql(FINDINGS, select="SELECT rule_id, count(*) AS n FROM findings GROUP BY 1"))
def rule_counts(spark, sf):
    return rollups.counts_by(findings(spark, sf), "rule_id")


@query("file_counts", with_sql(FINDINGS, select="SELECT file, count(*) AS n FROM findings GROUP BY 1"))
def file_counts(spark, sf):
    return rollups.counts_by(findings(spark, sf), "file")


@query("verdict_counts", with_sql(FINDINGS, select="SELECT scan_id, verdict, count(*) AS n FROM findings WHERE verdict <> '' GROUP BY ALL"))
def verdict_counts(spark, sf):
    return rollups.counts_by(findings(spark, sf).filter(F.col("verdict") != ""), "scan_id", "verdict")


def document_files(spark, sf) -> DataFrame:
    """Documents with the integrity facts a reader would report: labels give the failed and partial ones."""
    l = table(spark, sf, "labels")
    d = documents(spark, sf).join(l, "doc_id", "left")
    return d.select("project", F.col("tongue").alias("lang"), (F.col("tongue") != "es").alias("is_source"), F.lit(True).alias("is_text"),
                    (F.length("text") > 5000).alias("too_large"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("failed"),
                    F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("partial"), corpus.code_lines(F.col("text")).alias("lines"))


DOC_FILES = """doc_files AS (SELECT source AS project, lang, lang <> 'es' AS is_source, length(text) > 5000 AS too_large,
  coalesce(quality = 0, false) AS failed, coalesce(toxic = 1, false) AS partial,
  CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, chr(10), '')) + 1 ELSE 0 END AS lines FROM documents LEFT JOIN labels USING (doc_id))"""


@query("integrity_summary", with_sql(DOC_FILES, select="""SELECT project, count(*) FILTER (WHERE ok) AS scanned, count(*) AS text_scanned,
  CAST(coalesce(sum(lines) FILTER (WHERE ok), 0) AS BIGINT) AS code_lines, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (WHERE ok), '') AS languages,
  count(*) FILTER (WHERE too_large) AS skipped, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE partial) AS partial,
  count(*) FILTER (WHERE ok OR too_large OR failed) AS total, bool_and(NOT too_large AND NOT failed AND NOT partial) AS complete
FROM (SELECT *, is_source AND NOT too_large AND NOT failed AS ok FROM doc_files) GROUP BY project"""))
def integrity_summary(spark, sf):
    return rollups.integrity(document_files(spark, sf))


@query("language_stats", with_sql(FINDINGS, DOC_FILES, """f AS (SELECT CASE lang WHEN 'en' THEN 'javascript' WHEN 'fr' THEN 'python' WHEN 'de' THEN 'java' ELSE 'ruby' END AS lang,
  count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM doc_files GROUP BY 1),
i AS (SELECT CASE regexp_extract(file, '\\.[a-z]+$') WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go' END AS lang,
  count(*) AS issues FROM findings GROUP BY 1)""".replace("\\\\", "\\"),
       select="""SELECT lang, coalesce(files, 0) AS files, coalesce(lines, 0) AS lines, coalesce(issues, 0) AS issues,
  CASE WHEN coalesce(lines, 0) > 0 THEN round_even(coalesce(issues, 0) / (lines / 1000), 2) ELSE 0.0 END AS density FROM f FULL JOIN i USING (lang) WHERE lang IS NOT NULL"""))
def language_stats(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("en", "javascript", "fr", "python", "de", "java", "es", "ruby")])
    files = document_files(spark, sf).withColumn("lang", F.element_at(names, F.col("lang")))
    hits = findings(spark, sf).select(corpus.rule_language(file_ext(F.col("file"))).alias("lang"))
    return rollups.language_stats(files, hits)


def latest(spark, sf) -> DataFrame:
    s = scans(spark, sf).join(rollups.severity_counts(findings(spark, sf), "scan_id"), "scan_id", "left").join(
        lifecycle.diff_counts(diff(spark, sf)), "scan_id", "left").na.fill(0)
    return rollups.latest_per_project(s)


_LATEST_PARTS = (SCANS, FINDINGS, STORED, CHAIN, LAST, DIFF, COUNTS, SEV_COUNTS, """rated AS (
  SELECT s.*, coalesce(total, 0) AS total, """ + ", ".join(f"coalesce(sev_{s}, 0) AS sev_{s}" for s in SEVERITIES) + """, coalesce(new_count, 0) AS new_count
  FROM scans s LEFT JOIN sev USING (scan_id) LEFT JOIN diff_counts USING (scan_id)),
latest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC, scan_id DESC) = 1)""")


@query("latest_per_project", with_sql(SCANS, select="SELECT project, scan_id FROM scans QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC, scan_id DESC) = 1"))
def latest_per_project(spark, sf):
    return rollups.latest_per_project(scans(spark, sf)).select("project", "scan_id")


@query("portfolio", with_sql(*_LATEST_PARTS, select="""SELECT scan_id, project, total, sev_critical, sev_high FROM latest WHERE contains(lower(project), '1') AND sev_high > 0
ORDER BY sev_critical DESC, sev_high DESC, sev_medium DESC, total DESC, scan_id LIMIT 50"""))
def portfolio(spark, sf):
    """A page of the portfolio: the page size is the feature."""
    return rollups.portfolio(latest(spark, sf), query="1", severity="high").select("scan_id", "project", "total", "sev_critical", "sev_high")


@query("portfolio_totals", with_sql(*_LATEST_PARTS, select="SELECT count(*) AS projects, " + ", ".join(
    f"CAST(coalesce(sum(sev_{s}), 0) AS BIGINT) AS sev_{s}" for s in SEVERITIES) + " FROM latest WHERE contains(lower(project), '1') AND sev_high > 0"))
def portfolio_totals(spark, sf):
    return rollups.portfolio_totals(rollups.portfolio_filtered(latest(spark, sf), "1", "high"))


@query("dashboard", with_sql(*_LATEST_PARTS, """top_rules AS (SELECT rule_id, count(*) AS n FROM findings WHERE scan_id IN (SELECT scan_id FROM latest) GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 8)""",
       select="""SELECT count(*) AS projects, CAST(sum(total) AS BIGINT) AS total, """ + ", ".join(f"CAST(sum(sev_{s}) AS BIGINT) AS sev_{s}" for s in SEVERITIES) + """,
  CAST(sum(sev_critical + sev_high) AS BIGINT) AS crit_high, CAST(sum(new_count) AS BIGINT) AS new_total, (SELECT count(*) FROM scans) AS scans,
  (SELECT coalesce(string_agg(rule_id || ':' || n, ',' ORDER BY n DESC, rule_id), '') FROM top_rules) AS top_rules FROM latest"""))
def dashboard(spark, sf):
    """Totals, severity split and the eight rules with most hits over the newest scans."""
    rows = rollups.dashboard(latest(spark, sf), scans(spark, sf), findings(spark, sf))
    return rows.withColumn("top_rules", F.array_join(F.transform("top_rules", lambda r: F.concat_ws(":", r["rule_id"], r["n"].cast("string"))), ","))


@query("dashboard_rules", with_sql(*_LATEST_PARTS, select="SELECT rule_id, count(*) AS n FROM findings WHERE scan_id IN (SELECT scan_id FROM latest) GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 8"))
def dashboard_rules(spark, sf):
    return rollups.dashboard_rules(findings(spark, sf), rollups.latest_per_project(scans(spark, sf)))


@query("trend", with_sql(*_LATEST_PARTS, select="""SELECT scan_id, project, total, age, coalesce(total - older, 0) AS risk_delta FROM (
  SELECT *, row_number() OVER w AS age, lead(total) OVER w AS older FROM rated WINDOW w AS (PARTITION BY project ORDER BY created_at DESC, scan_id DESC)) WHERE age <= 12"""))
def trend(spark, sf):
    s = scans(spark, sf).join(rollups.severity_counts(findings(spark, sf), "scan_id"), "scan_id", "left").fillna(0, ["total"])
    return rollups.trend(s).select("scan_id", "project", "total", F.col("age").cast("long").alias("age"), "risk_delta")


# ---- checklists ---------------------------------------------------------------------------

def _quoted(rows) -> str:
    return ", ".join("('{}', {}, {}, '{}', '{}', '{}', [{}]::VARCHAR[])".format(
        std, so, io, code, name.replace("'", "''"), grp.replace("'", "''"), ", ".join(f"'{c}'" for c in cwes))
        for std, so, io, code, name, grp, cwes in rows)


ITEMS = f"items AS (SELECT * FROM (VALUES {_quoted(checklists.rows())}) t(std, std_ord, item_ord, code, name, grp, cwes))"
_RULE_CWES = sorted({r[3] for r in shipped() if r[3]} | {c for c in BRAND_CWE.values() if c})
AVAILABLE = "available AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in _RULE_CWES) + "]) AS cwe)"
CWE_COUNTS = "cwe_counts AS (SELECT cwe, count(*) AS n FROM findings WHERE cwe <> '' GROUP BY 1)"


def _available(spark, sf) -> DataFrame:
    """CWEs of the shipped pattern rules and of the rules behind the derived findings."""
    brands = dimension(spark, [(c,) for c in BRAND_CWE.values()], "cwe string")
    return standards.rule_cwes(pattern_rule_table(spark), brands)


@query("rule_cwes", with_sql(FINDINGS, CWE_COUNTS, AVAILABLE, select="SELECT a.cwe, coalesce(n, 0) AS n FROM available a LEFT JOIN cwe_counts USING (cwe)"))
def rule_cwes(spark, sf):
    n = standards.cwe_counts(findings(spark, sf))
    return _available(spark, sf).join(n, "cwe", "left").select("cwe", F.coalesce("n", F.lit(0)).alias("n"))


FIRST_ITEM = """first_item AS (SELECT std, std_ord, cwe, name, grp, code FROM (SELECT *, unnest(cwes) AS cwe FROM items)
  QUALIFY row_number() OVER (PARTITION BY std, cwe ORDER BY item_ord) = 1),
best AS (SELECT * FROM first_item QUALIFY row_number() OVER (PARTITION BY cwe ORDER BY std_ord) = 1)"""


@query("standard_map", with_sql(FINDINGS, ITEMS, FIRST_ITEM, select="""SELECT scan_id, idx, coalesce(std, '-') AS standard, coalesce(grp, '-') AS grp, coalesce(name, rule_id) AS weakness
FROM findings f LEFT JOIN best b ON b.cwe = f.cwe"""))
def standard_map(spark, sf):
    return standards.standard_map(findings(spark, sf), standards.items(spark)).select("scan_id", "idx", "standard", "grp", "weakness")


COVERED = """covered AS (SELECT i.std, i.code, i.item_ord, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, coalesce(bool_or(a.cwe IS NOT NULL), false) AS covered
  FROM (SELECT std, code, item_ord, unnest(CASE WHEN len(cwes) = 0 THEN [NULL] ELSE cwes END) AS cwe FROM items) i
  LEFT JOIN cwe_counts c USING (cwe) LEFT JOIN available a USING (cwe) GROUP BY ALL),
rated_items AS (SELECT *, CASE WHEN n > 0 THEN 'violated' WHEN covered THEN 'pass' ELSE 'not_covered' END AS verdict FROM covered)"""


def _coverage(spark, sf) -> DataFrame:
    return standards.coverage(standards.items(spark), standards.cwe_counts(findings(spark, sf)), _available(spark, sf))


@query("standard_coverage", with_sql(FINDINGS, ITEMS, CWE_COUNTS, AVAILABLE, COVERED, select="SELECT std, code, n, covered, verdict FROM rated_items"))
def standard_coverage(spark, sf):
    return _coverage(spark, sf).select("std", "code", "n", "covered", "verdict")


@query("standard_summary", with_sql(FINDINGS, ITEMS, CWE_COUNTS, AVAILABLE, COVERED, select="""SELECT std, count(*) AS items, count(*) FILTER (WHERE verdict = 'violated') AS violated,
  count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict = 'not_covered') AS not_assessed FROM rated_items GROUP BY std"""))
def standard_summary(spark, sf):
    return standards.standard_summary(_coverage(spark, sf))


@query("standard_unmapped", with_sql(FINDINGS, ITEMS, CWE_COUNTS, select="""SELECT cwe, n FROM cwe_counts
WHERE cwe NOT IN (SELECT unnest(cwes) FROM items WHERE std IN ('mois', 'mobile'))"""))
def standard_unmapped(spark, sf):
    return standards.unmapped(standards.items(spark, "mois", "mobile"), standards.cwe_counts(findings(spark, sf))).select("cwe", "n")


@query("standard_groups", with_sql(FINDINGS, ITEMS, CWE_COUNTS, select="""SELECT i.std, i.grp, count(DISTINCT i.code) AS n, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS findings
FROM (SELECT std, grp, code, unnest(CASE WHEN len(cwes) = 0 THEN [NULL] ELSE cwes END) AS cwe FROM items) i LEFT JOIN cwe_counts c USING (cwe) GROUP BY ALL"""))
def standard_groups(spark, sf):
    groups = standards.standard_groups(standards.items(spark))
    hits = _coverage(spark, sf).groupBy("std", "grp").agg(F.sum("n").cast("long").alias("findings"))
    return groups.join(hits, ["std", "grp"])


@query("rules_applied", with_sql(FINDINGS, "applied AS (SELECT a.rule_id || '.' || w AS rule_id FROM (SELECT unnest([" + ", ".join(f"'{r[0]}'" for r in shipped()) + "]) AS rule_id) a, (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part))",
       select="SELECT a.rule_id, coalesce(n, 0) AS n FROM applied a LEFT JOIN (SELECT rule_id, count(*) AS n FROM findings GROUP BY 1) USING (rule_id)"))
def rules_applied(spark, sf):
    """Every shipped rule in every variant the parts name, with its hits."""
    words = table(spark, sf, "part").select(F.substring_index("p_name", " ", 1).alias("w")).distinct()
    names = words.select(F.explode(F.array(*[F.lit(r[0]) for r in shipped()])).alias("id"), "w")
    return rollups.rules_applied(names.select(F.concat_ws(".", "id", "w").alias("rule_id")), findings(spark, sf))


# ---- consolidated report ------------------------------------------------------------------

def _sizes(spark, sf) -> DataFrame:
    """Scan sizes: files and lines from its order, languages from the extensions of its findings."""
    langs = (findings(spark, sf).select("scan_id", corpus.rule_language(file_ext(F.col("file"))).alias("l")).filter("l is not null").distinct()
             .groupBy("scan_id").agg(F.sort_array(F.collect_set("l")).alias("codes")))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scan_id"), F.year("o_orderdate").cast("long").alias("files"),
                                          F.floor("o_totalprice").alias("lines"))
    return (scans(spark, sf).join(o, "scan_id").join(langs, "scan_id", "left")
            .select("scan_id", "project", "files", "lines", rollups.language_label(F.col("codes")).alias("languages")))


SIZES = """sizes AS (SELECT s.scan_id, s.project, year(o_orderdate) AS files, CAST(floor(o_totalprice) AS BIGINT) AS lines,
  coalesce(languages, '-') AS languages FROM scans s JOIN orders ON o_orderkey = s.scan_id LEFT JOIN (
  SELECT scan_id, string_agg(DISTINCT CASE l WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' WHEN 'java' THEN 'Java' WHEN 'go' THEN 'Go' END, ', '
    ORDER BY CASE l WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' WHEN 'java' THEN 'Java' WHEN 'go' THEN 'Go' END) AS languages
  FROM (SELECT scan_id, regexp_extract(file, '([a-z]+)$', 1) AS l FROM findings) WHERE l <> 'txt' GROUP BY scan_id) USING (scan_id))"""
_MEASURES = ["files", "lines", "total", *[f"sev_{s}" for s in SEVERITIES]]


def _consolidated_sql(where: str) -> str:
    sums = ", ".join(f"CAST(sum(coalesce({m}, 0)) AS BIGINT) AS {m}" for m in _MEASURES)
    return with_sql(SCANS, FINDINGS, AUDIT, STATES, JUDGED, SIZES,
                    f"kept AS (SELECT scan_id, count(*) AS total, {_SEV} FROM judged WHERE {where} GROUP BY scan_id)",
                    select=f"SELECT project, scan_id, languages, {sums} FROM sizes LEFT JOIN kept USING (scan_id) GROUP BY ALL\nUNION ALL "
                           f"SELECT '(total)', NULL, '-', {sums} FROM sizes LEFT JOIN kept USING (scan_id)")


@query("consolidated_initial", _consolidated_sql("true"))
def consolidated_initial(spark, sf):
    return rollups.consolidated(_sizes(spark, sf), judged(spark, sf), kept_only=False)


@query("consolidated_final", _consolidated_sql("state NOT IN ('false_positive', 'deferred', 'fixed')"))
def consolidated_final(spark, sf):
    return rollups.consolidated(_sizes(spark, sf), judged(spark, sf), kept_only=True)


@query("consolidated_totals", "SELECT * EXCLUDE (project, scan_id, languages) FROM ("
       + _consolidated_sql("state NOT IN ('false_positive', 'deferred', 'fixed')") + ") WHERE project = '(total)'")
def consolidated_totals(spark, sf):
    rows = rollups.consolidated(_sizes(spark, sf), judged(spark, sf), kept_only=True)
    return rows.filter(F.col("project") == "(total)").drop("project", "scan_id", "languages")


MAPPED = """mapped AS (SELECT j.*, coalesce(std, '-') AS standard, coalesce(grp, '-') AS grp, coalesce(name, rule_id) AS weakness FROM judged j LEFT JOIN best b ON b.cwe = j.cwe)"""


@query("consolidated_weakness", with_sql(SCANS, FINDINGS, AUDIT, STATES, JUDGED, ITEMS, FIRST_ITEM, MAPPED, select="""SELECT scan_id, standard, grp, weakness, severity, count(*) AS n
FROM mapped WHERE state NOT IN ('false_positive', 'deferred', 'fixed') GROUP BY ALL"""))
def consolidated_weakness(spark, sf):
    return rollups.weakness_breakdown(standards.standard_map(judged(spark, sf), standards.items(spark)))


@query("consolidated_review", with_sql(SCANS, FINDINGS, AUDIT, STATES, NOTES, JUDGED, ITEMS, FIRST_ITEM, MAPPED, """dropped AS (
  SELECT weakness, severity, CASE state WHEN 'false_positive' THEN 'False positive' WHEN 'deferred' THEN 'Excluded' ELSE 'Fixed' END AS reason, s.project, coalesce(n.note, '') AS note,
         (s.created_at, m.scan_id, m.idx) AS ord FROM mapped m JOIN scans s ON s.scan_id = m.scan_id LEFT JOIN notes n ON n.scan_id = m.scan_id AND n.idx = m.idx
  WHERE state IN ('false_positive', 'deferred', 'fixed'))""",
       select="""SELECT weakness, severity, reason, count(*) AS n, coalesce(arg_min(note, ord) FILTER (WHERE note <> ''), '') AS opinion, arg_min(project, ord) AS project FROM dropped GROUP BY ALL"""))
def consolidated_review(spark, sf):
    rows = standards.standard_map(judged(spark, sf), standards.items(spark))
    s = scans(spark, sf).select("scan_id", "project", F.struct("created_at", "scan_id").alias("scan_order"))
    rows = rows.join(s, "scan_id").join(audit_notes(spark, sf), ["scan_id", "idx"], "left")
    return rollups.consolidated_review(rows)


_KEYS = " ".join(f"WHEN contains(rule_id, '{k}') THEN '{k}'" for k in remedies.KEYS)
_EXPLICIT = " ".join(f"WHEN rule_id = '{k}' THEN '{v}'" for k, v in remedies.EXPLICIT.items())


@query("remediation_key", with_sql(FINDINGS, "every AS (SELECT DISTINCT rule_id FROM findings UNION SELECT unnest([" + ", ".join(f"'{r[0]}'" for r in shipped()) + "]))",
       select=f"""SELECT rule_id, CASE {_EXPLICIT} WHEN starts_with(rule_id, 'vendor.') THEN 'secret' {_KEYS} WHEN contains(rule_id, 'secret') THEN 'secret'
  WHEN starts_with(rule_id, 'pii') THEN 'pii' WHEN contains(rule_id, 'sql') THEN 'sqli' ELSE '' END AS key FROM every"""))
def remediation_key(spark, sf):
    ids = findings(spark, sf).select("rule_id").unionByName(pattern_rule_table(spark).select(F.col("id").alias("rule_id"))).distinct()
    return ids.select("rule_id", standards.remediation_key(F.col("rule_id")).alias("key"))

