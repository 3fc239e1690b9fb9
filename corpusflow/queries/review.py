"""Filters, exports, triage, validation and accuracy over the derived hub tables."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from . import query
from .inputs import (AUDIT, DOCS, FINDINGS, RANK, SCANS, STATES, document_lines, findings, scans, states, table, with_sql)
from .lifecycle import JUDGED
from .text import DOC_HITS, DOC_LINES, document_findings
from ..functions.identity import csv_safe
from ..operators import evaluate, findings as hub, standards, triage
from ..plans import checkpoint_dir, dimension


@query("findings_filter", with_sql(FINDINGS, AUDIT, STATES, JUDGED, select="""SELECT scan_id, idx FROM judged
WHERE severity = 'high' AND state = '' AND cwe IN ('CWE-89', 'CWE-94', 'CWE-95', 'CWE-96', 'CWE-79', 'CWE-80')
  AND (contains(lower(rule_id), 'sql') OR contains(lower(file), 'sql') OR contains(lower(message), 'sql') OR contains(lower(cwe), 'sql'))"""))
def findings_filter(spark, sf):
    items = standards.items(spark, "mois").filter(F.col("code").isin("sql-injection", "code-injection", "xss"))
    rows = hub.filter_findings(findings(spark, sf), severity="high", text="SQL", cwes=items.select(F.explode("cwes").alias("cwe")))
    return hub.filter_audit(rows, states(spark, sf), "none").select("scan_id", "idx")


@query("findings_list", with_sql(FINDINGS, "hit AS (SELECT * FROM findings WHERE severity IN ('critical', 'high') AND contains(rule_id, 'xss') AND contains(file, 'src/'))",
       select="""SELECT scan_id, idx, rule_id, (SELECT count(*) FROM hit) AS total, CASE WHEN 60 < (SELECT count(*) FROM hit) THEN 60 END AS next_offset
FROM hit ORDER BY scan_id, idx LIMIT 20 OFFSET 40"""))
def findings_list(spark, sf):
    """A page of the filtered list: limit and offset are the feature."""
    return hub.list_findings(findings(spark, sf), ["CRITICAL", "high"], "xss", "src/", limit=20, offset=40).select(
        "scan_id", "idx", "rule_id", "total", "next_offset")


@query("findings_page", with_sql(FINDINGS, select=f"SELECT scan_id, idx, severity, rule_id FROM findings ORDER BY {RANK}, rule_id, file, line, scan_id, idx LIMIT 500 OFFSET 500"))
def findings_page(spark, sf):
    return hub.page(findings(spark, sf), page_no=2, size=900).select("scan_id", "idx", "severity", "rule_id")


@query("top_n_guard", with_sql(FINDINGS, select=f"SELECT scan_id, idx FROM findings ORDER BY {RANK}, file, line, scan_id, idx LIMIT 3000"))
def top_n_guard(spark, sf):
    return hub.top_by_severity(findings(spark, sf)).select("scan_id", "idx")


@query("flow_content_filter", with_sql(FINDINGS, select="""SELECT scan_id, idx FROM findings
WHERE regexp_matches('read_' || supplier, '^read_1') AND NOT contains(code, 'blue')"""))
def flow_content_filter(spark, sf):
    f = findings(spark, sf)
    return f.filter(hub.flow_content("^read_1", "source", regex=True) & hub.flow_content("blue", "sink", negate=True)).select("scan_id", "idx")


@query("uncertain_filter", with_sql(FINDINGS, select="SELECT scan_id, idx FROM findings WHERE uncertain"))
def uncertain_filter(spark, sf):
    return findings(spark, sf).filter(hub.uncertain()).select("scan_id", "idx")


@query("finding_project", with_sql(FINDINGS, select="SELECT scan_id, idx, rule_id, file, line, uncertain, fp, 'high' AS precision, 2 AS n_steps FROM findings"))
def finding_project(spark, sf):
    raw = findings(spark, sf).select("scan_id", "idx", "rule_id", "message", "severity", "cwe", "steps", "category")
    return hub.project_findings(raw, F.col("scan_id"), F.col("idx")).select(
        "scan_id", "idx", "rule_id", "file", "line", "uncertain", "fp", "precision", F.size("steps").alias("n_steps"))


@query("evidence", with_sql(FINDINGS, select="""SELECT scan_id, idx, source_file || ':1' AS source, file || ':' || line AS sink, 1 AS step_no, 'source' AS kind, 'read_' || supplier AS code FROM findings
UNION ALL SELECT scan_id, idx, source_file || ':1', file || ':' || line, 2, 'sink', code FROM findings"""))
def evidence(spark, sf):
    return hub.evidence(findings(spark, sf)).select("scan_id", "idx", "source", "sink", "step_no", "kind", "code")


@query("sources_touched", with_sql(FINDINGS, """touched AS (SELECT scan_id, source_file AS file FROM findings UNION SELECT scan_id, file FROM findings),
sized AS (SELECT *, length(file) * 1000 AS n_chars FROM touched WHERE length(file) * 1000 <= 15000)""",
       select="SELECT scan_id, file, total_chars FROM (SELECT *, CAST(sum(n_chars) OVER (PARTITION BY scan_id ORDER BY file) AS BIGINT) AS total_chars FROM sized) WHERE total_chars <= 30000"))
def sources_touched(spark, sf):
    f = findings(spark, sf)
    names = f.select("scan_id", F.explode(F.array("source_file", "file")).alias("file")).distinct()
    files = names.withColumn("size", F.length("file") * 1000).withColumn("n_chars", (F.length("file") * 1000).cast("long"))
    return hub.sources_touched(f, files, file_cap=15000, total_cap=30000).select("scan_id", "file", "total_chars")


@query("excl_rules", with_sql(SCANS, FINDINGS, """settings AS (SELECT DISTINCT project, CASE segment WHEN 'MACHINERY' THEN 'java.xss.red' ELSE 'py.sqli.blue' END AS rule_id FROM scans)""",
       select="SELECT f.scan_id, f.idx FROM findings f JOIN scans s USING (scan_id) WHERE NOT EXISTS (SELECT 1 FROM settings t WHERE t.project = s.project AND t.rule_id = f.rule_id)"))
def excl_rules(spark, sf):
    s = scans(spark, sf)
    settings = s.select("project", F.when(F.col("segment") == "MACHINERY", "java.xss.red").otherwise("py.sqli.blue").alias("rule_id")).distinct()
    return hub.exclude_rules(findings(spark, sf).join(s.select("scan_id", "project"), "scan_id"), settings).select("scan_id", "idx")


# ---- sinks --------------------------------------------------------------------------------

@query("sink_findings", with_sql(FINDINGS, select="SELECT category, severity, count(*) AS n FROM findings GROUP BY ALL"))
def sink_findings(spark, sf):
    """Write the partitioned table, read it back."""
    path = f"{checkpoint_dir(spark)}/findings-{uuid.uuid4().hex}"
    rows = findings(spark, sf).withColumn("project", F.col("category")).withColumn("scan_id", F.lit(1))
    hub.write_findings(rows, path)
    return spark.read.parquet(path).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("sink_sarif", with_sql(FINDINGS, """first_seen AS (SELECT scan_id, rule_id, row_number() OVER (PARTITION BY scan_id ORDER BY first_idx) - 1 AS rule_index FROM (
  SELECT scan_id, rule_id, min(idx) AS first_idx FROM findings GROUP BY ALL))""",
       select="""SELECT scan_id, idx, rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level,
  greatest(1, line) AS start_line, file AS uri, 2 AS n_locations, 'read_' || supplier AS first_code FROM findings JOIN first_seen USING (scan_id, rule_id)"""))
def sink_sarif(spark, sf):
    path = "$.codeFlows[0].threadFlows[0].locations"
    r = hub.sarif_results(findings(spark, sf))
    return r.select("scan_id", "idx", F.col("rule_index").cast("long").alias("rule_index"), "level", "start_line",
                    F.get_json_object("result", "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"),
                    F.json_array_length(F.get_json_object("result", path)).alias("n_locations"),
                    F.get_json_object("result", path + "[0].location.physicalLocation.region.snippet.text").alias("first_code"))


@query("sink_csv", with_sql(FINDINGS, AUDIT, STATES, JUDGED, select="""SELECT scan_id, idx AS no, severity, rule_id AS rule, cwe, owasp, file, line, message AS description, verdict, state AS audit, 2 AS n_steps FROM judged"""))
def sink_csv(spark, sf):
    return hub.csv_rows(findings(spark, sf), states(spark, sf))


@query("csv_safe", "SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+@-]') THEN chr(39) || substr(text, 1, 1) ELSE substr(text, 1, 1) END AS head FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN '=' WHEN lang = 'fr' THEN '@' WHEN lang = 'de' THEN '-' ELSE '' END || text AS text FROM documents)")
def csv_safe_cells(spark, sf):
    lead = F.when(F.col("lang") == "en", "=").when(F.col("lang") == "fr", "@").when(F.col("lang") == "de", "-").otherwise("")
    cell = F.concat(lead, F.col("text"))
    safe = csv_safe(cell)
    return table(spark, sf, "documents").select("doc_id", F.when(safe != cell, F.substring(safe, 1, 2)).otherwise(F.substring(safe, 1, 1)).alias("head"))


_TEXT_CASE = "CASE " + " ".join(f"WHEN contains(rule_id, '{k}') THEN '{v}'" for k, v in ((k, v.replace("'", "''")) for k, v in hub.REMEDIATION_TEXT.items())) + " ELSE '' END"


@query("sheet_rows", with_sql(FINDINGS, AUDIT, STATES, JUDGED, select=f"""SELECT scan_id, idx + 1 AS id, upper(substr(severity, 1, 1)) || substr(severity, 2) AS severity,
  CASE regexp_extract(file, '([a-z]+)$', 1) WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' WHEN 'java' THEN 'Java' WHEN 'go' THEN 'Go' ELSE 'TXT' END AS language,
  CAST(line AS VARCHAR) AS line, regexp_extract(file, '([^/]*)$', 1) AS file_name, cwe AS checker_description,
  message || CASE WHEN fp_hint THEN ' (env/example signal on the same line — possible false positive, verify)' ELSE '' END
    || CASE WHEN verdict <> '' THEN ' [LLM verdict: ' || verdict || ']' ELSE '' END AS opinion,
  CASE WHEN state = 'fixed' THEN 'Y' ELSE 'N' END AS done, {_TEXT_CASE} AS remediation,
  '[source] L1: read_' || supplier || chr(10) || '[sink] L' || line || ': ' || code AS source_code FROM judged"""))
def sheet_rows(spark, sf):
    return hub.sheet_rows(findings(spark, sf), states(spark, sf)).select(
        "scan_id", "id", "severity", "language", "line", "file_name", "checker_description", "opinion", "done", "remediation", "source_code")


@query("localize", with_sql(FINDINGS, select="""SELECT CASE WHEN contains(message, 'red') THEN replace(message, 'Issue in', 'Found:') ELSE message END AS message, count(*) AS n FROM findings GROUP BY 1"""))
def localize(spark, sf):
    f = findings(spark, sf)
    words = f.filter(F.contains("message", F.lit("red"))).select(F.col("message").alias("text"), F.replace(
        "message", F.lit("Issue in"), F.lit("Found:")).alias("translated")).distinct()
    return hub.localized(f, words, "message").groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query("ci_gate", with_sql(FINDINGS, select=f"SELECT scan_id, CASE WHEN bool_or({RANK} <= 1) THEN 1 ELSE 0 END AS exit_code FROM findings GROUP BY scan_id"))
def ci_gate(spark, sf):
    return hub.ci_gate(findings(spark, sf), "high")


# ---- triage -------------------------------------------------------------------------------

CLUSTERS = """clusters AS (SELECT scan_id, rule_id, sha1(rule_id || '|' || replace(code, ' ', '')) AS cluster, min(idx) AS idx, count(*) AS members FROM seg GROUP BY ALL)"""
SEG = "seg AS (SELECT f.* REPLACE (s.scan_id2 AS scan_id) FROM findings f JOIN (SELECT scan_id, year(created_at) AS scan_id2 FROM scans) s ON s.scan_id = f.scan_id)"


def _by_year(spark, sf) -> DataFrame:
    """All findings of a year as one scan, so clusters have many members."""
    s = scans(spark, sf).select("scan_id", F.year("created_at").cast("long").alias("year"))
    return findings(spark, sf).join(s, "scan_id").withColumn("scan_id", F.col("year")).drop("year")


@query("triage_cluster", with_sql(SCANS, FINDINGS, SEG, CLUSTERS, select="SELECT * FROM clusters"))
def triage_cluster(spark, sf):
    return triage.clusters(_by_year(spark, sf))


@query("triage_batches", with_sql(SCANS, FINDINGS, SEG, CLUSTERS, select="SELECT scan_id, idx, cluster, (row_number() OVER (ORDER BY scan_id, idx, cluster) - 1) // 5 AS batch FROM clusters"))
def triage_batches(spark, sf):
    return triage.batches(triage.clusters(_by_year(spark, sf))).select("scan_id", "idx", "cluster", "batch")


ANSWERS = """answers AS (SELECT scan_id, idx, CASE WHEN members > 60 THEN 'true_positive' WHEN members > 40 THEN 'false_positive' ELSE 'maybe' END AS verdict,
  CASE WHEN members > 50 THEN CAST(0.9 AS DOUBLE) END AS confidence, 'seen ' || members AS reason, CASE WHEN contains(rule_id, 'red') THEN 'Timeout' ELSE '' END AS error FROM clusters WHERE NOT contains(rule_id, 'blue'))"""
_JUDGED_REPS = """judged_reps AS (SELECT c.*, CASE WHEN a.scan_id IS NOT NULL AND error = '' AND verdict IN ('true_positive', 'false_positive', 'uncertain') THEN verdict ELSE 'uncertain' END AS verdict,
  CASE WHEN a.scan_id IS NOT NULL AND error = '' THEN CAST(coalesce(confidence, 0.0) AS DOUBLE) END AS confidence,
  CASE WHEN error <> '' THEN 'triage failed: ' || error WHEN a.scan_id IS NOT NULL THEN reason ELSE 'no verdict returned' END AS triage_reason
  FROM clusters c LEFT JOIN answers a ON a.scan_id = c.scan_id AND a.idx = c.idx)"""


def _keyed(spark, sf) -> DataFrame:
    """Findings of a year with their cluster: its digest moves to the scans, not the steps it is made of."""
    s = scans(spark, sf).select("scan_id", F.year("created_at").cast("long").alias("year"))
    rows = triage.cluster_key(findings(spark, sf)).select("scan_id", "idx", "line", "rule_id", F.unhex("cluster").alias("packed"))
    return rows.join(s, "scan_id").select(F.col("year").alias("scan_id"), "idx", "line", "rule_id", F.lower(F.hex("packed")).alias("cluster"))


def _judged_reps(spark, sf) -> DataFrame:
    reps = triage.clusters(_keyed(spark, sf), keyed=True)
    m = F.col("members")
    answers = reps.filter(~F.contains("rule_id", F.lit("blue"))).select(
        "scan_id", "idx", F.when(m > 60, "true_positive").when(m > 40, "false_positive").otherwise("maybe").alias("verdict"),
        F.when(m > 50, F.lit(0.9)).alias("confidence"), F.concat(F.lit("seen "), m.cast("string")).alias("reason"),
        F.lit("table").alias("provider"), F.when(F.contains("rule_id", F.lit("red")), "Timeout").otherwise("").alias("error"))
    return triage.apply_verdicts(reps, answers)


@query("triage_apply", with_sql(SCANS, FINDINGS, SEG, CLUSTERS, ANSWERS, _JUDGED_REPS, select="SELECT scan_id, idx, verdict, confidence, triage_reason FROM judged_reps"))
def triage_apply(spark, sf):
    return _judged_reps(spark, sf).select("scan_id", "idx", "verdict", "confidence", "triage_reason")


@query("triage_propagate", with_sql(SCANS, FINDINGS, SEG, CLUSTERS, ANSWERS, _JUDGED_REPS, select="""SELECT s.scan_id, s.idx, s.line, j.verdict, j.triage_reason
FROM seg s JOIN judged_reps j ON j.scan_id = s.scan_id AND j.cluster = sha1(s.rule_id || '|' || replace(s.code, ' ', ''))"""))
def triage_propagate(spark, sf):
    return triage.propagate(_keyed(spark, sf), _judged_reps(spark, sf), keyed=True).select("scan_id", "idx", "line", "verdict", "triage_reason")


@query("similar_issues", with_sql(SCANS, FINDINGS, SEG, CLUSTERS, select="SELECT scan_id, rule_id, cluster, idx, members - 1 AS others FROM clusters"))
def similar_issues(spark, sf):
    return triage.similar_issues(_by_year(spark, sf))


@query("triage_prompt", with_sql(DOCS, DOC_LINES, DOC_HITS, """spots AS (SELECT DISTINCT file, line FROM hits),
ctx AS (SELECT s.file, s.line, string_agg(lpad(CAST(l.line_no AS VARCHAR), 5, ' ') || '| ' || l.line, chr(10) ORDER BY l.line_no) AS t
  FROM spots s JOIN lines l ON l.file = s.file AND l.line_no BETWEEN s.line - 3 AND s.line + 3 GROUP BY ALL)""",
       select="SELECT DISTINCT file, line, sha1(t) AS context FROM ctx"))
def triage_prompt(spark, sf):
    """A prompt for every document finding; the code part of each is compared, once per line."""
    f = document_findings(spark, sf).select("file", "line", "steps", "rule_id", "cwe", "severity", F.abs(F.xxhash64("file")).alias("scan_id"),
                                            F.xxhash64("line", "rule_id", "start_col").alias("idx"))
    p = triage.prompts(f, document_lines(spark, sf))
    body = F.regexp_replace("prompt", r"(?s)^.*?\nCode:\n--- [^\n]*\n", "")
    return p.join(f.select("scan_id", "idx", "file", "line"), ["scan_id", "idx"]).select("file", "line", F.sha1(body).alias("context")).distinct()


def _observations(spark, sf) -> DataFrame:
    """Events as observations: the value is the delay, the type the signal, ``k`` the blocked state."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    u = F.col("user_id")
    rule = (F.when(F.col("event_type") == "click", "py.sqli").when(F.col("event_type") == "view", "js.xss").when(F.col("event_type") == "error", "java.ssrf")
            .when(F.col("event_type") == "signup", "php.open-redirect").otherwise("go.custom"))
    return e.select("event_id", rule.alias("rule_id"), (F.col("value") * 400).cast("long").alias("elapsed_ms"), (F.col("k") > 50).alias("oast_hit"),
                    (F.col("k") > 60).alias("body_marker"), F.lit(False).alias("file_leak"), (F.col("k") > 70).alias("redirect_external"),
                    F.when(F.col("k") > 90, "ORA-01756").alias("error_signature"),
                    F.when(F.col("k") < 3, "REQUIRES_AUTH").when(F.col("k") < 6, "OTHER").alias("blocked"),
                    (F.col("k") < 9).alias("static_safe"), (u > 75).alias("agent_confirmed"))


@query("validation_judge", with_sql("""obs AS (SELECT event_id, event_type, CAST(trunc(value * 400) AS BIGINT) AS ms, user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
typed AS (SELECT *, CASE event_type WHEN 'click' THEN 'time_delay' WHEN 'view' THEN 'reflected_marker' WHEN 'error' THEN 'oast_callback' WHEN 'signup' THEN 'redirect_location' ELSE 'manual' END AS oracle_type FROM obs)""",
       select="""SELECT event_id, oracle_type, CASE WHEN k < 6 THEN 'NOT_VALIDATED' WHEN k < 9 THEN 'FALSE_POSITIVE'
  WHEN CASE oracle_type WHEN 'time_delay' THEN ms >= 5000 WHEN 'reflected_marker' THEN k > 60 WHEN 'oast_callback' THEN k > 50 WHEN 'redirect_location' THEN k > 70 ELSE false END THEN 'CONFIRMED'
  WHEN (oracle_type = 'time_delay' AND k > 90) OR (oracle_type = 'manual' AND user_id > 75) THEN 'LIKELY' ELSE 'NOT_REPRODUCED' END AS verdict,
  CASE WHEN k < 3 THEN 'REQUIRES_AUTH' WHEN k < 6 THEN 'VALIDATION_BLOCKED' END AS blocked_reason FROM typed"""))
def validation_judge(spark, sf):
    return triage.judge(_observations(spark, sf)).select("event_id", "oracle_type", "verdict", "blocked_reason")


# routes and handlers are spelled into lines of conversations: each turn is a line of its conversation's file
_ENTRY_LINES = """turns AS (SELECT 'conv/' || conv_id || '.js' AS file, turn + 1 AS line_no,
  CASE WHEN role = 'user' AND length(text) < 120 THEN 'app.post("/c' || conv_id || '/' || turn || '", h' || conv_id || ')'
       WHEN role = 'user' AND length(text) < 300 THEN 'router.get(' || chr(39) || '/q' || turn || chr(39) || ', (req) => {'
       WHEN role = 'assistant' AND length(text) > 700 THEN 'function h' || conv_id || '(req) {'
       ELSE 'exec(v' || turn || ')' END AS line, role, conv_id, turn FROM conversations)"""


def _entry_lines(spark, sf) -> DataFrame:
    c, n = F.col("conv_id").cast("string"), F.length("text")
    t = F.col("turn").cast("string")
    line = (F.when((F.col("role") == "user") & (n < 120), F.concat(F.lit('app.post("/c'), c, F.lit("/"), t, F.lit('", h'), c, F.lit(")")))
            .when((F.col("role") == "user") & (n < 300), F.concat(F.lit("router.get('/q"), t, F.lit("', (req) => {")))
            .when((F.col("role") == "assistant") & (n > 700), F.concat(F.lit("function h"), c, F.lit("(req) {")))
            .otherwise(F.concat(F.lit("exec(v"), t, F.lit(")"))))
    return table(spark, sf, "conversations").select(F.concat(F.lit("conv/"), c, F.lit(".js")).alias("file"),
                                                    (F.col("turn") + 1).cast("int").alias("line_no"), line.alias("line"), "conv_id", "turn")


@query("entry_hint", with_sql(_ENTRY_LINES, """spots AS (SELECT * FROM turns WHERE starts_with(line, 'exec(')),
fns AS (SELECT s.file, s.line_no, arg_max(regexp_extract(f.line, 'function (\\w+)', 1), f.line_no) AS fn FROM spots s
  LEFT JOIN turns f ON f.file = s.file AND f.line_no <= s.line_no AND starts_with(f.line, 'function') GROUP BY ALL),
routes AS (SELECT file, line_no, line, CASE WHEN starts_with(line, 'app.post') THEN 'POST' ELSE 'GET' END AS method, regexp_extract(line, '["'']([^"'']+)["'']', 1) AS path
  FROM turns WHERE starts_with(line, 'app.post') OR starts_with(line, 'router.get')),
named AS (SELECT f.file, f.line_no, arg_min(r.method, r.line_no) AS method, arg_min(r.path, r.line_no) AS path FROM fns f
  JOIN routes r ON r.file = f.file AND regexp_matches(r.line, '\\b' || f.fn || '\\b') WHERE f.fn IS NOT NULL GROUP BY ALL),
inline AS (SELECT s.file, s.line_no, arg_max(r.method, r.line_no) AS method, arg_max(r.path, r.line_no) AS path FROM spots s
  JOIN routes r ON r.file = s.file AND r.line_no <= s.line_no GROUP BY ALL)""".replace("\\\\", "\\"),
       select="""SELECT f.file, CAST(f.line_no AS INTEGER) AS line, CASE WHEN n.path IS NOT NULL THEN n.method WHEN fn IS NULL AND i.path IS NOT NULL THEN i.method ELSE 'GET' END AS method,
  'query' AS location, 'v' AS param, CASE WHEN n.path IS NOT NULL THEN n.path WHEN fn IS NULL THEN i.path END AS path,
  CASE WHEN n.path IS NOT NULL OR (fn IS NULL AND i.path IS NOT NULL) THEN 'resolved' ELSE 'hint' END AS confidence
FROM fns f LEFT JOIN named n ON n.file = f.file AND n.line_no = f.line_no LEFT JOIN inline i ON i.file = f.file AND i.line_no = f.line_no"""))
def entry_hint(spark, sf):
    lines = _entry_lines(spark, sf)
    spots = lines.filter(F.startswith("line", F.lit("exec(")))
    step = lambda kind, code: F.struct(F.lit(kind).alias("kind"), F.col("file"), F.col("line_no").alias("line"), code.alias("code"),
                                       F.lit(False).alias("uncertain"))
    f = spots.select(F.col("conv_id").alias("scan_id"), F.col("turn").cast("long").alias("idx"), "file", F.array(
        step("source", F.lit("c.Query")), step("propagation", F.lit('v = c.Query("v")')), step("sink", F.col("line"))).alias("steps"))
    out = triage.entry_hints(f, lines)
    return out.join(spots.select(F.col("conv_id").alias("scan_id"), F.col("turn").cast("long").alias("idx"), "file", F.col("line_no").alias("line")),
                    ["scan_id", "idx"]).select("file", "line", "method", "location", "param", "path", "confidence")


# ---- accuracy -----------------------------------------------------------------------------

@query("attribute_hits", with_sql(FINDINGS, "truth AS (SELECT 's' || s_suppkey AS name FROM supplier WHERE s_acctbal > 0)",
       select="SELECT name, rule_id, count(*) AS n, count(*) FILTER (WHERE uncertain) AS n_uncertain FROM findings JOIN truth ON name = 's' || supplier GROUP BY ALL"))
def attribute_hits(spark, sf):
    truth = table(spark, sf, "supplier").filter(F.col("s_acctbal") > 0).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))
    return evaluate.attribute_hits(findings(spark, sf), truth)


TRUTH = """truth AS (SELECT CAST(l.doc_id AS VARCHAR) AS name, d.lang AS category, l.toxic = 1 AS is_real FROM labels l JOIN documents d USING (doc_id)),
rule_of AS (SELECT * FROM (VALUES ('en', 'pii.credit-card-number'), ('fr', 'pii.credit-card-number'), ('de', 'secret.credential-assignment'), ('es', NULL)) t(category, want)),
got AS (SELECT DISTINCT regexp_extract(file, '([0-9]+)', 1) AS name, rule_id FROM hits),
confusion AS (SELECT t.category, bool_or(want IS NOT NULL) AS scored,
  count(*) FILTER (WHERE want IS NOT NULL AND is_real AND g.name IS NOT NULL) AS tp, count(*) FILTER (WHERE want IS NOT NULL AND is_real AND g.name IS NULL) AS fn,
  count(*) FILTER (WHERE want IS NOT NULL AND NOT is_real AND g.name IS NOT NULL) AS fp, count(*) FILTER (WHERE want IS NOT NULL AND NOT is_real AND g.name IS NULL) AS tn,
  count(*) AS total FROM truth t LEFT JOIN rule_of USING (category) LEFT JOIN got g ON g.name = t.name AND g.rule_id = want GROUP BY t.category)"""
_CATEGORY_RULE = [("en", "pii.credit-card-number"), ("fr", "pii.credit-card-number"), ("de", "secret.credential-assignment"), ("es", None)]


def _confusion(spark, sf) -> DataFrame:
    from .text import src_truth
    hits = document_findings(spark, sf).select(F.regexp_extract("file", r"(\d+)", 1).alias("name"), "rule_id")
    return evaluate.confusion(src_truth(spark, sf), hits, dimension(spark, _CATEGORY_RULE, "category string, rule_id string"))


@query("confusion", with_sql(DOCS, DOC_LINES, DOC_HITS, TRUTH, select="SELECT * FROM confusion"))
def confusion(spark, sf):
    return _confusion(spark, sf)


def _metrics_sql(source: str) -> str:
    return f"""SELECT category, tp, fn, fp, tn, total, round(recall, 9) AS recall, round("precision", 9) AS "precision", round(fpr, 9) AS fpr,
  round(CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END, 9) AS f1, round(recall - fpr, 9) AS score FROM (
  SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS "precision",
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr FROM {source})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("category", "tp", "fn", "fp", "tn", "total", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "fpr", "f1", "score")])


@query("metrics", with_sql(DOCS, DOC_LINES, DOC_HITS, TRUTH, select=_metrics_sql("(SELECT * FROM confusion WHERE scored)")))
def metrics(spark, sf):
    return _rounded(evaluate.metrics(_confusion(spark, sf).filter("scored")))


@query("metrics_overall", with_sql(DOCS, DOC_LINES, DOC_HITS, TRUTH, select=_metrics_sql(
    "(SELECT coalesce(category, '(overall)') AS category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, "
    "CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(total) AS BIGINT) AS total FROM confusion WHERE scored GROUP BY ROLLUP (category))")))
def metrics_overall(spark, sf):
    return _rounded(evaluate.metrics_overall(_confusion(spark, sf)))


@query("metrics_excluded", with_sql(DOCS, DOC_LINES, DOC_HITS, TRUTH, select="SELECT category, total, CASE WHEN category = 'es' THEN 'no_rule' ELSE 'out_of_scope' END AS reason FROM confusion WHERE NOT scored"))
def metrics_excluded(spark, sf):
    return evaluate.excluded_categories(_confusion(spark, sf), dimension(spark, [("es",)], "category string"))


@query("uncertain_ratio", with_sql(FINDINGS, select="SELECT category, count(*) AS findings, count(*) FILTER (WHERE uncertain) AS uncertain, round(count(*) FILTER (WHERE uncertain) / count(*), 9) AS ratio FROM findings GROUP BY 1"))
def uncertain_ratio(spark, sf):
    return evaluate.uncertain_ratio(findings(spark, sf), "category").withColumn("ratio", F.round("ratio", 9))


_CATEGORY_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(rule_id), '{w}')" for w in words) + f" THEN '{name}'"
                                   for name, words in evaluate.CATEGORY_KEYWORDS) + " END"


@query("tool_category_map", with_sql(FINDINGS, select=f"SELECT rule_id, {_CATEGORY_SQL} AS category, count(*) AS n FROM findings GROUP BY ALL"))
def tool_category_map(spark, sf):
    return findings(spark, sf).groupBy("rule_id", evaluate.category_of(F.col("rule_id")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_LEVEL = "CASE {0} WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' WHEN '1-URGENT' THEN 'impossible' END"


@query("level_matrix", with_sql(SCANS, FINDINGS, f"""cases AS (SELECT DISTINCT project AS module, {_LEVEL.format('priority')} AS level FROM scans WHERE priority <> '4-NOT SPECIFIED'),
got AS (SELECT DISTINCT project AS module, {_LEVEL.format('priority')} AS level FROM findings JOIN scans USING (scan_id) WHERE rule_id = 'java.xss.red' AND segment <> 'BUILDING'),
m AS (SELECT c.module, c.level, CASE WHEN g.module IS NULL THEN 0 ELSE 1 END AS hit FROM cases c LEFT JOIN got g USING (module, level))""",
       select="""SELECT module, max(hit) FILTER (WHERE level = 'low') AS low, max(hit) FILTER (WHERE level = 'medium') AS medium, max(hit) FILTER (WHERE level = 'high') AS high,
  max(hit) FILTER (WHERE level = 'impossible') AS impossible FROM m GROUP BY module"""))
def level_matrix(spark, sf):
    """Project = module, order priority = level, expected rule everywhere but in one segment."""
    s = scans(spark, sf).filter(F.col("priority") != "4-NOT SPECIFIED")
    level = (F.when(F.col("priority") == "2-HIGH", "high").when(F.col("priority") == "3-MEDIUM", "medium")
             .when(F.col("priority") == "5-LOW", "low").otherwise("impossible"))
    cases = s.select(F.col("project").alias("module"), level.alias("level"), F.lit(True).alias("measurable")).distinct()
    hits = findings(spark, sf).join(s, "scan_id").select(F.col("project").alias("module"), level.alias("level"), "rule_id").distinct()
    expected = s.filter(F.col("segment") != "BUILDING").select(F.col("project").alias("module"), F.lit("java.xss.red").alias("rule_id")).distinct()
    return evaluate.level_matrix(cases, hits, expected).select("module", "low", "medium", "high", "impossible")


@query("result_identity", with_sql(FINDINGS, select="SELECT rule_id, file, line, count(*) AS a, count(*) FILTER (WHERE NOT uncertain) AS b FROM findings GROUP BY ALL HAVING bool_or(uncertain)"))
def result_identity(spark, sf):
    """Two runs that differ: all findings against the certain ones."""
    f = findings(spark, sf)
    return evaluate.result_difference(f, f.filter(~F.col("uncertain")))

