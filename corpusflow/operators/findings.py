"""The findings hub: ids, projection, filters, evidence, exports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import (csv_safe, file_ext, file_name, fingerprint, severity_rank)
from ..plans import number_in_key, running_sum
from ..schema import FINDING

# ---- fixed values: labels of the analysis sheet, export levels, size caps ----------------

SEVERITY_LABEL = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low", "info": "Info"}
LANGUAGE_LABEL = {
    ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript", ".php": "PHP", ".phtml": "PHP", ".inc": "PHP",
    ".py": "Python", ".sql": "SQL", ".xml": "XML", ".yml": "YAML", ".yaml": "YAML",
    ".json": "JSON", ".properties": "Properties", ".env": "Config", ".ini": "Config",
    ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".cs": "C#", ".go": "Go",
    ".rb": "Ruby", ".rake": "Ruby", ".swift": "Swift", ".cpp": "C++", ".cc": "C++", ".cxx": "C++",
    ".hpp": "C++", ".hh": "C++", ".hxx": "C++", ".c": "C", ".h": "C/C++"}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SOURCE_FILE_CAP = 1_000_000
SOURCES_TOTAL_CAP = 64_000_000

# ---- end of fixed values -----------------------------------------------------------------

#: Sheet remediation by first key found in the rule id; the wording is ours.
REMEDIATION_TEXT = {
    "sqli": "Bind parameters instead of building SQL text and allow-list the input.",
    "command-injection": "Call an API without a shell and pass arguments as a list.",
    "code-injection": "Remove dynamic code execution or dispatch from an allow-list.",
    "xss": "Encode output for its context.",
    "path-traversal": "Normalise the name and stay inside an allowed folder.",
    "file-inclusion": "Include only from a fixed list.",
    "ssrf": "Allow-list target hosts and block internal addresses.",
    "open-redirect": "Redirect to relative paths or allow-listed domains only.",
    "secret.": "Move the secret out of source and rotate it.",
    "vendor.": "Reissue the key, inject it at run time and clean the history.",
    "pii.": "Delete the personal data or store it encrypted.",
    "web.tls": "Switch certificate verification on.",
    "web.token-in-web-storage": "Keep tokens in HttpOnly, Secure cookies.",
    "web.": "Sanitise values before they reach the page.",
    "crypto.": "Use SHA-256 or better, AES-GCM and a secure random source.",
    "hygiene.debug": "Remove debug code and debug mode.",
    "hygiene.": "Clean up before release.",
    "infra.default-test-account": "Remove default accounts.",
    "infra.": "Move infrastructure details to configuration.",
}


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(mapping, key), default)


def project_findings(raw: DataFrame, scan_id: Column, idx: Column) -> DataFrame:
    """Any producer's rows in the hub schema; location and identity come from the last step."""
    have = set(raw.columns)
    sink = F.element_at("steps", -1)
    derived = {"scan_id": scan_id, "idx": idx, "file": sink["file"], "line": sink["line"],
               "uncertain": F.exists("steps", lambda s: s["uncertain"]),
               "fp": fingerprint(F.col("rule_id"), sink["file"], sink["code"])}
    cols = []
    for field in FINDING.fields:
        if field.name in derived:
            col = derived[field.name]
        elif field.name in have:
            col = F.col(field.name)
        else:
            default = {"precision": "high", "fp_hint": False, "category": "flow"}.get(field.name)
            col = F.lit(default)
        cols.append(col.cast(field.dataType).alias(field.name))
    return raw.select(*cols)


def union_axes(*axes: DataFrame) -> DataFrame:
    """Flow, pattern, file-name and dependency findings in one table."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.unionByName(axis, allowMissingColumns=True)
    return out


def number_findings(findings: DataFrame) -> DataFrame:
    """``idx`` by severity, rule, file and line over the scan; safe for one scan that holds most rows."""
    ranked = findings.withColumn("_rank", severity_rank(F.col("severity")))
    order = ["_rank", "rule_id", "file", "line", "fp"]
    return (number_in_key(ranked, ["scan_id"], order, "_n")
            .withColumn("idx", F.col("_n") - 1).drop("_n", "_rank"))


def finding_ids(findings: DataFrame) -> DataFrame:
    """Stable ``rule:file:line``; further findings at the same spot get ``#2``, ``#3`` ..."""
    base = F.concat_ws(":", "rule_id", "file", F.col("line").cast("string"))
    ranked = number_in_key(findings, ["rule_id", "file", "line"], ["idx"], "_n")
    return (ranked.withColumn("finding_id", F.when(F.col("_n") == 1, base).otherwise(
        F.concat(base, F.lit("#"), F.col("_n").cast("string")))).drop("_n"))


def filter_findings(findings: DataFrame, severity: str | None = None, rule: str | None = None,
                    file: str | None = None, text: str | None = None,
                    cwes: DataFrame | None = None) -> DataFrame:
    """AND of exact filters and a case-insensitive substring over rule, file, message and CWE."""
    out = findings
    if severity:
        out = out.filter(F.col("severity") == severity)
    if rule:
        out = out.filter(F.col("rule_id") == rule)
    if file:
        out = out.filter(F.col("file") == file)
    if text:
        low = F.lit(text.strip().lower())
        hit = F.lit(False)
        for c in ("rule_id", "file", "message", "cwe"):
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), low)
        out = out.filter(hit)
    if cwes is not None:
        out = out.join(cwes.select("cwe").distinct(), "cwe", "left_semi")
    return out


def filter_audit(findings: DataFrame, states: DataFrame, wanted: str) -> DataFrame:
    """Findings in one audit state; ``none`` means not audited.  (scan, idx) is unique in ``states``."""
    keys = ["scan_id", "idx"]
    if wanted == "none":
        return findings.join(states.select(*keys), keys, "left_anti")
    return findings.join(states.filter(F.col("state") == wanted).select(*keys), keys, "left_semi")


def page(findings: DataFrame, page_no: int = 1, size: int = 100) -> DataFrame:
    """One page ordered by severity, rule, file, line; at most 500 rows."""
    size = min(max(1, size), 500)
    rank = severity_rank(F.col("severity"), 4)
    return (findings.orderBy(rank, "rule_id", "file", "line", "scan_id", "idx")
            .offset((max(1, page_no) - 1) * size).limit(size))


def list_findings(findings: DataFrame, severities: Sequence[str] = (), rule: str = "", file: str = "",
                  limit: int = 20, offset: int = 0) -> DataFrame:
    """Filtered summary rows with total and next offset on every row."""
    out = findings
    if severities:
        out = out.filter(F.lower("severity").isin([s.lower() for s in severities]))
    if rule:
        out = out.filter(F.contains("rule_id", F.lit(rule)))
    if file:
        out = out.filter(F.contains("file", F.lit(file)))
    total = out.agg(F.count(F.lit(1)).alias("total"))
    rows = out.orderBy("scan_id", "idx").offset(offset).limit(limit)
    return (rows.withColumn("total", total.scalar())
            .withColumn("next_offset", F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit))))


def top_by_severity(findings: DataFrame, n: int = 3000) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), "file", "line", "scan_id", "idx").limit(n)


def flow_content(pattern: str, where: str = "any", negate: bool = False, regex: bool = False) -> Column:
    """Findings whose flow (whole, source or sink) holds a text or pattern."""
    def hit(code: Column) -> Column:
        return code.rlike(pattern) if regex else F.contains(code, F.lit(pattern))
    col = {"any": F.exists("steps", lambda s: hit(s["code"])),
           "source": hit(F.element_at("steps", 1)["code"]),
           "sink": hit(F.element_at("steps", -1)["code"])}[where]
    col = F.coalesce(col, F.lit(False))
    return ~col if negate else col


def uncertain() -> Column:
    return F.coalesce(F.exists("steps", lambda s: s["uncertain"]), F.lit(False))


def evidence(findings: DataFrame) -> DataFrame:
    """One row per step with the finding's source and sink beside it."""
    first, last = F.element_at("steps", 1), F.element_at("steps", -1)
    return (findings.select("scan_id", "idx", "rule_id", "cwe", "severity",
                            F.concat_ws(":", first["file"], first["line"].cast("string")).alias("source"),
                            F.concat_ws(":", last["file"], last["line"].cast("string")).alias("sink"),
                            F.posexplode("steps").alias("pos", "step"))
            .select("scan_id", "idx", "rule_id", "cwe", "severity", "source", "sink",
                    (F.col("pos") + 1).alias("step_no"), "step.kind", "step.file", "step.line", "step.code"))


def sources_touched(findings: DataFrame, files: DataFrame, file_cap: int = SOURCE_FILE_CAP,
                    total_cap: int = SOURCES_TOTAL_CAP) -> DataFrame:
    """Files any step refers to, in path order, until the text of a scan reaches the cap.

    ``files(scan_id, file, size, n_chars)``.  The cap is the feature here: a viewer payload.
    """
    wanted = findings.select("scan_id", F.explode("steps").alias("s")).select("scan_id", "s.file").distinct()
    touched = files.filter(F.col("size") <= file_cap).join(wanted, ["scan_id", "file"], "left_semi")
    total = running_sum(touched, ["scan_id"], ["file"], "n_chars", "total_chars")
    return total.filter(F.col("total_chars") <= total_cap)


def exclude_rules(findings: DataFrame, settings: DataFrame) -> DataFrame:
    """Drop rules a project switched off; ``settings(project, rule_id)``."""
    return findings.join(settings.select("project", "rule_id").distinct(), ["project", "rule_id"], "left_anti")


# ---- sinks ------------------------------------------------------------------------------

def write_findings(findings: DataFrame, path: str) -> None:
    """Partitioned by project and scan so review queries prune to one snapshot.

    Rows are ranged on (project, scan, file) first: a task writes few partitions, a huge scan is spread over
    several tasks.  Writing a scan again replaces it; other scans stay.
    """
    (findings.repartitionByRange("project", "scan_id", "file").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("project", "scan_id").parquet(path))


def localized(rows: DataFrame, translations: DataFrame, column: str) -> DataFrame:
    """Exact-text translation with the original as fallback; ``translations(text, translated)``."""
    t = translations.groupBy("text").agg(F.max("translated").alias("_t")).withColumnRenamed("text", column)
    return rows.join(t, column, "left").withColumn(column, F.coalesce("_t", column)).drop("_t")


def csv_rows(findings: DataFrame, states: DataFrame) -> DataFrame:
    """The eleven export columns."""
    joined = findings.join(states.select("scan_id", "idx", "state"), ["scan_id", "idx"], "left")
    safe = {c: csv_safe(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("severity", "cwe", "owasp", "file")}
    return joined.select(
        "scan_id", F.col("idx").alias("no"), safe["severity"], csv_safe(F.col("rule_id")).alias("rule"),
        safe["cwe"], safe["owasp"], safe["file"], "line", csv_safe(F.col("message")).alias("description"),
        F.coalesce("verdict", F.lit("")).alias("verdict"), F.coalesce("state", F.lit("")).alias("audit"),
        F.size("steps").alias("n_steps"))


def write_csv(findings: DataFrame, states: DataFrame, path: str) -> None:
    csv_rows(findings, states).write.mode("overwrite").option("header", True).csv(path)


def sheet_remediation(rule_id: Column) -> Column:
    out = F.lit("")
    for key, text in reversed(list(REMEDIATION_TEXT.items())):
        out = F.when(F.contains(rule_id, F.lit(key)), F.lit(text)).otherwise(out)
    return out


def sheet_rows(findings: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of the 14-column analysis sheet."""
    joined = findings.join(states.select("scan_id", "idx", "state"), ["scan_id", "idx"], "left")
    hint = F.when(F.col("fp_hint"), F.lit(" (env/example signal on the same line — possible false positive, verify)")
                  ).otherwise(F.lit(""))
    verdict = F.when(F.coalesce("verdict", F.lit("")) != "",
                     F.concat(F.lit(" [LLM verdict: "), F.col("verdict"), F.lit("]"))).otherwise(F.lit(""))
    ext = file_ext(F.col("file"))
    bare = F.upper(F.regexp_replace(ext, r"^\.", ""))
    flow = F.array_join(F.transform("steps", lambda s: F.concat(
        F.lit("["), s["kind"], F.lit("] L"), s["line"].cast("string"), F.lit(": "), s["code"])), "\n")
    text = F.when((F.col("category") == "flow") | (F.size("steps") > 1), flow).otherwise(
        F.element_at("steps", 1)["code"])
    cols = {
        "severity": _lookup(SEVERITY_LABEL, F.col("severity"), F.col("severity")),
        "language": _lookup(LANGUAGE_LABEL, ext, F.when(bare == "", F.lit("-")).otherwise(bare)),
        "checker": F.col("rule_id"),
        "line": F.when(F.col("line") > 0, F.col("line").cast("string")).otherwise(F.lit("")),
        "file_name": file_name(F.col("file")),
        "in_scope": F.lit("Y"), "function": F.lit(""), "path": F.col("file"),
        "checker_description": F.concat(F.col("cwe"), F.when(F.coalesce("owasp", F.lit("")) != "", F.concat(
            F.lit(" · "), F.col("owasp"))).otherwise(F.lit(""))),
        "opinion": F.concat(F.col("message"), hint, verdict),
        "done": F.when(F.col("state") == "fixed", F.lit("Y")).otherwise(F.lit("N")),
        "remediation": sheet_remediation(F.col("rule_id")),
        "source_code": text}
    return joined.select("scan_id", (F.col("idx") + 1).alias("id"),
                         *[csv_safe(c).alias(n) for n, c in cols.items()])


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding; rules are numbered in first-seen order within their scan."""
    # the numbers alone: what describes a rule is not moved to be numbered here
    rules = rule_numbers(findings.groupBy("scan_id", "rule_id").agg(F.min("idx").alias("first_idx")))
    level = _lookup(SARIF_LEVEL, F.col("severity"), F.lit("warning"))

    def location(s: Column) -> Column:
        at = F.greatest(F.lit(1), s["line"])
        return F.struct(F.struct(
            F.struct(s["file"].alias("uri")).alias("artifactLocation"),
            F.struct(at.alias("startLine"), at.alias("endLine"),
                     F.struct(s["code"].alias("text")).alias("snippet")).alias("region")).alias("physicalLocation"),
            F.struct(F.concat(s["kind"], F.lit(": "), s["code"]).alias("text")).alias("message"))

    flows = F.array(F.struct(F.array(F.struct(F.transform("steps", lambda s: F.struct(
        location(s).alias("location"))).alias("locations"))).alias("threadFlows")))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(location(F.element_at("steps", -1))).alias("locations"), flows.alias("codeFlows"))
    return (findings.join(rules, ["scan_id", "rule_id"])
            .select("scan_id", "idx", "rule_id", "rule_index", level.alias("level"),
                    F.greatest(F.lit(1), "line").alias("start_line"), F.to_json(result).alias("result")))


def rule_numbers(first: DataFrame) -> DataFrame:
    """``scan_id, rule_id, rule_index`` of the rules of each scan, ordered by ``first_idx``, ties by name as in sarif_rules."""
    ranked = number_in_key(first.select("scan_id", "rule_id", "first_idx"), ["scan_id"], ["first_idx", "rule_id"], "_n")
    return ranked.select("scan_id", "rule_id", (F.col("_n") - 1).alias("rule_index"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules of each scan, 0-based in order of first appearance; rules that appear at the same place by name."""
    first = findings.groupBy("scan_id", "rule_id").agg(
        F.min("idx").alias("first_idx"),
        F.min_by(F.struct("message", "severity", "cwe", "owasp"), "idx").alias("r"))
    ranked = number_in_key(first, ["scan_id"], ["first_idx", "rule_id"], "_n")
    return ranked.select("scan_id", "rule_id", (F.col("_n") - 1).alias("rule_index"), "r.message", "r.severity",
                         "r.cwe", "r.owasp", _lookup(SARIF_LEVEL, F.col("r.severity"), F.lit("warning")).alias("level"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """NDJSON per scan: ``results`` and the ``rules`` their ``ruleIndex`` points to, in that order.

    A scan may hold more findings than one document or task can.
    """
    (sarif_results(findings).select("scan_id", F.col("result").alias("value"))
     .write.mode("overwrite").partitionBy("scan_id").text(f"{path}/results"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("message").alias("text")).alias("shortDescription"),
                    F.struct(F.col("level")).alias("defaultConfiguration"),
                    F.struct("cwe", "owasp", "severity", F.col("rule_index").alias("index")).alias("properties"))
    (sarif_rules(findings).repartition("scan_id").sortWithinPartitions("scan_id", "rule_index")
     .select("scan_id", F.to_json(rule).alias("value")).write.mode("overwrite").partitionBy("scan_id").text(f"{path}/rules"))


def ci_gate(findings: DataFrame, fail_on: str | None = None) -> DataFrame:
    """Exit code per scan: at or above the threshold fails; unset fails on any finding; ``none`` never."""
    if fail_on == "none":
        failed = F.lit(False)
    elif fail_on is None:
        failed = F.count(F.lit(1)) > 0
    else:
        failed = F.bool_or(severity_rank(F.col("severity")) <= severity_rank(F.lit(fail_on)))
    return findings.groupBy("scan_id").agg(F.when(failed, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"))
