"""Hub tables derived from the shared tables, once in Spark and once in SQL.

scan = order, project = customer, finding = line item, rule / file / CWE from its part,
severity from its discount, review log from the event table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identity import fingerprint
from ..plans import spread
from ..sources.corpus import split_lines

#: part brand -> CWE of its findings
BRAND_CWE = {i: c for i, c in enumerate([
    "CWE-89", "CWE-94", "CWE-22", "CWE-79", "CWE-78", "CWE-434", "CWE-601", "CWE-611", "CWE-643", "CWE-90",
    "CWE-352", "CWE-918", "CWE-120", "CWE-134", "CWE-327", "CWE-359", "CWE-798", "CWE-338", "CWE-522",
    "CWE-295", "CWE-1004", "CWE-615", "", "CWE-489", "CWE-1395"], start=1)}
TYPE_RULE = {"ECONOMY": "py.sqli", "SMALL": "vendor.github-token", "MEDIUM": "web.document-write",
             "LARGE": "pii.email-address", "STANDARD": "java.xss", "PROMO": "sca.vulnerable-dependency"}
TYPE_EXT = {"ECONOMY": ".py", "SMALL": ".ts", "MEDIUM": ".js", "LARGE": ".txt", "STANDARD": ".java", "PROMO": ".go"}
TYPE_CATEGORY = {"ECONOMY": "flow", "SMALL": "secret", "MEDIUM": "config", "LARGE": "pii", "STANDARD": "flow",
                 "PROMO": "dependency"}
EVENT_STATE = {"signup": "", "purchase": "confirmed", "error": "false_positive", "view": "deferred", "click": "fixed"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # the fact tables of a small run come as one row group: use all cores on them
    return spread(df) if name in ("lineitem", "orders") else df


def _map(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _case(values: dict, key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def scans(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("scan_id"), F.col("c_name").alias("project"),
        F.concat("c_name", F.lit("-v"), F.year("o_orderdate").cast("string"), F.lit(".zip")).alias("name"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("sca"),
        F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"))


SCANS = """scans AS (
  SELECT o_orderkey AS scan_id, c_name AS project,
         c_name || '-v' || CAST(year(o_orderdate) AS VARCHAR) || '.zip' AS name,
         o_orderdate AS created_at, o_orderstatus = 'F' AS sca, o_orderpriority AS priority, c_mktsegment AS segment
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = l.join(p, l.l_partkey == p.p_partkey)
    ext = _map(TYPE_EXT, F.col("p_type"))
    rule = F.concat(_map(TYPE_RULE, F.col("p_type")), F.lit("."), F.substring_index("p_name", " ", 1))
    file = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), ext)
    code = F.concat(F.lower("p_type"), F.lit(" ( "), F.col("p_name"), F.lit(" )"))
    d = F.col("l_discount")
    severity = (F.when(d >= 0.09, "critical").when(d >= 0.07, "high").when(d >= 0.04, "medium")
                .when(d >= 0.02, "low").otherwise("info"))
    rows = j.select(
        F.col("l_orderkey").alias("scan_id"),
        line_idx().alias("idx"),
        rule.alias("rule_id"), F.concat(F.lit("Issue in "), F.col("p_name")).alias("message"), severity.alias("severity"),
        _map(BRAND_CWE, F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")).alias("cwe"),
        F.lit("").alias("owasp"), file.alias("file"), F.col("l_linenumber").alias("line"),
        _map(TYPE_CATEGORY, F.col("p_type")).alias("category"), code.alias("code"),
        F.when(F.col("l_linestatus") == "F", "true_positive").otherwise("").alias("verdict"),
        (F.col("l_returnflag") == "N").alias("fp_hint"), (F.col("l_returnflag") == "A").alias("uncertain"),
        F.concat(F.lit("lib/s"), F.col("l_suppkey").cast("string"), ext).alias("source_file"),
        F.col("l_suppkey").alias("supplier"))
    step = lambda kind, f, line, c, u: F.struct(F.lit(kind).alias("kind"), f.alias("file"), line.cast("int").alias("line"),
                                                c.alias("code"), u.alias("uncertain"))
    return (rows.withColumn("fp", fingerprint(F.col("rule_id"), F.col("file"), F.col("code")))
            .withColumn("steps", F.array(
                step("source", F.col("source_file"), F.lit(1), F.concat(F.lit("read_"), F.col("supplier").cast("string")), F.col("uncertain")),
                step("sink", F.col("file"), F.col("line"), F.col("code"), F.lit(False)))))


def line_idx() -> Column:
    """Number of a line item inside its order."""
    base = (F.col("l_partkey") * 1000000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    return base * 100 + F.col("l_quantity").cast("long")


LINE_IDX = "(((l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT))"
_BRAND = "CASE CAST(substr(p_brand, 7) AS INT) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in BRAND_CWE.items()) + " END"
FINDINGS = f"""raw_findings AS (
  SELECT l_orderkey AS scan_id, {LINE_IDX} AS idx,
         {_case(TYPE_RULE, 'p_type')} || '.' || split_part(p_name, ' ', 1) AS rule_id,
         'Issue in ' || p_name AS message,
         CASE WHEN l_discount >= 0.09 THEN 'critical' WHEN l_discount >= 0.07 THEN 'high'
              WHEN l_discount >= 0.04 THEN 'medium' WHEN l_discount >= 0.02 THEN 'low' ELSE 'info' END AS severity,
         {_BRAND} AS cwe, '' AS owasp,
         'src/' || replace(p_name, ' ', '/') || {_case(TYPE_EXT, 'p_type')} AS file, l_linenumber AS line,
         {_case(TYPE_CATEGORY, 'p_type')} AS category,
         lower(p_type) || ' ( ' || p_name || ' )' AS code,
         CASE WHEN l_linestatus = 'F' THEN 'true_positive' ELSE '' END AS verdict,
         l_returnflag = 'N' AS fp_hint, l_returnflag = 'A' AS uncertain,
         'lib/s' || l_suppkey || {_case(TYPE_EXT, 'p_type')} AS source_file, l_suppkey AS supplier
  FROM lineitem JOIN part ON p_partkey = l_partkey),
findings AS (
  SELECT *, substr(sha1(rule_id || '|' || file || '|' || replace(code, ' ', '')), 1, 16) AS fp FROM raw_findings)"""

RANK = ("CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 "
        "WHEN 'info' THEN 4 ELSE 9 END")


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events hit the finding at line ``k`` of scan ``user_id``; others point at no finding."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    l = table(spark, sf, "lineitem")
    j = e.join(l, (e.user_id == l.l_orderkey) & (e.k == l.l_linenumber), "left")
    return j.select(F.col("user_id").alias("scan_id"), F.coalesce(line_idx(), -F.col("k").cast("long") - 1).alias("idx"),
                    _map(EVENT_STATE, F.col("event_type")).alias("after"), F.col("ts").alias("at"),
                    F.col("event_id").alias("id"), "event_type", "props")


AUDIT = f"""audit_events AS (
  SELECT user_id AS scan_id,
         coalesce({LINE_IDX}, -k - 1) AS idx,
         {_case(EVENT_STATE, 'event_type')} AS after, ts AS "at", event_id AS id, event_type, props
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
  LEFT JOIN lineitem ON l_orderkey = user_id AND l_linenumber = k)"""

STATES = """states AS (
  SELECT scan_id, idx, arg_max(after, ("at", id)) AS state FROM audit_events GROUP BY ALL
  HAVING arg_max(after, ("at", id)) <> '')"""


def states(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.lifecycle import audit_state
    return audit_state(audit_events(spark, sf))


def audit_notes(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.lifecycle import audit_notes as latest
    return latest(raw_notes(spark, sf))


def raw_notes(spark: SparkSession, sf: str) -> DataFrame:
    return audit_events(spark, sf).select("scan_id", "idx", "at", "id", F.when(
        F.col("event_type") == "click", F.lit("  ")).otherwise(F.concat(F.lit(" seen "), F.col("props"), F.lit(" "))).alias("note"))


NOTES = """raw_notes AS (
  SELECT scan_id, idx, "at", id, CASE WHEN event_type = 'click' THEN '  ' ELSE ' seen ' || props || ' ' END AS note
  FROM audit_events),
notes AS (
  SELECT scan_id, idx, trim(arg_max(note, ("at", id))) AS note FROM raw_notes GROUP BY ALL
  HAVING trim(arg_max(note, ("at", id))) <> '')"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the files of a corpus: language unknown to the rules, one project per source."""
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    return d.select(F.col("source").alias("project"), F.concat(
        "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.lit(None).cast("string").alias("lang"), F.lit(".txt").alias("ext"), F.col("lang").alias("tongue"), "doc_id", "text")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    p = spread(table(spark, sf, "pages").select("page_id", "html"))
    return p.select(F.lit("web").alias("project"), F.concat(
        F.lit("page/"), F.col("page_id").cast("string"), F.lit(".js")).alias("file"),
        F.lit("javascript").alias("lang"), F.lit(".js").alias("ext"), F.col("html").alias("text"))


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return split_lines(documents(spark, sf))


DOCS = r"""docs AS (
  SELECT source AS project, lang || '/' || doc_id || '.txt' AS file, lang AS tongue, doc_id, text FROM documents),
page_files AS (SELECT 'web' AS project, 'page/' || page_id || '.js' AS file, html AS text FROM pages)"""


def lines_sql(name: str, source: str, keep: str = "project, file") -> str:
    """CTE of 1-based lines; a line end at the very end opens no further line."""
    end = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    return f"""{name}_parts AS (
  SELECT {keep}, string_split_regex(regexp_replace(text, '(?:{end})$', ''), '{end}') AS parts FROM {source} WHERE length(text) > 0),
{name} AS (
  SELECT {keep}, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM {name}_parts)"""


def with_sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select
