"""Flow queries: line items as call facts, and two graphs drawn from the order tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from . import query
from .inputs import TYPE_EXT, _case, _map, table, with_sql
from ..operators.flow import closure, edges as cut, match, resolve, scan, summaries
from ..plans import dimension, durable
from ..sources import rules as rule_files

TYPE_LANG = {"ECONOMY": "python", "SMALL": "typescript", "MEDIUM": "javascript", "LARGE": "php", "STANDARD": "java", "PROMO": "go"}
METHODS = {1: "exec", 2: "length", 3: "trim", 4: "put", 5: "get", 6: "map", 7: "Replace"}
LANGS = sorted(set(TYPE_LANG.values()))


def _line_key():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))


def calls(spark, sf) -> DataFrame:
    """One call per line item; its callee is spelled from the part name and the line number."""
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = l.join(p, l.l_partkey == p.p_partkey)
    lead = F.when(F.col("l_returnflag") == "R", "app::").when(F.col("l_returnflag") == "A", "self.").otherwise("")
    path = F.replace("p_name", F.lit(" "), F.lit("."))
    return j.select(
        _line_key().alias("call_id"),
        _map(TYPE_LANG, F.col("p_type")).alias("lang"), F.concat(lead, path).alias("path"),
        F.concat(lead, path, F.lit("."), _map(METHODS, F.col("l_linenumber"))).alias("callee"),
        F.concat_ws(", ", "p_name", "p_brand").alias("args_text"), (F.col("l_linestatus") == "F").alias("is_statement"),
        F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), _map(TYPE_EXT, F.col("p_type"))).alias("file"),
        F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("l_orderkey").alias("order_key"))


CALLS = f"""calls AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) AS call_id, {_case(TYPE_LANG, 'p_type')} AS lang,
         CASE l_returnflag WHEN 'R' THEN 'app::' WHEN 'A' THEN 'self.' ELSE '' END || replace(p_name, ' ', '.') AS path,
         CASE l_returnflag WHEN 'R' THEN 'app::' WHEN 'A' THEN 'self.' ELSE '' END || replace(p_name, ' ', '.') || '.' ||
         CASE l_linenumber WHEN 1 THEN 'exec' WHEN 2 THEN 'length' WHEN 3 THEN 'trim' WHEN 4 THEN 'put' WHEN 5 THEN 'get' WHEN 6 THEN 'map' ELSE 'Replace' END AS callee,
         replace(p_name, ' ', '.') AS bare, p_name || ', ' || p_brand AS args_text, l_linestatus = 'F' AS is_statement,
         'src/' || replace(p_name, ' ', '/') || {_case(TYPE_EXT, 'p_type')} AS file, p_brand AS brand, p_size AS size, l_orderkey AS order_key
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def nodes(spark, sf) -> DataFrame:
    return calls(spark, sf).select("lang", F.col("call_id").alias("node_id"), "path")


def arguments(spark, sf) -> DataFrame:
    """Receiver (-1) and two arguments per call; the first of small parts is a constant."""
    idx = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("arg_idx")
    rows = calls(spark, sf).select("call_id", "size", idx).withColumn("node_id", F.concat_ws("@", "call_id", F.col("arg_idx").cast("string")))
    return rows.select("call_id", "arg_idx", "node_id", F.when((F.col("arg_idx") == 0) & (F.col("size") <= 40), F.col("size").cast("string")).alias("literal"))


ARGS = "args AS (SELECT call_id, i AS arg_idx, call_id || '@' || i AS node_id FROM calls, (SELECT unnest([-1, 0, 1]) AS i))"

SPECS = [
    {"id": "r.cmd", "languages": ["python", "java", "go"], "severity": "critical", "cwe": "CWE-78",
     "sources": [{"pattern": "member", "object": "small", "property": ["ring", "bolt"]}, {"pattern": "name", "name": ["red.anvil", "blue"]},
                 {"pattern": "annotation", "name": ["1-URGENT"]}, {"pattern": "outparam", "name": ["trim"], "arg": 1}],
     "sinks": [{"callee": ["ring.exec", "widget.exec"], "arg": 0}, {"callee": "exec"}, {"pattern": "return", "decorator": ["app.BUILDING", "MACHINERY"]}],
     "sanitizers": [{"callee": ["Replace"]}, {"callee": ["trim"], "requires": ["Brand#1", "ring"]}], "validators": ["HOUSEHOLD"]},
    {"id": "r.web", "languages": ["javascript", "typescript", "php"], "severity": "high", "cwe": "CWE-79",
     "sources": [{"pattern": "member", "object": "large"}, {"pattern": "name", "name": ["small.bolt"]}, {"pattern": "annotation", "name": ["2-HIGH", "5-LOW"]},
                 {"pattern": "outcopy", "name": ["put"], "arg": 0}],
     "sinks": [{"callee": "map", "arg": 5}, {"callee": ["get"], "arg": 1}, {"pattern": "assign", "property": ["FURNITURE", "MACHINERY"]}],
     "sanitizers": [{"callee": ["anvil.Replace", "length"]}], "validators": ["BUILDING", {"token": ["AUTOMOBILE"]}]},
]


def rule_tables(spark) -> dict[str, DataFrame]:
    return rule_files.flow_rule_tables(spark, SPECS, trust_stored_data=True)


_CMD, _WEB = "('python', 'java', 'go')", "('javascript', 'typescript', 'php')"


def _by_rule(cmd: str, web: str, cols: str, source: str) -> str:
    return (f"SELECT 'r.cmd' AS rule_id, {cols} FROM {source} WHERE lang IN {_CMD} AND ({cmd})\nUNION ALL "
            f"SELECT 'r.web', {cols} FROM {source} WHERE lang IN {_WEB} AND ({web})")


_KINDS = {"r.cmd": (_CMD, 5, 5, 2), "r.web": (_WEB, 5, 4, 2)}


@query("src_rules", with_sql(CALLS, "n AS (SELECT lang, count(*) AS calls FROM calls GROUP BY lang)", select="\nUNION ALL ".join(
    f"SELECT '{rid}' AS rule_id, '{kind}' AS kind, lang, CAST({count} AS BIGINT) AS n, calls FROM n WHERE lang IN {langs}"
    for rid, (langs, *counts) in _KINDS.items() for kind, count in zip(("sources", "sinks", "sanitizers"), counts))))
def src_rules(spark, sf):
    """Rules applied to the languages of the calls: how many patterns of each kind meet how many calls."""
    t = rule_tables(spark)
    by_lang = calls(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("calls"))
    kinds = [t[k].groupBy("rule_id", "lang").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k in ("sources", "sinks", "sanitizers")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).join(by_lang, "lang").select("rule_id", "kind", "lang", "n", "calls")


@query("match_source_member", with_sql(CALLS, select=_by_rule("bare LIKE 'small.%' AND split_part(bare, '.', 2) IN ('ring', 'bolt')", "split_part(bare, '.', 1) = 'large'", "call_id AS node_id", "calls")))
def match_source_member(spark, sf):
    return match.sources_by_member(nodes(spark, sf), rule_tables(spark)["sources"])


@query("match_source_name", with_sql(CALLS, select=_by_rule("bare = 'red.anvil' OR bare LIKE 'red.anvil.%' OR bare = 'blue' OR bare LIKE 'blue.%'", "bare = 'small.bolt' OR bare LIKE 'small.bolt.%'", "call_id AS node_id", "calls")))
def match_source_name(spark, sf):
    return match.sources_by_name(nodes(spark, sf), rule_tables(spark)["sources"])


_ORDER_LANG = "CASE WHEN o_orderstatus = 'F' THEN 'python' WHEN o_orderstatus = 'O' THEN 'php' ELSE 'go' END"


def params(spark, sf) -> DataFrame:
    """Orders as parameters: priority is the annotation, the customer's segment the decorator."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    lang = F.when(F.col("o_orderstatus") == "F", "python").when(F.col("o_orderstatus") == "O", "php").otherwise("go")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        lang.alias("lang"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"), F.lit("param").alias("kind"),
        F.array("o_orderpriority").alias("annotations"), F.array(F.concat(F.lit("web.app."), F.col("c_mktsegment"))).alias("decorators"),
        F.col("c_mktsegment").alias("prop"))


PARAMS = f"params AS (SELECT {_ORDER_LANG} AS lang, 'o' || o_orderkey AS node_id, o_orderpriority AS a, c_mktsegment AS seg FROM orders JOIN customer ON c_custkey = o_custkey)"


@query("match_source_annotation", with_sql(PARAMS, select=_by_rule("a = '1-URGENT'", "a IN ('2-HIGH', '5-LOW')", "node_id", "params")))
def match_source_annotation(spark, sf):
    return match.sources_by_annotation(params(spark, sf), rule_tables(spark)["sources"])


@query("match_source_outparam", with_sql(CALLS, select=f"SELECT 'r.cmd' AS rule_id, call_id || '@1' AS node_id FROM calls WHERE lang IN {_CMD} AND callee LIKE '%.trim'"))
def match_source_outparam(spark, sf):
    return match.sources_by_outparam(calls(spark, sf), arguments(spark, sf), rule_tables(spark)["sources"])


@query("outcopy", with_sql(CALLS, ARGS, select=f"""SELECT 'r.web' AS rule_id, CASE WHEN arg_idx = 0 THEN 'outcopy#r.web#' || call_id || '#0' ELSE node_id END AS src,
  CASE WHEN arg_idx = 0 THEN node_id ELSE 'outcopy#r.web#' || call_id || '#0' END AS dst FROM calls JOIN args USING (call_id) WHERE lang IN {_WEB} AND callee LIKE '%.put'"""))
def outcopy(spark, sf):
    return match.outcopy_edges(calls(spark, sf), arguments(spark, sf), rule_tables(spark)["sources"])


SINKS = f"""sinks AS (SELECT 'r.cmd' AS rule_id, call_id, arg_idx, node_id FROM calls JOIN args USING (call_id) WHERE lang IN {_CMD} AND callee LIKE '%.exec'
    AND CASE WHEN callee LIKE '%ring.exec' OR callee LIKE '%widget.exec' THEN arg_idx = 0 ELSE arg_idx >= 0 END
  UNION ALL SELECT 'r.web', call_id, arg_idx, node_id FROM calls JOIN args USING (call_id) WHERE lang IN {_WEB} AND callee LIKE '%.get' AND arg_idx = 1)"""


@query("match_sink_call", with_sql(CALLS, ARGS, SINKS, select="SELECT * FROM sinks"))
def match_sink_call(spark, sf):
    """A pattern for argument 5 matches no two-argument call."""
    return match.sinks_by_call(calls(spark, sf), arguments(spark, sf), rule_tables(spark)["sinks"])


@query("first_tainted_arg", with_sql(CALLS, ARGS, SINKS, select="SELECT rule_id, call_id, min(arg_idx) AS arg_idx FROM sinks JOIN calls USING (call_id) WHERE brand IN ('Brand#1', 'Brand#2') OR arg_idx = 1 GROUP BY ALL"))
def first_tainted_arg(spark, sf):
    s = match.sinks_by_call(calls(spark, sf), arguments(spark, sf), rule_tables(spark)["sinks"])
    hot = s.join(calls(spark, sf).select("call_id", "brand"), "call_id").filter(F.col("brand").isin("Brand#1", "Brand#2") | (F.col("arg_idx") == 1))
    return match.first_tainted_arg(s, hot.select("rule_id", F.col("node_id").alias("node"))).select("rule_id", "call_id", "arg_idx")


@query("match_sink_return", with_sql(PARAMS, select=f"SELECT 'r.cmd' AS rule_id, node_id FROM params WHERE lang IN {_CMD} AND seg IN ('BUILDING', 'MACHINERY')"))
def match_sink_return(spark, sf):
    return match.sinks_by_return(params(spark, sf), rule_tables(spark)["sinks"])


@query("match_sink_assign", with_sql(PARAMS, select=f"SELECT 'r.web' AS rule_id, node_id FROM params WHERE lang IN {_WEB} AND seg IN ('FURNITURE', 'MACHINERY')"))
def match_sink_assign(spark, sf):
    return match.sinks_by_assign(params(spark, sf).withColumn("kind", F.lit("member_write")), rule_tables(spark)["sinks"])


SANITIZED = f"""sanitized AS (SELECT 'r.cmd' AS rule_id, call_id FROM calls WHERE lang IN {_CMD} AND (callee LIKE '%.Replace' OR callee LIKE '%.trim' AND (contains(args_text, 'Brand#1') OR contains(args_text, 'ring')))
  UNION ALL SELECT 'r.web', call_id FROM calls WHERE lang IN {_WEB} AND (callee LIKE '%.anvil.Replace' OR callee LIKE '%.length'))"""


@query("match_sanitizer", with_sql(CALLS, SANITIZED, select="SELECT * FROM sanitized"))
def match_sanitizer(spark, sf):
    return match.sanitizer_calls(calls(spark, sf), rule_tables(spark)["sanitizers"])


@query("match_receiver_sanitizer", with_sql(CALLS, SANITIZED, select="SELECT rule_id, call_id || '@-1' AS node FROM sanitized JOIN calls USING (call_id) WHERE is_statement"))
def match_receiver_sanitizer(spark, sf):
    c = calls(spark, sf)
    receivers = arguments(spark, sf).filter(F.col("arg_idx") == -1).select("call_id", "node_id")
    return match.receiver_sanitizers(match.sanitizer_calls(c, rule_tables(spark)["sanitizers"]), c, receivers)


LIBRARY = [{"block": {"method": ["length", "get"], "name": ["small.ring.trim"]}, "propagate": {"method": ["trim"]}},
           {"languages": ["java", "go"], "block": {"method": ["map"]}, "propagate": {"name": ["blue.bolt.get", "red.bolt.map"], "method": ["get"]}}]


def library(spark) -> DataFrame:
    rows = rule_files.library_rows(LIBRARY)
    return rule_files.library_model(dimension(spark, rows, "load_order int, kind string, key string, languages array<string>, verdict string"))


VERDICTS = """verdicts AS (SELECT call_id, lang, callee, CASE WHEN callee = 'small.ring.trim' THEN 'block'
  WHEN callee IN ('blue.bolt.get', 'red.bolt.map') AND lang IN ('java', 'go') THEN 'propagate'
  WHEN callee LIKE '%.length' THEN 'block' WHEN callee LIKE '%.get' AND lang IN ('java', 'go') THEN 'propagate'
  WHEN callee LIKE '%.trim' THEN 'propagate' WHEN callee LIKE '%.map' AND lang IN ('java', 'go') THEN 'block' END AS verdict FROM calls)"""


@query("library_verdict", with_sql(CALLS, VERDICTS, select="SELECT call_id, verdict FROM verdicts"))
def library_verdict(spark, sf):
    """``get`` is redefined by the later file for two languages; the earlier entry is gone."""
    return match.library_verdicts(calls(spark, sf), library(spark))


@query("src_library_model", with_sql(CALLS, VERDICTS, select="SELECT lang, coalesce(verdict, 'unknown') AS verdict, count(*) AS n FROM verdicts GROUP BY ALL"))
def src_library_model(spark, sf):
    v = match.library_verdicts(calls(spark, sf), library(spark)).join(calls(spark, sf).select("call_id", "lang"), "call_id")
    return v.groupBy("lang", F.coalesce("verdict", F.lit("unknown")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("uncertain_mark", with_sql(CALLS, VERDICTS, select="SELECT call_id || '@0' AS src, call_id AS dst, verdict IS NULL AS uncertain FROM verdicts WHERE coalesce(verdict, '') <> 'block'"))
def uncertain_mark(spark, sf):
    c = calls(spark, sf)
    e = c.select(F.concat("call_id", F.lit("@0")).alias("src"), F.col("call_id").alias("dst"), "call_id")
    return match.uncertain_edges(e, match.library_verdicts(c, library(spark))).select("src", "dst", "uncertain")


@query("sink_prefilter", with_sql(CALLS, select=f"""SELECT rule_id, file, count(*) AS n FROM (
  SELECT 'r.cmd' AS rule_id, file, callee FROM calls WHERE lang IN {_CMD} AND callee LIKE '%.exec' UNION ALL
  SELECT 'r.web', file, callee FROM calls WHERE lang IN {_WEB} AND (callee LIKE '%.map' OR callee LIKE '%.get')) GROUP BY ALL"""))
def sink_prefilter(spark, sf):
    """Active rules, then per rule the files worth analysing, with their sink-name calls."""
    t, c = rule_tables(spark), calls(spark, sf)
    active = match.active_rules(t["sinks"], c)
    sinks = t["sinks"].join(active, ["rule_id", "lang"], "left_semi")
    none = dimension(spark, [], "rule_id string, name string")
    files = match.interesting_files(c.join(active.select("lang").distinct(), "lang", "left_semi"), sinks, none)
    # a file is analysed for the rules of its language
    named = c.join(active, "lang").withColumn("name", match.last_segment(F.col("callee")))
    want = sinks.filter("callee is not null").select("rule_id", match.last_segment(F.col("callee")).alias("name")).distinct()
    return named.join(files, ["rule_id", "file"], "left_semi").join(want, ["rule_id", "name"], "left_semi").groupBy("rule_id", "file").agg(
        F.count(F.lit(1)).alias("n"))


# ---- call graph: parts are functions, line items call them ---------------------------------

def functions(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.lit("shop").alias("project"), F.concat(F.lit("lib/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.lower("p_type"), F.lit(".py")).alias("file"),
        F.col("p_partkey").cast("string").alias("fn_id"),
        F.when(F.col("p_retailprice") > 1085, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string")))
         .otherwise(F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string"))).alias("name"),
        F.col("p_partkey").cast("int").alias("line"), (F.col("p_size") / 25).cast("int").alias("arity"), (F.col("p_type") == "PROMO").alias("implicit_self"))


FUNCTIONS = """functions AS (SELECT 'lib/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '.py' AS file, lower(replace(p_brand, '#', '')) AS dir, lower(p_type) AS module,
  CAST(p_partkey AS VARCHAR) AS fn_id, CASE WHEN p_retailprice > 1085 THEN replace(p_name, ' ', '_') || p_partkey ELSE replace(p_name, ' ', '_') || '_' || p_size END AS name,
  CAST(p_partkey AS INT) AS line, CAST(trunc(p_size / 25) AS INT) AS arity, p_type = 'PROMO' AS implicit_self FROM part)"""
_LAST = "arg_max(fn_id, (file, line, fn_id))"
ALIASES = f"""aliases AS (
  SELECT '' AS scope, name AS alias, 'bare' AS alias_kind, {_LAST} AS fn_id FROM functions GROUP BY name
  UNION ALL SELECT file, name, 'file', {_LAST} FROM functions GROUP BY file, name
  UNION ALL SELECT '', q, 'qualified', {_LAST} FROM (SELECT *, unnest([module || '.' || name, dir || '.' || module || '.' || name, 'lib.' || dir || '.' || module || '.' || name]) AS q FROM functions) GROUP BY q
  UNION ALL SELECT '', name || '#unique', 'unique', max(fn_id) FROM functions GROUP BY name HAVING count(*) = 1
  UNION ALL SELECT '', name || '#alt' || (row_number() OVER (PARTITION BY name ORDER BY file, line, fn_id) - 1), 'alt', fn_id FROM functions
    WHERE name IN (SELECT name FROM functions GROUP BY name HAVING count(*) BETWEEN 2 AND 4))"""


@query("function_index", with_sql(FUNCTIONS, select="SELECT file, name, count(*) AS n FROM functions GROUP BY ALL"))
def function_index(spark, sf):
    facts = functions(spark, sf).withColumn("kind", F.lit("fn_def"))
    noise = facts.withColumn("kind", F.lit("expr"))
    return resolve.function_index(facts.unionByName(noise)).groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"))


@query("function_alias", with_sql(FUNCTIONS, ALIASES, select="SELECT scope, alias, alias_kind, fn_id FROM aliases"))
def function_alias(spark, sf):
    return resolve.function_aliases(functions(spark, sf)).select("scope", "alias", "alias_kind", "fn_id")


def call_sites(spark, sf) -> DataFrame:
    """Line items as call sites: the caller's file is that of the supplier's brand, the callee is spelled four ways."""
    l, f = table(spark, sf, "lineitem"), functions(spark, sf)
    j = l.join(f, F.col("l_partkey").cast("string") == f.fn_id)
    way = F.col("l_linenumber")
    module = F.regexp_extract("file", r"([a-z]+)\.py$", 1)
    return j.select(
        _line_key().alias("call_id"), "project",
        F.when(F.col("l_returnflag") == "R", F.col("file")).otherwise(F.lit("lib/brand7/promo.py")).alias("file"),
        F.when(way <= 2, F.col("name")).when(way == 3, F.concat_ws(".", module, "name")).when(way <= 5, F.concat(F.lit("obj."), F.col("name")))
         .otherwise(F.concat(F.lit("New."), F.col("name"))).alias("callee"),
        F.col("name").alias("prop"), F.when(way <= 2, "none").when(way <= 5, "ident").otherwise("call").alias("recv_kind"),
        (F.col("l_quantity") / 20).cast("int").alias("nargs"), (way > 3).alias("is_member"))


SITES = """sites AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) AS call_id, CASE WHEN l_returnflag = 'R' THEN file ELSE 'lib/brand7/promo.py' END AS file,
  CASE WHEN l_linenumber <= 2 THEN name WHEN l_linenumber = 3 THEN module || '.' || name WHEN l_linenumber <= 5 THEN 'obj.' || name ELSE 'New.' || name END AS callee, name AS prop,
  CASE WHEN l_linenumber <= 2 THEN 'none' WHEN l_linenumber <= 5 THEN 'ident' ELSE 'call' END AS recv_kind, CAST(trunc(l_quantity / 20) AS INT) AS nargs, l_linenumber > 3 AS is_member
  FROM lineitem JOIN functions ON fn_id = CAST(l_partkey AS VARCHAR))"""
RESOLVED = """candidates AS (
  SELECT call_id, fn_id, 1 AS prio FROM sites s JOIN aliases a ON a.alias_kind = 'file' AND a.scope = s.file AND a.alias = s.callee
  UNION ALL SELECT call_id, fn_id, 2 FROM sites s JOIN aliases a ON a.alias_kind IN ('bare', 'qualified') AND a.alias = s.callee
  UNION ALL SELECT call_id, fn_id, 3 FROM sites s JOIN aliases a ON a.alias_kind = 'file' AND a.scope = s.file AND a.alias = s.prop WHERE recv_kind = 'call'
  UNION ALL SELECT call_id, a.fn_id, 4 FROM sites s JOIN aliases a ON a.alias_kind = 'unique' AND a.alias = regexp_extract(s.callee, '([^.]+)$', 1) || '#unique'
    JOIN functions f ON f.fn_id = a.fn_id WHERE recv_kind = 'ident' AND contains(callee, '.') AND (f.arity - CAST(f.implicit_self AS INT) < 0 OR f.arity - CAST(f.implicit_self AS INT) = nargs)),
resolved AS (SELECT call_id, arg_min(fn_id, prio) AS fn_id, min(prio) AS prio FROM candidates GROUP BY call_id)"""


def resolved(spark, sf) -> DataFrame:
    f = functions(spark, sf)
    return resolve.resolve_calls(call_sites(spark, sf), resolve.function_aliases(f), f)


@query("call_resolve", with_sql(FUNCTIONS, ALIASES, SITES, RESOLVED, select="SELECT call_id, fn_id, prio FROM resolved"))
def call_resolve(spark, sf):
    return resolved(spark, sf)


@query("self_shift", with_sql(FUNCTIONS, ALIASES, SITES, RESOLVED, select="""SELECT r.call_id, r.fn_id AS callee_fn, i + CASE WHEN implicit_self AND is_member THEN 1 ELSE 0 END AS param_idx
FROM resolved r JOIN functions f USING (fn_id) JOIN sites s ON s.call_id = r.call_id, (SELECT unnest([0, 1]) AS i)"""))
def self_shift(spark, sf):
    sites = call_sites(spark, sf)
    args = sites.select("call_id", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("arg_idx")).withColumn("node_id", F.lit(""))
    return resolve.call_arguments(args, resolved(spark, sf), functions(spark, sf), sites).select("call_id", "callee_fn", "param_idx")


@query("alt_promote", with_sql(FUNCTIONS, ALIASES, select="""SELECT name, count(*) AS n FROM functions WHERE name IN (SELECT name FROM functions GROUP BY name HAVING count(*) BETWEEN 2 AND 4)
GROUP BY name HAVING min(arity) = max(arity)"""))
def alt_promote(spark, sf):
    """Homonyms with the same behaviour; here the parameter count stands for the summary."""
    f = functions(spark, sf)
    same = f.select("fn_id", F.lit("r").alias("rule_id"), F.col("arity").cast("string").alias("summary"))
    return resolve.promote_alts(resolve.function_aliases(f), same).select("name", "n")


# ---- derived edges -------------------------------------------------------------------------

@query("edge_mutator", with_sql(CALLS, select="SELECT call_id || '@1' AS src, call_id || '@-1' AS dst FROM calls WHERE callee LIKE '%.put' AND size > 40"))
def edge_mutator(spark, sf):
    return cut.mutator_edges(calls(spark, sf), arguments(spark, sf))


@query("edge_callback", with_sql(CALLS, select="SELECT call_id || '@-1' AS src, 'fn' || call_id AS dst FROM calls WHERE callee LIKE '%.map'"))
def edge_callback(spark, sf):
    c = calls(spark, sf)
    first = c.select("call_id", F.lit(0).alias("param_idx"), F.concat(F.lit("fn"), F.col("call_id")).alias("node_id"))
    return cut.callback_edges(c, arguments(spark, sf), first.unionByName(first.withColumn("param_idx", F.lit(1))))


_SLOTTED = "CASE WHEN size > 40 THEN NULL ELSE CAST(size AS VARCHAR) END"
SLOTS = f"""puts AS (SELECT brand || '#' || path AS container, {_SLOTTED} AS slot, call_id || '@1' AS node_id FROM calls WHERE callee LIKE '%.put'),
gets AS (SELECT brand || '#' || path AS container, {_SLOTTED} AS slot, call_id AS node_id FROM calls WHERE callee LIKE '%.get')"""


def _slots(spark, sf):
    return cut.container_accesses(calls(spark, sf).withColumn("fn_id", F.col("brand")), arguments(spark, sf))


@query("edge_slot", with_sql(CALLS, SLOTS, select="""SELECT g.node_id AS node, count(*) AS n FROM gets g JOIN puts p ON p.container = g.container
  AND (g.slot IS NULL OR p.slot IS NULL OR p.slot = g.slot) GROUP BY 1"""))
def edge_slot(spark, sf):
    """Put x get pairs per get, counted over the hub edges without ever forming a pair."""
    puts, gets = _slots(spark, sf)
    puts, gets = durable(puts), durable(gets)
    e = durable(cut.slot_edges(puts, gets))
    start = puts.select(F.col("node_id").alias("node"), F.lit(1).alias("w"))
    reached = start
    out = None
    for _ in range(4):  # put -> slot/whole -> any -> get
        reached = reached.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("w"))
        hit = reached.join(gets.select(F.col("node_id").alias("node")), "node", "left_semi")
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("node").agg(F.sum("w").cast("long").alias("n"))


PATHS = """defs AS (SELECT brand AS fn_id, bare AS path, call_id AS node_id FROM calls WHERE callee LIKE '%.exec'),
uses AS (SELECT brand AS fn_id, split_part(bare, '.', 1) AS path, call_id AS node_id, false AS const_slot FROM calls WHERE callee LIKE '%.trim'
  UNION ALL SELECT brand, bare || '.x', call_id, true FROM calls WHERE callee LIKE '%.map')"""


def _paths(spark, sf):
    c = calls(spark, sf).withColumn("bare", match.source_path(F.col("path")))
    defs = c.filter(F.endswith("callee", F.lit(".exec"))).select(F.col("brand").alias("fn_id"), F.col("bare").alias("path"), F.col("call_id").alias("node_id"))
    whole = c.filter(F.endswith("callee", F.lit(".trim"))).select(F.col("brand").alias("fn_id"), F.substring_index("bare", ".", 1).alias("path"), F.col("call_id").alias("node_id"), F.lit(False).alias("const_slot"))
    slot = c.filter(F.endswith("callee", F.lit(".map"))).select(F.col("brand").alias("fn_id"), F.concat("bare", F.lit(".x")).alias("path"), F.col("call_id").alias("node_id"), F.lit(True).alias("const_slot"))
    return defs, whole.unionByName(slot)


@query("edge_prefix_path", with_sql(CALLS, PATHS, select="""SELECT u.node_id AS node, count(DISTINCT d.path) AS n FROM uses u JOIN defs d ON d.fn_id = u.fn_id
  AND (u.path = d.path OR starts_with(u.path, d.path || '.') OR (NOT u.const_slot AND starts_with(d.path, u.path || '.'))) GROUP BY 1"""))
def edge_prefix_path(spark, sf):
    """How many tainted places each use can see, by walking the hub edges back one place at a time."""
    defs, uses = _paths(spark, sf)
    e = cut.path_edges(defs, uses)
    places = defs.select(F.concat_ws("#", F.lit("at"), "fn_id", "path").alias("place"), "path").distinct()
    above = places.join(e, F.col("place") == F.col("src")).select(F.col("dst").alias("node"), "path")
    far = above.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "path")
    seen = above.unionByName(far).join(uses.select(F.col("node_id").alias("node")), "node", "left_semi").distinct()
    return seen.groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query("edge_ctor_setter", with_sql(FUNCTIONS, ALIASES, SITES, RESOLVED, select="""SELECT 'r' AS rule_id, r.call_id || '@' || i AS src, r.call_id || '@-1' AS dst FROM resolved r JOIN functions f USING (fn_id)
  JOIN sites s ON s.call_id = r.call_id, (SELECT unnest([0, 1]) AS i) WHERE i + CASE WHEN implicit_self AND is_member THEN 1 ELSE 0 END = 1 AND arity = 1"""))
def edge_ctor_setter(spark, sf):
    """Functions with one parameter keep parameter 1 in a field."""
    sites, f = call_sites(spark, sf), functions(spark, sf)
    args = sites.select("call_id", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("arg_idx")).withColumn(
        "node_id", F.concat_ws("@", "call_id", F.col("arg_idx").cast("string")))
    keeps = f.filter(F.col("arity") == 1).select(F.lit("r").alias("rule_id"), "fn_id", F.lit(1).alias("param_idx"))
    recv = args.filter(F.col("arg_idx") == -1).select("call_id", "node_id")
    return cut.setter_edges(resolve.call_arguments(args, resolved(spark, sf), f, sites), keeps, recv)


@query("edge_self", with_sql(FUNCTIONS, ALIASES, SITES, RESOLVED, select="SELECT 'r' AS rule_id, call_id || '@-1' AS src, call_id AS dst FROM resolved r JOIN functions f USING (fn_id) JOIN sites USING (call_id) WHERE implicit_self AND is_member"))
def edge_self(spark, sf):
    """Methods of one type return their object's state."""
    sites = call_sites(spark, sf).select("call_id", F.when(F.col("is_member"), F.concat("call_id", F.lit("@-1"))).alias("recv_node"), F.col("call_id").alias("ret_node"))
    getters = functions(spark, sf).filter("implicit_self").select(F.lit("r").alias("rule_id"), "fn_id")
    return cut.self_edges(resolved(spark, sf).join(sites, "call_id"), getters)


def _ops(spark, sf) -> DataFrame:
    """Line items as edges with an operator: kind by return flag, operator by line number."""
    l = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    op = F.when(n == 1, "==").when(n == 2, "length").when(n == 3, "!").when(n == 4, "Int").when(n == 5, "+").when(n == 6, "size").otherwise("concat")
    kind = F.when(n.isin(1, 5), "binary").when(n.isin(2, 6), "prop").when(n == 3, "unary").when(n == 4, "cast").otherwise("use")
    return l.select(_line_key().alias("edge"), kind.alias("kind"), op.alias("op"),
                    (F.col("l_tax") > 0.05).alias("numeric"))


@query("cut_value_destroying", "SELECT kind, op, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 5 THEN 'binary' ELSE 'use' END AS kind, CASE WHEN l_linenumber = 5 THEN '+' ELSE 'concat' END AS op FROM lineitem WHERE l_linenumber = 7 OR (l_linenumber = 5 AND NOT l_tax > 0.05)) GROUP BY ALL")
def cut_value_destroying(spark, sf):
    return cut.cut_value_destroying(_ops(spark, sf)).groupBy("kind", "op").agg(F.count(F.lit(1)).alias("n"))


# ---- guards: orders are checks ---------------------------------------------------------------

def _guards(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    form = (F.when(F.col("o_orderpriority") == "1-URGENT", "positive").when(F.col("o_orderpriority") == "2-HIGH", "reject")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "allow_list").when(F.col("o_orderpriority") == "5-LOW", "default").otherwise("null_check"))
    token = F.when(F.col("o_orderpriority") == "1-URGENT", F.when(F.col("c_mktsegment") == "MACHINERY", "s.Replace").otherwise("x.trim")).otherwise(F.col("c_mktsegment"))
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("guard_id"), form.alias("form"), token.alias("token"),
        (F.col("o_orderstatus") == "P").alias("negated"), (F.col("o_orderstatus") == "F").alias("exits"))


GUARDS = """guards AS (SELECT 'g' || o_orderkey AS guard_id, o_orderpriority AS pr, c_mktsegment AS seg, o_orderstatus AS st FROM orders JOIN customer ON c_custkey = o_custkey),
kills AS (SELECT 'r.cmd' AS rule_id, guard_id FROM guards WHERE pr = '1-URGENT' AND st <> 'P'
  UNION ALL SELECT 'r.cmd', guard_id FROM guards WHERE pr = '2-HIGH' AND st = 'F' AND seg = 'HOUSEHOLD'
  UNION ALL SELECT 'r.web', guard_id FROM guards WHERE pr = '2-HIGH' AND st = 'F' AND seg IN ('BUILDING', 'AUTOMOBILE')
  UNION ALL SELECT '*', guard_id FROM guards WHERE (pr = '3-MEDIUM' AND st = 'F') OR pr = '5-LOW')"""


def _kills(spark, sf) -> DataFrame:
    t = rule_tables(spark)
    return cut.guard_kills(_guards(spark, sf), t["sanitizers"], t["validators"])


@query("guard_positive", with_sql(GUARDS, select="SELECT rule_id, guard_id FROM kills JOIN guards USING (guard_id) WHERE pr = '1-URGENT'"))
def guard_positive(spark, sf):
    t = rule_tables(spark)
    return cut.guard_kills(_guards(spark, sf).filter(F.col("form") == "positive"), t["sanitizers"], t["validators"])


@query("guard_reject_exit", with_sql(GUARDS, select="SELECT rule_id, guard_id FROM kills JOIN guards USING (guard_id) WHERE pr IN ('2-HIGH', '3-MEDIUM')"))
def guard_reject_exit(spark, sf):
    t = rule_tables(spark)
    return cut.guard_kills(_guards(spark, sf).filter(F.col("form").isin("reject", "allow_list")), t["sanitizers"], t["validators"])


_EDGES_OF_GUARDS = "lineitem_edges AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) AS edge, 'g' || l_orderkey AS guard_id FROM lineitem)"


def _guarded(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(_line_key().alias("edge"),
                                               F.concat(F.lit("g"), F.col("l_orderkey").cast("string")).alias("guard_id"))


@query("guard_default", with_sql(GUARDS, _EDGES_OF_GUARDS, select="SELECT edge FROM lineitem_edges WHERE guard_id NOT IN (SELECT guard_id FROM kills WHERE rule_id = '*')"))
def guard_default(spark, sf):
    """Edges left after the cuts every rule shares (defaulted values, structural rejects)."""
    return cut.drop_guarded(_guarded(spark, sf), _kills(spark, sf)).select("edge")


@query("cut_const_ternary", with_sql("guards AS (SELECT 'g' || o_orderkey AS guard_id FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED')", _EDGES_OF_GUARDS,
       select="SELECT edge FROM lineitem_edges WHERE guard_id NOT IN (SELECT guard_id FROM guards)"))
def cut_const_ternary(spark, sf):
    t = rule_tables(spark)
    g = _guards(spark, sf).withColumn("form", F.when(F.col("form") == "null_check", "ternary").otherwise("null_check"))
    return cut.drop_guarded(_guarded(spark, sf), cut.guard_kills(g, t["sanitizers"], t["validators"])).select("edge")


@query("const_branch_prune", with_sql("""assigns AS (SELECT l_suppkey AS fn_id, l_partkey AS name, CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS INT) END AS literal FROM lineitem),
single AS (SELECT fn_id, name, max(literal) AS value FROM assigns GROUP BY ALL HAVING count(*) = 1 AND max(literal) IS NOT NULL),
tests AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) AS branch_id, l_suppkey AS fn_id, l_partkey AS name, l_linestatus, l_linenumber * 5 AS lit FROM lineitem)""",
       select="""SELECT branch_id, CASE WHEN l_linestatus = 'F' THEN value > lit ELSE value = lit END AS runs_then FROM tests JOIN single USING (fn_id, name) WHERE fn_id <> 1"""))
def const_branch_prune(spark, sf):
    """Supplier = function, part = variable: assigned once there, its literal decides the branch."""
    l = table(spark, sf, "lineitem")
    fn, name = F.col("l_suppkey").alias("fn_id"), F.col("l_partkey").alias("name")
    assigns = l.select(fn, name, F.when(F.col("l_returnflag") != "A", F.col("l_quantity").cast("int").cast("string")).alias("literal"))
    params = l.filter(F.col("l_suppkey") == 1).select(fn, name)
    branch = _line_key().alias("branch_id")
    tests = l.select(branch, fn, name, F.when(F.col("l_linestatus") == "F", ">").otherwise("==").alias("op"), (F.col("l_linenumber") * 5).cast("string").alias("literal"))
    dead = cut.constant_branches(assigns, params, tests)
    facts = dead.select("branch_id", F.explode(F.array(F.lit("then"), F.lit("else"))).alias("side"))
    return cut.prune_branches(facts, dead).select("branch_id", (F.col("side") == "then").alias("runs_then"))


# ---- closure: customer -> order -> part -> supplier -> customer ------------------------------

def graph(spark, sf) -> dict[str, DataFrame]:
    """Edges over all items; suppliers lead back to customers of the same nation and balance band, through one node for each.

    Equal edges are not removed here: the closure keeps each once when it stores them.
    """
    c, o, l = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    node = lambda k, col: F.concat(F.lit(k), F.col(col).cast("string"))
    no = F.lit(False)
    e = o.select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"), no.alias("uncertain"))
    e = e.unionByName(l.select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst"), (F.col("l_tax") >= 0.06).alias("uncertain")))
    e = e.unionByName(l.select(node("p", "l_partkey").alias("src"), node("s", "l_suppkey").alias("dst"), no.alias("uncertain")))
    band = lambda nation, money: F.concat(F.lit("b"), F.col(nation).cast("string"), F.lit(":"), F.floor(F.col(money) / 100).cast("string"))
    e = e.unionByName(s.select(node("s", "s_suppkey").alias("src"), band("s_nationkey", "s_acctbal").alias("dst"), no.alias("uncertain")))
    e = e.unionByName(c.select(band("c_nationkey", "c_acctbal").alias("src"), node("c", "c_custkey").alias("dst"), no.alias("uncertain")))
    seeds = c.filter(F.col("c_acctbal") < -900).select(F.col("c_mktsegment").alias("rule_id"), node("c", "c_custkey").alias("node"))
    kill = {"MACHINERY": "Brand#2", "BUILDING": "Brand#3", "FURNITURE": "Brand#4", "HOUSEHOLD": "Brand#5", "AUTOMOBILE": "Brand#6"}
    rules = dimension(spark, list(kill.items()), "rule_id string, p_brand string")
    kills = p.join(rules, "p_brand").select("rule_id", node("p", "p_partkey").alias("node"))
    return {"edges": e, "seeds": seeds, "kills": kills}


GRAPH = """all_edges AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, false AS uncertain FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, l_tax >= 0.06 FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, false FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'b' || s_nationkey || ':' || CAST(floor(s_acctbal / 100) AS BIGINT), false FROM supplier
  UNION ALL SELECT 'b' || c_nationkey || ':' || CAST(floor(c_acctbal / 100) AS BIGINT), 'c' || c_custkey, false FROM customer),
edges AS (SELECT src, dst, bool_and(uncertain) AS uncertain FROM all_edges GROUP BY ALL),
seeds AS (SELECT c_mktsegment AS rule_id, 'c' || c_custkey AS node FROM customer WHERE c_acctbal < -900),
kills AS (SELECT rule_id, 'p' || p_partkey AS node FROM part JOIN (VALUES ('MACHINERY', 'Brand#2'), ('BUILDING', 'Brand#3'), ('FURNITURE', 'Brand#4'), ('HOUSEHOLD', 'Brand#5'), ('AUTOMOBILE', 'Brand#6')) t(rule_id, b) ON b = p_brand)"""
REACH = """steps AS (SELECT rule_id, node, 0 AS hop FROM seeds UNION
  SELECT s.rule_id, e.dst, s.hop + 1 FROM steps s JOIN edges e ON e.src = s.node WHERE s.hop < 30 AND NOT EXISTS (SELECT 1 FROM kills k WHERE k.rule_id = s.rule_id AND k.node = e.dst)),
reached AS (SELECT rule_id, node, min(hop) AS hop FROM steps GROUP BY ALL)"""
CERTAIN = """sure_steps AS (SELECT rule_id, node, 0 AS hop FROM seeds UNION
  SELECT s.rule_id, e.dst, s.hop + 1 FROM sure_steps s JOIN edges e ON e.src = s.node WHERE NOT e.uncertain AND s.hop < 30 AND NOT EXISTS (SELECT 1 FROM kills k WHERE k.rule_id = s.rule_id AND k.node = e.dst)),
sure AS (SELECT rule_id, node, min(hop) AS hop FROM sure_steps GROUP BY ALL)"""


def reached(spark, sf) -> DataFrame:
    g = graph(spark, sf)
    return closure.reach(g["seeds"], g["edges"], g["kills"])


@query("taint_reach", with_sql(GRAPH, REACH, select="SELECT rule_id, node, hop FROM reached"))
def taint_reach(spark, sf):
    return reached(spark, sf).select("rule_id", "node", "hop")


@query("trace_build", with_sql(GRAPH, REACH, select="SELECT rule_id, node AS target, hop + 1 AS n_steps, substr(node, 1, 1) AS last_kind FROM reached WHERE node LIKE 's%'"))
def trace_build(spark, sf):
    r = reached(spark, sf)
    steps = closure.trace(r, r.filter(F.startswith("node", F.lit("s"))).select("rule_id", "node"))
    return steps.groupBy("rule_id", "target").agg(F.count(F.lit(1)).alias("n_steps"), F.max_by(F.substring("node", 1, 1), "pos").alias("last_kind")).withColumn(
        "n_steps", F.col("n_steps").cast("int"))


@query("emit_flow_findings", with_sql(GRAPH, REACH, CERTAIN, select="""SELECT r.rule_id, r.node AS target, 'flow into ' || lower(r.rule_id) AS message, s.hop IS NULL OR s.hop > r.hop AS uncertain
FROM reached r LEFT JOIN sure s ON s.rule_id = r.rule_id AND s.node = r.node WHERE r.node LIKE 's%'"""))
def emit_flow_findings(spark, sf):
    r = reached(spark, sf)
    targets = r.filter(F.startswith("node", F.lit("s"))).select("rule_id", F.col("node").alias("target"))
    rules = r.select("rule_id").distinct().withColumn("message", F.concat(F.lit("flow into "), F.lower("rule_id")))
    return closure.emit_findings(targets, r, rules).select("rule_id", "target", "message", "uncertain")


@query("guard_derived", with_sql(GRAPH, """checked AS (SELECT 'g' || s_suppkey AS guard_id, 's' || s_suppkey AS node_id FROM supplier WHERE s_acctbal > 9000),
up AS (SELECT guard_id, node_id, 0 AS hop FROM checked UNION SELECT u.guard_id, e.src, u.hop + 1 FROM up u JOIN edges e ON e.dst = u.node_id WHERE u.hop < 30)""",
       select="SELECT guard_id, node_id, min(hop) AS hop FROM up GROUP BY ALL"))
def guard_derived(spark, sf):
    """All ancestors of checked suppliers."""
    s = table(spark, sf, "supplier").filter(F.col("s_acctbal") > 9000)
    g = s.select(F.concat(F.lit("g"), F.col("s_suppkey").cast("string")).alias("guard_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return cut.derived_guard_nodes(g, graph(spark, sf)["edges"].select("src", "dst"))


# ---- summaries: suppliers are functions, neighbouring lines of an order are calls -------------

def program(spark, sf) -> dict[str, DataFrame]:
    """Parameter i of a supplier's function is line number i; line i of an order calls line i + 1's supplier.

    A supplier's balance decides whether its parameters return (over 5000), hit its sink (9000 and more) or it holds a
    source (under -500).  An edge may be listed twice; whoever walks them drops that."""
    s = table(spark, sf, "supplier")
    l = table(spark, sf, "lineitem").join(s.select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal"), "l_suppkey")
    rule = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("rule_id")
    text = lambda *parts: F.concat(*[F.lit(x) if len(x) == 1 else F.col(x).cast("string") for x in parts])
    rows = l.select(F.col("l_suppkey").cast("string").alias("fn_id"), F.col("l_linenumber").alias("param_idx"), text("p", "l_suppkey", ".", "l_linenumber").alias("node"),
                    text("r", "l_suppkey").alias("ret"), text("k", "l_suppkey").alias("sink"), "l_linestatus", "s_acctbal", (F.col("l_tax") >= 0.07).alias("taxed")).distinct()
    a = l.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("i"), F.col("l_suppkey").alias("s1"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    b = l.select(F.col("l_orderkey").alias("ok"), (F.col("l_linenumber") - 1).alias("i"), F.col("l_suppkey").alias("s2"))
    # equal lines lie together here; every table below reads the calls, so they are kept until these are stored
    c = a.join(b, ["ok", "i"]).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    once = c.select("ok", "i", "s1", "s2").distinct()
    named = F.concat_ws(".", "ok", "i", "s1", "s2").alias("id")
    calls, once = c, once.select("i", "s2", named)
    c = c.select("*", named)
    arg, ret = F.concat(F.lit("a"), F.col("id")), F.concat(F.lit("v"), F.col("id"))
    source = s.filter(F.col("s_acctbal") < -500)
    edges = (rows.filter((F.col("l_linestatus") == "F") & (F.col("s_acctbal") > 5000)).select(F.col("node").alias("src"), F.col("ret").alias("dst"))
             .unionByName(rows.filter(F.col("taxed") & (F.col("s_acctbal") >= 9000)).select(F.col("node").alias("src"), F.col("sink").alias("dst")))
             .unionByName(c.select(F.concat(text("p", "s1", "."), F.col("i").cast("string")).alias("src"), arg.alias("dst")))
             .unionByName(c.filter(F.col("d") > 0.05).select(ret.alias("src"), text("r", "s1").alias("dst")))
             .unionByName(c.filter(F.col("t") < 0.02).select(text("x", "s1").alias("src"), arg.alias("dst")))
             .unionByName(source.select(text("x", "s_suppkey").alias("src"), text("r", "s_suppkey").alias("dst"))))
    return {
        "calls": calls,
        "params": rows.select("fn_id", "param_idx", "node").distinct().select("*", rule),
        "returns": s.select(F.col("s_suppkey").cast("string").alias("fn_id"), text("r", "s_suppkey").alias("node")),
        "edges": edges,
        "call_args": once.select(F.col("s2").cast("string").alias("callee_fn"), (F.col("i") + 1).alias("param_idx"), arg.alias("arg_node"), ret.alias("ret_node")),
        "sinks": s.select(text("k", "s_suppkey").alias("node"), rule),
        "sources": source.select(text("x", "s_suppkey").alias("node"), rule),
        "kills": s.filter(F.col("s_nationkey") < 5).select(F.lit("B").alias("rule_id"), text("r", "s_suppkey").alias("node")),
    }


#: Rounds of the fixpoint that the SQL writes out; it fails if the last one still finds something new.
ROUNDS = 7

PROGRAM = """rules AS (SELECT unnest(['A', 'B']) AS rule_id),
li AS (SELECT l_orderkey AS ok, l_linenumber AS i, l_suppkey AS s, l_discount AS d, l_tax AS t, l_linestatus AS st, s_acctbal AS bal FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
call_rows AS (SELECT DISTINCT a.ok || '.' || a.i || '.' || a.s || '.' || b.s AS id, a.s AS s1, b.s AS s2, a.i AS i, a.d AS d, a.t AS t FROM li a JOIN li b ON b.ok = a.ok AND b.i = a.i + 1),
params AS (SELECT DISTINCT rule_id, CAST(s AS VARCHAR) AS fn_id, i AS param_idx, 'p' || s || '.' || i AS node FROM li, rules),
rets AS (SELECT CAST(s_suppkey AS VARCHAR) AS fn_id, 'r' || s_suppkey AS node FROM supplier),
edges AS MATERIALIZED (SELECT 'p' || s || '.' || i AS src, 'r' || s AS dst FROM li WHERE st = 'F' AND bal > 5000 UNION SELECT 'p' || s || '.' || i, 'k' || s FROM li WHERE t >= 0.07 AND bal >= 9000
  UNION SELECT 'p' || s1 || '.' || i, 'a' || id FROM call_rows UNION SELECT 'v' || id, 'r' || s1 FROM call_rows WHERE d > 0.05
  UNION SELECT 'x' || s1, 'a' || id FROM call_rows WHERE t < 0.02 UNION SELECT 'x' || s_suppkey, 'r' || s_suppkey FROM supplier WHERE s_acctbal < -500),
call_args AS MATERIALIZED (SELECT DISTINCT CAST(s2 AS VARCHAR) AS callee_fn, i + 1 AS param_idx, 'a' || id AS arg_node, 'v' || id AS ret_node FROM call_rows),
sinks AS (SELECT rule_id, 'k' || s_suppkey AS node FROM supplier, rules),
sources AS (SELECT rule_id, 'x' || s_suppkey AS node FROM supplier, rules WHERE s_acctbal < -500),
kills AS (SELECT 'B' AS rule_id, 'r' || s_suppkey AS node FROM supplier WHERE s_nationkey < 5),
cut0 AS (SELECT NULL AS rule_id, NULL AS src, NULL AS dst WHERE false)"""


def _round(k: int) -> str:
    """What parameters reach with the shortcuts of the round before, and the shortcuts that follow."""
    return f"""walk{k} AS (SELECT rule_id, fn_id, param_idx, node FROM params WHERE (rule_id, node) NOT IN (SELECT rule_id, node FROM kills) UNION
  SELECT w.rule_id, w.fn_id, w.param_idx, e.dst FROM walk{k} w JOIN (SELECT rule_id, src, dst FROM edges, rules UNION ALL SELECT rule_id, src, dst FROM cut{k - 1}) e
    ON e.rule_id = w.rule_id AND e.src = w.node LEFT JOIN kills x ON x.rule_id = w.rule_id AND x.node = e.dst WHERE x.node IS NULL),
facts{k} AS MATERIALIZED (SELECT DISTINCT rule_id, fn_id, param_idx FROM walk{k} JOIN rets USING (fn_id, node)),
cut{k} AS MATERIALIZED (SELECT DISTINCT rule_id, arg_node AS src, ret_node AS dst FROM facts{k} f JOIN call_args c ON c.callee_fn = f.fn_id AND c.param_idx = f.param_idx)"""


FIXPOINT = ",\n".join(_round(k) for k in range(1, ROUNDS + 1)) + f""",
settled AS (SELECT CASE WHEN (SELECT count(*) FROM facts{ROUNDS}) <> (SELECT count(*) FROM facts{ROUNDS - 1}) THEN error('more rounds are needed') ELSE 'yes' END AS ok),
facts AS (SELECT f.* FROM facts{ROUNDS} f, settled WHERE ok = 'yes'),
direct AS MATERIALIZED (SELECT DISTINCT w.rule_id, w.fn_id, w.param_idx, w.node AS sink FROM walk{ROUNDS} w JOIN sinks USING (rule_id, node)),
up AS MATERIALIZED (SELECT DISTINCT w.rule_id, c.callee_fn, c.param_idx AS callee_idx, w.fn_id, w.param_idx FROM walk{ROUNDS} w JOIN call_args c ON c.arg_node = w.node),
near AS (SELECT DISTINCT rule_id, fn_id, param_idx, 0 AS hop FROM direct UNION
  SELECT n.rule_id, u.fn_id, u.param_idx, n.hop + 1 FROM near n JOIN up u ON u.rule_id = n.rule_id AND u.callee_fn = n.fn_id AND u.callee_idx = n.param_idx WHERE n.hop < 20),
sinking AS MATERIALIZED (SELECT rule_id, fn_id, param_idx, min(hop) AS hop FROM near GROUP BY ALL)"""
TAINTED = f"""back AS (SELECT DISTINCT node AS src, ret_node AS dst FROM call_args JOIN rets ON fn_id = callee_fn),
moves AS MATERIALIZED (SELECT rule_id, src, dst FROM edges, rules UNION SELECT rule_id, src, dst FROM back, rules UNION SELECT rule_id, src, dst FROM cut{ROUNDS}),
taint AS (SELECT rule_id, node, 0 AS n FROM sources WHERE (rule_id, node) NOT IN (SELECT rule_id, node FROM kills) UNION
  SELECT t.rule_id, e.dst, t.n + 1 FROM taint t JOIN moves e ON e.rule_id = t.rule_id AND e.src = t.node
    LEFT JOIN kills x ON x.rule_id = t.rule_id AND x.node = e.dst WHERE x.node IS NULL AND t.n < 40),
tainted AS MATERIALIZED (SELECT rule_id, node, min(n) AS n FROM taint GROUP BY ALL),
parent AS MATERIALIZED (SELECT d.rule_id, d.node, min(m.src) AS parent FROM tainted d JOIN moves m ON m.rule_id = d.rule_id AND m.dst = d.node
  JOIN tainted a ON a.rule_id = d.rule_id AND a.node = m.src AND a.n + 1 = d.n GROUP BY ALL),
entries AS MATERIALIZED (SELECT DISTINCT t.rule_id, t.node AS entry, callee_fn AS fn_id, param_idx FROM tainted t JOIN call_args ON arg_node = t.node),
outer_back AS (SELECT rule_id, node AS entry, node, node AS path FROM (SELECT rule_id, entry AS node FROM entries UNION SELECT t.rule_id, t.node FROM tainted t JOIN sinks USING (rule_id, node)) UNION ALL
  SELECT b.rule_id, b.entry, p.parent, p.parent || '>' || b.path FROM outer_back b JOIN parent p ON p.rule_id = b.rule_id AND p.node = b.node),
outer_path AS MATERIALIZED (SELECT rule_id, entry, max_by(path, length(path)) AS path FROM outer_back GROUP BY ALL)"""
#: What one function holds of an inner path: the way from its parameter to each argument and sink.
INNER = f"""body AS MATERIALIZED (SELECT rule_id, src, dst FROM edges, rules UNION SELECT rule_id, src, dst FROM cut{ROUNDS}),
inside AS (SELECT rule_id, fn_id, param_idx, node, 0 AS n FROM params WHERE (rule_id, node) NOT IN (SELECT rule_id, node FROM kills) UNION
  SELECT w.rule_id, w.fn_id, w.param_idx, e.dst, w.n + 1 FROM inside w JOIN body e ON e.rule_id = w.rule_id AND e.src = w.node
    LEFT JOIN kills x ON x.rule_id = w.rule_id AND x.node = e.dst WHERE x.node IS NULL AND w.n < 20),
near_inside AS MATERIALIZED (SELECT rule_id, fn_id, param_idx, node, min(n) AS n FROM inside GROUP BY ALL),
inside_parent AS MATERIALIZED (SELECT d.rule_id, d.fn_id, d.param_idx, d.node, min(m.src) AS parent FROM near_inside d JOIN body m ON m.rule_id = d.rule_id AND m.dst = d.node
  JOIN near_inside a ON a.rule_id = d.rule_id AND a.fn_id = d.fn_id AND a.param_idx = d.param_idx AND a.node = m.src AND a.n + 1 = d.n GROUP BY ALL),
links AS MATERIALIZED (SELECT rule_id, w.fn_id, w.param_idx, c.callee_fn, c.param_idx AS callee_idx, count(DISTINCT c.arg_node) AS n_calls, min({{'n': w.n, 'node': w.node}}).node AS node
  FROM near_inside w JOIN call_args c ON c.arg_node = w.node GROUP BY ALL),
inner_back AS (SELECT rule_id, fn_id, param_idx, node AS target, node, node AS path FROM (SELECT rule_id, fn_id, param_idx, node FROM links UNION SELECT rule_id, fn_id, param_idx, sink FROM direct) UNION ALL
  SELECT b.rule_id, b.fn_id, b.param_idx, b.target, p.parent, p.parent || '>' || b.path FROM inner_back b JOIN inside_parent p USING (rule_id, fn_id, param_idx, node)),
inner_path AS MATERIALIZED (SELECT rule_id, fn_id, param_idx, target, max_by(path, length(path)) AS path FROM inner_back GROUP BY ALL),
reaching AS (SELECT rule_id, sink, fn_id, param_idx, 0 AS hop FROM direct UNION
  SELECT r.rule_id, r.sink, u.fn_id, u.param_idx, r.hop + 1 FROM reaching r JOIN up u ON u.rule_id = r.rule_id AND u.callee_fn = r.fn_id AND u.callee_idx = r.param_idx WHERE r.hop < 20),
level AS MATERIALIZED (SELECT rule_id, sink, fn_id, param_idx, min(hop) AS hop FROM reaching GROUP BY ALL),
steps AS (SELECT d.rule_id, d.sink, d.fn_id, d.param_idx, 0 AS hop, CAST(1 AS DOUBLE) AS n_paths, p.path FROM direct d
    JOIN inner_path p ON p.rule_id = d.rule_id AND p.fn_id = d.fn_id AND p.param_idx = d.param_idx AND p.target = d.sink UNION ALL
  SELECT s.rule_id, s.sink, k.fn_id, k.param_idx, s.hop + 1, sum(s.n_paths * k.n_calls), min({{'next': s.fn_id || '#' || s.param_idx, 'path': p.path || '>' || s.path}}).path
  FROM steps s JOIN links k ON k.rule_id = s.rule_id AND k.callee_fn = s.fn_id AND k.callee_idx = s.param_idx
    JOIN level l ON l.rule_id = s.rule_id AND l.sink = s.sink AND l.fn_id = k.fn_id AND l.param_idx = k.param_idx AND l.hop = s.hop + 1
    JOIN inner_path p ON p.rule_id = k.rule_id AND p.fn_id = k.fn_id AND p.param_idx = k.param_idx AND p.target = k.node
  GROUP BY s.rule_id, s.sink, k.fn_id, k.param_idx, s.hop)"""


def _stored_parts(p: dict[str, DataFrame]) -> dict[str, DataFrame]:
    calls = p.pop("calls")
    parts = {k: durable(v) for k, v in p.items()}
    calls.unpersist()
    return parts


def program_summaries(spark, sf):
    p = _stored_parts(program(spark, sf))
    return p, summaries.summarize(p["params"], p["returns"], p["edges"], p["call_args"], p["sinks"], p["kills"])


@query("summaries", with_sql(PROGRAM, FIXPOINT, select="SELECT *, 'return' AS fact FROM facts UNION ALL SELECT rule_id, fn_id, param_idx, 'sink' FROM sinking"))
def summary_facts(spark, sf):
    _, s = program_summaries(spark, sf)
    return s.returns.withColumn("fact", F.lit("return")).unionByName(s.sinks.drop("hop").withColumn("fact", F.lit("sink")))


@query("summary_fixpoint", with_sql(PROGRAM, FIXPOINT, select="SELECT rule_id, hop, count(*) AS facts FROM sinking GROUP BY ALL"))
def summary_fixpoint(spark, sf):
    _, s = program_summaries(spark, sf)
    return s.sinks.groupBy("rule_id", "hop").agg(F.count(F.lit(1)).alias("facts"))


@query("interproc_return", with_sql(PROGRAM, FIXPOINT, select=f"SELECT rule_id, src, dst FROM cut{ROUNDS}, settled WHERE ok = 'yes'"))
def interproc_return(spark, sf):
    _, s = program_summaries(spark, sf)
    return s.shortcuts.select("rule_id", "src", "dst").distinct()


@query("interproc_sink", with_sql(PROGRAM, FIXPOINT, TAINTED, INNER, select="""SELECT rule_id, entry, sink, true AS via_call, o.path || '>' || s.path AS path, CAST(n_paths AS BIGINT) AS n_paths
FROM entries JOIN steps s USING (rule_id, fn_id, param_idx) JOIN outer_path o USING (rule_id, entry)
UNION ALL SELECT t.rule_id, t.node, t.node, false, o.path, 1 FROM tainted t JOIN sinks USING (rule_id, node) JOIN outer_path o ON o.rule_id = t.rule_id AND o.entry = t.node"""))
def interproc_sink(spark, sf):
    """Every sink behind every tainted argument, with the path through caller, calls and callees."""
    p, s = program_summaries(spark, sf)
    _, found = summaries.interprocedural(p["sources"], p["returns"], p["edges"], p["call_args"], p["sinks"], s, p["kills"])
    return found.select("rule_id", "entry", "sink", "via_call", F.array_join("steps", ">").alias("path"), F.col("n_paths").cast("long").alias("n_paths"))


@query("flow_scan", with_sql(PROGRAM, FIXPOINT, f"""moves AS MATERIALIZED (SELECT rule_id, st || src AS src, st || dst AS dst FROM
    (SELECT rule_id, src, dst FROM edges, rules UNION ALL SELECT rule_id, src, dst FROM cut{ROUNDS}) e, (SELECT unnest(['u', 'd']) AS st)
  UNION SELECT rule_id, 'u' || node, 'u' || ret_node FROM call_args JOIN rets ON fn_id = callee_fn, rules
  UNION SELECT rule_id, st || arg_node, 'd' || 'p' || callee_fn || '.' || param_idx FROM call_args, rules, (SELECT unnest(['u', 'd']) AS st)),
flow AS (SELECT rule_id, 'u' || node AS node, 1 AS n FROM sources WHERE (rule_id, node) NOT IN (SELECT rule_id, node FROM kills) UNION
  SELECT f.rule_id, m.dst, f.n + 1 FROM flow f JOIN moves m ON m.rule_id = f.rule_id AND m.src = f.node LEFT JOIN kills x ON x.rule_id = f.rule_id AND x.node = substr(m.dst, 2)
  WHERE x.node IS NULL AND f.n < 40)""", select="""SELECT f.rule_id, substr(f.node, 2) AS sink, min(n) AS n_steps, 'source' AS first_kind, 'sink' AS last_kind, 'flow into ' || lower(f.rule_id) AS message
FROM flow f JOIN sinks k ON k.rule_id = f.rule_id AND k.node = substr(f.node, 2) GROUP BY ALL"""))
def flow_scan(spark, sf):
    """From facts to findings with the steps of every function on the way."""
    p, s = program_summaries(spark, sf)
    nodes = p["edges"].select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().select(
        "node_id", F.lit("f").alias("file"), F.lit(1).alias("line"), F.col("node_id").alias("code"))
    rules = p["sources"].select("rule_id").distinct().withColumn("message", F.concat(F.lit("flow into "), F.lower("rule_id")))
    found = scan.flow_scan(p["sources"], p["params"], p["returns"], p["edges"], p["call_args"], p["sinks"], nodes, rules, p["kills"], summ=s)
    return found.select("rule_id", "sink", F.size("steps").alias("n_steps"), F.element_at("steps", 1)["kind"].alias("first_kind"),
                        F.element_at("steps", -1)["kind"].alias("last_kind"), "message")


# ---- objects: every supplier is a class, its function also has a receiver ----------------------

def object_program(spark, sf) -> dict[str, DataFrame]:
    """``program`` with objects.  A line's tax of 0.03 keeps its parameter in a field; a supplier's nation decides whether
    its receiver returns (10 to 14) or hits the sink (15 to 17).  A function has one object per class it calls; a first line
    constructs it, later lines call its methods."""
    p = program(spark, sf)
    s, l = table(spark, sf, "supplier"), table(spark, sf, "lineitem")
    rule = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("rule_id")
    named = lambda kind, *cols: F.concat(F.lit(kind), F.concat_ws(".", *[F.col(c).cast("string") for c in cols]))
    a = l.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("i"), F.col("l_suppkey").alias("s1"))
    b = l.select(F.col("l_orderkey").alias("ok"), (F.col("l_linenumber") - 1).alias("i"), F.col("l_suppkey").alias("s2"))
    c = a.join(b, ["ok", "i"]).select(F.concat_ws(".", "ok", "i", "s1", "s2").alias("call_id"), "i", F.col("s2").cast("string").alias("fn_id"), named("o", "s1", "s2").alias("object")).distinct()
    ctor = F.col("i") == 1
    objects = c.select("call_id", F.when(~ctor, F.col("object")).alias("recv_node"), F.concat(F.lit("v"), F.col("call_id")).alias("ret_node"), ctor.alias("is_ctor"))
    args = c.select("call_id", F.col("fn_id").alias("callee_fn"), (F.col("i") + 1).alias("param_idx"), F.concat(F.lit("a"), F.col("call_id")).alias("arg_node"))
    receiver, nation = named("t", "s_suppkey"), F.col("s_nationkey")
    edges = (p["edges"]
             .unionByName(l.filter(F.round("l_tax", 2) == 0.03).select(named("p", "l_suppkey", "l_linenumber").alias("src"), named("f", "l_suppkey").alias("dst")).distinct())
             .unionByName(s.filter(nation.between(10, 14)).select(receiver.alias("src"), named("r", "s_suppkey").alias("dst")))
             .unionByName(s.filter(nation.between(15, 17)).select(receiver.alias("src"), named("k", "s_suppkey").alias("dst")))
             .unionByName(c.filter(ctor).select(F.concat(F.lit("v"), F.col("call_id")).alias("src"), F.col("object").alias("dst"))))
    fn = F.col("s_suppkey").cast("string").alias("fn_id")
    return p | {
        "params": p["params"].unionByName(s.select(fn, F.lit(summaries.SELF).alias("param_idx"), receiver.alias("node"), rule)),
        "edges": edges, "fields": s.select(fn, named("f", "s_suppkey").alias("node")),
        "call_args": summaries.object_arguments(args, c.select("call_id", "fn_id"), objects)}


#: Rounds of the fixpoint with objects that the SQL writes out.
OBJECT_ROUNDS = 9

OBJECTS = """oparams AS (SELECT * FROM params UNION ALL SELECT rule_id, CAST(s_suppkey AS VARCHAR), -1, 't' || s_suppkey FROM supplier, rules),
ofields AS (SELECT CAST(s_suppkey AS VARCHAR) AS fn_id, 'f' || s_suppkey AS node FROM supplier),
oedges AS MATERIALIZED (SELECT * FROM edges UNION SELECT 'p' || s || '.' || i, 'f' || s FROM li WHERE round(t, 2) = 0.03
  UNION SELECT 't' || s_suppkey, 'r' || s_suppkey FROM supplier WHERE s_nationkey BETWEEN 10 AND 14 UNION SELECT 't' || s_suppkey, 'k' || s_suppkey FROM supplier WHERE s_nationkey BETWEEN 15 AND 17
  UNION SELECT 'v' || id, 'o' || s1 || '.' || s2 FROM call_rows WHERE i = 1),
ocalls AS MATERIALIZED (SELECT DISTINCT CAST(s2 AS VARCHAR) AS callee_fn, i + 1 AS param_idx, 'a' || id AS arg_node, 'v' || id AS ret_node,
    CASE WHEN i = 1 THEN 'v' || id ELSE 'o' || s1 || '.' || s2 END AS self_node FROM call_rows
  UNION SELECT CAST(s2 AS VARCHAR), -1, 'o' || s1 || '.' || s2, 'v' || id, NULL FROM call_rows WHERE i <> 1),
ocut0 AS (SELECT NULL AS rule_id, NULL AS src, NULL AS dst WHERE false)"""


def _object_round(k: int) -> str:
    return f"""owalk{k} AS (SELECT rule_id, fn_id, param_idx, node FROM oparams WHERE (rule_id, node) NOT IN (SELECT rule_id, node FROM kills) UNION
  SELECT w.rule_id, w.fn_id, w.param_idx, e.dst FROM owalk{k} w JOIN (SELECT rule_id, src, dst FROM oedges, rules UNION ALL SELECT rule_id, src, dst FROM ocut{k - 1}) e
    ON e.rule_id = w.rule_id AND e.src = w.node LEFT JOIN kills x ON x.rule_id = w.rule_id AND x.node = e.dst WHERE x.node IS NULL),
ofacts{k} AS MATERIALIZED (SELECT DISTINCT rule_id, fn_id, param_idx, 'return' AS kind FROM owalk{k} JOIN rets USING (fn_id, node)
  UNION ALL SELECT DISTINCT rule_id, fn_id, param_idx, 'keep' FROM owalk{k} JOIN ofields USING (fn_id, node) WHERE param_idx >= 0),
ocut{k} AS MATERIALIZED (SELECT DISTINCT rule_id, kind, arg_node AS src, CASE kind WHEN 'return' THEN ret_node ELSE self_node END AS dst
  FROM ofacts{k} f JOIN ocalls c ON c.callee_fn = f.fn_id AND c.param_idx = f.param_idx WHERE kind = 'return' OR self_node IS NOT NULL)"""


OBJECT_FIXPOINT = ",\n".join(_object_round(k) for k in range(1, OBJECT_ROUNDS + 1)) + f""",
osettled AS (SELECT CASE WHEN (SELECT count(*) FROM ofacts{OBJECT_ROUNDS}) <> (SELECT count(*) FROM ofacts{OBJECT_ROUNDS - 1}) THEN error('more rounds are needed') ELSE 'yes' END AS ok),
odirect AS MATERIALIZED (SELECT DISTINCT w.rule_id, w.fn_id, w.param_idx FROM owalk{OBJECT_ROUNDS} w JOIN sinks USING (rule_id, node)),
oup AS MATERIALIZED (SELECT DISTINCT w.rule_id, c.callee_fn, c.param_idx AS callee_idx, w.fn_id, w.param_idx FROM owalk{OBJECT_ROUNDS} w JOIN ocalls c ON c.arg_node = w.node),
onear AS (SELECT rule_id, fn_id, param_idx FROM odirect UNION SELECT u.rule_id, u.fn_id, u.param_idx FROM onear n JOIN oup u ON u.rule_id = n.rule_id AND u.callee_fn = n.fn_id AND u.callee_idx = n.param_idx)"""


def object_summaries(spark, sf):
    p = _stored_parts(object_program(spark, sf))
    return p, summaries.summarize(p["params"], p["returns"], p["edges"], p["call_args"], p["sinks"], p["kills"], fields=p["fields"])


@query("summary_receivers", with_sql(PROGRAM, OBJECTS, OBJECT_FIXPOINT, select=f"""SELECT rule_id, fn_id, param_idx, kind AS fact FROM ofacts{OBJECT_ROUNDS}, osettled WHERE ok = 'yes'
UNION ALL SELECT rule_id, fn_id, param_idx, 'sink' FROM onear"""))
def summary_receivers(spark, sf):
    """Facts about parameters and receivers (-1): returned, kept in a field, reaching a sink."""
    _, s = object_summaries(spark, sf)
    return (s.returns.withColumn("fact", F.lit("return")).unionByName(s.keeps.withColumn("fact", F.lit("keep")))
            .unionByName(s.sinks.drop("hop").withColumn("fact", F.lit("sink"))))


@query("summary_setters", with_sql(PROGRAM, OBJECTS, OBJECT_FIXPOINT, select=f"SELECT DISTINCT rule_id, src, dst FROM ocut{OBJECT_ROUNDS}, osettled WHERE ok = 'yes' AND kind = 'keep'"))
def summary_setters(spark, sf):
    """Setter and constructor edges that follow from the summaries."""
    p, s = object_summaries(spark, sf)
    at = p["call_args"].filter(F.col("self_node").isNotNull()).withColumn("call_id", F.col("arg_node"))
    return cut.setter_edges(at, s.keeps, at.select("call_id", F.col("self_node").alias("node_id")))


@query("summary_getters", with_sql(PROGRAM, OBJECTS, OBJECT_FIXPOINT, select=f"SELECT DISTINCT rule_id, src, dst FROM ocut{OBJECT_ROUNDS}, osettled WHERE ok = 'yes' AND kind = 'return' AND src LIKE 'o%'"))
def summary_getters(spark, sf):
    """Getter edges that follow from the summaries."""
    p, s = object_summaries(spark, sf)
    at = p["call_args"].filter(F.col("param_idx") == summaries.SELF)
    return cut.self_edges(at.select(F.col("callee_fn").alias("fn_id"), F.col("arg_node").alias("recv_node"), "ret_node"), s.self_returns)


@query("flow_scan_objects", with_sql(PROGRAM, OBJECTS, OBJECT_FIXPOINT, f"""omoves AS MATERIALIZED (SELECT rule_id, st || src AS src, st || dst AS dst FROM
    (SELECT rule_id, src, dst FROM oedges, rules UNION ALL SELECT rule_id, src, dst FROM ocut{OBJECT_ROUNDS}) e, (SELECT unnest(['u:', 'd:']) AS st)
  UNION SELECT rule_id, 'u:' || node, 'u:' || ret_node FROM ocalls JOIN rets ON fn_id = callee_fn, rules
  UNION SELECT rule_id, st || arg_node, 'd:' || CASE ocalls.param_idx WHEN -1 THEN 't' || callee_fn ELSE 'p' || callee_fn || '.' || ocalls.param_idx END FROM ocalls JOIN
    (SELECT DISTINCT fn_id, param_idx FROM oparams) q ON q.fn_id = callee_fn AND q.param_idx = ocalls.param_idx, rules, (SELECT unnest(['u:', 'd:']) AS st)),
oflow AS (SELECT rule_id, 'u:' || node AS node, 1 AS n FROM sources WHERE (rule_id, node) NOT IN (SELECT rule_id, node FROM kills) UNION
  SELECT f.rule_id, m.dst, f.n + 1 FROM oflow f JOIN omoves m ON m.rule_id = f.rule_id AND m.src = f.node LEFT JOIN kills x ON x.rule_id = f.rule_id AND x.node = substr(m.dst, 3)
  WHERE x.node IS NULL AND f.n < 40),
oseen AS MATERIALIZED (SELECT rule_id, node, min(n) AS n FROM oflow GROUP BY ALL),
osteps AS MATERIALIZED (SELECT m.rule_id, m.src, m.dst, a.n + 1 AS n FROM omoves m JOIN oseen a ON a.rule_id = m.rule_id AND a.node = m.src),
oparent AS MATERIALIZED (SELECT d.rule_id, d.node, min(m.src) AS parent FROM oseen d JOIN osteps m ON m.rule_id = d.rule_id AND m.dst = d.node AND m.n = d.n GROUP BY ALL),
oends AS (SELECT s.rule_id, k.node AS sink, min({{'n': n, 'node': s.node}}) AS b FROM oseen s JOIN sinks k ON k.rule_id = s.rule_id AND k.node = substr(s.node, 3) GROUP BY ALL),
oback AS (SELECT rule_id, sink, b.node AS node, substr(b.node, 3) AS path FROM oends UNION ALL
  SELECT b.rule_id, b.sink, p.parent, substr(p.parent, 3) || '>' || b.path FROM oback b JOIN oparent p ON p.rule_id = b.rule_id AND p.node = b.node)""",
       select="SELECT rule_id, sink, max_by(path, length(path)) AS path, CAST(false AS BOOLEAN) AS uncertain FROM oback GROUP BY ALL"))
def flow_scan_objects(spark, sf):
    """Flows through constructors, setters, getters and ``object.run()``, with the whole path of each."""
    p, s = object_summaries(spark, sf)
    nodes = p["edges"].select(F.explode(F.array("src", "dst")).alias("node_id")).unionByName(p["params"].select(F.col("node").alias("node_id")))
    objects = p["call_args"].select(F.explode(F.array("arg_node", "ret_node", "self_node")).alias("node_id")).filter(F.col("node_id").isNotNull())
    nodes = nodes.unionByName(objects).distinct().select(
        "node_id", F.lit("f").alias("file"), F.lit(1).alias("line"), F.col("node_id").alias("code"))
    rules = p["sources"].select("rule_id").distinct().withColumn("message", F.lit("flow"))
    found = scan.flow_scan(p["sources"], p["params"], p["returns"], p["edges"], p["call_args"], p["sinks"], nodes, rules, p["kills"], summ=s)
    return found.select("rule_id", "sink", F.array_join(F.transform("steps", lambda x: x["code"]), ">").alias("path"), "uncertain")


@query("summary_resume", with_sql(PROGRAM, OBJECTS, OBJECT_FIXPOINT, select=f"SELECT rule_id, fn_id, param_idx, kind AS fact FROM ofacts{OBJECT_ROUNDS}, osettled WHERE ok = 'yes'"))
def summary_resume(spark, sf):
    """The fixpoint without the calls of even line numbers, then resumed with them: the facts of all calls at once."""
    p = _stored_parts(object_program(spark, sf))
    even = F.element_at(F.split(F.substr("ret_node", F.lit(2)), r"\."), 2).cast("int") % 2 == 0
    first, rest = p["call_args"].filter(~even), p["call_args"].filter(even)
    base = summaries.summarize(p["params"], p["returns"], p["edges"], first, p["sinks"], p["kills"], fields=p["fields"])
    s = summaries.summarize(p["params"], p["returns"], p["edges"], first, p["sinks"], p["kills"], fields=p["fields"], before=base, new_calls=rest)
    return s.returns.withColumn("fact", F.lit("return")).unionByName(s.keeps.withColumn("fact", F.lit("keep")))


# ---- rule overlays ---------------------------------------------------------------------------

@query("rule_overlay", """WITH shipped AS (SELECT p_name AS id, min(p_type) AS severity, min(p_brand) AS message, [min(p_type), min(p_brand)] AS sinks FROM part GROUP BY p_name),
users AS (SELECT p_name || CASE WHEN p_size > 49 THEN ' own' ELSE '' END AS id, min(p_type) FILTER (WHERE p_size > 30) AS severity, max(p_brand) AS b, min(p_size) = 1 AS rep FROM part WHERE p_type <> 'PROMO' GROUP BY 1)
SELECT id, CASE WHEN rep THEN u.severity ELSE coalesce(u.severity, s.severity) END AS severity, CASE WHEN rep THEN NULL ELSE s.message END AS message,
  array_to_string(CASE WHEN u.id IS NULL THEN s.sinks WHEN rep OR s.id IS NULL THEN [b] WHEN list_contains(s.sinks, b) THEN s.sinks ELSE list_append(s.sinks, b) END, ',') AS sinks
FROM shipped s FULL JOIN users u USING (id)""")
def rule_overlay(spark, sf):
    p = table(spark, sf, "part")
    shipped = p.groupBy(F.col("p_name").alias("id")).agg(F.min("p_type").alias("severity"), F.min("p_brand").alias("message"),
                                                         F.array(F.min("p_type"), F.min("p_brand")).alias("sinks"))
    own = F.concat("p_name", F.when(F.col("p_size") > 49, " own").otherwise(""))
    user = (p.filter(F.col("p_type") != "PROMO").groupBy(own.alias("id")).agg(
        F.min(F.when(F.col("p_size") > 30, F.col("p_type"))).alias("severity"), F.array(F.max("p_brand")).alias("sinks"), (F.min("p_size") == 1).alias("replace"))
        .withColumn("message", F.lit(None).cast("string")))
    return rule_files.overlay(shipped, user, ["severity", "message"], ["sinks"]).withColumn("sinks", F.array_join("sinks", ","))


#: What each line number reads: names of the shipped list of one or more languages, and one of none.
READS = {1: "getString", 2: "fetch", 3: "readString", 4: "os.ReadFile", 5: "fs.readFile.x", 6: "mysqli_fetch_row", 7: "readAllBytesX"}


@query("store_sources", with_sql(CALLS, select="""SELECT rule_id, lang, count(*) AS n FROM (
  SELECT 'r.cmd' AS rule_id, lang FROM calls WHERE lang = 'java' AND (callee LIKE '%.exec' OR callee LIKE '%.trim')
  UNION ALL SELECT 'r.cmd', lang FROM calls WHERE lang = 'go' AND callee LIKE '%.put'
  UNION ALL SELECT 'r.web', lang FROM calls WHERE lang = 'php' AND (callee LIKE '%.length' OR callee LIKE '%.map')
  UNION ALL SELECT 'r.web', lang FROM calls WHERE lang IN ('javascript', 'typescript') AND callee LIKE '%.get') GROUP BY ALL"""))
def store_sources(spark, sf):
    """Stored-data reads of the shipped list become sources of the rules of their language."""
    t = rule_tables(spark)
    every = rule_files.with_store_sources(t["sources"].filter(F.lit(False)), t["rules"], rule_files.store_source_table(spark))
    method = {METHODS[k]: v for k, v in READS.items()}
    n = calls(spark, sf).select("lang", F.col("call_id").alias("node_id"), _map(method, match.last_segment(F.col("callee"))).alias("path"))
    hit = match.sources_by_name(n, every).join(n.select("node_id", "lang"), "node_id")
    return hit.groupBy("rule_id", "lang").agg(F.count(F.lit(1)).alias("n"))
