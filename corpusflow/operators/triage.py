"""Review support: clusters, prompts, verdict hand-back, entry hints, judging of observations."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import file_name, squeezed
from ..plans import carry_last, number_in_key
from ..tables import remedies
from .standards import remediation_key

#: Fixed values.
BATCH = 5
CONTEXT_LINES = 6
VERDICTS = ("true_positive", "false_positive", "uncertain")

# ---- fixed values: shapes of route registrations and function starts ---------------------
ROUTE = (r"(?i)\.(get|post|put|delete|patch|any|all|head|options|handle|handlefunc)\s*\(\s*"
         r"(?:['\"](GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)['\"]\s*,\s*)?['\"]([^'\"]+)['\"]")
FUNCTION_START = (r"(?:func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(|function\s+(\w+)\s*\(|"
                  r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(|def\s+(\w+)\s*\()")
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
# ---- end of fixed values -----------------------------------------------------------------


def cluster_key(findings: DataFrame) -> DataFrame:
    code = squeezed(F.coalesce(F.element_at("steps", -1)["code"], F.lit("")))
    return findings.withColumn("cluster", F.sha1(F.concat_ws("|", "rule_id", code)))


def clusters(findings: DataFrame, keyed: bool = False) -> DataFrame:
    """One representative (smallest idx) per rule and sink code, with the member count; ``keyed`` rows have their ``cluster``."""
    return (findings if keyed else cluster_key(findings)).groupBy("scan_id", "rule_id", "cluster").agg(
        F.min("idx").alias("idx"), F.count(F.lit(1)).alias("members"))


def batches(representatives: DataFrame, size: int = BATCH) -> DataFrame:
    """Representatives in numbered batches, in order of first appearance."""
    ranked = number_in_key(representatives, [], ["scan_id", "idx", "cluster"], "_n")
    return ranked.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def prompts(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Rule, flow and a few source lines around the first and the last step.

    The line range is exploded to single line numbers, so context is an equi-join on (file, line).
    """
    first, last = F.element_at("steps", 1), F.element_at("steps", -1)
    half = CONTEXT_LINES // 2
    spots = F.array_distinct(F.array(F.struct(first["file"].alias("file"), first["line"].alias("at")),
                                     F.struct(last["file"].alias("file"), last["line"].alias("at"))))
    want = (findings.select("scan_id", "idx", F.posexplode(spots).alias("spot", "s"))
            .select("scan_id", "idx", "spot", "s.file", F.explode(
                F.sequence(F.greatest(F.lit(1), F.col("s.at") - half), F.col("s.at") + half)).alias("line_no")))
    context = (want.join(lines.select("file", "line_no", "line"), ["file", "line_no"])
               .groupBy("scan_id", "idx", "spot", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                   F.struct("line_no", "line"))), lambda x: F.concat(
                       F.lpad(x["line_no"].cast("string"), 5, " "), F.lit("| "), x["line"])), "\n").alias("text"))
               .groupBy("scan_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                   F.struct("spot", F.concat(F.lit("--- "), file_name(F.col("file")), F.lit("\n"), F.col("text")).alias("t")))),
                   lambda x: x["t"]), "\n").alias("context")))
    flow = F.array_join(F.transform("steps", lambda s: F.concat(
        F.lit("  ["), s["kind"], F.lit("] "), file_name(s["file"]), F.lit(":"), s["line"].cast("string"), F.lit("  "), s["code"])), "\n")
    head = F.concat(F.lit("Rule: "), F.col("rule_id"), F.lit(" ("), F.col("cwe"), F.lit(") / severity: "), F.col("severity"),
                    F.lit("\nFlow:\n"), flow)
    return (findings.withColumn("head", head).join(context, ["scan_id", "idx"], "left")
            .select("scan_id", "idx", F.concat_ws("\nCode:\n", "head", "context").alias("prompt")))


def apply_verdicts(representatives: DataFrame, answers: DataFrame) -> DataFrame:
    """Join answers back; an invalid, missing or failed answer is ``uncertain`` with a reason."""
    a = answers.select("scan_id", "idx", F.col("verdict").alias("_v"), F.col("confidence").alias("_c"),
                       F.col("reason").alias("_r"), F.col("provider").alias("_p"), F.col("error").alias("_e"), F.lit(True).alias("_has"))
    out = representatives.join(a, ["scan_id", "idx"], "left")
    failed = F.coalesce("_e", F.lit("")) != ""
    got = F.col("_has").isNotNull() & ~failed
    return out.select(
        *representatives.columns,
        F.when(got & F.col("_v").isin(list(VERDICTS)), F.col("_v")).otherwise(F.lit("uncertain")).alias("verdict"),
        F.when(got, F.coalesce("_c", F.lit(0.0))).alias("confidence"),
        F.when(failed, F.concat(F.lit("triage failed: "), F.col("_e"))).when(got, F.coalesce("_r", F.lit("")))
         .otherwise(F.lit("no verdict returned")).alias("triage_reason"),
        F.when(got, F.col("_p")).alias("triage_provider"))


def score(prompt_rows: DataFrame, scorer: Callable, schema: str) -> DataFrame:
    """Run a user scoring function over prompt batches inside the tasks."""
    return prompt_rows.mapInPandas(scorer, schema)


def propagate(findings: DataFrame, judged: DataFrame, keyed: bool = False) -> DataFrame:
    """Copy the representative's verdict to every member; (scan, cluster) is unique in ``judged``.

    The digest travels as bytes, half as long as its text.
    """
    cols = ["verdict", "confidence", "triage_reason", "triage_provider"]
    rows = findings.select(*[c for c in findings.columns if c not in cols])
    rows = rows if keyed else cluster_key(rows)
    rest = [c for c in rows.columns if c not in ("scan_id", "cluster")]
    packed = rows.select("scan_id", F.unhex("cluster").alias("_cluster"), *rest)
    verdicts = judged.select("scan_id", F.unhex("cluster").alias("_cluster"), *cols)
    return (packed.join(verdicts, ["scan_id", "_cluster"], "left")
            .select("scan_id", F.lower(F.hex("_cluster")).alias("cluster"), *rest, *cols))


def similar_issues(findings: DataFrame) -> DataFrame:
    """Same rule, same sink: one representative and how many more there are."""
    return clusters(findings).withColumn("others", F.col("members") - 1).drop("members")


def _accessor(field: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in remedies.ACCESSOR.items() for x in (k, v[field])])
    return F.element_at(table, F.col("accessor"))


def function_starts(lines: DataFrame) -> DataFrame:
    name = F.coalesce(*[F.nullif(F.regexp_extract("line", FUNCTION_START, g), F.lit("")) for g in (1, 2, 3, 4)])
    return lines.filter(F.col("line").rlike(FUNCTION_START)).select("file", "line_no", name.alias("name"))


def route_lines(lines: DataFrame) -> DataFrame:
    verb = F.lower(F.regexp_extract("line", ROUTE, 1))
    explicit = F.upper(F.regexp_extract("line", ROUTE, 2))
    method = F.when(explicit != "", explicit).when(verb.isin(list(VERBS)), F.upper(verb))
    return lines.filter(F.col("line").rlike(ROUTE)).select(
        "file", "line_no", method.alias("method"), F.regexp_extract("line", ROUTE, 3).alias("path"), "line")


def enclosing_function(spots: DataFrame, starts: DataFrame) -> DataFrame:
    """Nearest function start at or above each spot: an as-of join without per-file windows."""
    rows = (spots.select("file", F.col("line").alias("line_no"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("name"),
                         "scan_id", "idx")
            .unionByName(starts.select("file", "line_no", F.lit(0).alias("side"), "name",
                                       F.lit(None).cast("long").alias("scan_id"), F.lit(None).cast("long").alias("idx"))))
    carried = carry_last(rows, ["file"], ["line_no", "side", "scan_id", "idx"], "name", "fn")
    return carried.filter(F.col("side") == 1).select("scan_id", "idx", "fn")


def entry_hints(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """HTTP method, place and parameter from the source accessor; route from the same file.

    A route that names the enclosing function wins (first such line); an anonymous handler
    takes the nearest route above the sink.
    """
    src = F.coalesce(F.element_at("steps", 1)["code"], F.lit(""))
    base = findings.withColumn("accessor", F.substring_index(src, ".", -1)).withColumn("line", F.element_at("steps", -1)["line"])
    quoted = F.regexp_replace("accessor", r"([^A-Za-z0-9_])", r"\\$1")
    pattern = F.concat(quoted, F.lit(r"\(\s*['\"]([^'\"]+)['\"]"))
    found = F.filter(F.transform("steps", lambda s: F.regexp_extract_all(F.coalesce(s["code"], F.lit("")), pattern, F.lit(1))),
                     lambda x: F.size(x) > 0)
    base = base.withColumn("param", F.when(F.size(found) > 0, F.element_at(F.element_at(found, 1), 1)))
    base = base.withColumn("method0", _accessor(0)).withColumn("location", _accessor(1))
    spots = base.select("scan_id", "idx", "file", "line")
    fns = enclosing_function(spots, function_starts(lines))
    routes = route_lines(lines)
    # names on a route line, exploded: the handler lookup is an equi-join on (file, name)
    words = routes.select("file", "line_no", "method", "path", F.explode(F.array_distinct(
        F.regexp_extract_all("line", F.lit(r"(\w+)"), F.lit(1)))).alias("fn"))
    by_name = words.groupBy("file", "fn").agg(F.min_by(F.struct("method", "path"), "line_no").alias("named"))
    rows = (spots.select("file", F.col("line").alias("line_no"), F.lit(1).alias("side"),
                         F.lit(None).cast("struct<method:string,path:string>").alias("route"), "scan_id", "idx")
            .unionByName(routes.select("file", "line_no", F.lit(0).alias("side"), F.struct("method", "path").alias("route"),
                                       F.lit(None).cast("long").alias("scan_id"), F.lit(None).cast("long").alias("idx"))))
    above = (carry_last(rows, ["file"], ["line_no", "side", "scan_id", "idx"], "route", "inline")
             .filter(F.col("side") == 1).select("scan_id", "idx", "inline"))
    out = (base.join(fns, ["scan_id", "idx"], "left").join(by_name, ["file", "fn"], "left")
           .join(above, ["scan_id", "idx"], "left"))
    route = F.when(F.col("named").isNotNull(), F.col("named")).when(F.col("fn").isNull(), F.col("inline"))
    return out.withColumn("route", route).select(
        "scan_id", "idx", F.coalesce("route.method", "method0").alias("method"), "location", "param",
        F.col("route.path").alias("path"),
        F.when(F.col("route").isNotNull(), F.lit("resolved"))
         .when(F.col("method0").isNotNull() | F.col("param").isNotNull(), F.lit("hint"))
         .otherwise(F.lit("unknown")).alias("confidence"))


def judge(observed: DataFrame) -> DataFrame:
    """Verdict of each observation by the oracle of its rule; blocked is not "not reproduced"."""
    oracle_map = F.create_map(*[F.lit(x) for kv in remedies.ORACLE.items() for x in kv])
    oracle = F.coalesce(F.element_at(oracle_map, remediation_key(F.col("rule_id"))), F.lit("manual"))

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    signature = F.coalesce("error_signature", F.lit("")) != ""
    late = F.coalesce("elapsed_ms", F.lit(0)) >= remedies.DELAY_MS
    hit = (F.when(F.col("oracle_type") == "time_delay", late)
           .when(F.col("oracle_type") == "oast_callback", flag("oast_hit"))
           .when(F.col("oracle_type") == "reflected_marker", flag("body_marker"))
           .when(F.col("oracle_type") == "file_content", flag("file_leak"))
           .when(F.col("oracle_type") == "redirect_location", flag("redirect_external")).otherwise(False))
    partial = (F.when(F.col("oracle_type") == "time_delay", signature)
               .when(F.col("oracle_type") == "manual", flag("agent_confirmed")).otherwise(False))
    blocked = F.coalesce("blocked", F.lit("")) != ""
    verdict = (F.when(blocked, F.lit("NOT_VALIDATED")).when(flag("static_safe"), F.lit("FALSE_POSITIVE"))
               .when(hit, F.lit("CONFIRMED")).when(partial, F.lit("LIKELY")).otherwise(F.lit("NOT_REPRODUCED")))
    reason = F.when(blocked, F.when(F.col("blocked").isin(list(remedies.BLOCKED)), F.col("blocked")).otherwise(
        F.lit("VALIDATION_BLOCKED")))
    return observed.withColumn("oracle_type", oracle).withColumn("verdict", verdict).withColumn("blocked_reason", reason)
