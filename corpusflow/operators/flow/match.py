"""Rules meet program facts.

String conditions such as "ends with ``.name``" or "starts with ``name.``" become
equi-joins on the one segment both sides must share, with the exact condition checked
inside the join, so no rule x node cross product is ever formed and no row is exploded.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: receiver names --------------------------------------------------------
SELF_PREFIX = ("self", "this", "cls", "$this")
# ---- end of fixed values -----------------------------------------------------------------


def source_path(path: Column) -> Column:
    """Namespace and one leading receiver removed."""
    bare = F.substring_index(path, "::", -1)
    first = F.substring_index(bare, ".", 1)
    return F.when(F.contains(bare, F.lit(".")) & first.isin(list(SELF_PREFIX)),
                  F.substr(bare, F.length(first) + 2)).otherwise(bare)


def prefixes(path: Column) -> Column:
    """``a.b.c`` -> a, a.b, a.b.c"""
    n = F.length(path) - F.length(F.replace(path, F.lit("."), F.lit(""))) + 1
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", path, F.lit("."), i))


def tail(path: Column) -> Column:
    """Last segment, where both ``.`` and ``::`` separate."""
    return last_segment(F.substring_index(path, "::", -1))


def ends_with(path: Column, candidate: Column) -> Column:
    """Equal, or ending at a segment boundary."""
    return ((path == candidate) | F.endswith(path, F.concat(F.lit("."), candidate))
            | F.endswith(path, F.concat(F.lit("::"), candidate)))


def starts_with(path: Column, name: Column) -> Column:
    return (path == name) | F.startswith(path, F.concat(name, F.lit(".")))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def sources_by_member(nodes: DataFrame, rule_sources: DataFrame) -> DataFrame:
    """Root segment is the rule's object and the second segment is one of its properties, if it lists any."""
    segs = F.split(source_path(F.col("path")), r"\.")
    n = nodes.filter(F.col("path").isNotNull()).withColumns(
        {"seg0": F.element_at(segs, 1), "seg1": F.try_element_at(segs, F.lit(2))})
    r = rule_sources.filter(F.col("kind") == "member").select("rule_id", "lang", F.col("object").alias("seg0"), "property")
    hit = n.join(r, ["lang", "seg0"]).filter(
        (F.size("property") == 0) | F.coalesce(F.array_contains("property", F.col("seg1")), F.lit(False)))
    return hit.select("rule_id", "node_id").distinct()


def sources_by_name(nodes: DataFrame, rule_sources: DataFrame) -> DataFrame:
    """Path equals the name or continues it with a dot."""
    n = nodes.filter(F.col("path").isNotNull()).select("lang", "node_id", source_path(F.col("path")).alias("_path"))
    n = n.withColumn("_head", F.substring_index("_path", ".", 1))
    r = rule_sources.filter(F.col("kind") == "name").select(
        "rule_id", "lang", "name", F.substring_index("name", ".", 1).alias("_head"))
    return n.join(r, ["lang", "_head"]).filter(starts_with(F.col("_path"), F.col("name"))).select("rule_id", "node_id").distinct()


def sources_by_annotation(nodes: DataFrame, rule_sources: DataFrame) -> DataFrame:
    """Parameters a framework fills from the request."""
    n = nodes.filter(F.col("kind") == "param").select("lang", "node_id", F.explode("annotations").alias("name"))
    r = rule_sources.filter(F.col("kind") == "annotation").select("rule_id", "lang", "name")
    return n.join(r, ["lang", "name"]).select("rule_id", "node_id").distinct()


def _out_calls(calls: DataFrame, rule_sources: DataFrame, kind: str) -> DataFrame:
    """Calls that write into argument ``arg``, by full callee path or its last segment."""
    names = F.array_distinct(F.array(F.col("callee"), last_segment(F.col("callee"))))
    c = calls.filter(F.col("callee").isNotNull()).select("lang", "call_id", F.explode(names).alias("name"))
    r = rule_sources.filter(F.col("kind") == kind).select("rule_id", "lang", "name", "arg")
    return c.join(r, ["lang", "name"]).select("rule_id", "call_id", "arg").distinct()


def sources_by_outparam(calls: DataFrame, args: DataFrame, rule_sources: DataFrame) -> DataFrame:
    """The argument such a call fills is itself input."""
    hit = _out_calls(calls, rule_sources, "outparam").withColumnRenamed("arg", "arg_idx")
    return hit.join(args.select("call_id", "arg_idx", "node_id"), ["call_id", "arg_idx"]).select("rule_id", "node_id").distinct()


def outcopy_edges(calls: DataFrame, args: DataFrame, rule_sources: DataFrame) -> DataFrame:
    """Rule-scoped edges from the other arguments and the receiver (``arg_idx`` -1) into the output argument.

    Goes through one hub node per (rule, call): linear in the arguments instead of all pairs.
    """
    hit = _out_calls(calls, rule_sources, "outcopy")
    a = args.select("call_id", "arg_idx", "node_id")
    rows = hit.join(a, "call_id")
    hub = F.concat_ws("#", F.lit("outcopy"), "rule_id", "call_id", F.col("arg").cast("string"))
    into = rows.filter(F.col("arg_idx") != F.col("arg")).select("rule_id", F.col("node_id").alias("src"), hub.alias("dst"))
    out = rows.filter(F.col("arg_idx") == F.col("arg")).select("rule_id", hub.alias("src"), F.col("node_id").alias("dst"))
    return into.unionByName(out).distinct()


def callee_matches(calls: DataFrame, patterns: DataFrame, *extra: str) -> DataFrame:
    """Calls whose callee equals a candidate or ends with it at a boundary."""
    c = calls.filter(F.col("callee").isNotNull()).select("lang", "call_id", F.col("callee").alias("_path"), tail(F.col("callee")).alias("_tail"))
    r = patterns.filter(F.col("callee").isNotNull()).select(
        "rule_id", "lang", F.col("callee").alias("_want"), tail(F.col("callee")).alias("_tail"), *extra)
    return c.join(r, ["lang", "_tail"]).filter(ends_with(F.col("_path"), F.col("_want"))).drop("_path", "_want", "_tail")


def sinks_by_call(calls: DataFrame, args: DataFrame, rule_sinks: DataFrame) -> DataFrame:
    """Sink arguments.  The first sink pattern that matches a call decides which argument counts.

    No index means every argument; an index the call does not have means no sink.
    """
    hit = (callee_matches(calls, rule_sinks.filter(F.col("kind") == "call"), "sink_ord", "arg")
           .groupBy("rule_id", "call_id").agg(F.min_by(F.struct("arg"), "sink_ord").alias("s")))
    rows = hit.join(args.filter(F.col("arg_idx") >= 0).select("call_id", "arg_idx", "node_id"), "call_id")
    return (rows.filter(F.col("s.arg").isNull() | (F.col("s.arg") == F.col("arg_idx")))
            .select("rule_id", "call_id", "arg_idx", "node_id"))


def first_tainted_arg(sinks: DataFrame, reached: DataFrame) -> DataFrame:
    """One finding per sink call: its first tainted argument."""
    hit = sinks.join(reached.select("rule_id", F.col("node").alias("node_id")), ["rule_id", "node_id"])
    return hit.groupBy("rule_id", "call_id").agg(F.min_by(F.struct("arg_idx", "node_id"), "arg_idx").alias("a")).select(
        "rule_id", "call_id", "a.arg_idx", "a.node_id")


def sinks_by_return(returns: DataFrame, rule_sinks: DataFrame) -> DataFrame:
    """Return values of functions a decorator registers as request handlers."""
    d = returns.select("lang", "node_id", F.explode("decorators").alias("_path")).withColumn("_tail", tail(F.col("_path")))
    r = rule_sinks.filter((F.col("kind") == "return") & F.col("decorator").isNotNull()).select(
        "rule_id", "lang", "decorator", tail(F.col("decorator")).alias("_tail"))
    return d.join(r, ["lang", "_tail"]).filter(ends_with(F.col("_path"), F.col("decorator"))).select("rule_id", "node_id").distinct()


def sinks_by_assign(writes: DataFrame, rule_sinks: DataFrame) -> DataFrame:
    """Writes to a property such as ``cmd.CommandText``."""
    r = rule_sinks.filter(F.col("kind") == "assign").select("rule_id", "lang", F.col("property").alias("prop"))
    return writes.filter(F.col("kind") == "member_write").join(r, ["lang", "prop"]).select("rule_id", "node_id").distinct()


def sanitizer_calls(calls: DataFrame, rule_sanitizers: DataFrame) -> DataFrame:
    """Calls that clean their value; a pattern with ``requires`` also needs one token in the argument text."""
    c = calls.select("call_id", F.col("args_text").alias("_text"))
    hit = callee_matches(calls, rule_sanitizers, "requires").join(c, "call_id")
    ok = (F.size("requires") == 0) | F.exists("requires", lambda t: F.contains(F.coalesce("_text", F.lit("")), t))
    return hit.filter(ok).select("rule_id", "call_id").distinct()


def receiver_sanitizers(sanitizers: DataFrame, calls: DataFrame, receivers: DataFrame) -> DataFrame:
    """A sanitizer called as a statement cleans its receiver: kills on the receiver's later reads.

    ``receivers(call_id, node_id)`` lists the reads the call dominates.
    """
    statements = calls.filter(F.col("is_statement")).select("call_id")
    return (sanitizers.join(statements, "call_id", "left_semi").join(receivers, "call_id")
            .select("rule_id", F.col("node_id").alias("node")).distinct())


def library_verdicts(calls: DataFrame, model: DataFrame) -> DataFrame:
    """block / propagate / NULL for callees without source; the full path is asked before the method name.

    ``model(kind, key, lang, verdict)`` with lang NULL for every language.
    """
    lang_free = model.filter(F.col("lang").isNull()).drop("lang")
    by_lang = model.filter(F.col("lang").isNotNull())
    c = calls.select("call_id", "lang", F.col("callee").alias("path"), last_segment(F.col("callee")).alias("method"))
    out = c
    for kind, col in (("path", "path"), ("method", "method")):
        free = lang_free.filter(F.col("kind") == kind).select(F.col("key").alias(col), F.col("verdict").alias(f"{kind}_free"))
        own = by_lang.filter(F.col("kind") == kind).select(F.col("key").alias(col), "lang", F.col("verdict").alias(f"{kind}_own"))
        out = out.join(free, col, "left").join(own, [col, "lang"], "left")
    return out.select("call_id", F.coalesce("path_own", "path_free", "method_own", "method_free").alias("verdict"))


def uncertain_edges(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges through a call: blocked ones vanish, unknown callees are marked uncertain."""
    v = verdicts.select("call_id", "verdict", F.lit(True).alias("_known_call"))
    called = edges.filter(F.col("call_id").isNotNull())
    out = called.join(v, "call_id", "left").filter(F.coalesce("verdict", F.lit("")) != "block")
    out = out.withColumn("uncertain", F.coalesce("_known_call", F.lit(False)) & F.col("verdict").isNull()).select(
        *edges.columns, "uncertain")
    # edges that pass no call bypass the join, where NULL would be one hot key
    return out.unionByName(edges.filter(F.col("call_id").isNull()).withColumn("uncertain", F.lit(False)))


def active_rules(rule_sinks: DataFrame, calls: DataFrame) -> DataFrame:
    """Rules whose language occurs and one of whose sink names is called somewhere."""
    present = calls.filter(F.col("callee").isNotNull()).select("lang", tail(F.col("callee")).alias("literal")).distinct()
    want = rule_sinks.filter(F.col("callee").isNotNull()).select(
        "rule_id", "lang", tail(F.col("callee")).alias("literal"))
    return want.join(present, ["lang", "literal"], "left_semi").select("rule_id", "lang").distinct()


def interesting_files(calls: DataFrame, rule_sinks: DataFrame, sink_functions: DataFrame) -> DataFrame:
    """Per rule the files that call a sink name or a function that leads to a sink (``rule_id, name``)."""
    names = (rule_sinks.filter(F.col("callee").isNotNull())
             .select("rule_id", tail(F.col("callee")).alias("name"))
             .unionByName(sink_functions.select("rule_id", "name")).distinct())
    used = calls.filter(F.col("callee").isNotNull()).select(
        "file", tail(F.col("callee")).alias("name")).distinct()
    return used.join(names, "name").select("rule_id", "file").distinct()
