"""Call graph: function aliases and call resolution as keyed joins."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .match import last_segment

#: How many path parts qualify a name; how many homonyms are still compared.
QUALIFIED_DEPTH = 3
MAX_ALTS = 4


def function_index(nodes: DataFrame) -> DataFrame:
    """Named functions, also those bound by assignment, from ``fn_def`` facts."""
    return (nodes.filter((F.col("kind") == "fn_def") & (F.coalesce("name", F.lit("")) != ""))
            .select("project", "file", "fn_id", "name", "line", "arity", "implicit_self"))


def function_aliases(functions: DataFrame) -> DataFrame:
    """(project, scope, alias, alias_kind, fn_id); the last definition of an alias wins.

    Each alias is one aggregate row, so a name defined a million times costs one
    map-side combined maximum, not a list.
    """
    order = F.struct("file", "line", "fn_id")

    def last(df: DataFrame, kind: str, *keys: str) -> DataFrame:
        cols = ["project", *keys]
        return df.groupBy(*cols).agg(F.max_by("fn_id", order).alias("fn_id")).select(
            "project", (F.col("file") if "file" in keys else F.lit("")).alias("scope"),
            F.col(keys[-1]).alias("alias"), F.lit(kind).alias("alias_kind"), "fn_id")

    stem = F.regexp_replace("file", r"\.[^./]*$", "")
    parts = F.filter(F.split(stem, "/"), lambda p: p != "")
    depth = F.explode(F.sequence(F.lit(1), F.least(F.lit(QUALIFIED_DEPTH), F.size(parts))))
    qualified = functions.withColumn("_parts", parts).filter(F.size("_parts") > 0).withColumn("_i", depth)
    qualified = qualified.withColumn("qualified", F.concat(
        F.array_join(F.slice("_parts", -F.col("_i"), F.col("_i")), "."), F.lit("."), F.col("name")))
    counted = functions.groupBy("project", "name").agg(F.count(F.lit(1)).alias("_n"), F.max("fn_id").alias("fn_id"))
    unique = counted.filter(F.col("_n") == 1).select(
        "project", F.lit("").alias("scope"), F.concat("name", F.lit("#unique")).alias("alias"),
        F.lit("unique").alias("alias_kind"), "fn_id")
    # only names with two to four definitions reach the window
    few = counted.filter(F.col("_n").between(2, MAX_ALTS)).select("project", "name")
    alts = functions.join(few, ["project", "name"], "left_semi").withColumn(
        "_i", F.row_number().over(W.partitionBy("project", "name").orderBy("file", "line", "fn_id")) - 1)
    alts = alts.select("project", F.lit("").alias("scope"),
                       F.concat("name", F.lit("#alt"), F.col("_i").cast("string")).alias("alias"),
                       F.lit("alt").alias("alias_kind"), "fn_id")
    return (last(functions, "bare", "name").unionByName(last(functions, "file", "file", "name"))
            .unionByName(last(qualified, "qualified", "qualified")).unionByName(unique).unionByName(alts))


def resolve_calls(calls: DataFrame, aliases: DataFrame, functions: DataFrame) -> DataFrame:
    """Callee function of each call by priority.

    1 same file, exact name; 2 exact or module-qualified; 3 same file by method name where the
    receiver is itself a call; 4 the project's only function of that name where the receiver is
    a plain variable and the argument count fits.
    ``calls(call_id, project, file, callee, prop, recv_kind, nargs)``.
    """
    def table(kind: str, *cols: str) -> DataFrame:
        return aliases.filter(F.col("alias_kind") == kind).select("project", *cols)

    in_file = table("file", F.col("scope").alias("file"), F.col("alias").alias("_name"), F.col("fn_id"))
    exact = (aliases.filter(F.col("alias_kind").isin("bare", "qualified"))
             .groupBy("project", F.col("alias").alias("_name")).agg(F.max_by("fn_id", "alias_kind").alias("fn_id")))
    only = aliases.filter(F.col("alias_kind") == "unique").select(
        "project", F.regexp_replace("alias", "#unique$", "").alias("_name"), "fn_id").join(
        functions.select("fn_id", "arity", "implicit_self"), "fn_id")
    named = calls.withColumn("_name", F.col("callee"))
    p1 = named.join(in_file, ["project", "file", "_name"]).select("call_id", "fn_id", F.lit(1).alias("prio"))
    p2 = named.join(exact, ["project", "_name"]).select("call_id", "fn_id", F.lit(2).alias("prio"))
    p3 = (calls.filter(F.col("recv_kind") == "call").withColumn("_name", F.col("prop"))
          .join(in_file, ["project", "file", "_name"]).select("call_id", "fn_id", F.lit(3).alias("prio")))
    want = F.col("arity") - F.when(F.col("implicit_self"), 1).otherwise(0)
    p4 = (calls.filter((F.col("recv_kind") == "ident") & F.contains("callee", F.lit(".")))
          .withColumn("_name", last_segment(F.col("callee"))).join(only, ["project", "_name"])
          .filter((want < 0) | (want == F.col("nargs"))).select("call_id", "fn_id", F.lit(4).alias("prio")))
    found = p1.unionByName(p2).unionByName(p3).unionByName(p4)
    return found.groupBy("call_id").agg(F.min_by(F.struct("fn_id", "prio"), "prio").alias("r")).select(
        "call_id", "r.fn_id", "r.prio")


def promote_alts(aliases: DataFrame, summary_hash: DataFrame) -> DataFrame:
    """Names whose few definitions all behave the same become resolvable by name alone."""
    name = F.regexp_replace("alias", r"#alt\d+$", "")
    alts = aliases.filter(F.col("alias_kind") == "alt").withColumn("name", name).join(summary_hash, "fn_id")
    return (alts.groupBy("project", "name", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("summary").alias("lo"), F.max("summary").alias("hi"), F.min("fn_id").alias("fn_id"))
        .filter((F.col("n") > 1) & F.col("lo").eqNullSafe(F.col("hi"))).select("project", "name", "rule_id", "n", "fn_id"))


def call_arguments(args: DataFrame, resolved: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Arguments with the callee parameter they land in; a method's own self shifts them by one."""
    shift = F.when(F.col("implicit_self") & F.col("is_member"), 1).otherwise(0)
    return (args.filter(F.col("arg_idx") >= 0).join(resolved.select("call_id", "fn_id"), "call_id")
            .join(functions.select("fn_id", "implicit_self"), "fn_id")
            .join(calls.select("call_id", "is_member"), "call_id")
            .select("call_id", F.col("fn_id").alias("callee_fn"), (F.col("arg_idx") + shift).alias("param_idx"),
                    F.col("node_id").alias("arg_node")))
