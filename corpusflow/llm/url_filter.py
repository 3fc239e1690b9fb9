"""URL filters: stated rules first, association rules mined from labels for the rest.

Tokens of labelled URLs (host labels, path segments, extension, query keys, scheme) and their label are
transactions; FP-growth mines frequent combinations, and rules "tokens -> bad" are kept above a support and
a confidence.  Only tokens that are frequent together with a bad label can be in such a rule; others are dropped before
mining.  All that are left form combinations, none is cut off.  Tokens that stand in exactly the same labelled URLs are one
item: a rule holds with any of them alike, so a URL of many fixed segments costs one item, and a page fits where it has one
token at least of each item.  What is left grows with the number of rules there are, 2 to the number of items that are
frequent together in different URLs at most.  Rules are matched by an inverted index: each is filed under its rarest item, a
URL looks up its own tokens and checks the rest of a rule only where one agrees.  Distinct token sets are matched
once, not URLs.  Everything is DataFrame code and the library's FP-growth; nothing runs in Python.

Defined results
  NULL URLs and URLs without ``://``: host and path are empty, no stated rule fits, no token matches.
  Repeated rows are judged alike.  Very long URLs are used whole.  Without labels no rule is mined and
  every URL that no stated rule decides is allowed.  Of stated rules the longest decides, of equally long
  ones the first in alphabetical order.  A rule with an empty path fits URLs whose path starts with ``/``; one without
  any path (``http://x.net``) has none that could start with it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, stored

#: The stated rules: text (host and path), verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.0005, 0.6
#: Labelled URLs that a rule stands on at least.
LEAST_URLS = 5
#: Not a limit of mining: URLs of one template make fewer rules than combinations of so many tokens would.
TRANSACTION = 12
BAD = "=bad"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, each with its kind; numbers are left out, they identify, they do not describe."""
    u = F.coalesce(url, F.lit(""))
    labels = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(F.lower(path(url)), "/"), lambda x: (x != "") & ~x.rlike(r"^\d+(\.\w+)?$")),
                           lambda x: F.concat(F.lit("p:"), x))
    ending = F.regexp_extract(F.lower(path(url)), r"(\.\w+)$", 1)
    keys = F.transform(F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.regexp_extract(u, r"^(\w+)://", 1))))
    found = F.concat(labels, segments, F.array(F.concat(F.lit("e:"), ending)), keys, scheme)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) > 2)))


def stated(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest stated rule that fits, else NULL."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, at = text.split("/", 1)
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith("/" + at)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def alike(each: DataFrame, useful: DataFrame) -> DataFrame:
    """``token, item, alike``: tokens of ``useful`` (token, n_bad, n, and marks of its rows) that stand in the same rows.

    Equal marks propose a class; it stays if every row that has one of its tokens has all, else each is its own.
    """
    proposed = stored(useful.groupBy("n_bad", "n", "mark_1", "mark_2").agg(F.array_sort(F.collect_list("token")).alias("alike"))
                      .select(F.explode("alike").alias("token"), F.element_at("alike", 1).alias("item"), "alike"), "url-alike")
    several = proposed.filter(F.size("alike") > 1).select("token", "item", F.size("alike").alias("size"))
    split = (each.join(several, "token").groupBy("row", "item").agg(F.count(F.lit(1)).alias("here"), F.first("size").alias("size"))
             .filter(F.col("here") != F.col("size")).select("item", F.lit(True).alias("split")).distinct())
    own = F.col("split").isNotNull()
    return stored(proposed.join(split, "item", "left").select(
        "token", F.when(own, F.col("token")).otherwise(F.col("item")).alias("item"),
        F.when(own, F.array("token")).otherwise(F.col("alike")).alias("alike")), "url-items")


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``labelled`` (url, bad boolean) -> ``antecedent, alike, confidence, support`` of rules that lead to bad.

    ``alike`` has, per token of ``antecedent``, all that stand in the same labelled URLs; the rule holds with any of them.
    """
    from pyspark.ml.fpm import FPGrowth
    rows = stored(labelled.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("bad"), F.lit(False)).alias("bad"),
                                  tokens(F.col("url")).alias("tokens")), "url-transactions")
    n = rows.count()
    least = max(support, LEAST_URLS / max(1, n))
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"mark_{k}") for k in (1, 2)]
    useful = (each.groupBy("token").agg(F.count_if("bad").alias("n_bad"), F.count(F.lit(1)).alias("n"), *marks)
              .filter(F.col("n_bad") >= least * n))
    classes = alike(each, useful)
    items = (each.join(classes.select("token", "item"), "token").groupBy("row", "bad").agg(F.collect_set("item").alias("found"))
             .select("row", F.concat("found", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array())).alias("items")))
    # URLs without such a token count among all URLs all the same
    rows = stored(rows.select("row").join(items, "row", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items")), "url-items")
    if rows.filter(F.size("items") > 1).isEmpty():
        return stored(rows.limit(0).select(F.col("items").alias("antecedent"), F.array("items").alias("alike"),
                                           F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")), "url-rules")
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(rows)
    rules = (model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
             .select(F.monotonically_increasing_id().alias("id"), "antecedent", "confidence", "support"))
    rules = stored(rules, "url-antecedents")
    named = (rules.select("id", F.explode("antecedent").alias("token"))
             .join(classes.filter(F.col("token") == F.col("item")).select("token", "alike"), "token")
             .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "alike"))).alias("parts")))
    return stored(rules.join(named, "id").select(F.col("parts.token").alias("antecedent"), F.col("parts.alike").alias("alike"),
                                                 "confidence", "support"), "url-rules")


def match(urls: DataFrame, rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """Distinct token sets of ``urls`` (column ``tokens``) that a mined rule fits, with the best confidence."""
    listed = rules.withColumn("id", F.monotonically_increasing_id())
    # a rule stands under each token of its rarest item
    filed = (listed.select("id", "confidence", "alike", F.posexplode("alike").alias("at", "one"))
             .select("id", "confidence", "alike", "at", F.explode("one").alias("token")).join(token_counts, "token")
             .groupBy("id", "at").agg(F.sum("n").alias("n"), F.collect_list("token").alias("under"),
                                      F.first("alike").alias("alike"), F.first("confidence").alias("confidence"))
             .groupBy("id").agg(F.min(F.struct("n", "at", "under")).alias("rarest"), F.first("alike").alias("alike"),
                                F.first("confidence").alias("confidence"))
             .select(F.explode("rarest.under").alias("token"), "alike", "confidence"))
    filed = stored(filed, "url-index")
    looked = urls.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    return (looked.join(filed, "token").filter(F.forall("alike", lambda one: F.arrays_overlap(one, F.col("tokens"))))
            .groupBy("tokens").agg(F.max("confidence").alias("confidence")))


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules: Sequence[tuple[str, str]] = RULES, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``id, host, path, rule, verdict, confidence`` per page; ``labelled`` has ``url`` and ``bad``."""
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url"))
    rows = rows.select(id_col, host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), tokens(F.col("_url")).alias("tokens"))
    mined = mine(labelled, support, confidence)
    counts = stored(rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
                    .join(mined.select(F.explode(F.flatten("alike")).alias("token")).distinct(), "token", "left_semi"), "url-tokens")
    fits = stored(match(rows, mined, counts), "url-matches")
    judged = rows.join(fits, "tokens", "left").withColumn("_stated", stated(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", F.col("_stated.rule").alias("rule"),
                         F.coalesce("_stated.verdict", method).alias("verdict"), "confidence")
