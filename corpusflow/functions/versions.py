"""Version order and advisory ranges.

The order is deliberately not semver: parts are split on ``. - + _``, numbers
compare as numbers and sort before words, and a longer list is greater.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def version_key(version: Column) -> Column:
    """Array of (kind, digits, number, word); arrays of structs compare part by part.

    A number is its text without leading zeros behind its length, so numbers of any length compare.
    """
    parts = F.filter(F.split(F.coalesce(version, F.lit("")), r"[.\-+_]"), lambda p: p != "")

    def part(p: Column) -> Column:
        is_number = p.rlike(r"^\d+$")
        number = F.when(is_number, F.regexp_replace(p, r"^0+(?=\d)", "")).otherwise(F.lit("0"))
        return F.struct(F.when(is_number, F.lit(0)).otherwise(F.lit(1)).alias("kind"), F.length(number).alias("digits"),
                        number.alias("number"), F.when(is_number, F.lit("")).otherwise(p).alias("word"))
    return F.transform(parts, part)


def in_range(version: Column, range_type: Column, events: Column) -> Column:
    """True / False / NULL (undecided) for one advisory range.

    Events are folded in order.  An ``introduced`` above the version leaves an
    earlier hit alone; ``fixed`` and ``last_affected`` only act on a hit.
    """
    v = version_key(version)

    def step(hit: Column, ev: Column) -> Column:
        intro, fixed, last = ev["introduced"], ev["fixed"], ev["last_affected"]
        return (F.when(intro.isNotNull(), hit | (intro == "0") | (version_key(intro) <= v))
                 .when(fixed.isNotNull(), hit & ~(version_key(fixed) <= v))
                 .when(last.isNotNull(), hit & ~(version_key(last) < v))
                 .otherwise(hit))

    decided = F.aggregate(F.coalesce(events, F.array().cast(
        "array<struct<introduced:string,fixed:string,last_affected:string>>")), F.lit(False), step)
    undecided = (F.coalesce(range_type, F.lit("")) == "GIT") | (F.size(v) == 0)
    return F.when(~undecided, decided)


def affected(version: Column, versions: Column, ranges: Column) -> Column:
    """An explicit version list decides alone; otherwise any-true, all-false or NULL."""
    verdicts = F.transform(ranges, lambda r: in_range(version, r["type"], r["events"]))
    listed = F.size(F.coalesce(versions, F.array().cast("array<string>"))) > 0
    some = F.size(F.coalesce(verdicts, F.array().cast("array<boolean>"))) > 0
    return (F.when(listed, F.array_contains(versions, version))
             .when(F.coalesce(F.exists(verdicts, lambda x: F.coalesce(x, F.lit(False))),
                              F.lit(False)), F.lit(True))
             .when(some & F.forall(verdicts, lambda x: F.coalesce(~x, F.lit(False))), F.lit(False)))


def advisory_severity(scores: Column, label: Column) -> Column:
    """First purely numeric score sets the band; else the database label; else medium."""
    numeric = F.filter(scores, lambda s: s["score"].rlike(r"^[0-9.]+$"))
    banded = F.filter(F.transform(numeric, lambda s: s["score"].try_cast("double")), lambda x: x >= 0.1)
    score = F.when(F.size(banded) > 0, F.element_at(banded, 1))
    named = F.lower(label)
    return (F.when(score >= 9.0, F.lit("critical")).when(score >= 7.0, F.lit("high"))
             .when(score >= 4.0, F.lit("medium")).when(score >= 0.1, F.lit("low"))
             .when(named == "critical", F.lit("critical")).when(named == "high", F.lit("high"))
             .when(named.isin("moderate", "medium"), F.lit("medium")).when(named == "low", F.lit("low"))
             .otherwise(F.lit("medium")))


def fixed_versions(affected_entries: Column, package: Column) -> Column:
    """Distinct sorted versions that fix ``package`` according to one advisory."""
    mine = F.filter(affected_entries, lambda a: a["package"]["name"].isNull() | (a["package"]["name"] == package))
    ranges = F.flatten(F.transform(mine, lambda a: F.coalesce(a["ranges"], F.array())))
    events = F.flatten(F.transform(ranges, lambda r: F.coalesce(r["events"], F.array())))
    return F.array_sort(F.array_distinct(F.filter(F.transform(events, lambda e: e["fixed"]), lambda x: x.isNotNull())))
