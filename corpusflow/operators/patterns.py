"""Single-line pattern scan: one pass over the lines, no shuffle.

Every rule becomes a literal expression behind a cheap literal gate.  A line
that no rule touches is dropped inside the same projection; only the rare lines
with a hit reach the array work (validators, masks, duplicate removal), which
is row-local as well.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import regex, values
from ..functions.identity import file_name
from ..plans.dims import BROADCAST_ROWS
from ..schema import PATTERN_RULE
from ..tables import pattern_rules as shipped_rules

#: Unicode noncharacters used to mark matches inside a line.
_START, _MID, _END = "\ufdd0", "\ufdd1", "\ufdd2"
_FIELDS = [f.name for f in PATTERN_RULE.fields]

#: Fixed value: an emitted line is cut here.
SNIPPET_CHARS = 200


def shipped(language: str | None = None) -> list[tuple]:
    rules = shipped_rules.shipped()
    at = _FIELDS.index("languages")
    return [r for r in rules if not language or not r[at] or language in r[at]]


def _rule(row) -> dict:
    return dict(zip(_FIELDS, row))


def rule_applies(rule: dict) -> str:
    """Language known: its rules and language-free ones.  Unknown: only all-file, language-free rules."""
    langs = ", ".join(regex.sql_text(x) for x in rule["languages"])
    exts = ", ".join(regex.sql_text(x) for x in rule["file_exts"])
    known = f"coalesce(lang IN ({langs}), false)" if langs else "true"
    unknown = "true" if rule["all_files"] and not langs else "false"
    ok = known if known == unknown else f"CASE WHEN coalesce(lang, '') <> '' THEN {known} ELSE {unknown} END"
    return ok + (f" AND coalesce(lower(ext) IN ({exts}), false)" if exts else "")


def is_comment(line: Column) -> Column:
    return line.rlike(regex.to_java(shipped_rules.COMMENT_LINE, "(?U)"))


def fp_hint(line: Column) -> Column:
    return line.rlike(regex.to_java(shipped_rules.FP_HINT))


def lowered(confidence: Column) -> Column:
    return F.when(confidence == "high", F.lit("medium")).otherwise(F.lit("low"))


#: Offsets are summed inside chunks and over chunks, so a line with n matches costs n * CHUNK, not n * n.
CHUNK = 256


def _with_parts(h: Column) -> Column:
    """Pieces of the marked line after the first: value, length of the match, length of the whole piece."""
    def piece(part: Column) -> Column:
        whole = F.substring_index(part, _MID, 1)
        value = F.substring_index(F.substring_index(part, _END, 1), _MID, -1)
        span = F.length(part) - F.length(value) - 2
        return F.struct(value.alias("value"), F.length(whole).alias("len"), span.alias("span"))

    parts = F.split(h["marked"], _START)
    pieces = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return h.withField("pieces", pieces).withField("lead", F.length(F.substring_index(h["marked"], _START, 1)))


def _with_starts(h: Column) -> Column:
    """Start column of every chunk of pieces."""
    n_chunks = F.ceil(F.size(h["pieces"]) / CHUNK).cast("int")
    sums = F.transform(F.sequence(F.lit(1), F.greatest(n_chunks, F.lit(1))), lambda c: F.aggregate(
        F.slice(h["pieces"], (c - 1) * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda acc, p: acc + p["span"]))
    return h.withField("starts", F.aggregate(sums, F.array(h["lead"]), lambda acc, x: F.array_append(
        acc, F.element_at(acc, -1) + x)))


def _with_matches(h: Column) -> Column:
    """Matches in order with their value and exact offsets."""
    kind = "struct<pos:int,out:array<struct<value:string,start_col:int,end_col:int>>>"

    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["pos"] + p["span"]).alias("pos"), F.array_append(acc["out"], F.struct(
            p["value"].alias("value"), acc["pos"].alias("start_col"), (acc["pos"] + p["len"]).alias("end_col"))).alias("out"))

    chunks = F.transform(F.sequence(F.lit(1), F.size(h["starts"]) - 1), lambda c: F.aggregate(
        F.slice(h["pieces"], (c - 1) * CHUNK + 1, F.lit(CHUNK)),
        F.struct(F.element_at(h["starts"], c).alias("pos"), F.array().alias("out")).cast(kind), step)["out"])
    return h.withField("matches", F.flatten(chunks)).dropFields("marked", "pieces", "lead", "starts")


def _each_hit(df: DataFrame, change) -> DataFrame:
    return df.withColumn("hits", F.transform("hits", change))


def _keep_first(df: DataFrame, field: str) -> DataFrame:
    """Of the matches with an equal field the one furthest left stays; by sorting, never by comparing pairs."""
    ordered = _each_hit(df, lambda h: h.withField("keyed", F.sort_array(F.transform(h["matches"], lambda m: F.struct(
        m[field].alias("key"), m["start_col"].alias("at"), m.alias("m"))))))
    kept = _each_hit(ordered, lambda h: h.withField("matches", F.sort_array(F.transform(
        F.filter(h["keyed"], lambda k, i: (i == 0) | (F.get(h["keyed"], i - 1)["key"] != k["key"])),
        lambda k: F.struct(k["at"].alias("start_col"), k["m"]["end_col"].alias("end_col"), k["m"]["value"].alias("value"),
                           k["m"]["masked"].alias("masked"))))).dropFields("keyed"))
    return kept


def _hit(rule: dict) -> str:
    """SQL for one rule: its attributes and the marked line where it matches, else NULL.

    Written as SQL text because a few thousand Column calls would cost more than the scan itself.
    """
    sql = regex.sql_text
    pattern = sql(regex.to_java(rule["pattern"]))
    excludes = "|".join("(?:" + regex.to_java(x, "") + ")" for x in rule["excludes"])
    attributes = {c: rule[c] for c in ("id", "message", "severity", "cwe", "owasp", "category", "validator",
                                       "mask", "confidence")}
    attributes["skip_comments"] = bool(rule["skip_comments"])
    attributes["exclude"] = regex.JAVA_FLAGS + excludes if excludes else None
    fields = ", ".join(f"'{name}', {sql(value)}" for name, value in attributes.items())
    marked = sql(f"{_START}$0{_MID}${rule['grp']}{_END}")
    cond = " AND ".join(x for x in (rule_applies(rule), regex.gate(rule["pattern"]),
                                    f"rlike(line, {pattern})") if x and x != "true")
    return (f"CASE WHEN {cond} THEN named_struct({fields}, "
            f"'marked', regexp_replace(line, {pattern}, {marked})) END")


def matched_lines(lines: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Lines with at least one raw match, plus ``hits``: one entry per matching rule, in rule order."""
    clean = F.translate(F.col("line"), _START + _MID + _END, "\ufffd" * 3)
    base = lines.withColumn("line", clean)
    base = base.withColumns(regex.gate_columns(F.col("line")))
    hits = ", ".join(_hit(_rule(row)) for row in rules)
    found = F.expr(f"filter(array({hits}), h -> h IS NOT NULL)")
    # the one-element array keeps the hit list in one evaluation: exploding it drops lines without hits
    once = F.filter(F.array(F.struct(found.alias("found"))), lambda x: F.size(x["found"]) > 0)
    kept = base.select(*lines.columns, F.explode(once).alias("_hit"))
    out = kept.select(*lines.columns, F.col("_hit.found").alias("hits"))
    for change in (_with_parts, _with_starts, _with_matches):
        out = _each_hit(out, change)
    return out


def accepted_hits(found: DataFrame) -> DataFrame:
    """Matches that pass their rule's validator, with the masked value."""
    valid = found.withColumn("hits", F.transform("hits", lambda h: h.withField("matches", F.filter(
        h["matches"], lambda m: values.validated(h["validator"], m["value"])))))
    return valid.withColumn("hits", F.transform("hits", lambda h: h.withField("matches", F.transform(
        h["matches"], lambda m: m.withField("masked", values.masked(h["mask"], m["value"]))))))


def masked_snippet(accepted: DataFrame, chars: int | None = SNIPPET_CHARS) -> DataFrame:
    """Adds ``snippet``: the trimmed line with every sensitive match of every masking rule hidden, then cut for display
    at ``chars`` characters (None: not cut).  The whole line is masked, whatever a registered masker leaves of a value."""
    secrets = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(F.filter(
        h["matches"], lambda m: (m["value"] != "") & (m["value"] != m["masked"])),
        lambda m: F.concat(m["value"], F.lit(_MID), m["masked"])))))
    rows = accepted.withColumn("_secrets", secrets).withColumn("_text", F.regexp_replace("line", r"^[\s\x0b]+|[\s\x0b]+$", ""))
    hidden = F.aggregate("_secrets", F.col("_text"), lambda acc, x: F.replace(
        acc, F.substring_index(x, _MID, 1), F.substring_index(x, _MID, -1)))
    rows = rows.withColumn("snippet", hidden).drop("_secrets", "_text")
    return rows if chars is None else rows.withColumn("snippet", F.when(
        F.length("snippet") > chars, F.concat(F.substring("snippet", 1, chars), F.lit("…"))).otherwise(F.col("snippet")))


def deduplicated(accepted: DataFrame) -> DataFrame:
    """Per line and rule: distinct raw values, then distinct masked values, one for ``mask=none``."""
    out = _keep_first(_keep_first(accepted, "value"), "masked")
    return _each_hit(out, lambda h: h.withField(
        "matches", F.when(h["mask"] == "none", F.slice(h["matches"], 1, 1)).otherwise(h["matches"])))


def pattern_scan(lines: DataFrame, rules: Sequence[tuple] | None = None, snippet_chars: int | None = SNIPPET_CHARS) -> DataFrame:
    """Findings of all rules over ``lines(project, file, lang, ext, line_no, line)``; ``snippet_chars`` None shows whole lines."""
    rules = shipped() if rules is None else list(rules)
    ready = deduplicated(masked_snippet(accepted_hits(matched_lines(lines, rules)), snippet_chars))
    ready = ready.withColumn("fp_hint", fp_hint(F.col("line"))).withColumn("_comment", is_comment(F.col("line")))
    hits = (ready.select("project", "file", "lang", F.col("line_no").cast("int").alias("line"), "snippet",
                         "fp_hint", "_comment", F.col("line").alias("_text"), F.explode("hits").alias("h"))
            .filter(~(F.col("h.skip_comments") & F.col("_comment")))
            .filter(F.col("h.exclude").isNull() | ~F.rlike(F.col("_text"), F.col("h.exclude"))))
    out = hits.select("project", "file", "lang", "line", "snippet", "fp_hint",
                      F.col("h.id").alias("rule_id"), "h.message", "h.severity", "h.cwe", "h.owasp", "h.category",
                      F.when(F.col("fp_hint"), lowered(F.col("h.confidence"))).otherwise(
                          F.col("h.confidence")).alias("precision"),
                      F.explode("h.matches").alias("m"))
    return out.select(*[c for c in out.columns if c != "m"], F.col("m.masked").alias("matched_value"),
                      "m.start_col", "m.end_col",
                      F.array(F.struct(F.lit("match").alias("kind"), F.col("file"), F.col("line"),
                                       F.col("snippet").alias("code"), F.lit(False).alias("uncertain"))).alias("steps"))


def rules_from_table(table: DataFrame) -> list[tuple]:
    """Rules that arrive as a table.  They are configuration: their number is checked before they are read."""
    rows = table.select(*_FIELDS).limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} pattern rules")
    return [tuple(r) for r in rows]


def risky_filenames(files: DataFrame) -> DataFrame:
    """Files whose name alone is a finding; they carry line 0."""
    name = file_name(F.col("file"))
    return (files.filter(name.rlike(shipped_rules.RISKY_FILENAME))
            .select("project", "file", F.lit("secret.risky-filename").alias("rule_id"),
                    F.lit("high").alias("severity"), F.lit("CWE-538").alias("cwe"),
                    F.lit(shipped_rules.A05).alias("owasp"), F.lit("secret").alias("category"),
                    F.lit(0).alias("line"), F.lit("medium").alias("precision"), name.alias("matched_value")))
