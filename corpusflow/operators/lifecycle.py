"""Snapshots of a project over time: identity, difference, review state.

Both sides of every snapshot comparison are first reduced to one row per
(scan, fingerprint), so the joins below never meet a repeated key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.identity import fingerprint, severity_rank
from ..plans import durable, lag_in_key

#: Review states and the ones that close a finding.
AUDIT_STATES = ("", "confirmed", "false_positive", "fixed", "deferred")
CLOSED = ("false_positive", "deferred", "fixed")
NOTE_CHARS = 4000
HISTORY_ROWS = 50


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """Rename chains a->b->c as ``(old_id, canonical)``; a cycle stops where it would repeat.

    ``aliases(old_id, new_id)`` holds one row per rename ever made.  The walk carries the
    names it passed, so the recursion ends on cycles too.
    """
    return aliases.sparkSession.sql("""
        WITH RECURSIVE walk(old_id, seen, name, n) AS (
          SELECT old_id, array(old_id), new_id, 1 FROM {aliases}
          UNION ALL
          SELECT w.old_id, array_append(w.seen, w.name), a.new_id, w.n + 1
          FROM walk w JOIN {aliases} a ON a.old_id = w.name
          WHERE NOT array_contains(w.seen, w.name))
        SELECT old_id, max_by(name, n) AS canonical FROM walk GROUP BY old_id""", aliases=aliases)


def with_stored_fp(findings: DataFrame, canonical: DataFrame) -> DataFrame:
    """``stored_fp``: recomputed under the current name when the rule was renamed since."""
    names = canonical.select(F.col("old_id").alias("rule_id"), "canonical")
    sink = F.element_at("steps", -1)["code"]
    renamed = F.col("canonical").isNotNull() & (F.col("canonical") != F.col("rule_id")) & (F.size("steps") > 0)
    return (findings.join(names, "rule_id", "left")
            .withColumn("stored_fp", F.when(renamed, fingerprint(F.col("canonical"), F.col("file"), sink))
                        .otherwise(F.coalesce("fp", F.lit("")))).drop("canonical"))


def previous_scans(scans: DataFrame) -> DataFrame:
    """Each scan with the one just before it in the same project (strictly earlier)."""
    by_time = scans.groupBy("project", "created_at").agg(F.max("scan_id").alias("_at"))
    prior = lag_in_key(by_time, ["project"], ["created_at"], ["_at"], "prev")
    return (scans.join(prior.select("project", "created_at", F.col("prev_at").alias("prev_scan_id")),
                       ["project", "created_at"], "left")
            .withColumn("prev_scan_id", F.when(F.coalesce("project", F.lit("")) != "", F.col("prev_scan_id"))))


def scan_diff(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """new / resolved / persistent of every scan against its previous one.

    Duplicate fingerprints are represented by their last row, empty ones are ignored.
    Where only one of the two scans looked at dependencies, dependency rows of both are left out.
    ``scans(scan_id, prev_scan_id, sca, prev_sca)``; a scan without a predecessor reports all as new.
    """
    keep = [c for c in ("rule_id", "severity", "file", "line", "category") if c in findings.columns]
    category = F.col("f.category") if "category" in keep else F.lit("")
    # flat columns from here on: what a caller does not read does not travel to the joins
    last = (findings.filter((F.coalesce("stored_fp", F.lit("")) != "") & F.col("idx").isNotNull())
            .groupBy("scan_id", "stored_fp")
            .agg(F.max(F.struct("idx", *keep)).alias("f"))
            .select("scan_id", "stored_fp", (F.coalesce(category, F.lit("")) == "dependency").alias("dep"),
                    *[F.col("f")[c].alias(c) for c in ("idx", *keep)]))
    same_axis = F.col("prev_scan_id").isNull() | F.col("sca").eqNullSafe(F.col("prev_sca"))
    # read from both sides: three narrow columns, stored
    plan = durable(scans.select("scan_id", "prev_scan_id", same_axis.alias("same_axis")))
    current = last.join(plan.select("scan_id", "same_axis"), "scan_id").withColumn("has", F.lit(True))
    old = (last.withColumnRenamed("scan_id", "prev_scan_id")
           .join(plan.filter(F.col("prev_scan_id").isNotNull()), "prev_scan_id")
           .select("scan_id", "stored_fp", F.lit(True).alias("_old_has"),
                   *[F.col(c).alias(f"_old_{c}") for c in ("same_axis", "dep", "idx", *keep)]))
    both = current.join(old, ["scan_id", "stored_fp"], "full_outer")
    axis = F.coalesce("same_axis", "_old_same_axis")
    # a dependency row counts only when both scans looked at dependencies
    cur_in = F.coalesce("has", F.lit(False)) & (axis | ~F.col("dep"))
    old_in = F.coalesce("_old_has", F.lit(False)) & (axis | ~F.col("_old_dep"))
    status = (F.when(cur_in & old_in, F.lit("persistent")).when(cur_in, F.lit("new")).when(old_in, F.lit("resolved")))
    return (both.withColumn("status", status).filter(F.col("status").isNotNull())
            .select("scan_id", "stored_fp", "status",
                    *[F.when(cur_in, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in ("idx", *keep)]))


def diff_counts(diff: DataFrame) -> DataFrame:
    return (diff.groupBy("scan_id").agg(
        F.count_if(F.col("status") == "new").alias("new_count"),
        F.count_if(F.col("status") == "resolved").alias("resolved_count"),
        F.count_if(F.col("status") == "persistent").alias("persistent_count")))


def verify_fix(before: DataFrame, after: DataFrame, baseline_files: DataFrame) -> DataFrame:
    """Per file closed / remaining / new.  A file without a baseline is not "all new"."""
    b = before.select("file", "fp").distinct().withColumn("_b", F.lit(True))
    a = after.select("file", "fp").distinct().withColumn("_a", F.lit(True))
    both = b.join(a, ["file", "fp"], "full_outer")
    counts = both.groupBy("file").agg(
        F.count_if(F.col("_b").isNotNull() & F.col("_a").isNull()).alias("closed"),
        F.count_if(F.col("_b").isNotNull() & F.col("_a").isNotNull()).alias("remaining"),
        F.count_if(F.col("_b").isNull()).alias("new"))
    known = baseline_files.select("file").distinct().withColumn("_known", F.lit(True))
    out = counts.join(known, "file", "full_outer").fillna(0, ["closed", "remaining", "new"])
    verdict = (F.when(F.col("_known").isNull(), F.lit("none"))
               .when((F.col("remaining") == 0) & (F.col("new") == 0), F.lit("all_closed"))
               .when(F.col("remaining") > 0, F.lit("still_vulnerable")).otherwise(F.lit("changed")))
    return out.select("file", "closed", "remaining", "new", verdict.alias("verdict"))


def audit_state(events: DataFrame) -> DataFrame:
    """Latest state per finding; an empty state removes it."""
    latest = events.groupBy("scan_id", "idx").agg(
        F.max_by("after", F.struct("at", "id")).alias("state"), F.max("at").alias("at"))
    return latest.filter(F.coalesce("state", F.lit("")) != "")


def audit_notes(notes: DataFrame) -> DataFrame:
    """Latest note per finding, trimmed and capped; an empty note removes it."""
    latest = notes.groupBy("scan_id", "idx").agg(F.max_by("note", F.struct("at", "id")).alias("note"))
    text = F.regexp_replace("note", r"^\s+|\s+$", "")
    return latest.withColumn("note", F.substring(text, 1, NOTE_CHARS)).filter(F.coalesce("note", F.lit("")) != "")


def valid_events(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Events with a known status on an existing finding."""
    return (events.filter(F.col("after").isin(list(AUDIT_STATES)))
            .join(findings.select("scan_id", "idx"), ["scan_id", "idx"], "left_semi"))


def rejected_events(events: DataFrame, findings: DataFrame) -> DataFrame:
    known = F.coalesce(F.col("after").isin(list(AUDIT_STATES)), F.lit(False))
    orphan = events.join(findings.select("scan_id", "idx"), ["scan_id", "idx"], "left_anti")
    return (orphan.withColumn("reason", F.when(known, F.lit("index")).otherwise(F.lit("status")))
            .unionByName(events.filter(~known).join(findings.select("scan_id", "idx"), ["scan_id", "idx"], "left_semi")
                         .withColumn("reason", F.lit("status"))))


def bulk_audit(targets: DataFrame, states: DataFrame, notes: DataFrame, status: str, note: str = "",
               overwrite: bool = False) -> DataFrame:
    """One verdict for a filtered set: which rows change, which notes are written or kept."""
    text = note.strip()[:NOTE_CHARS]
    rows = (targets.select("scan_id", "idx").distinct()
            .join(states.select("scan_id", "idx", F.col("state").alias("before")), ["scan_id", "idx"], "left")
            .join(notes.select("scan_id", "idx", F.col("note").alias("old_note")), ["scan_id", "idx"], "left"))
    has_note = F.coalesce("old_note", F.lit("")) != ""
    kept = has_note & F.lit(bool(text) and not overwrite)
    new_note = F.when(F.lit(not text) | kept, F.col("old_note")).otherwise(F.lit(text))
    before = F.coalesce("before", F.lit(""))
    return rows.select("scan_id", "idx", before.alias("before"), F.lit(status).alias("after"),
                       (before != status).alias("changed"), kept.alias("note_kept"), new_note.alias("note"))


def audit_history(events: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """Newest events per finding.  The rank limit is applied before the shuffle as well."""
    w = W.partitionBy("scan_id", "idx").orderBy(F.col("at").desc(), F.col("id").desc())
    return events.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)


def carry_over(findings: DataFrame, previous: DataFrame, states: DataFrame, notes: DataFrame) -> DataFrame:
    """Verdict and note of the previous snapshot on findings with the same fingerprint.

    Both are inherited independently; the first earlier row that has one wins.
    ``findings(scan_id, prev_scan_id, idx, fp)``, ``previous(scan_id, idx, stored_fp)``.
    """
    old = previous.filter(F.coalesce("stored_fp", F.lit("")) != "")
    keyed = ["scan_id", "idx"]

    def first(table: DataFrame, col: str) -> DataFrame:
        return (old.join(table.select(*keyed, col), keyed)
                .groupBy("scan_id", "stored_fp").agg(F.min_by(col, "idx").alias(col))
                .select(F.col("scan_id").alias("prev_scan_id"), F.col("stored_fp").alias("fp"), col))

    # rows without a predecessor cannot inherit; as NULL keys they would all meet in one task
    return (findings.filter(F.col("prev_scan_id").isNotNull()).join(first(states, "state"), ["prev_scan_id", "fp"], "left")
            .join(first(notes, "note"), ["prev_scan_id", "fp"], "left")
            .filter(F.col("state").isNotNull() | F.col("note").isNotNull()))


def with_state(findings: DataFrame, states: DataFrame) -> DataFrame:
    return (findings.join(states.select("scan_id", "idx", "state"), ["scan_id", "idx"], "left")
            .withColumn("state", F.coalesce("state", F.lit(""))))


def is_open(state: Column) -> Column:
    return ~F.coalesce(state, F.lit("")).isin(list(CLOSED))


def open_counts(with_states: DataFrame) -> DataFrame:
    return with_states.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total"),
                                              F.count_if(is_open(F.col("state"))).alias("open_count"))


def open_severity(with_states: DataFrame) -> DataFrame:
    return (with_states.filter(is_open(F.col("state"))).groupBy("scan_id", "severity")
            .agg(F.count(F.lit(1)).alias("n")))


def audit_summary(with_states: DataFrame) -> DataFrame:
    state = F.when(F.col("state") == "", F.lit("unaudited")).otherwise(F.col("state"))
    return with_states.groupBy("scan_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def flag_new(findings: DataFrame, diff: DataFrame) -> DataFrame:
    """``is_new`` against the previous scan; (scan, fingerprint) is unique in the diff."""
    new = diff.filter(F.col("status") == "new").select("scan_id", F.col("stored_fp").alias("fp"), F.lit(True).alias("_new"))
    return findings.join(new, ["scan_id", "fp"], "left").withColumn(
        "is_new", F.coalesce("_new", F.lit(False))).drop("_new")


def priority_queue(findings: DataFrame, top: int = 8) -> DataFrame:
    """Unaudited first looks per scan: new before old, then severity, then file."""
    w = W.partitionBy("scan_id").orderBy((~F.col("is_new")).cast("int"), severity_rank(F.col("severity")), "file", "idx")
    return (findings.filter(F.col("state") == "").withColumn("pos", F.row_number().over(w))
            .filter(F.col("pos") <= top))


def delete_scans(table: DataFrame, doomed: DataFrame) -> DataFrame:
    """A table without the rows of the deleted snapshots."""
    return table.join(doomed.select("scan_id").distinct(), "scan_id", "left_anti")
