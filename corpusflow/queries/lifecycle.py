"""Identity, snapshot difference and review state over the derived hub tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import query
from .inputs import (AUDIT, FINDINGS, NOTES, RANK, SCANS, STATES, audit_events, audit_notes, findings, raw_notes,
                     scans, states, with_sql)

from ..operators import findings as hub, lifecycle

from ..plans import dimension
from ..plans.dims import BROADCAST_ROWS

#: rename history: a chain over two steps, a plain rename, and a cycle
RENAMES = [("py.sqli.small", "py.sqli.tiny"), ("py.sqli.tiny", "py.sqli.mini"), ("java.xss.red", "java.xss.crimson"),
           ("java.xss.blue", "java.xss.green"), ("java.xss.green", "java.xss.blue")]
CANONICAL = {"py.sqli.small": "py.sqli.mini", "py.sqli.tiny": "py.sqli.mini", "java.xss.red": "java.xss.crimson",
             "java.xss.blue": "java.xss.blue", "java.xss.green": "java.xss.green"}


def _canonical(spark) -> DataFrame:
    names = lifecycle.resolve_aliases(dimension(spark, RENAMES, "old_id string, new_id string"))
    # one row per old name at most; unhinted, all findings would move by their few rule names to meet them
    return F.broadcast(names) if len(RENAMES) <= BROADCAST_ROWS else names


def stored(spark, sf) -> DataFrame:
    return lifecycle.with_stored_fp(findings(spark, sf), _canonical(spark))


_NAMES = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CANONICAL.items()) + " ELSE rule_id END"
STORED = f"""stored AS (SELECT *, CASE WHEN {_NAMES} <> rule_id
    THEN substr(sha1({_NAMES} || '|' || file || '|' || replace(code, ' ', '')), 1, 16) ELSE fp END AS stored_fp FROM findings)"""


@query("fingerprint", with_sql(FINDINGS, select="SELECT fp, count(*) AS n FROM findings GROUP BY fp"))
def fingerprint(spark, sf):
    return findings(spark, sf).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))


@query("rule_alias", with_sql(FINDINGS, select=f"SELECT rule_id, {_NAMES} AS canonical, count(*) AS n FROM findings GROUP BY ALL"))
def rule_alias(spark, sf):
    f = findings(spark, sf).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    names = _canonical(spark).withColumnRenamed("old_id", "rule_id")
    return f.join(names, "rule_id", "left").select("rule_id", F.coalesce("canonical", "rule_id").alias("canonical"), "n")


@query("stored_fp", with_sql(FINDINGS, STORED, select="SELECT stored_fp, count(*) AS n, count(*) FILTER (WHERE stored_fp <> fp) AS renamed FROM stored GROUP BY 1"))
def stored_fp(spark, sf):
    return stored(spark, sf).groupBy("stored_fp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stored_fp") != F.col("fp")).alias("renamed"))


def chain(spark, sf) -> DataFrame:
    """Scans with their predecessor and its dependency flag."""
    s = lifecycle.previous_scans(scans(spark, sf))
    # the predecessors' flags are those of the scans themselves; the order of the scans is not needed a second time
    prev = scans(spark, sf).select(F.col("scan_id").alias("prev_scan_id"), F.col("sca").alias("prev_sca"))
    return s.join(prev, "prev_scan_id", "left")


CHAIN = """by_time AS (SELECT project, created_at, max(scan_id) AS last_id FROM scans GROUP BY ALL),
priors AS (SELECT project, created_at, lag(last_id) OVER (PARTITION BY project ORDER BY created_at) AS prev_scan_id FROM by_time),
chain AS (SELECT s.*, p.prev_scan_id, o.sca AS prev_sca FROM scans s JOIN priors p USING (project, created_at)
          LEFT JOIN scans o ON o.scan_id = p.prev_scan_id)"""


@query("previous_scan", with_sql(SCANS, CHAIN, select="SELECT scan_id, project, prev_scan_id FROM chain"))
def previous_scan(spark, sf):
    return chain(spark, sf).select("scan_id", "project", "prev_scan_id")


def diff(spark, sf, *shown: str) -> DataFrame:
    """Every scan against its previous one, with the columns ``shown`` of the findings."""
    rows = stored(spark, sf).select("scan_id", "idx", "stored_fp", "category", *shown)
    return lifecycle.scan_diff(rows, chain(spark, sf))


LAST = """last_rows AS (
  SELECT scan_id, stored_fp, arg_max(rule_id, idx) AS rule_id, arg_max(severity, idx) AS severity, arg_max(category, idx) AS category, max(idx) AS idx
  FROM stored GROUP BY ALL)"""
DIFF = """cur AS (SELECT c.scan_id, l.stored_fp, l.rule_id, l.category, l.idx, l.severity,
  NOT (c.prev_scan_id IS NOT NULL AND c.sca IS DISTINCT FROM c.prev_sca) AS same_axis FROM chain c JOIN last_rows l USING (scan_id)),
old AS (SELECT c.scan_id, l.stored_fp, l.rule_id, l.category, l.idx, l.severity,
  NOT (c.sca IS DISTINCT FROM c.prev_sca) AS same_axis FROM chain c JOIN last_rows l ON l.scan_id = c.prev_scan_id),
cur_axis AS (SELECT * FROM cur WHERE same_axis OR category <> 'dependency'),
old_axis AS (SELECT * FROM old WHERE same_axis OR category <> 'dependency'),
diff AS (SELECT coalesce(c.scan_id, o.scan_id) AS scan_id, coalesce(c.stored_fp, o.stored_fp) AS stored_fp,
  CASE WHEN o.stored_fp IS NULL THEN 'new' WHEN c.stored_fp IS NULL THEN 'resolved' ELSE 'persistent' END AS status,
  coalesce(c.rule_id, o.rule_id) AS rule_id, coalesce(c.idx, o.idx) AS idx, coalesce(c.category, o.category) AS category
  FROM cur_axis c FULL JOIN old_axis o ON c.scan_id = o.scan_id AND c.stored_fp = o.stored_fp)"""


@query("scan_diff", with_sql(SCANS, FINDINGS, STORED, CHAIN, LAST, DIFF, select="SELECT scan_id, stored_fp, status, rule_id, idx FROM diff"))
def scan_diff(spark, sf):
    return diff(spark, sf, "rule_id").select("scan_id", "stored_fp", "status", "rule_id", "idx")


@query("diff_same_axis", with_sql(SCANS, FINDINGS, STORED, CHAIN, LAST, DIFF, select="SELECT category, status, count(*) AS n FROM diff GROUP BY ALL"))
def diff_same_axis(spark, sf):
    return diff(spark, sf).groupBy("category", "status").agg(F.count(F.lit(1)).alias("n"))


COUNTS = """diff_counts AS (SELECT scan_id, count(*) FILTER (WHERE status = 'new') AS new_count, count(*) FILTER (WHERE status = 'resolved') AS resolved_count,
  count(*) FILTER (WHERE status = 'persistent') AS persistent_count FROM diff GROUP BY scan_id)"""


@query("diff_counts", with_sql(SCANS, FINDINGS, STORED, CHAIN, LAST, DIFF, COUNTS, select="SELECT * FROM diff_counts"))
def diff_counts(spark, sf):
    return lifecycle.diff_counts(diff(spark, sf))


@query("verify_fix", with_sql(FINDINGS, """b AS (SELECT DISTINCT source_file AS file, fp FROM findings WHERE fp_hint),
a AS (SELECT DISTINCT source_file AS file, fp FROM findings WHERE uncertain),
known AS (SELECT DISTINCT file FROM b),
c AS (SELECT coalesce(b.file, a.file) AS file, count(*) FILTER (WHERE a.fp IS NULL) AS closed,
  count(*) FILTER (WHERE a.fp IS NOT NULL AND b.fp IS NOT NULL) AS remaining, count(*) FILTER (WHERE b.fp IS NULL) AS "new"
  FROM b FULL JOIN a ON a.file = b.file AND a.fp = b.fp GROUP BY 1)""",
       select="""SELECT c.file, closed, remaining, "new", CASE WHEN known.file IS NULL THEN 'none' WHEN remaining = 0 AND "new" = 0 THEN 'all_closed'
  WHEN remaining > 0 THEN 'still_vulnerable' ELSE 'changed' END AS verdict FROM c LEFT JOIN known USING (file)"""))
def verify_fix(spark, sf):
    f = findings(spark, sf).select(F.col("source_file").alias("file"), "fp", "fp_hint", "uncertain")
    before = f.filter("fp_hint")
    return lifecycle.verify_fix(before, f.filter("uncertain"), before)


@query("audit_state", with_sql(AUDIT, STATES, select="SELECT scan_id, idx, state FROM states"))
def audit_state(spark, sf):
    return states(spark, sf).select("scan_id", "idx", "state")


@query("audit_note", with_sql(AUDIT, NOTES, select="SELECT scan_id, idx, note FROM notes"))
def audit_note(spark, sf):
    return lifecycle.audit_notes(raw_notes(spark, sf)).select("scan_id", "idx", "note")


@query("audit_validate", with_sql(AUDIT, FINDINGS, select="""SELECT event_type, f.idx IS NOT NULL AS accepted, count(*) AS n
FROM audit_events LEFT JOIN (SELECT DISTINCT scan_id, idx FROM findings) f USING (scan_id, idx) GROUP BY ALL"""))
def audit_validate(spark, sf):
    e, f = audit_events(spark, sf), findings(spark, sf)
    ok = lifecycle.valid_events(e, f).withColumn("accepted", F.lit(True))
    no = lifecycle.rejected_events(e, f).drop("reason").withColumn("accepted", F.lit(False))
    return ok.unionByName(no).groupBy("event_type", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("audit_bulk", with_sql(AUDIT, STATES, NOTES, FINDINGS, select="""SELECT t.scan_id, t.idx, coalesce(state, '') AS before, coalesce(state, '') <> 'false_positive' AS changed,
  coalesce(note, '') <> '' AS note_kept, coalesce(note, 'vendor code') AS note
FROM (SELECT DISTINCT scan_id, idx FROM findings WHERE severity = 'low') t LEFT JOIN states USING (scan_id, idx) LEFT JOIN notes USING (scan_id, idx)"""))
def audit_bulk(spark, sf):
    targets = findings(spark, sf).filter(F.col("severity") == "low")
    out = lifecycle.bulk_audit(targets, states(spark, sf), audit_notes(spark, sf), "false_positive", " vendor code ")
    return out.select("scan_id", "idx", "before", "changed", "note_kept", "note")


@query("audit_history", with_sql(AUDIT, select="""SELECT scan_id, idx, id, n FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, idx ORDER BY "at" DESC, id DESC) AS n FROM audit_events) WHERE n <= 50"""))
def audit_history(spark, sf):
    return lifecycle.audit_history(audit_events(spark, sf)).select("scan_id", "idx", "id", F.col("n").cast("long").alias("n"))


#: A hundred orders are one snapshot here, so that neighbours share most stored fingerprints.
SNAP = 100
CARRY = f"""snap AS (SELECT scan_id // {SNAP} AS scan_id, (scan_id % {SNAP}) * 10000000000000000 + idx AS idx, stored_fp AS fp FROM stored),
snap_states AS (SELECT scan_id // {SNAP} AS scan_id, (scan_id % {SNAP}) * 10000000000000000 + idx AS idx, state FROM states),
snap_notes AS (SELECT scan_id // {SNAP} AS scan_id, (scan_id % {SNAP}) * 10000000000000000 + idx AS idx, note FROM notes),
old_states AS (SELECT s.scan_id + 1 AS scan_id, s.fp, arg_min(t.state, s.idx) AS state FROM snap s JOIN snap_states t USING (scan_id, idx) GROUP BY ALL),
old_notes AS (SELECT s.scan_id + 1 AS scan_id, s.fp, arg_min(t.note, s.idx) AS note FROM snap s JOIN snap_notes t USING (scan_id, idx) GROUP BY ALL)"""


@query("carry_over", with_sql(FINDINGS, STORED, AUDIT, STATES, NOTES, CARRY, select="""SELECT f.scan_id, f.idx, s.state, n.note FROM snap f
LEFT JOIN old_states s ON s.scan_id = f.scan_id AND s.fp = f.fp LEFT JOIN old_notes n ON n.scan_id = f.scan_id AND n.fp = f.fp
WHERE s.state IS NOT NULL OR n.note IS NOT NULL"""))
def carry_over(spark, sf):
    """Verdicts and notes go from one snapshot to the next by the stored fingerprint."""
    def snap(df):
        return df.withColumn("idx", (F.col("scan_id") % SNAP) * F.lit(10 ** 16) + F.col("idx")).withColumn("scan_id", F.floor(F.col("scan_id") / SNAP))
    f = snap(stored(spark, sf).select("scan_id", "idx", "stored_fp"))
    current = f.select("scan_id", F.when(F.col("scan_id") > 0, F.col("scan_id") - 1).alias("prev_scan_id"), "idx", F.col("stored_fp").alias("fp"))
    return lifecycle.carry_over(current, f, snap(states(spark, sf)), snap(audit_notes(spark, sf))).select("scan_id", "idx", "state", "note")


@query("scan_delete", with_sql(SCANS, FINDINGS, select="SELECT f.scan_id, count(*) AS n FROM findings f JOIN scans s USING (scan_id) WHERE s.priority <> '5-LOW' GROUP BY 1"))
def scan_delete(spark, sf):
    doomed = scans(spark, sf).filter(F.col("priority") == "5-LOW")
    return lifecycle.delete_scans(findings(spark, sf), doomed).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))


def judged(spark, sf) -> DataFrame:
    return lifecycle.with_state(findings(spark, sf), states(spark, sf))


JUDGED = "judged AS (SELECT f.*, coalesce(state, '') AS state FROM findings f LEFT JOIN states USING (scan_id, idx))"
_OPEN = "state NOT IN ('false_positive', 'deferred', 'fixed')"


@query("open_count", with_sql(FINDINGS, AUDIT, STATES, JUDGED, select=f"SELECT scan_id, count(*) AS total, count(*) FILTER (WHERE {_OPEN}) AS open_count FROM judged GROUP BY 1"))
def open_count(spark, sf):
    return lifecycle.open_counts(judged(spark, sf))


@query("open_severity", with_sql(FINDINGS, AUDIT, STATES, JUDGED, select=f"SELECT scan_id, severity, count(*) AS n FROM judged WHERE {_OPEN} GROUP BY ALL"))
def open_severity(spark, sf):
    return lifecycle.open_severity(judged(spark, sf))


@query("audit_summary", with_sql(FINDINGS, AUDIT, STATES, JUDGED, select="SELECT scan_id, CASE WHEN state = '' THEN 'unaudited' ELSE state END AS state, count(*) AS n FROM judged GROUP BY ALL"))
def audit_summary(spark, sf):
    return lifecycle.audit_summary(judged(spark, sf))


def flagged(spark, sf) -> DataFrame:
    rows = lifecycle.with_state(stored(spark, sf), states(spark, sf)).withColumn("fp", F.col("stored_fp"))
    d = diff(spark, sf)
    return lifecycle.flag_new(rows, d)


FLAGGED = """flagged AS (SELECT f.*, coalesce(state, '') AS state, d.stored_fp IS NOT NULL AS is_new FROM stored f
  LEFT JOIN states USING (scan_id, idx) LEFT JOIN (SELECT scan_id, stored_fp FROM diff WHERE status = 'new') d ON d.scan_id = f.scan_id AND d.stored_fp = f.stored_fp)"""
_ALL = (SCANS, FINDINGS, STORED, CHAIN, LAST, DIFF, AUDIT, STATES, FLAGGED)


@query("is_new_flag", with_sql(*_ALL, select="SELECT scan_id, idx, is_new FROM flagged"))
def is_new_flag(spark, sf):
    return flagged(spark, sf).select("scan_id", "idx", "is_new")


@query("priority_queue", with_sql(*_ALL, select=f"""SELECT scan_id, idx, pos FROM (SELECT scan_id, idx,
  row_number() OVER (PARTITION BY scan_id ORDER BY is_new DESC, {RANK}, file, idx) AS pos FROM flagged WHERE state = '') WHERE pos <= 8"""))
def priority_queue(spark, sf):
    return lifecycle.priority_queue(flagged(spark, sf)).select("scan_id", "idx", F.col("pos").cast("long").alias("pos"))


@query("finding_id", with_sql(FINDINGS, select="""SELECT scan_id, idx, rule_id || ':' || file || ':' || line || CASE WHEN n = 1 THEN '' ELSE '#' || n END AS finding_id
FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, file, line ORDER BY idx, scan_id) AS n FROM findings)"""))
def finding_id(spark, sf):
    # idx is unique inside a scan only; over all scans the scan breaks ties
    f = findings(spark, sf).select("scan_id", "idx", "rule_id", "file", "line")
    packed = f.withColumn("at", F.struct("idx", "scan_id")).drop("idx").withColumnRenamed("at", "idx")
    return hub.finding_ids(packed).select("scan_id", F.col("idx.idx").alias("idx"), "finding_id")


