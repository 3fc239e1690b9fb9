"""Continuous forms of the pattern scan and of the review state."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.identity import fingerprint
from ..operators.lifecycle import CLOSED
from ..operators.patterns import pattern_scan
from ..sources.corpus import split_lines


def stream_pattern_scan(files: DataFrame, rules: Sequence[tuple] | None = None, event_time: str | None = None,
                        lateness: str = "1 hour") -> DataFrame:
    """Findings of arriving files, each fingerprint once.

    The scan itself is stateless.  With an event time the duplicate state is bounded by the
    watermark; without one it grows with the distinct findings.
    """
    lines = split_lines(files)
    found = pattern_scan_keeping(lines, rules, event_time)
    found = found.withColumn("fp", fingerprint(F.col("rule_id"), F.col("file"), F.element_at("steps", -1)["code"]))
    if event_time:
        return found.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["project", "fp"])
    return found.dropDuplicates(["project", "fp"])


def pattern_scan_keeping(lines: DataFrame, rules, event_time: str | None) -> DataFrame:
    """``pattern_scan`` that carries an event time through."""
    if not event_time:
        return pattern_scan(lines, rules)
    tagged = lines.withColumn("project", F.struct("project", event_time))
    out = pattern_scan(tagged, rules)
    return out.withColumn(event_time, F.col(f"project.{event_time}")).withColumn("project", F.col("project.project"))


def latest_state(events: DataFrame) -> DataFrame:
    """Newest event per finding as a streaming aggregate; a late event loses by its timestamp."""
    return events.groupBy("scan_id", "idx").agg(F.max_by("after", F.struct("at", "id")).alias("state"),
                                                F.max(F.struct("at", "id")).alias("stamp"))


def audit_upsert(state_path: str):
    """``foreachBatch`` writer: merges one micro-batch into the state table under ``state_path``.

    The table is versioned by folder: batch n reads version n - 1 and writes version n.  A batch
    replayed after a failure rewrites its own version from the same input, so the fold stays exact.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        new = batch.groupBy("scan_id", "idx").agg(
            F.max(F.struct("at", "id", F.col("after").alias("state"))).alias("e"))
        previous = f"{state_path}/v{batch_id - 1}"
        if batch_id > 0:
            new = session.read.parquet(previous).unionByName(new)
        (new.groupBy("scan_id", "idx").agg(F.max("e").alias("e"))
         .write.mode("overwrite").parquet(f"{state_path}/v{batch_id}"))
        write.last = batch_id
    write.last = None
    return write


def open_counts(state: DataFrame) -> DataFrame:
    """Findings per scan that a verdict closed, and those judged but open."""
    rows = state.select("scan_id", F.col("e.state").alias("state")).filter(F.coalesce("state", F.lit("")) != "")
    closed = F.col("state").isin(list(CLOSED))
    return rows.groupBy("scan_id").agg(F.count_if(closed).alias("closed"), F.count_if(~closed).alias("open_judged"))
