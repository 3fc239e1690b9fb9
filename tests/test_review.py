"""Triage, validation, accuracy, streams."""
import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from corpusflow import streaming
from corpusflow.operators import evaluate, triage
from corpusflow.sources import truth

STEPS = "array<struct<kind:string,file:string,line:int,code:string,uncertain:boolean>>"


def _findings(spark):
    rows = [(1, i, rule, "CWE-1", "high", [("match", "f.js", i + 1, code, False)]) for i, (rule, code) in enumerate([("r", "a b"), ("r", "ab"), ("r", "c"), ("q", "ab")])]
    return spark.createDataFrame(rows, f"scan_id long, idx long, rule_id string, cwe string, severity string, steps {STEPS}")


def test_four_findings_three_clusters_and_propagation(spark):
    f = _findings(spark)
    reps = triage.clusters(f)
    assert reps.count() == 3
    lines = spark.createDataFrame([("f.js", i, f"line {i}") for i in range(1, 10)], "file string, line_no int, line string")
    prompts = triage.prompts(f, lines)
    assert "    1| line 1" in prompts.filter("idx = 0").first().prompt

    def scorer(batches):
        for b in batches:
            yield pd.DataFrame({"scan_id": b.scan_id, "idx": b.idx, "verdict": "true_positive", "confidence": 0.5, "reason": "x", "provider": "p", "error": ""})

    answers = triage.score(prompts.join(reps.select("scan_id", "idx"), ["scan_id", "idx"]), scorer,
                           "scan_id long, idx long, verdict string, confidence double, reason string, provider string, error string")
    judged = triage.apply_verdicts(reps, answers.filter("idx <> 2"))
    out = {r.idx: r.verdict for r in triage.propagate(f, judged).collect()}
    assert out == {0: "true_positive", 1: "true_positive", 2: "uncertain", 3: "true_positive"}


def test_judging(spark):
    cols = ("event string, rule_id string, elapsed_ms long, oast_hit boolean, body_marker boolean, file_leak boolean, redirect_external boolean, "
            "error_signature string, blocked string, static_safe boolean, agent_confirmed boolean")
    n = None
    rows = [("a", "py.sqli", 6000, n, n, n, n, n, n, n, n), ("b", "py.sqli", 10, n, n, n, n, "ORA", n, n, n), ("c", "js.xss", n, n, True, n, n, n, n, n, n), ("d", "js.xss", n, n, n, n, n, n, n, n, n),
            ("e", "x", n, n, n, n, n, n, n, n, True), ("f", "js.xss", n, n, True, n, n, n, n, True, n), ("g", "js.xss", n, n, True, n, n, n, "REQUIRES_AUTH", n, n), ("h", "js.xss", n, n, n, n, n, n, "odd", n, n)]
    got = {r.event: (r.verdict, r.blocked_reason) for r in triage.judge(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": ("CONFIRMED", n), "b": ("LIKELY", n), "c": ("CONFIRMED", n), "d": ("NOT_REPRODUCED", n), "e": ("LIKELY", n), "f": ("FALSE_POSITIVE", n),
                   "g": ("NOT_VALIDATED", "REQUIRES_AUTH"), "h": ("NOT_VALIDATED", "VALIDATION_BLOCKED")}


def test_confusion_and_metrics(spark):
    t = spark.createDataFrame([("1", "a", True), ("2", "a", False), ("3", "a", True), ("4", "b", True)], truth.TRUTH)
    h = spark.createDataFrame([("1", "r"), ("1", "r"), ("2", "r"), ("4", "r")], "name string, rule_id string")
    c = evaluate.confusion(t, h, spark.createDataFrame([("a", "r"), ("b", None)], "category string, rule_id string"))
    rows = {r.category: r for r in c.collect()}
    assert (rows["a"].tp, rows["a"].fn, rows["a"].fp, rows["a"].tn) == (1, 1, 1, 0) and rows["b"].total == 1 and not rows["b"].scored
    m = {r.category: r for r in evaluate.metrics_overall(c).collect()}
    assert m["(overall)"].recall == 0.5 and m["(overall)"].score == -0.5


def test_truth_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text("# name,cat,real\nT1,sqli,true,89\nT2,xss,false,79\n")
    assert {tuple(r) for r in truth.from_csv(spark, str(tmp_path / "e.csv")).collect()} == {("T1", "sqli", True), ("T2", "xss", False)}
    files = spark.createDataFrame([("sql/CWE_89/unsafe/x1.php",), ("sql/CWE_89/safe/x2.php",), ("docs/readme.php",)], "file string")
    assert {tuple(r) for r in truth.from_paths(files).collect()} == {("x1", "CWE_89", True), ("x2", "CWE_89", False)}
    case = tmp_path / "m" / "case1"
    (case / "src").mkdir(parents=True)
    (case / "manifest.sarif").write_text('{"runs": [{"properties": {"state": "bad"}}]}')
    (case / "src" / "CWE89__x.cs").write_text("x")
    assert [tuple(r) for r in truth.from_manifests(spark, str(tmp_path / "m")).collect()] == [("CWE89__x", "CWE89", True)]


def test_result_difference_is_empty_only_for_equal_runs(spark):
    a = spark.createDataFrame([("r", "f", 1), ("r", "f", 1)], "rule_id string, file string, line int")
    assert evaluate.result_difference(a, a).count() == 0 and evaluate.result_difference(a, a.dropDuplicates()).count() == 1


def test_late_events_lose_by_time_over_batches(spark, tmp_path):
    schema = "scan_id long, idx long, after string, at timestamp, id long"
    t = lambda d: dt.datetime(2026, 1, d)
    for i, rows in enumerate([[(1, 1, "fixed", t(5), 1), (1, 2, "confirmed", t(1), 2)], [(1, 1, "confirmed", t(3), 3)], [(1, 2, "", t(9), 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"d{i}"))
    fold = streaming.audit_upsert(str(tmp_path / "state"))
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    src.writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    state = spark.read.parquet(str(tmp_path / "state" / f"v{fold.last}"))
    assert fold.last == 2 and {(r.idx, r.e.state) for r in state.collect()} == {(1, "fixed"), (2, "")}
    assert [tuple(r) for r in streaming.open_counts(state).collect()] == [(1, 1, 0)]


def test_stream_scan_reports_a_fingerprint_once(spark, tmp_path):
    schema = "project string, file string, lang string, ext string, text string, at timestamp"
    row = ("p", "a.js", "javascript", ".js", "host = 10.1.1.1\n", dt.datetime(2026, 1, 1))
    for i in range(2):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"d{i}"))
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streaming.stream_pattern_scan(src, event_time="at").select("rule_id", "fp", "at")
    out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_rows_with_their_cluster_move_without_steps(spark):
    f = _findings(spark)
    keyed = triage.cluster_key(f).select("scan_id", "idx", "rule_id", "cluster")
    reps = triage.clusters(keyed, keyed=True)
    assert sorted(map(tuple, reps.collect())) == sorted(map(tuple, triage.clusters(f).collect()))
    judged = triage.apply_verdicts(reps, reps.select("scan_id", "idx", F.lit("true_positive").alias("verdict"), F.lit(0.5).alias("confidence"), F.lit("x").alias("reason"),
                                                     F.lit("p").alias("provider"), F.lit("").alias("error")).filter("idx <> 2"))
    some = triage.propagate(keyed, judged, keyed=True)
    whole = triage.propagate(f, judged)
    assert whole.columns[:2] == ["scan_id", "cluster"] and "steps" in whole.columns
    cols = ["scan_id", "idx", "cluster", "verdict", "triage_reason"]
    assert sorted(map(tuple, some.select(cols).collect())) == sorted(map(tuple, whole.select(cols).collect()))
    assert {r.idx: r.verdict for r in some.collect()} == {0: "true_positive", 1: "true_positive", 2: "uncertain", 3: "true_positive"}
