"""Identity, snapshot difference, review state, exports, checklists, roll-ups."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.identity import csv_safe, fingerprint, project_name
from corpusflow.operators import findings as hub, lifecycle, rollups, standards
from corpusflow.plans import carry_last, lag_in_key, number_in_key, running_sum
from corpusflow.sources import rules


def one(spark, col, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(col(F.col("v"))).collect()]


def test_fingerprint_ignores_spacing_only(spark):
    a, b, c = one(spark, lambda v: fingerprint(F.lit("r"), F.lit("f"), v), "x = 1", "x=1 ", "x = 2")
    assert a == b != c and len(a) == 16


def test_project_names(spark):
    assert one(spark, project_name, "shop-main.zip", "shop-v2.3.zip", "shop_20260902.zip", "plain.zip") == ["shop", "shop", "shop", "plain"]


def test_csv_safe(spark):
    assert one(spark, csv_safe, "=cmd", "+1", "-1", "@x", "ok") == ["'=cmd", "'+1", "'-1", "'@x", "ok"]


def test_rename_chain_and_cycle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("t", "x")], "old_id string, new_id string")
    got = {r.old_id: r.canonical for r in lifecycle.resolve_aliases(df).collect()}
    assert got == {"a": "c", "b": "c", "x": "x", "y": "y", "t": "x"}


def _f(scan, idx, fp, category="flow", severity="high"):
    return (scan, idx, fp, "r", severity, "f", 1, category)


F_SCHEMA = "scan_id long, idx long, stored_fp string, rule_id string, severity string, file string, line int, category string"


def _diff(spark, rows, sca=(False, False)):
    scans = spark.createDataFrame([(1, None, sca[0], None), (2, 1, sca[1], sca[0])], "scan_id long, prev_scan_id long, sca boolean, prev_sca boolean")
    d = lifecycle.scan_diff(spark.createDataFrame(rows, F_SCHEMA), scans)
    return {(r.stored_fp, r.status) for r in d.filter("scan_id = 2").collect()}


def test_diff_statuses(spark):
    rows = [_f(1, 0, "a"), _f(1, 1, "b"), _f(2, 0, "b"), _f(2, 1, "c"), _f(2, 2, "c"), _f(2, 3, "")]
    assert _diff(spark, rows) == {("a", "resolved"), ("b", "persistent"), ("c", "new")}


def test_diff_with_itself_is_empty(spark):
    rows = [_f(s, i, fp) for s in (1, 2) for i, fp in enumerate("abc")]
    assert {s for _, s in _diff(spark, rows)} == {"persistent"}


def test_turning_dependencies_off_resolves_nothing(spark):
    rows = [_f(1, 0, "a"), _f(1, 1, "d", "dependency"), _f(2, 0, "a")]
    assert _diff(spark, rows, (True, False)) == {("a", "persistent")}
    assert _diff(spark, rows, (True, True)) == {("a", "persistent"), ("d", "resolved")}


def test_open_counts(spark):
    rows = spark.createDataFrame([(1, i, "high") for i in range(5)], "scan_id long, idx long, severity string")
    t = dt.datetime(2026, 1, 1)
    events = spark.createDataFrame([(1, 0, "false_positive", t, 1), (1, 1, "confirmed", t, 2), (1, 2, "fixed", t, 3), (1, 2, "", t, 4), (1, 9, "fixed", t, 5), (1, 3, "bad", t, 6)],
                                   "scan_id long, idx long, after string, at timestamp, id long")
    ok = lifecycle.valid_events(events, rows)
    assert {r.reason for r in lifecycle.rejected_events(events, rows).collect()} == {"index", "status"}
    judged = lifecycle.with_state(rows, lifecycle.audit_state(ok))
    (o,) = lifecycle.open_counts(judged).collect()
    assert (o.total, o.open_count) == (5, 4)
    assert {r.state: r.n for r in lifecycle.audit_summary(judged).collect()} == {"false_positive": 1, "confirmed": 1, "unaudited": 3}


def test_previous_scan_is_strictly_earlier(spark):
    t = [dt.datetime(2026, 1, d) for d in (1, 2, 2, 3)]
    scans = spark.createDataFrame([(i, "p", x) for i, x in enumerate(t)] + [(9, "", t[0])], "scan_id long, project string, created_at timestamp")
    got = {r.scan_id: r.prev_scan_id for r in lifecycle.previous_scans(scans).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 2, 9: None}


def test_verify_without_baseline_is_not_all_new(spark):
    s = "file string, fp string"
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], s)
    after = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], s)
    got = {r.file: r.verdict for r in lifecycle.verify_fix(before, after, before).collect()}
    assert got == {"a": "all_closed", "b": "still_vulnerable", "c": "changed", "d": "none"}


def test_bulk_keeps_notes_unless_told(spark):
    t = spark.createDataFrame([(1, 0), (1, 1)], "scan_id long, idx long")
    states = spark.createDataFrame([(1, 0, "fixed")], "scan_id long, idx long, state string")
    notes = spark.createDataFrame([(1, 1, "mine")], "scan_id long, idx long, note string")
    keep = {r.idx: r for r in lifecycle.bulk_audit(t, states, notes, "fixed", " why ").collect()}
    assert (keep[0].changed, keep[0].note, keep[1].changed, keep[1].note, keep[1].note_kept) == (False, "why", True, "mine", True)
    over = {r.idx: r.note for r in lifecycle.bulk_audit(t, states, notes, "fixed", "why", overwrite=True).collect()}
    assert over == {0: "why", 1: "why"}


# ---- ordered helpers against brute force, with one key that holds most rows -------------------

@pytest.fixture(scope="module")
def skewed(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 37) % 501, i, None if i % 4 else i) for i in range(501)]
    return rows, spark.createDataFrame(rows, "k string, o long, v long, w long").repartition(7)


def _brute(rows, step):
    out = {}
    for key in {r[0] for r in rows}:
        state = None
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            state, out[(key, r[1])] = step(state, r)
    return out


def test_number_lag_sum_and_carry(spark, skewed):
    rows, df = skewed
    got = {(r.k, r.o): r.n for r in number_in_key(df, ["k"], ["o"], "n").collect()}
    assert got == _brute(rows, lambda s, r: ((s or 0) + 1, (s or 0) + 1))
    got = {(r.k, r.o): r.prev_v for r in lag_in_key(df, ["k"], ["o"], ["v"]).collect()}
    assert got == _brute(rows, lambda s, r: (r[2], s))
    got = {(r.k, r.o): r.t for r in running_sum(df, ["k"], ["o"], "v", "t").collect()}
    assert got == _brute(rows, lambda s, r: ((s or 0) + r[2], (s or 0) + r[2]))
    got = {(r.k, r.o): r.c for r in carry_last(df, ["k"], ["o"], "w", "c").collect()}
    assert got == _brute(rows, lambda s, r: ((s if r[3] is None else r[3]),) * 2)


# ---- checklists -------------------------------------------------------------------------------

def test_not_covered_is_not_a_pass_and_design_never_passes(spark):
    counts = spark.createDataFrame([("CWE-89", 3)], "cwe string, n long")
    known = spark.createDataFrame([("CWE-89",), ("CWE-79",)], "cwe string")
    cov = {(r.std, r.code): r.verdict for r in standards.coverage(standards.items(spark), counts, known).collect()}
    assert cov[("mois", "sql-injection")] == "violated" and cov[("mois", "xss")] == "pass" and cov[("mois", "csrf")] == "not_covered"
    assert {v for (s, _), v in cov.items() if s == "mois-design"} == {"not_covered"}
    n = {r.std: r["count"] for r in standards.items(spark).groupBy("std").count().collect()}
    assert n == {"mois": 49, "mois-design": 20, "mobile": 26, "efs": 28, "owasp": 10, "cwe": 30}


def test_rule_overlay(spark):
    schema = "id string, severity string, message string, sinks array<string>"
    shipped = spark.createDataFrame([("a", "high", "m", ["x", "y"]), ("b", "high", "m", ["x"]), ("c", "low", "m", ["x"])], schema)
    user = spark.createDataFrame([("a", "low", None, ["y", "z"], None), ("b", None, None, ["q"], True), ("n", "info", None, ["w"], None)], schema + ", replace boolean")
    got = {r.id: (r.severity, r.message, r.sinks) for r in rules.overlay(shipped, user, ["severity", "message"], ["sinks"]).collect()}
    assert got == {"a": ("low", "m", ["x", "y", "z"]), "b": (None, None, ["q"]), "c": ("low", "m", ["x"]), "n": ("info", None, ["w"])}


def test_sarif_numbers_rules_without_moving_what_describes_them(spark, monkeypatch):
    seen, number = [], hub.number_in_key

    def watched(df, *rest):
        seen.append(df.columns)
        return number(df, *rest)

    monkeypatch.setattr(hub, "number_in_key", watched)
    rows = [(1, 5, "b", 1), (1, 7, "a", 2), (1, 9, "b", 3), (2, 1, "a", 4), (2, 1, "b", 4)]
    f = spark.createDataFrame(rows, "scan_id long, idx long, rule_id string, line int").selectExpr(
        "*", "'m' AS message", "'high' AS severity", "'' AS cwe", "'' AS owasp", "array(named_struct('kind', 'sink', 'file', 'f', 'line', line, 'code', 'c')) AS steps")
    got = sorted((r.scan_id, r.rule_id, r.rule_index) for r in hub.sarif_results(f).distinct().collect())
    assert got[:3] == [(1, "a", 1), (1, "b", 0), (1, "b", 0)] and {g[2] for g in got[3:]} == {0, 1}
    assert seen == [["scan_id", "rule_id", "first_idx"]]
    # results and rules agree where rules begin at the same place
    assert {g for g in got} == {(r.scan_id, r.rule_id, r.rule_index) for r in hub.sarif_rules(f).collect()}


def test_sarif_lines_start_at_one(spark):
    step = "array<struct<kind:string,file:string,line:int,code:string,uncertain:boolean>>"
    f = spark.createDataFrame([(1, 0, "secret.risky-filename", "m", "high", "CWE-538", "", 0, [("match", "id_rsa", 0, "id_rsa", False)])],
                              f"scan_id long, idx long, rule_id string, message string, severity string, cwe string, owasp string, line int, steps {step}")
    (r,) = hub.sarif_results(f).collect()
    assert r.start_line == 1 and '"startLine":1' in r.result and r.level == "error"


def test_consolidated_final_drops_closed(spark):
    scans = spark.createDataFrame([(1, "p", 10, 100, "Java")], "scan_id long, project string, files long, lines long, languages string")
    st = spark.createDataFrame([(1, "high", ""), (1, "high", "fixed"), (1, "low", "false_positive"), (1, "low", "confirmed")], "scan_id long, severity string, state string")
    total = lambda kept: {r.project: r.total for r in rollups.consolidated(scans, st, kept).collect()}
    assert total(False) == {"p": 4, "(total)": 4} and total(True) == {"p": 2, "(total)": 2}


def test_empty_project_is_complete(spark):
    empty = spark.createDataFrame([], "project string, lang string, is_source boolean, is_text boolean, too_large boolean, failed boolean, partial boolean, lines long")
    assert rollups.integrity(empty).count() == 0


def test_the_dashboard_shows_the_severity_split_and_the_rules_with_most_hits(spark):
    df = spark.createDataFrame
    latest = df([(1, 4, 1, 1, 2, 0, 0, 3), (2, 3, 2, 0, 0, 1, 0, 1)],
                "scan_id long, total long, sev_critical long, sev_high long, sev_medium long, sev_low long, sev_info long, new_count long")
    # the rules of scan 3, which is not the newest of its project, don't count
    hits = [(1, "b"), (1, "b"), (1, "c"), (2, "a"), (2, "a"), (2, "c"), (2, "d"), *[(3, "old")] * 5]
    row = rollups.dashboard(latest, df([(1,), (2,), (3,)], "scan_id long"), df(hits, "scan_id long, rule_id string"), top=3).first()
    assert (row.projects, row.total, row.crit_high, row.new_total, row.scans) == (2, 7, 4, 4, 3)
    assert (row.sev_critical, row.sev_high, row.sev_medium, row.sev_low, row.sev_info) == (3, 1, 2, 1, 0)
    assert [tuple(r) for r in row.top_rules] == [("a", 2), ("b", 2), ("c", 2)]
