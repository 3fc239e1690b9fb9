"""Registered queries against their SQL on the smallest tables, and plan shapes."""
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="shared tables are not here")

#: one of each family; tools/check.py runs all of them
NAMES = ("pattern_scan", "mask_value", "split_lines", "scan_diff", "previous_scan", "priority_queue", "scan_summary", "portfolio",
         "standard_coverage", "consolidated_final", "triage_batches", "entry_hint", "confusion", "match_sink_call", "call_resolve",
         "const_branch_prune", "advisory_join", "cve_merge", "stream_audit_state", "sink_sarif")


@pytest.fixture(scope="module")
def sides(spark):
    import duckdb

    import __spark_entry__ as e
    sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
    import check
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return check, con, e.queries(), e.oracle_sql()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sides, name):
    check, con, queries, sql = sides
    df = queries[name](spark, SF)
    rel = con.sql(sql[name])
    assert check.normal(df.columns, [tuple(r) for r in df.collect()]) == check.normal(rel.columns, rel.fetchall())


def test_every_query_is_registered_once_with_a_sql_or_a_brute_force_test(sides):
    _, _, queries, sql = sides
    assert set(sql) <= set(queries)
    # the corpus operators, where they are installed, have tests of their own
    assert {q for q in set(queries) - set(sql) if not q.startswith("op") and q != "pipeline"} == set()


@pytest.mark.parametrize("name", ["priority_queue", "audit_history", "trend", "scan_summary"])
def test_rank_limits_are_applied_before_the_shuffle(spark, sides, name):
    plan = sides[2][name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["findings_filter", "scan_diff", "standard_map", "advisory_join", "match_sink_call", "dashboard", "edge_slot"])
def test_no_cross_products(spark, sides, name):
    plan = sides[2][name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rules_and_checklists_broadcast(spark, sides):
    plan = sides[2]["match_sink_call"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_scan_reads_only_needed_columns(spark, sides):
    plan = sides[2]["pattern_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
