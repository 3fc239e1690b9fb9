"""Flow operators against brute force: closure, guards, summaries, call resolution."""
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.flow import closure, edges as cut, match, resolve, summaries
from corpusflow.operators.flow.scan import flow_scan
from corpusflow.sources import rules as rule_files

E = "src string, dst string, uncertain boolean, guard_id string"


def graph(seed, n=40, m=90):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.random() < 0.3, f"g{r.randrange(6)}" if r.random() < 0.3 else None) for _ in range(m)}, key=repr)


def brute_reach(edges, seeds, kills, guard_kills):
    out = {}
    for rule, node in seeds:
        if (rule, node) not in kills:
            out[(rule, node)] = (0, False)
    frontier, hop = dict(out), 0
    while frontier:
        hop += 1
        new = {}
        for (rule, node), (_, flag) in frontier.items():
            for s, d, u, g in edges:
                if s != node or (rule, d) in kills or (rule, d) in out or (g and ((rule, g) in guard_kills or ("*", g) in guard_kills)):
                    continue
                new[(rule, d)] = (hop, min(new.get((rule, d), (hop, True))[1], flag or u))
        out.update(new)
        frontier = new
    return out


def run_reach(spark, edges, seeds, kills, guard_kills, **kw):
    e = spark.createDataFrame(edges, E)
    s = spark.createDataFrame(seeds, "rule_id string, node string")
    k = spark.createDataFrame(sorted(kills), "rule_id string, node string")
    g = spark.createDataFrame(sorted(guard_kills), "rule_id string, guard_id string")
    return closure.reach(s, e, k, g, **kw)


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_equals_brute_force_with_and_without_salting(spark, seed):
    edges = graph(seed) + [("n1", f"h{i}", False, None) for i in range(60)]  # n1 is a hub
    seeds = [("A", "n1"), ("A", "n2"), ("B", "n3"), ("B", "n1")]
    kills, guards = {("A", "n7"), ("B", "n8"), ("B", "n3")}, {("A", "g1"), ("*", "g2")}
    want = brute_reach(edges, seeds, kills, guards)
    for degree in (closure.HUB_DEGREE, 7):
        got = {(r.rule_id, r.node): (r.hop, r.uncertain) for r in run_reach(spark, edges, seeds, kills, guards, hub_degree=degree).collect()}
        assert got == want


def test_more_kills_never_reach_more_and_extra_edges_elsewhere_do_not_matter(spark):
    edges, seeds = graph(5), [("A", "n0"), ("A", "n1")]
    nodes = lambda df: {(r.rule_id, r.node) for r in df.collect()}
    base = nodes(run_reach(spark, edges, seeds, {("A", "zz")}, {("A", "zz")}))
    more = nodes(run_reach(spark, edges, seeds, {("A", "n5"), ("A", "n6")}, {("A", "zz")}))
    assert more <= base
    far = nodes(run_reach(spark, list(reversed(edges)) + [("q1", "q2", False, None), ("q2", "q1", False, None)], seeds, {("A", "zz")}, {("A", "zz")}))
    assert far == base


def test_trace_follows_edges_from_source_to_target(spark):
    edges, seeds = graph(3), [("A", "n0"), ("A", "n1"), ("A", "n2")]
    r = run_reach(spark, edges, seeds, {("A", "zz")}, {("A", "zz")})
    hops = {x.node: x.hop for x in r.collect()}
    rows = closure.trace(r, r.select("rule_id", "node")).collect()
    pairs = {(s, d) for s, d, _, _ in edges}
    for target, hop in hops.items():
        path = [x.node for x in sorted((x for x in rows if x.target == target), key=lambda x: x.pos)]
        assert len(path) == hop + 1 and path[-1] == target and ("A", path[0]) in seeds
        assert all(p in pairs for p in zip(path, path[1:]))
    nodes = spark.createDataFrame([(n, "f", 1, n) for n in hops], "node_id string, file string, line int, code string")
    arr = closure.trace_array(closure.trace(r, r.select("rule_id", "node")), nodes).collect()
    assert all(a.steps[0].kind == "source" and a.steps[-1].code == a.target for a in arr)


def brute_summaries(params, returns, edges, call_args, sinks, kills):
    """(rule, fn, idx) -> returns?, sinks; by plain iteration to a fixpoint."""
    ret, sink = set(), set()
    changed = True
    while changed:
        changed = False
        for rule, fn, idx, start in params:
            seen, todo = set(), [start]
            while todo:
                n = todo.pop()
                if n in seen or (rule, n) in kills:
                    continue
                seen.add(n)
                todo += [d for s, d in edges if s == n]
                todo += [v for g, j, a, v in call_args if a == n and (rule, g, j) in ret]
            facts_r = {(rule, fn, idx)} if any((fn, n) in returns for n in seen) else set()
            facts_s = {(rule, fn, idx, n) for n in seen if (rule, n) in sinks}
            facts_s |= {(rule, fn, idx, k) for g, j, a, _ in call_args if a in seen for (r2, g2, j2, k) in sink if (r2, g2, j2) == (rule, g, j)}
            if not facts_r <= ret or not facts_s <= sink:
                changed = True
                ret |= facts_r
                sink |= facts_s
    return ret, sink


def random_program(seed, nf=8):
    r = random.Random(seed)
    params = [(rule, f"f{i}", j, f"p{i}.{j}") for rule in "AB" for i in range(nf) for j in range(2)]
    returns = [(f"f{i}", f"r{i}") for i in range(nf)]
    edges, args = set(), set()
    for c in range(16):
        i, g = r.randrange(nf), r.randrange(nf)
        a, v, j = f"a{c}", f"v{c}", r.randrange(2)
        args.add((f"f{g}", j, a, v))
        edges.add((r.choice([f"p{i}.0", f"p{i}.1", f"x{i}"]), a))
        if r.random() < 0.6:
            edges.add((v, f"r{i}"))
        if r.random() < 0.3:
            edges.add((v, f"k{i}"))
    for i in range(nf):
        if r.random() < 0.4:
            edges.add((f"p{i}.{r.randrange(2)}", f"r{i}"))
        if r.random() < 0.4:
            edges.add((f"p{i}.{r.randrange(2)}", f"k{i}"))
        if r.random() < 0.3:
            edges.add((f"x{i}", f"r{i}"))
    sinks = [(rule, f"k{i}") for rule in "AB" for i in range(nf)]
    sources = [(rule, f"x{i}") for rule in "AB" for i in range(0, nf, 2)]
    kills = {("B", "r1"), ("B", "k2"), ("A", "a3")}
    return params, returns, sorted(edges), sorted(args), sinks, sources, kills


@pytest.mark.parametrize("seed", [11, 12])
def test_summaries_and_findings_equal_brute_force(spark, seed):
    params, returns, edges, args, sinks, sources, kills = random_program(seed)
    df = spark.createDataFrame
    p, rt = df(params, "rule_id string, fn_id string, param_idx int, node string"), df(returns, "fn_id string, node string")
    e, ca = df(edges, "src string, dst string"), df(args, "callee_fn string, param_idx int, arg_node string, ret_node string")
    sk, sr, kl = (df(sorted(x), "rule_id string, node string") for x in (sinks, sources, kills))
    s = summaries.summarize(p, rt, e, ca, sk, kl)
    ret, sink = brute_summaries(params, set(returns), edges, args, set(sinks), kills)
    assert {(r.rule_id, r.fn_id, r.param_idx) for r in s.returns.collect()} == ret
    assert {(r.rule_id, r.fn_id, r.param_idx) for r in s.sinks.collect()} == {x[:3] for x in sink}
    starts = s.sinks.select("rule_id", F.concat_ws("#", "fn_id", "param_idx").alias("start"))
    assert {(r.rule_id, *r.start.split("#"), r.sink) for r in summaries.sinks_behind(s, starts).collect()} == {(a, b, str(i), k) for a, b, i, k in sink}
    _, found = summaries.interprocedural(sr, rt, e, ca, sk, s, kl)
    want, by_fn = set(), dict(returns)
    for rule in "AB":
        seen, todo = set(), [n for r, n in sources if r == rule]
        while todo:
            n = todo.pop()
            if n in seen or (rule, n) in kills:
                continue
            seen.add(n)
            todo += [d for s_, d in edges if s_ == n]
            todo += [v for g, j, a, v in args if a == n and (rule, g, j) in ret]
            todo += [v for g, j, a, v in args if by_fn[g] == n]
        want |= {(rule, n, n) for n in seen if (rule, n) in set(sinks)}
        want |= {(rule, a, k) for g, j, a, _ in args if a in seen for r2, g2, j2, k in sink if (r2, g2, j2) == (rule, g, j)}
    assert {(r.rule_id, r.entry, r.sink) for r in found.collect()} == want
    nodes = df([(n, "f", 1, n) for n in sorted({n for e_ in edges for n in e_} | {x[3] for x in params} | {n for _, n in sources})], "node_id string, file string, line int, code string")
    scanned = flow_scan(sr, p, rt, e, ca, sk, nodes, df([("A", "m"), ("B", "m")], "rule_id string, message string"), kl, summ=s).collect()
    assert {(r.rule_id, r.sink) for r in scanned} == {(a, k) for a, _, k in want}
    moves = set(edges) | {(by_fn[g], v) for g, j, a, v in args} | {(a, f"p{g[1:]}.{j}") for g, j, a, v in args} | {(a, v) for g, j, a, v in args}
    for r in scanned:
        path = [x.code for x in r.steps]
        assert path[0] in {n for _, n in sources} and path[-1] == r.sink and all(m in moves for m in zip(path, path[1:]))
        assert not any((r.rule_id, n) in kills for n in path)


def test_constant_slots_are_told_apart(spark):
    s = "container string, slot string, node_id string"
    puts = spark.createDataFrame([("m", "a", "pa"), ("m", None, "pu"), ("q", "b", "qb")], s)
    gets = spark.createDataFrame([("m", "a", "ga"), ("m", "b", "gb"), ("m", None, "gu")], s)
    e = cut.slot_edges(puts, gets)
    seeds = puts.select(F.col("node_id").alias("rule_id"), F.col("node_id").alias("node"))
    got = {(r.rule_id, r.node) for r in closure.reach(seeds, e).collect() if r.node.startswith("g")}
    assert got == {("pa", "ga"), ("pa", "gu"), ("pu", "ga"), ("pu", "gb"), ("pu", "gu")}


def test_prefix_paths(spark):
    s = "fn_id string, path string, node_id string"
    defs = spark.createDataFrame([("f", "x", "dx"), ("f", "d.b", "db"), ("g", "x", "other")], s)
    uses = spark.createDataFrame([("f", "x.y.z", "u1", False), ("f", "d", "u2", False), ("f", "d.a", "u3", True), ("f", "d.b", "u4", True)], s + ", const_slot boolean")
    seeds = defs.select(F.col("node_id").alias("rule_id"), F.col("node_id").alias("node"))
    got = {(r.rule_id, r.node) for r in closure.reach(seeds, cut.path_edges(defs, uses)).collect() if r.node.startswith("u")}
    assert got == {("dx", "u1"), ("db", "u2"), ("db", "u4")}


def test_derived_guard_cleans_ancestors_not_siblings(spark):
    derives = spark.createDataFrame([("data", "url"), ("url", "host"), ("data", "sibling")], "src string, dst string")
    guards = spark.createDataFrame([("g", "host")], "guard_id string, node_id string")
    assert {r.node_id for r in cut.derived_guard_nodes(guards, derives).collect()} == {"host", "url", "data"}


SPECS = [{"id": "js.cmd", "languages": ["javascript"], "sources": [{"object": "req", "property": ["query", "body"]}, {"pattern": "name", "name": "process.argv"}],
          "sinks": [{"callee": ["child_process.exec", "system"], "arg": 0}], "sanitizers": [{"callee": "quote"}, {"callee": "filter_var", "requires": "INT"}]}]


def test_matching_boundaries(spark):
    t = rule_files.flow_rule_tables(spark, SPECS, trust_stored_data=True)
    nodes = spark.createDataFrame([("javascript", p, p) for p in ("req.query.h", "self.req.body", "req.cookies", "process.argv", "process.argv.0", "process.argvX", "x::req.query")],
                                  "lang string, node_id string, path string")
    assert {r.node_id for r in match.sources_by_member(nodes, t["sources"]).collect()} == {"req.query.h", "self.req.body", "x::req.query"}
    assert {r.node_id for r in match.sources_by_name(nodes, t["sources"]).collect()} == {"process.argv", "process.argv.0"}
    calls = spark.createDataFrame([("javascript", c, c, a) for c, a in (("child_process.exec", ""), ("a.child_process.exec", ""), ("exec", ""), ("std::system", ""), ("mysystem", ""),
                                                                        ("quote", ""), ("s.filter_var", "x, INT"), ("filter_var", "x, MAIL"))],
                                  "lang string, call_id string, callee string, args_text string")
    args = calls.select("call_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("arg_idx")).withColumn("node_id", F.concat("call_id", F.lit("@"), F.col("arg_idx").cast("string")))
    got = {(r.call_id, r.arg_idx) for r in match.sinks_by_call(calls, args, t["sinks"]).collect()}
    assert got == {("child_process.exec", 0), ("a.child_process.exec", 0), ("std::system", 0)}
    assert {r.call_id for r in match.sanitizer_calls(calls, t["sanitizers"]).collect()} == {"quote", "s.filter_var"}


def test_stored_data_sources_can_be_switched_off(spark):
    n = lambda **kw: rule_files.flow_rule_tables(spark, SPECS, **kw)["sources"].count()
    assert n(trust_stored_data=True) == 2 and n() == 2 + len(rule_files.STORE_SOURCES["javascript"][0]["name"])


def test_rule_files_and_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"defaults": {"severity": "low"}, "rules": [{"id": "x", "pattern": "a"}, {"id": "y", "pattern": "b", "severity": "high"}]}')
    (tmp_path / "b.json").write_text("{broken")
    rows = rule_files.pattern_rule_rows(rule_files.read_records(tmp_path))
    assert [(r[0], r[2]) for r in rows] == [("x", "low"), ("y", "high")]


def test_same_file_wins_and_unique_needs_fitting_arguments(spark):
    f = spark.createDataFrame([("p", "a/u.py", "1", "run", 1, 1, False), ("p", "b/v.py", "2", "run", 1, 1, False), ("p", "b/v.py", "3", "only", 5, 2, True)],
                              "project string, file string, fn_id string, name string, line int, arity int, implicit_self boolean")
    al = resolve.function_aliases(f)
    c = spark.createDataFrame([("c1", "p", "a/u.py", "run", "run", "none", 1), ("c2", "p", "z.py", "run", "run", "none", 1), ("c3", "p", "z.py", "u.run", "run", "ident", 1),
                               ("c4", "p", "z.py", "o.only", "only", "ident", 1), ("c5", "p", "z.py", "o.only", "only", "ident", 3), ("c6", "p", "b/v.py", "New.run", "run", "call", 1)],
                              "call_id string, project string, file string, callee string, prop string, recv_kind string, nargs int")
    got = {r.call_id: (r.fn_id, r.prio) for r in resolve.resolve_calls(c, al, f).collect()}
    assert got == {"c1": ("1", 1), "c2": ("2", 2), "c3": ("1", 2), "c4": ("3", 4), "c6": ("2", 3)}


def test_closure_plan_has_no_cartesian_product(spark):
    e = closure.Edges(spark.createDataFrame(graph(4), E))
    f = spark.createDataFrame([("A", "n0", False)], "rule_id string, node string, uncertain boolean")
    plan = e.expand(f, ["rule_id"])._jdf.queryExecution().executedPlan().toString()
    e.release()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_flow_scan_stitches_the_steps_of_caller_and_callee(spark):
    df = spark.createDataFrame
    # f: x = source(); y = id(x); sink_of(y)   id(p) returns p   sink_of(q): exec(q), through g(q2)
    edges = df([("x", "a1", False), ("p", "rid", False), ("v1", "a2", True), ("q", "a3", False), ("q2", "k", False)], "src string, dst string, uncertain boolean")
    params = df([("R", "id", 0, "p"), ("R", "outer", 0, "q"), ("R", "inner", 0, "q2")], "rule_id string, fn_id string, param_idx int, node string")
    returns = df([("id", "rid")], "fn_id string, node string")
    calls = df([("id", 0, "a1", "v1"), ("outer", 0, "a2", "v2"), ("inner", 0, "a3", "v3")], "callee_fn string, param_idx int, arg_node string, ret_node string")
    one = lambda n: df([("R", n)], "rule_id string, node string")
    names = ["x", "a1", "v1", "a2", "q", "a3", "q2", "k"]
    nodes = df([(n, "main.py" if i < 4 else "lib.py", i + 1, n) for i, n in enumerate(names)], "node_id string, file string, line int, code string")
    rows = flow_scan(one("x"), params, returns, edges, calls, one("k"), nodes, df([("R", "high")], "rule_id string, severity string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert [(s.kind, s.code, s.file, s.line, s.uncertain) for s in r.steps] == [
        ("source", "x", "main.py", 1, False), ("propagation", "a1", "main.py", 2, False), ("propagation", "v1", "main.py", 3, False), ("call", "a2", "main.py", 4, True),
        ("param", "q", "lib.py", 5, False), ("call", "a3", "lib.py", 6, False), ("param", "q2", "lib.py", 7, False), ("sink", "k", "lib.py", 8, False)]
    assert (r.sink, r.file, r.line, r.severity, r.uncertain) == ("k", "lib.py", 8, "high", True)
    killed = flow_scan(one("x"), params, returns, edges, calls, one("k"), nodes, df([("R", "high")], "rule_id string, severity string"), one("q2"))
    assert killed.count() == 0


def test_rounds_leave_no_shuffle_files(spark):
    """A stored round frees what it shuffled: the disk holds rounds, not everything ever moved."""
    import time
    from pathlib import Path

    from corpusflow.plans import durable

    folder = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    before = set(folder.glob("*/shuffle_*.data"))
    rows = spark.range(20_000).repartition(7, "id").groupBy("id").count()
    out = durable(rows)
    for _ in range(50):
        left = set(folder.glob("*/shuffle_*.data")) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 20_000


def test_edges_move_once_and_equal_ones_are_kept_once(spark):
    doubled = spark.createDataFrame(graph(4) * 3, E)
    e = closure.Edges(doubled)
    plan = e.rows._jdf.queryExecution().logical().toString()
    assert e.rows.count() == len(graph(4)) and "Repartition" in plan
    e.release()
    assert {r.src: r.salts for r in closure._hubs(doubled, 8).collect()} == {
        n: -(-k // 8) for n in {g[0] for g in graph(4)} for k in [3 * sum(g[0] == n for g in graph(4))] if k > 8}


def test_walking_back_joins_one_hop_at_a_time(spark, monkeypatch):
    chain = [("A", f"n{i}", i, f"n{i - 1}" if i else None, False) for i in range(6)]
    reached = spark.createDataFrame(chain, "rule_id string, node string, hop int, parent string, step_uncertain boolean")
    plans, real = [], closure.durable
    monkeypatch.setattr(closure, "durable", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    targets = spark.createDataFrame([("A", "n5"), ("A", "n2")], "rule_id string, node string")
    steps = closure.trace(reached, targets).collect()
    assert sorted((r.target, r.pos, r.node) for r in steps) == sorted(
        [("n5", i, f"n{i}") for i in range(6)] + [("n2", i, f"n{i}") for i in range(3)])
    assert all(f"= {h})" in p for h, p in zip(range(4, -1, -1), plans[1:])) and len(plans) == 6


def test_a_round_moves_what_it_derives_and_nothing_else(spark, monkeypatch):
    """Reached nodes, edges and shortcuts of earlier rounds stay where they lie."""
    import importlib
    durable = importlib.import_module("corpusflow.plans.durable")
    plans, keep = [], durable.durable

    def spy(frame):
        plans.append(frame.select("*")._jdf.queryExecution().executedPlan().toString())
        return keep(frame)

    monkeypatch.setattr(durable, "durable", spy)
    monkeypatch.setattr(summaries, "durable", spy)
    params, returns, edges, args, sinks, _, _ = random_program(11)
    df = spark.createDataFrame
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = summaries.summarize(df(params, "rule_id string, fn_id string, param_idx int, node string"), df(returns, "fn_id string, node string"),
                                df(edges, "src string, dst string"), df(args, "callee_fn string, param_idx int, arg_node string, ret_node string"),
                                df(sinks, "rule_id string, node string"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounds = [p for p in plans if "LeftAnti" in p and p.count("node#") and "kind#" not in p and "parent#" not in p]
    assert len(rounds) >= 3 and any("Union" in p for p in rounds)
    moved = [(i, line) for i, p in enumerate(rounds) for line in p.splitlines() if "ENSURE_REQUIREMENTS" in line]
    assert not moved
    ret, _ = brute_summaries(params, set(returns), edges, args, set(sinks), set())
    assert {(r.rule_id, r.fn_id, r.param_idx) for r in s.returns.collect()} == ret


def test_repeated_edges_change_no_summary(spark):
    params, returns, edges, args, sinks, _, kills = random_program(12)
    df = spark.createDataFrame
    p, rt = df(params, "rule_id string, fn_id string, param_idx int, node string"), df(returns, "fn_id string, node string")
    e, ca = df(edges + edges, "src string, dst string"), df(args + args, "callee_fn string, param_idx int, arg_node string, ret_node string")
    sk, kl = (df(sorted(x), "rule_id string, node string") for x in (sinks, kills))
    s = summaries.summarize(p, rt, e, ca, sk.unionByName(sk), kl)
    ret, sink = brute_summaries(params, set(returns), edges, args, set(sinks), kills)
    assert sorted((r.rule_id, r.fn_id, r.param_idx) for r in s.returns.collect()) == sorted(ret)
    assert sorted((r.rule_id, r.fn_id, r.param_idx) for r in s.sinks.collect()) == sorted({x[:3] for x in sink})
    assert sorted(s.direct.collect()) == sorted(s.direct.distinct().collect())


def test_sinks_are_walked_from_the_side_of_fewer_rows(spark, monkeypatch):
    """A chain of calls into one sink: one row a function, not one per (function, function behind it)."""
    n = 12
    df = spark.createDataFrame
    p = df([("A", f"f{i}", 0, f"p{i}") for i in range(n)], "rule_id string, fn_id string, param_idx int, node string")
    e = df([(f"p{i}", f"a{i}") for i in range(n - 1)] + [(f"p{n - 1}", "k")], "src string, dst string")
    ca = df([(f"f{i + 1}", 0, f"a{i}", f"v{i}") for i in range(n - 1)], "callee_fn string, param_idx int, arg_node string, ret_node string")
    s = summaries.summarize(p, df([("f0", "r0")], "fn_id string, node string"), e, ca, df([("A", "k")], "rule_id string, node string"))
    sizes, reach = [], summaries.reach

    def counted(*args, **kw):
        out = reach(*args, **kw)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(summaries, "reach", counted)
    starts = s.sinks.select("rule_id", F.concat_ws("#", "fn_id", "param_idx").alias("start"))
    assert sorted((r.start, r.sink) for r in summaries.sinks_behind(s, starts).collect()) == sorted((f"f{i}#0", "k") for i in range(n))
    assert sizes and max(sizes) <= n
    one = starts.filter(F.col("start") == "f3#0")
    assert [(r.start, r.sink) for r in summaries.sinks_behind(s, one).collect()] == [("f3#0", "k")]


def inside_bodies(params, returns, edges, args, kills):
    """(rule, fn, idx) -> nodes its parameter taints inside its function, brute force."""
    ret, _ = brute_summaries(params, set(returns), edges, args, set(), kills)
    out = {}
    for rule, fn, idx, node in params:
        seen, todo = set(), [node]
        while todo:
            n = todo.pop()
            if n not in seen and (rule, n) not in kills:
                seen.add(n)
                todo += [d for s, d in edges if s == n] + [v for g, j, a, v in args if a == n and (rule, g, j) in ret]
        out[rule, fn, idx] = seen
    return out


@pytest.mark.parametrize("seed", [185, 334])
def test_findings_carry_the_path_through_caller_calls_and_callees(spark, seed):
    params, returns, edges, args, sinks, sources, kills = random_program(seed)
    df = spark.createDataFrame
    p, rt = df(params, "rule_id string, fn_id string, param_idx int, node string"), df(returns, "fn_id string, node string")
    e, ca = df(edges, "src string, dst string"), df(args, "callee_fn string, param_idx int, arg_node string, ret_node string")
    sk, sr, kl = (df(sorted(x), "rule_id string, node string") for x in (sinks, sources, kills))
    s = summaries.summarize(p, rt, e, ca, sk, kl)
    _, found = summaries.interprocedural(sr, rt, e, ca, sk, s, kl)
    inside, place, by_fn = inside_bodies(params, returns, edges, args, kills), {(f, j): n for _, f, j, n in params}, dict(returns)
    moves = set(edges) | {(by_fn[g], v) for g, _, _, v in args} | {(a, v) for _, _, a, v in args} | {(a, place[g, j]) for g, j, a, _ in args}
    rows = found.collect()
    assert any(r.via_call for r in rows)
    for r in rows:
        assert r.steps[0] in {n for _, n in sources} and r.steps[-1] == r.sink and all(m in moves for m in zip(r.steps, r.steps[1:]))
        assert not any((r.rule_id, n) in kills for n in r.steps) and r.entry in r.steps
        if not r.via_call:
            assert (r.entry, r.n_paths) == (r.sink, 1)
            continue
        start = next((g, j) for g, j, a, _ in args if a == r.entry and place[g, j] == r.steps[r.steps.index(r.entry) + 1])
        level, seen, calls = {start: 1}, set(), 0
        while not any(r.sink in inside[r.rule_id, *f] for f in level):
            seen |= set(level)
            after = {}
            for f, n in level.items():
                for g, j, a, _ in args:
                    if a in inside[r.rule_id, *f] and (g, j) not in seen:
                        after[g, j] = after.get((g, j), 0) + n
            level, calls = after, calls + 1
        assert r.n_paths == sum(n for f, n in level.items() if r.sink in inside[r.rule_id, *f])
        assert sum(x in place.values() for x in r.steps[r.steps.index(r.entry) + 1:]) == calls + 1
    assert len(rows) == len({(r.rule_id, r.entry, r.sink, r.via_call) for r in rows})
