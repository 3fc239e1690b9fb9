"""What used to be cut short: nesting, long numbers, masked lines, guards far back, globs, attributes, keys of containers."""
import json
import re

from pyspark.sql import functions as F

from corpusflow.functions import values, versions
from corpusflow.operators import lifecycle, patterns
from corpusflow.operators.flow import closure, edges
from corpusflow.sources import corpus, lockfiles


def test_numbers_of_any_length_compare(spark):
    big = "1." + "9" * 45
    pairs = [("1.0", big, True), (big, "1." + "9" * 44, False), ("1.007", "1.7", False), ("1.7", "1.007", False), ("1.0", "1.a", True), ("01", "1", False)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = rows.select((versions.version_key(F.col("a")) < versions.version_key(F.col("b"))).alias("lt")).collect()
    assert [r.lt for r in got] == [x for _, _, x in pairs]


def test_lockfiles_nest_as_deep_as_they_like(spark):
    deps = {}
    for i in reversed(range(12)):
        deps = {f"p{i}": {"version": f"1.{i}", **({"dependencies": deps} if deps else {})}}
    text = json.dumps({"lockfileVersion": 1, "dependencies": deps}, indent=1)
    out = lockfiles.package_lock(spark.createDataFrame([("p", "a/package-lock.json", text)], "project string, file string, text string")).collect()
    assert sorted((r.name, r.version) for r in out) == sorted((f"p{i}", f"1.{i}") for i in range(12))
    assert all(f'"{r.name}"' in text.split("\n")[r.line - 1] for r in out)


def test_xml_attributes_and_quotes(spark):
    pom = ('<project><dependencies><dependency scope="x">\n<groupId id="1">g</groupId><artifactId>a</artifactId ><version>1</version></dependency>'
           "<dependency><groupId>h</groupId>\n<artifactId>b</artifactId><version>2</version></dependency></dependencies></project>")
    config = """<packages>\n<package id='A' version='1.0' />\n<package version="2.0" id="B" /></packages>"""
    composer = json.dumps({"packages": [{"name": "n/a", "version": "v1", "license": "MIT"}, {"name": "n/b", "version": "2", "license": ["A", "B"]}]})
    files = spark.createDataFrame([("p", "pom.xml", pom), ("p", "packages.config", config), ("p", "composer.lock", composer)], "project string, file string, text string")
    out = {r.name: (r.version, r.license) for r in lockfiles.components(files).collect()}
    assert out == {"g:a": ("1", ""), "h:b": ("2", ""), "A": ("1.0", ""), "B": ("2.0", ""), "n/a": ("1", "MIT"), "n/b": ("2", "A, B")}
    assert lockfiles.pom(files, max_chars=10).count() == 0 and lockfiles.pom(files, max_chars=None).count() == 2


def test_a_masker_that_leaves_nothing_shows_nothing(spark):
    values.register_masker("vanish", lambda v: F.lit(""))
    secret = "sekret" * 50
    line = " ".join([f"key={secret}"] * 40) + " tail"
    rule = dict(zip(patterns._FIELDS, patterns.shipped()[0])) | {
        "id": "t", "pattern": "sekret+(?:sekret)*", "grp": 0, "mask": "vanish", "validator": None, "excludes": [], "languages": [], "file_exts": [], "all_files": True}
    lines = spark.createDataFrame([("p", "f.txt", None, ".txt", 1, line)], "project string, file string, lang string, ext string, line_no int, line string")
    row = patterns.pattern_scan(lines, [tuple(rule[f] for f in patterns._FIELDS)]).first()
    assert "sekre" not in row.snippet and row.snippet.startswith("key= key=")


def test_guards_clean_ancestors_however_far(spark):
    derives = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)] + [("n24", "side")], "src string, dst string")
    guards = spark.createDataFrame([("g", "n25")], "guard_id string, node_id string")
    found = {r.node_id for r in edges.derived_guard_nodes(guards, derives).collect()}
    assert found == {f"n{i}" for i in range(26)}


def test_globs_of_projects_know_classes(spark):
    files = spark.createDataFrame([("p", f) for f in ("src/a.js", "src/b.js", "src/c.js", "src/[.js", "lib/x/y.py", "q.t")], "project string, file string")
    for glob, gone in (("src/[ab].js", {"src/a.js", "src/b.js"}), ("src/[!ab].js", {"src/c.js", "src/[.js"}), ("lib/", {"lib/x/y.py"}), ("src/[.js", {"src/[.js"}),
                       ("*.t", {"q.t"}), ("src/?.js", {"src/a.js", "src/b.js", "src/c.js", "src/[.js"})):
        left = corpus.drop_project_globs(files, spark.createDataFrame([("p", glob)], "project string, glob string"))
        assert {r.file for r in files.collect()} - {r.file for r in left.collect()} == gone, glob


def test_decode_reads_the_corpus_once(spark, tmp_path):
    for name, raw in (("a.txt", "é".encode()), ("b.txt", "한글".encode("cp949")), ("c.txt", b"\xff\xfe\x80"), ("d.txt", b"\xef\xbb\xbfx")):
        (tmp_path / name).write_bytes(raw)
    out = corpus.decode(corpus.read_files(spark, f"file:{tmp_path}"))
    assert {r.file: r.text for r in out.select("file", "text").collect()} == {"a.txt": "é", "b.txt": "한글", "c.txt": b"\xff\xfe\x80".decode("latin-1"), "d.txt": "x"}
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan binaryFile") <= 1


def test_keys_of_containers(spark):
    calls = spark.createDataFrame([("c1", "f", "m.put"), ("c2", "f", "m.put"), ("c3", "f", "m.get"), ("c4", "f", "xs.add"), ("c5", "f", "m.get")], "call_id string, fn_id string, callee string")
    args = spark.createDataFrame([("c1", 0, "k1", "a"), ("c1", 1, "v1", None), ("c2", 0, "k2", None), ("c2", 1, "v2", None), ("c3", 0, "k3", "a"), ("c4", 0, "x", None),
                                  ("c5", 0, "k5", "b")] + [(f"c{i}", -1, f"r{i}", None) for i in (1, 2, 3, 4, 5)], "call_id string, arg_idx int, node_id string, literal string")
    assert {tuple(r) for r in edges.mutator_edges(calls, args).collect()} == {("v2", "r2"), ("x", "r4")}
    puts, gets = edges.container_accesses(calls, args)
    seeds = spark.createDataFrame([("r", "v1")], "rule_id string, node string")
    reached = {r.node for r in closure.reach(seeds, edges.slot_edges(puts, gets)).collect()}
    assert "c3" in reached and "c5" not in reached
    unknown = {r.node for r in closure.reach(seeds.withColumn("node", F.lit("v2")), edges.slot_edges(puts, gets)).collect()}
    assert {"c3", "c5"} <= unknown


def test_steps_carry_their_own_flag(spark):
    graph = spark.createDataFrame([("a", "b", False, None), ("b", "c", True, None), ("c", "d", False, "g1"), ("c", "x", False, "g2")], "src string, dst string, uncertain boolean, guard_id string")
    kills = spark.createDataFrame([("*", "g2")], "rule_id string, guard_id string")
    reached = closure.reach(spark.createDataFrame([("r", "a")], "rule_id string, node string"), graph, guard_kills=kills)
    assert {r.node for r in reached.collect()} == {"a", "b", "c", "d"}
    nodes = spark.createDataFrame([(n, "f", i, n) for i, n in enumerate("abcdx")], "node_id string, file string, line int, code string")
    traces = closure.trace_array(closure.trace(reached, reached.filter("node = 'd'").select("rule_id", "node")), nodes)
    row = closure.emit_findings(traces, reached, spark.createDataFrame([("r", "m")], "rule_id string, message string")).first()
    assert [(s.kind, s.code, s.uncertain) for s in row.steps] == [("source", "a", False), ("propagation", "b", False), ("propagation", "c", True), ("sink", "d", False)]
    assert row.uncertain and (row.file, row.line) == ("f", 3)


def test_scans_are_replaced_and_sarif_has_its_rules(spark, tmp_path):
    from corpusflow.operators import findings
    step = "steps array<struct<kind:string,file:string,line:int,code:string,uncertain:boolean>>"
    schema = f"project string, scan_id long, idx long, rule_id string, message string, severity string, cwe string, owasp string, file string, line int, {step}"
    row = lambda scan, idx, rule: ("p", scan, idx, rule, f"m {rule}", "high", "CWE-1", "", "f.py", 3, [("match", "f.py", 3, "code", False)])
    one, two = spark.createDataFrame([row(1, 0, "b"), row(1, 1, "a"), row(1, 2, "b")], schema), spark.createDataFrame([row(2, 0, "a")], schema)
    table = f"file:{tmp_path}/findings"
    for batch in (one, two, one):
        findings.write_findings(batch, table)
    assert spark.read.parquet(table).groupBy("scan_id").count().orderBy("scan_id").collect() == [(1, 3), (2, 1)]
    findings.write_sarif(one, f"file:{tmp_path}/sarif")
    results = [json.loads(r.value) for r in spark.read.text(f"file:{tmp_path}/sarif/results").select("value").collect()]
    rules = {x["properties"]["index"]: x["id"] for x in (json.loads(r.value) for r in spark.read.text(f"file:{tmp_path}/sarif/rules").select("value").collect())}
    assert rules == {0: "b", 1: "a"} and all(rules[x["ruleIndex"]] == x["ruleId"] for x in results) and len(results) == 3


def test_lines_of_components_are_found_inside_their_file(spark):
    """Nothing is broadcast or moved to number the components; the first of several lines counts."""
    lock = '{"packages": {"": {"version": "1"},\n "node_modules/b": {"version": "2"},\n "node_modules/a": {"version": "3", "x": "node_modules/b"},\n "n\\u0061": {"version": "4"}}}'
    composer = '{"x": "q",\n"packages": [{"name": "p", "version": "1"},\n{"name": "q", "version": "2"}, {"name": "r",\n "version": "3"}]}'
    files = spark.createDataFrame([("p", "package-lock.json", lock), ("p", "composer.lock", composer), ("p", "packages.config", "<packages/>")],
                                  "project string, file string, text string")
    assert {r.name: r.line for r in lockfiles.package_lock(files).collect()} == {"b": 2, "a": 3, "na": 1}
    assert {r.name: r.line for r in lockfiles.composer_lock(files).collect()} == {"p": 2, "q": 1, "r": 3}
    for parse in (lockfiles.package_lock, lockfiles.composer_lock, lockfiles.pom, lockfiles.packages_config):
        plan = parse(files)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan, parse.__name__


def test_snapshot_difference_moves_only_what_is_read(spark):
    rows = spark.createDataFrame([(1, 0, "a", "r", "high", "f", 1, "flow"), (2, 0, "b", "r", "low", "f", 1, "flow")],
                                 "scan_id long, idx long, stored_fp string, rule_id string, severity string, file string, line int, category string")
    scans = spark.createDataFrame([(1, None, False, None), (2, 1, False, False)], "scan_id long, prev_scan_id long, sca boolean, prev_sca boolean")
    counts = lifecycle.diff_counts(lifecycle.scan_diff(rows, scans))
    plan = counts._jdf.queryExecution().optimizedPlan().toString().split("\n")
    above = plan[:next(i for i, p in enumerate(plan) if "max(struct(" in p)]
    assert above and not any(re.search(r"\b(file|severity|rule_id|idx)#", p) for p in above)
    assert {r.scan_id: tuple(r)[1:] for r in counts.collect()} == {1: (1, 0, 0), 2: (1, 1, 0)}


def test_findings_do_not_move_by_rule_to_meet_the_rename_history(spark):
    from corpusflow.queries import lifecycle as q
    rows = spark.createDataFrame([("r", "f", "x", [("c",)])], "rule_id string, file string, fp string, steps array<struct<code:string>>")
    out = lifecycle.with_stored_fp(rows, q._canonical(spark))
    assert "hashpartitioning(rule_id" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1
