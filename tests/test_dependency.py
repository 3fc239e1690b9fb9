"""Lockfiles, version order, advisories."""
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import versions
from corpusflow.operators import sca
from corpusflow.schema import ADVISORY
from corpusflow.sources import advisories, lockfiles

FILES = {
    "requirements.txt": "django==4.2.1\nrequests[security] == 2.25.0  # x\nflask>=2.0\n-r other.txt\n",
    "package-lock.json": '{"packages": {"": {"version": "1.0.0"},\n"node_modules/lodash": {"version": "4.17.15", "license": "MIT"}}}',
    "v1/package-lock.json": '{"dependencies": {"a": {"version": "1.0.0",\n "dependencies": {"b": {"version": "2.0.0"}}}}}',
    "bad/package-lock.json": "{broken",
    "pom.xml": "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.2</version></dependency>"
               "<dependency><groupId>g</groupId><artifactId>b</artifactId><version>${rev}</version></dependency></dependencies></project>",
    "evil/pom.xml": "<!DOCTYPE x><project><dependency><groupId>g</groupId><artifactId>z</artifactId><version>1</version></dependency></project>",
    "go.mod": "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x/y v0.1.0 // indirect\n)\n",
    "Gemfile.lock": "GEM\n  specs:\n    rack (2.2.3)\n      dep (>= 1)\nPLATFORMS\n",
    "composer.lock": '{"packages": [{"name": "m/log", "version": "v1.25.0", "license": ["MIT"]}]}',
    "packages.config": '<packages>\n<package id="N" version="13.0.1" /></packages>',
    "node_modules/x/requirements.txt": "skipped==1.0",
}


def test_all_formats(spark):
    df = spark.createDataFrame([("p", k, v) for k, v in FILES.items()], "project string, file string, text string")
    got = {(r.ecosystem, r.name, r.version, r.line, r.license) for r in lockfiles.components(df).collect()}
    assert got == {("PyPI", "django", "4.2.1", 1, ""), ("PyPI", "requests", "2.25.0", 2, ""), ("npm", "lodash", "4.17.15", 2, "MIT"), ("npm", "a", "1.0.0", 1, ""),
                   ("npm", "b", "2.0.0", 2, ""), ("Maven", "g:a", "1.2", 1, ""), ("Go", "github.com/a/b", "1.2.3", 3, ""), ("Go", "golang.org/x/y", "0.1.0", 4, ""),
                   ("RubyGems", "rack", "2.2.3", 3, ""), ("Packagist", "m/log", "1.25.0", 1, "MIT"), ("NuGet", "N", "13.0.1", 2, "")}


@pytest.mark.parametrize("a, b", [("1.0.0", "1.0.0-rc1"), ("1.9", "1.10"), ("1", "1.0"), ("2", "beta"), ("1.99999999999999999999999", "2"), ("1.0.1", "1.0.a")])
def test_order_is_by_parts_not_semver(spark, a, b):
    row = spark.range(1).select((versions.version_key(F.lit(a)) < versions.version_key(F.lit(b))).alias("lt"), (versions.version_key(F.lit(b)) < versions.version_key(F.lit(a))).alias("gt")).first()
    assert row.lt and not row.gt


def adv(id, name="x", events=(), versions=(), kind="ECOSYSTEM", aliases=(), score=None, label=None, summary=""):
    ev = [{"introduced": None, "fixed": None, "last_affected": None, **e} for e in events]
    return {"id": id, "aliases": list(aliases), "summary": summary, "severity": [{"type": "CVSS", "score": score}] if score else [], "database_specific": {"severity": label},
            "affected": [{"package": {"ecosystem": "PyPI", "name": name}, "versions": list(versions), "ranges": [{"type": kind, "events": ev}] if ev or kind == "GIT" else []}]}


COMP = "ecosystem string, name string, version string, file string, line int, license string"


@pytest.mark.parametrize("version, a, hit", [
    ("0.12.2", adv("A", events=[{"introduced": "0"}, {"fixed": "0.12.3"}]), True),
    ("1.0.0", adv("A", events=[{"introduced": "0"}, {"fixed": "0.12.3"}]), False),
    ("1.0.0", adv("A", kind="GIT"), None),
    ("1.4", adv("A", versions=["1.4", "1.5"]), True), ("1.6", adv("A", versions=["1.4", "1.5"]), False),
    ("1.5", adv("A", events=[{"introduced": "1.0"}, {"last_affected": "1.5"}]), True),
    ("1.5", adv("A", events=[{"introduced": "1.0"}, {"fixed": "1.2"}, {"introduced": "2.0"}]), False),
    ("1.1", adv("A", events=[{"introduced": "1.0"}, {"introduced": "2.0"}]), True),
    ("1.1", adv("A"), None),
])
def test_ranges_are_three_valued(spark, version, a, hit):
    c = spark.createDataFrame([("PyPI", "x", version, "f", 1, "")], COMP)
    assert sca.advisory_join(c, spark.createDataFrame([a], ADVISORY)).first().hit is hit


def test_two_advisories_one_cve(spark):
    ev = [{"introduced": "0"}, {"fixed": "2.0"}]
    rows = [adv("G1", events=ev, aliases=["CVE-1"], score="5.3", summary=" s1 "), adv("G2", events=[{"introduced": "0"}, {"fixed": "3.0"}], aliases=["X", "CVE-1"], score="9.8"),
            adv("G3", events=ev, label="MODERATE"), adv("G4", events=ev, score="CVSS:3.1/AV:N")]
    c = spark.createDataFrame([("PyPI", "x", "1.0", "f", 7, "")], COMP)
    got = {r.cve: (r.severity, r.fixed, r.summary) for r in sca.cve_merge(sca.advisory_join(c, spark.createDataFrame(rows, ADVISORY))).collect()}
    assert got == {"CVE-1": ("critical", ["2.0", "3.0"], "s1"), "G3": ("medium", ["2.0"], None), "G4": ("medium", ["2.0"], None)}


def test_advisory_folder_skips_broken_documents(spark, tmp_path):
    (tmp_path / "PyPI").mkdir()
    (tmp_path / "PyPI" / "a.json").write_text('{"id": "A", "affected": [{"package": {"name": "x"}, "versions": ["1"]}]}')
    (tmp_path / "PyPI" / "b.json").write_text("{nope")
    c = spark.createDataFrame([("PyPI", "x", "1", "f", 1, "")], COMP)
    assert sca.advisory_join(c, advisories.read_advisories(spark, str(tmp_path))).select("advisory_id", "hit").collect() == [("A", True)]


def test_status_tells_not_performed_from_none(spark):
    p = spark.createDataFrame([("a",), ("b",), ("c",)], "project string")
    c = spark.createDataFrame([("a",), ("b",)], "project string")
    f = spark.createDataFrame([("a",)], "project string")
    assert {r.project: r.status for r in sca.sca_status(p, c, f).collect()} == {"a": "found", "b": "none_found", "c": "not_performed"}
    assert {r.status for r in sca.sca_status(p, c, f.limit(0), lookup_ok=False).collect()} == {"not_performed"}
