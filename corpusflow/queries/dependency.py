"""Dependency queries: parts as components, part groups as advisories, one lockfile of each format per part."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import query
from .inputs import table, with_sql
from ..functions import versions
from ..functions.identity import severity_rank
from ..operators import sca
from ..plans import spread
from ..sources import lockfiles


def components(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("ecosystem"), F.col("p_name").alias("name"),
                    F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")).alias("version"),
                    F.concat(F.lit("locks/"), F.col("p_partkey").cast("string")).alias("file"), F.lit(1).alias("line"),
                    F.when(F.col("p_type") == "PROMO", "MIT").otherwise("").alias("license"))


COMPONENTS = """raw_components AS (
  SELECT p_brand AS ecosystem, p_name AS name, p_size || '.' || p_retailprice AS version, 'locks/' || p_partkey AS file,
         CASE WHEN p_type = 'PROMO' THEN 'MIT' ELSE '' END AS license FROM part),
components AS (SELECT ecosystem, name, version, arg_min(file, file) AS file, arg_min(license, file) AS license FROM raw_components GROUP BY ALL)"""


def collected(spark, sf) -> DataFrame:
    return sca.collect(components(spark, sf))


def advisories(spark, sf) -> DataFrame:
    """One advisory per (brand, name, type): a range from the smallest to the largest size; two types share a CVE."""
    p = table(spark, sf, "part")
    g = p.groupBy("p_brand", "p_name", "p_type").agg(
        F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.avg("p_retailprice").alias("price"),
        F.min(F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))).alias("one"))
    t = F.col("p_type")
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")

    def ev(**kw):
        return F.struct(*[kw.get(k, F.lit(None).cast("string")).alias(k) for k in ("introduced", "fixed", "last_affected")])

    events = (F.when(t == "STANDARD", F.array(ev(introduced=F.lit("0")), ev(last_affected=hi)))
              .otherwise(F.array(ev(introduced=lo), ev(fixed=hi))))
    kind = F.when(t == "PROMO", "GIT").otherwise("ECOSYSTEM")
    listed = F.when(t == "LARGE", F.array("one")).otherwise(F.array().cast("array<string>"))
    cve = F.when(t.isin("ECONOMY", "SMALL"), F.array(F.lit("GHSA-x"), F.concat(F.lit("CVE-"), F.replace("p_name", F.lit(" "), F.lit("-")))))
    score = F.when(t == "ECONOMY", F.round(F.col("lo") / 5.0, 1).cast("string")).otherwise("CVSS:3.1/AV:N")
    label = F.when(t == "SMALL", "MODERATE").when(t == "MEDIUM", "HIGH").when(t == "STANDARD", "LOW")
    return g.select(
        F.concat_ws("/", F.lit("ADV"), "p_brand", "p_name", "p_type").alias("id"), cve.alias("aliases"),
        F.concat(F.lit(" flaw in "), F.col("p_name")).alias("summary"),
        F.array(F.struct(F.lit("CVSS").alias("type"), score.alias("score"))).alias("severity"),
        F.struct(label.alias("severity")).alias("database_specific"),
        F.array(F.struct(F.struct(F.col("p_brand").alias("ecosystem"), F.col("p_name").alias("name")).alias("package"),
                         listed.alias("versions"),
                         F.array(F.struct(kind.alias("type"), events.alias("events"))).alias("ranges"))).alias("affected"))


ADVISORIES = """advisories AS (
  SELECT p_brand AS ecosystem, p_name AS name, p_type, 'ADV/' || p_brand || '/' || p_name || '/' || p_type AS id, min(p_size) AS lo, max(p_size) AS hi,
         min(p_size || '.' || p_retailprice) AS one,
         CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'CVE-' || replace(p_name, ' ', '-') END AS cve,
         CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN round(min(p_size) / 5.0, 1) >= 9 THEN 'critical' WHEN round(min(p_size) / 5.0, 1) >= 7 THEN 'high'
                WHEN round(min(p_size) / 5.0, 1) >= 4 THEN 'medium' WHEN round(min(p_size) / 5.0, 1) >= 0.1 THEN 'low' ELSE 'medium' END
              WHEN p_type = 'SMALL' THEN 'medium' WHEN p_type = 'MEDIUM' THEN 'high' WHEN p_type = 'STANDARD' THEN 'low' ELSE 'medium' END AS severity
  FROM part GROUP BY p_brand, p_name, p_type)"""
JOINED = """joined AS (
  SELECT c.*, a.id, a.p_type, a.cve, a.severity, a.lo, a.hi, a.one,
         CASE WHEN p_type = 'LARGE' THEN c.version = a.one WHEN p_type = 'PROMO' THEN NULL
              WHEN p_type = 'STANDARD' THEN NOT ([CAST(a.hi AS BIGINT)] < k) ELSE [CAST(a.lo AS BIGINT)] <= k AND NOT ([CAST(a.hi AS BIGINT)] <= k) END AS hit
  FROM (SELECT *, [CAST(x AS BIGINT) FOR x IN string_split(version, '.')] AS k FROM components) c JOIN advisories a USING (ecosystem, name))"""


@query("comp_collect", with_sql(COMPONENTS, select="SELECT ecosystem, name, version, file, license FROM components"))
def comp_collect(spark, sf):
    return collected(spark, sf).select("ecosystem", "name", "version", "file", "license")


_V = "p_size || '.' || p_retailprice || CASE WHEN p_type = 'PROMO' THEN '-rc_' || p_size ELSE '' END"
_KEY = "[{'k': CASE WHEN regexp_full_match(x, '[0-9]+') THEN 0 ELSE 1 END, 'n': CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS BIGINT) ELSE 0 END, 'w': CASE WHEN regexp_full_match(x, '[0-9]+') THEN '' ELSE x END} FOR x IN string_split_regex(%s, '[.+_-]') IF x <> '']"


def _version(col_type: str = "p_type"):
    return F.concat(F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")),
                    F.when(F.col(col_type) == "PROMO", F.concat(F.lit("-rc_"), F.col("p_size").cast("string"))).otherwise(""))


@query("version_key", f"""SELECT version, array_to_string([k.k || ':' || k.n || ':' || k.w FOR k IN key], '|') AS key, key < {_KEY % "'25.1000.0-rc_1'"} AS older
FROM (SELECT version, {_KEY % 'version'} AS key FROM (SELECT DISTINCT {_V} AS version FROM part))""")
def version_key(spark, sf):
    v = table(spark, sf, "part").select(_version().alias("version")).distinct().withColumn("k", versions.version_key(F.col("version")))
    shown = F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["kind"].cast("string"), x["number"], x["word"])), "|")
    return v.select("version", shown.alias("key"), (F.col("k") < versions.version_key(F.lit("25.1000.0-rc_1"))).alias("older"))


@query("version_in_range", with_sql(COMPONENTS, ADVISORIES, JOINED, select="SELECT ecosystem, name, version, id, hit FROM joined WHERE p_type <> 'LARGE'"))
def version_in_range(spark, sf):
    j = collected(spark, sf).join(sca.advisory_ranges(advisories(spark, sf)), ["ecosystem", "name"]).filter(F.size("aff.versions") == 0)
    r = F.element_at("aff.ranges", 1)
    return j.select("ecosystem", "name", "version", F.col("advisory_id").alias("id"), versions.in_range(F.col("version"), r["type"], r["events"]).alias("hit"))


@query("version_affected", with_sql(COMPONENTS, ADVISORIES, JOINED, select="SELECT ecosystem, name, version, id, hit FROM joined"))
def version_affected(spark, sf):
    return sca.advisory_join(collected(spark, sf), advisories(spark, sf)).select("ecosystem", "name", "version", F.col("advisory_id").alias("id"), "hit")


@query("advisory_join", with_sql(COMPONENTS, ADVISORIES, JOINED, select="SELECT ecosystem, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit IS NULL) AS undecided FROM joined GROUP BY 1"))
def advisory_join(spark, sf):
    return sca.advisory_counts(sca.advisory_join(collected(spark, sf), advisories(spark, sf)))


@query("src_advisories", with_sql(ADVISORIES, select="SELECT ecosystem, count(*) AS n FROM advisories GROUP BY 1"))
def src_advisories(spark, sf):
    return sca.advisory_ranges(advisories(spark, sf)).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"))


@query("advisory_severity", with_sql(ADVISORIES, select="SELECT id, severity FROM advisories"))
def advisory_severity(spark, sf):
    return advisories(spark, sf).select("id", versions.advisory_severity(F.col("severity"), F.col("database_specific.severity")).alias("severity"))


@query("advisory_fixed", with_sql(ADVISORIES, select="SELECT id, CASE WHEN p_type = 'STANDARD' THEN '' ELSE CAST(hi AS VARCHAR) END AS fixed FROM advisories"))
def advisory_fixed(spark, sf):
    a = sca.advisory_ranges(advisories(spark, sf))
    return a.select(F.col("advisory_id").alias("id"), F.array_join(versions.fixed_versions(F.col("affected"), F.col("name")), ",").alias("fixed"))


MERGED = """merged AS (
  SELECT ecosystem, name, version, coalesce(cve, id) AS cve, min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) AS rank,
         coalesce(string_agg(DISTINCT CAST(hi AS VARCHAR), ', ' ORDER BY CAST(hi AS VARCHAR)) FILTER (WHERE p_type <> 'STANDARD'), '') AS fixed,
         count(DISTINCT CAST(hi AS VARCHAR)) FILTER (WHERE p_type <> 'STANDARD') AS n_fixed
  FROM joined WHERE hit GROUP BY ALL)"""


def merged(spark, sf) -> DataFrame:
    return sca.cve_merge(sca.advisory_join(collected(spark, sf), advisories(spark, sf)))


@query("cve_merge", with_sql(COMPONENTS, ADVISORIES, JOINED, MERGED, select="SELECT ecosystem, name, version, cve, rank, fixed, 'flaw in ' || name AS summary FROM merged"))
def cve_merge(spark, sf):
    return merged(spark, sf).select("ecosystem", "name", "version", "cve", severity_rank(F.col("severity")).alias("rank"),
                                    F.array_join("fixed", ", ").alias("fixed"), "summary")


@query("sca_findings", with_sql(COMPONENTS, ADVISORIES, JOINED, MERGED, select="""SELECT name || '@' || version || ' · ' || cve AS matched_value,
  ecosystem || ':' || name || '@' || version || '  ' || cve AS code, name || ' ' || version || ' has a known vulnerability ' || cve || '. flaw in ' || name ||
  CASE WHEN n_fixed > 1 THEN ' Update to one of ' || fixed || '.' WHEN n_fixed = 1 THEN ' Update to ' || fixed || ' or later.' ELSE ' Check for a newer release.' END AS message FROM merged"""))
def sca_findings(spark, sf):
    return sca.to_findings(merged(spark, sf)).select("matched_value", F.element_at("steps", 1)["code"].alias("code"), "message")


@query("sbom_rows", with_sql(COMPONENTS, select="SELECT ecosystem, name, version, CASE WHEN license <> '' THEN license ELSE '-' END AS license FROM components"))
def sbom_rows(spark, sf):
    return sca.sbom(collected(spark, sf))


@query("sbom_ranked", with_sql(COMPONENTS, ADVISORIES, JOINED, MERGED, "hits AS (SELECT name || '@' || version AS key, count(*) AS n FROM merged GROUP BY 1)",
       select="""SELECT ecosystem, name, version, coalesce(n, 0) AS vulns FROM components LEFT JOIN hits ON key = name || '@' || version
ORDER BY coalesce(n, 0) DESC, ecosystem, name, version LIMIT 500"""))
def sbom_ranked(spark, sf):
    """The report's table: its 500-row limit is the feature."""
    return sca.sbom_ranked(collected(spark, sf), sca.to_findings(merged(spark, sf))).select("ecosystem", "name", "version", "vulns")


@query("sca_status", with_sql(COMPONENTS, ADVISORIES, JOINED, MERGED, """projects AS (SELECT DISTINCT p_brand AS project FROM part UNION SELECT n_name FROM nation),
c AS (SELECT ecosystem AS project, count(*) AS components FROM components GROUP BY 1), m AS (SELECT ecosystem AS project, count(*) AS vulnerable FROM merged WHERE rank = 0 GROUP BY 1)""",
       select="""SELECT project, coalesce(components, 0) AS components, coalesce(vulnerable, 0) AS vulnerable, CASE WHEN components IS NULL THEN 'not_performed' WHEN vulnerable IS NULL THEN 'none_found' ELSE 'found' END AS status
FROM projects LEFT JOIN c USING (project) LEFT JOIN m USING (project)"""))
def sca_status(spark, sf):
    """Brands are projects with lockfiles, nations are projects without; findings are the critical ones."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("project"))
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("project"))
    c = collected(spark, sf).withColumn("project", F.col("ecosystem"))
    m = merged(spark, sf).filter(F.col("severity") == "critical").withColumn("project", F.col("ecosystem"))
    return sca.sca_status(brands.unionByName(nations), c, m)


# ---- lockfiles ----------------------------------------------------------------------------

def _files(spark, sf) -> DataFrame:
    """Seven lockfiles per part, each with one usable entry and some lines that do not count."""
    p = spread(table(spark, sf, "part"))
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    v = F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    c = F.concat
    L = F.lit
    texts = {
        "requirements.txt": c(L("# pinned\nflask>=2.0\n-r other.txt\n"), name, L("[extra] == "), v, L("  # note\n")),
        "package-lock.json": c(L('{"packages": {"": {"version": "1.0.0"},\n "node_modules/a/node_modules/'), name, L('": {"version": "'), v, L('", "license": "'), F.col("p_type"), L('"}}}')),
        "pom.xml": c(L("<project>\n<dependencies><dependency><groupId>org.x</groupId>\n<artifactId>"), name, L("</artifactId><version>"), v,
                     L("</version></dependency>\n<dependency><groupId>org.y</groupId><artifactId>z</artifactId><version>${rev}</version></dependency></dependencies></project>")),
        "go.mod": c(L("module example.com/app\n\nrequire (\n\texample.com/"), name, L(" v"), v, L(" // indirect\n)\n")),
        "Gemfile.lock": c(L("GEM\n  remote: x\n  specs:\n    "), name, L(" ("), v, L(")\n      dep (>= 1)\n\nPATH\n    other (1.0)\n")),
        "composer.lock": c(L('{"packages": [{"name": "acme/'), name, L('", "version": "v'), v, L('", "license": ["MIT", "'), F.col("p_type"), L('"]}],\n "packages-dev": []}')),
        "packages.config": c(L('<?xml version="1.0"?>\n<packages>\n  <package id="'), name, L('" version="'), v, L('" />\n</packages>')),
    }
    entries = F.array(*[F.struct(L(k).alias("base"), t.alias("text")) for k, t in texts.items()])
    return (p.select("p_brand", "p_partkey", F.explode(entries).alias("e"))
            .select(F.col("p_brand").alias("project"), F.concat_ws("/", L("app"), F.col("p_partkey").cast("string"), "e.base").alias("file"), "e.text"))


def _lock_sql(base: str, name: str, line: int, license: str = "''") -> str:
    return (f"SELECT p_brand AS project, 'app/' || p_partkey || '/{base}' AS file, {name} AS name, p_size || '.' || p_retailprice AS version, "
            f"CAST({line} AS INTEGER) AS line, {license} AS license FROM part")


_NAME = "replace(p_name, ' ', '-')"
_LOCKS = {
    "comp_requirements": (lockfiles.requirements, _lock_sql("requirements.txt", _NAME, 4)),
    "comp_package_lock": (lockfiles.package_lock, _lock_sql("package-lock.json", _NAME, 1 + 1, "p_type")),
    "comp_pom": (lockfiles.pom, _lock_sql("pom.xml", f"'org.x:' || {_NAME}", 3)),
    "comp_go_mod": (lockfiles.go_mod, _lock_sql("go.mod", f"'example.com/' || {_NAME}", 4)),
    "comp_gemfile_lock": (lockfiles.gemfile_lock, _lock_sql("Gemfile.lock", _NAME, 4)),
    "comp_composer_lock": (lockfiles.composer_lock, _lock_sql("composer.lock", f"'acme/' || {_NAME}", 1, "'MIT, ' || p_type")),
    "comp_packages_config": (lockfiles.packages_config, _lock_sql("packages.config", _NAME, 3)),
}


def _register(name: str, parse, sql: str) -> None:
    @query(name, sql)
    def run(spark, sf):
        return parse(_files(spark, sf)).select("project", "file", "name", "version", "line", "license")


for _name, (_parse, _sql) in _LOCKS.items():
    _register(_name, _parse, _sql)


@query("src_lockfiles", "SELECT ecosystem, count(*) AS n FROM (SELECT unnest(['PyPI', 'npm', 'Maven', 'Go', 'RubyGems', 'Packagist', 'NuGet']) AS ecosystem, p_partkey FROM part) GROUP BY 1")
def src_lockfiles(spark, sf):
    return lockfiles.components(_files(spark, sf)).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"))


@query("comp_line", "SELECT ecosystem, line, count(*) AS n FROM (SELECT unnest([('PyPI', 4), ('npm', 2), ('Maven', 3), ('Go', 4), ('RubyGems', 4), ('Packagist', 1), ('NuGet', 3)]) AS e, p_partkey, CAST(e[1] AS VARCHAR) AS ecosystem, CAST(e[2] AS INTEGER) AS line FROM part) GROUP BY ALL")
def comp_line(spark, sf):
    return lockfiles.components(_files(spark, sf)).groupBy("ecosystem", "line").agg(F.count(F.lit(1)).alias("n"))
