"""Dependencies: components of lockfiles, advisory ranges, merged findings."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.identity import severity_from_rank, severity_rank, strip
from ..functions.versions import advisory_severity, affected, fixed_versions

#: Fixed values.
RULE_ID = "sca.vulnerable-dependency"
CWE = "CWE-1395"
OWASP = "A06:2021-Vulnerable and Outdated Components"
SBOM_ROWS = 500


def collect(components: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct (ecosystem, name, version); the first file and line wins.  ``cap`` only where asked for."""
    named = components.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("version", F.lit("")) != ""))
    out = (named.groupBy("ecosystem", "name", "version")
           .agg(F.min_by(F.struct("file", "line", "license"), F.struct("file", "line")).alias("c"))
           .select("ecosystem", "name", "version", "c.*"))
    return out.orderBy("file", "line", "ecosystem", "name", "version").limit(cap) if cap else out


def advisory_ranges(advisories: DataFrame) -> DataFrame:
    """One row per affected package entry; ``ecosystem`` falls back to the dump's own."""
    own = F.col("ecosystem") if "ecosystem" in advisories.columns else F.lit(None).cast("string")
    return (advisories.withColumn("_eco", own)
            .select(F.col("id").alias("advisory_id"), "aliases", "summary", "severity", "database_specific",
                    "affected", "_eco", F.posexplode("affected").alias("pos", "aff"))
            .withColumn("ecosystem", F.coalesce("aff.package.ecosystem", "_eco"))
            .withColumn("name", F.coalesce("aff.package.name", F.lit(""))))


def advisory_join(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """Components x advisories of the same package with ``hit`` True / False / NULL (undecided).

    The advisory side is the one that can repeat a key; components are distinct, and AQE
    splits a package that carries most advisories or most versions.
    """
    a = advisory_ranges(advisories)
    return (components.join(a, ["ecosystem", "name"])
            .withColumn("hit", affected(F.col("version"), F.col("aff.versions"), F.col("aff.ranges"))))


def advisory_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("ecosystem").agg(F.count_if(F.col("hit")).alias("hits"),
                                           F.count_if(F.col("hit").isNull()).alias("undecided"))


def cve_merge(joined: DataFrame) -> DataFrame:
    """One row per component and CVE: highest severity, all fixes, first summary."""
    hits = joined.filter(F.col("hit"))
    cves = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.startswith(a, F.lit("CVE-")))
    rows = hits.select(
        "ecosystem", "name", "version", "file", "line",
        F.when(F.size(cves) > 0, F.element_at(cves, 1)).otherwise(F.col("advisory_id")).alias("cve"),
        severity_rank(advisory_severity(F.col("severity"), F.col("database_specific.severity"))).alias("rank"),
        fixed_versions(F.col("affected"), F.col("name")).alias("fixed"),
        strip(F.coalesce("summary", F.lit(""))).alias("summary"), "advisory_id")
    # fixes are exploded so the union is a set of strings, not a list of lists held per group
    top = (rows.groupBy("ecosystem", "name", "version", "cve")
           .agg(F.min_by(F.struct("file", "line"), F.struct("file", "line")).alias("at"),
                F.min("rank").alias("rank"),
                F.min_by(F.when(F.col("summary") != "", F.col("summary")),
                         F.when(F.col("summary") != "", F.col("advisory_id"))).alias("summary")))
    fixes = (rows.select("ecosystem", "name", "version", "cve", F.explode("fixed").alias("f")).distinct()
             .groupBy("ecosystem", "name", "version", "cve").agg(F.array_sort(F.collect_set("f")).alias("fixed")))
    return (top.join(fixes, ["ecosystem", "name", "version", "cve"], "left")
            .withColumn("fixed", F.coalesce("fixed", F.array().cast("array<string>")))
            .withColumn("severity", severity_from_rank(F.col("rank"))))


def to_findings(merged: DataFrame) -> DataFrame:
    label = F.concat(F.col("name"), F.lit("@"), F.col("version"), F.lit(" · "), F.col("cve"))
    code = F.concat(F.col("ecosystem"), F.lit(":"), F.col("name"), F.lit("@"), F.col("version"), F.lit("  "), F.col("cve"))
    fix = (F.when(F.size("fixed") > 1, F.concat(F.lit(" Update to one of "), F.array_join("fixed", ", "), F.lit(".")))
           .when(F.size("fixed") == 1, F.concat(F.lit(" Update to "), F.element_at("fixed", 1), F.lit(" or later.")))
           .otherwise(F.lit(" Check for a newer release.")))
    message = F.concat(F.col("name"), F.lit(" "), F.col("version"), F.lit(" has a known vulnerability "), F.col("cve"),
                       F.lit("."), F.when(F.coalesce("summary", F.lit("")) != "",
                                          F.concat(F.lit(" "), F.col("summary"))).otherwise(F.lit("")), fix)
    return merged.select(
        F.lit(RULE_ID).alias("rule_id"), message.alias("message"), "severity", F.lit(CWE).alias("cwe"),
        F.lit(OWASP).alias("owasp"), F.lit("dependency").alias("category"), F.lit("high").alias("precision"),
        label.alias("matched_value"),
        F.array(F.struct(F.lit("sink").alias("kind"), F.col("at.file").alias("file"),
                         F.col("at.line").cast("int").alias("line"), code.alias("code"),
                         F.lit(False).alias("uncertain"))).alias("steps"))


def sbom(components: DataFrame) -> DataFrame:
    return components.select("ecosystem", "name", "version", F.when(
        F.coalesce("license", F.lit("")) != "", F.col("license")).otherwise(F.lit("-")).alias("license"))


def sbom_ranked(components: DataFrame, findings: DataFrame, top: int = SBOM_ROWS) -> DataFrame:
    """Bill of materials with hit counts, vulnerable first; the row limit is the report's."""
    hits = (findings.filter(F.col("category") == "dependency")
            .groupBy(F.substring_index("matched_value", " · ", 1).alias("_key")).agg(F.count(F.lit(1)).alias("vulns")))
    rows = (sbom(components).withColumn("_key", F.concat_ws("@", "name", "version"))
            .join(hits, "_key", "left").withColumn("vulns", F.coalesce("vulns", F.lit(0))).drop("_key"))
    return rows.orderBy(F.col("vulns").desc(), "ecosystem", "name", "version").limit(top)


def sca_status(projects: DataFrame, components: DataFrame, findings: DataFrame, lookup_ok: bool = True) -> DataFrame:
    """not_performed / none_found / found per project; a failed lookup is never "none"."""
    c = components.groupBy("project").agg(F.count(F.lit(1)).alias("components"))
    f = findings.groupBy("project").agg(F.count(F.lit(1)).alias("vulnerable"))
    out = (projects.select("project").distinct().join(c, "project", "left").join(f, "project", "left")
           .fillna(0, ["components", "vulnerable"]))
    status = (F.when((F.col("components") == 0) | F.lit(not lookup_ok), F.lit("not_performed"))
              .when(F.col("vulnerable") == 0, F.lit("none_found")).otherwise(F.lit("found")))
    return out.withColumn("status", status)
