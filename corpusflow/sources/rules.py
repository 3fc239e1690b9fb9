"""Rule files and their overlays.

Rule files are small configuration (a few hundred records): the driver reads them and
they enter the plans as dimension tables.  JSON always works; YAML where a parser is
installed.
"""
from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import dimension
from ..schema import PATTERN_RULE
from ..tables import pattern_rules

try:
    import yaml
except ImportError:  # pragma: no cover - optional
    yaml = None

DEFAULT_LANGUAGES = ["javascript", "typescript"]

# ---- fixed values: reads of stored data that count as input, by language -----------------
_JS_STORE = [{"pattern": "name", "name": [
    "db.query", "db.execute", "db.querySync", "db.collection", "db.get", "db.all",
    "readFileSync", "fs.readFileSync", "fs.readFile", "readFile"]}]
_C_STORE = [{"pattern": "name", "name": ["sqlite3_column_text", "sqlite3_column_blob"]}]
STORE_SOURCES = {
    "go": [{"pattern": "outparam", "arg": 0, "name": ["Scan"]},
           {"pattern": "name", "name": ["os.ReadFile", "ioutil.ReadFile", "os.Open"]}],
    "javascript": _JS_STORE,
    "typescript": _JS_STORE,
    "ruby": [{"pattern": "name", "name": ["find_by", "find_by_sql", "exec_query", "File.read", "IO.read"]}],
    "java": [{"pattern": "name", "name": ["getString", "getObject", "readAllBytes", "readString"]}],
    "php": [{"pattern": "name", "name": [
        "mysqli_fetch_assoc", "mysqli_fetch_array", "mysqli_fetch_row", "mysqli_fetch_object", "pg_fetch_assoc",
        "pg_fetch_array", "pg_fetch_row", "fetch", "fetchAll", "fetchColumn", "file_get_contents", "fgets", "fread"]}],
    "csharp": [{"pattern": "name", "name": ["GetString", "GetValue", "ReadAllText", "ReadAllLines", "ReadLine"]}],
    "c": _C_STORE,
    "cpp": _C_STORE,
}
# ---- end of fixed values -----------------------------------------------------------------

RULES = "rule_id string, message string, severity string, cwe string, owasp string, languages array<string>, legacy_ids array<string>"
SOURCES = "rule_id string, lang string, kind string, object string, property array<string>, name string, arg int"
SINKS = "rule_id string, lang string, sink_ord int, kind string, callee string, arg int, decorator string, property string"
SANITIZERS = "rule_id string, lang string, callee string, requires array<string>"
VALIDATORS = "rule_id string, token string"


def _listed(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def read_records(directory: str | Path) -> list[dict]:
    """Documents of a rule folder in file-name order; a file that does not parse is skipped."""
    out = []
    for path in sorted(Path(directory).iterdir()):
        if path.suffix == ".json":
            load = json.loads
        elif path.suffix in (".yml", ".yaml") and yaml is not None:
            load = yaml.safe_load
        else:
            continue
        try:
            doc = load(path.read_text(encoding="utf-8"))
        except (ValueError, OSError) if yaml is None else (ValueError, OSError, yaml.YAMLError):
            continue
        if isinstance(doc, dict):
            out.append(doc)
    return out


def pattern_rule_rows(docs: Iterable[dict]) -> list[tuple]:
    """Pattern rules of rule files; ``defaults`` of a file apply to its ``rules``."""
    return [pattern_rules.record(d.get("defaults") or {}, r) for d in docs for r in d.get("rules") or []]


def pattern_rule_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return dimension(spark, pattern_rules.shipped() if rows is None else rows, PATTERN_RULE)


def flow_rule_tables(spark: SparkSession, specs: Iterable[dict], trust_stored_data: bool = False) -> dict[str, DataFrame]:
    """Rule documents as the exploded tables the flow operators join."""
    rules, sources, sinks, sanitizers, validators = [], [], [], [], []
    for d in specs:
        rid, langs = d["id"], _listed(d.get("languages")) or DEFAULT_LANGUAGES
        rules.append((rid, d.get("message", rid), d.get("severity", "medium"), d.get("cwe", ""), d.get("owasp", ""),
                      langs, _listed(d.get("legacy_ids"))))
        own = list(d.get("sources") or [])
        if not trust_stored_data:
            own += [s for lang in langs for s in STORE_SOURCES.get(lang, [])]
        for lang in langs:
            for s in own:
                kind = s.get("pattern", "member")
                for name in _listed(s.get("name")) or [None]:
                    sources.append((rid, lang, kind, s.get("object"), _listed(s.get("property")), name, int(s.get("arg", 0))))
            for i, s in enumerate(d.get("sinks") or []):
                kind = s.get("pattern", "call")
                for callee in _listed(s.get("callee")) or [None]:
                    for deco in _listed(s.get("decorator")) or [None]:
                        for prop in _listed(s.get("property")) or [None]:
                            sinks.append((rid, lang, i, kind, callee, s.get("arg"), deco, prop))
            for s in d.get("sanitizers") or []:
                for callee in _listed(s.get("callee")):
                    sanitizers.append((rid, lang, callee, _listed(s.get("requires"))))
        for v in d.get("validators") or []:
            for token in (_listed(v.get("token")) if isinstance(v, dict) else [v]):
                validators.append((rid, token))
    return {"rules": dimension(spark, rules, RULES), "sources": dimension(spark, sources, SOURCES),
            "sinks": dimension(spark, sinks, SINKS), "sanitizers": dimension(spark, sanitizers, SANITIZERS),
            "validators": dimension(spark, validators, VALIDATORS)}


def alias_table(rules: DataFrame) -> DataFrame:
    """Rename history from ``legacy_ids``."""
    return rules.select(F.explode("legacy_ids").alias("old_id"), F.col("rule_id").alias("new_id"))


def overlay(shipped: DataFrame, user: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """User rules over shipped ones by id: lists append without repeats, scalars override, ``replace`` drops.

    A user row says nothing about a column by leaving it NULL.
    """
    s = shipped.select("id", *[F.col(c).alias("s_" + c) for c in scalars + lists])
    u = user.select("id", F.coalesce("replace", F.lit(False)).alias("_replace"), *[F.col(c).alias("u_" + c) for c in scalars + lists])
    j = s.join(u, "id", "full_outer")
    replaced = F.coalesce("_replace", F.lit(False))

    def scalar(c):
        return F.when(replaced, F.col("u_" + c)).otherwise(F.coalesce("u_" + c, "s_" + c)).alias(c)

    def many(c):
        old, new = F.coalesce("s_" + c, F.array().cast("array<string>")), F.coalesce("u_" + c, F.array().cast("array<string>"))
        added = F.filter(new, lambda x: ~F.array_contains(old, x))
        return F.when(replaced, new).otherwise(F.concat(old, added)).alias(c)

    return j.select("id", *[scalar(c) for c in scalars], *[many(c) for c in lists])


def with_store_sources(rule_sources: DataFrame, rules: DataFrame, store: DataFrame, trust_stored_data: bool = False) -> DataFrame:
    """Stored-data sources added to every rule of their language unless stored data is trusted."""
    if trust_stored_data:
        return rule_sources
    extra = rules.select("rule_id", F.explode("languages").alias("lang")).join(store, "lang")
    return rule_sources.unionByName(extra.select(*rule_sources.columns))


def store_source_table(spark: SparkSession) -> DataFrame:
    rows = [(lang, s["pattern"], None, [], name, int(s.get("arg", 0)))
            for lang, pats in STORE_SOURCES.items() for s in pats for name in s["name"]]
    return dimension(spark, rows, "lang string, kind string, object string, property array<string>, name string, arg int")


def library_model(entries: DataFrame) -> DataFrame:
    """Library behaviour ``(kind, key, lang, verdict)``; of repeated keys the last file's entry stays.

    ``entries(load_order, kind, key, languages, verdict)``; no languages means all.
    """
    last = entries.groupBy("kind", "key").agg(F.max_by(F.struct("languages", "verdict"), "load_order").alias("e"))
    return last.select("kind", "key", F.explode_outer("e.languages").alias("lang"), F.col("e.verdict").alias("verdict"))


def library_rows(docs: Iterable[dict], start: int = 0) -> list[tuple]:
    """Entries of library-summary documents in load order."""
    rows = []
    for i, d in enumerate(docs, start):
        langs = _listed(d.get("languages"))
        for j, verdict in enumerate(("block", "propagate")):
            section = d.get(verdict) or {}
            for kind, field in (("method", "method"), ("path", "name")):
                rows += [(i * 2 + j, kind, key, langs, verdict) for key in section.get(field) or ()]
    return rows
