"""Seven lockfile formats as one Spark job over ``files(project, file, text)``.

Every format is a column expression over the file text, so a corpus with a
million lockfiles is a million independent rows.  Line numbers of the structured
formats are looked up in the sorted tokens of the same row; only nested npm
entries, which leave their row, are joined back to the tokens.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import file_name, strip
from ..plans import durable
from .corpus import LINE_END

#: Folders that hold other people's lockfiles, size cap of an XML file.
VENDOR_DIRS = ("node_modules", ".git", "vendor", "dist", "build", "target", ".venv", "venv")
MAX_XML_CHARS = 5 * 1024 * 1024

# ---- fixed values: line shapes of the text formats ---------------------------------------
PINNED = r"^([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*==\s*([A-Za-z0-9._!+-]+)"
GO_REQUIRE = r"^([\w.\-/~]+\.[\w.\-/~]+)\s+v([0-9][\w.\-+]*)$"
GEM_ENTRY = r"^ {4}([A-Za-z0-9._-]+) \(([0-9][^)]*)\)$"
# ---- end of fixed values -----------------------------------------------------------------


def _named(files: DataFrame, name: str) -> DataFrame:
    return files.filter(file_name(F.col("file")) == name)


def _text_lines(text: Column) -> Column:
    return F.split(text, LINE_END)


#: What a needle looks like in each format.  Splitting a line into these tokens finds
#: exactly the places where the needle occurs, since a token never holds another one.
JSON_TOKEN = r'"(?:[^"\\]|\\.)*"'
ARTIFACT_TOKEN = r"<artifactId>[^<]*<"
ID_TOKEN = r'id="[^"]*"'


def _first_lines(files: DataFrame, token: str) -> DataFrame:
    """First line of every token of a file: one pass over the text, however many components it has."""
    rows = files.select("project", "file", F.posexplode(_text_lines(F.col("text"))).alias("pos", "l"))
    tokens = rows.select("project", "file", "pos", F.explode(F.regexp_extract_all("l", F.lit(token), F.lit(0))).alias("needle"))
    return tokens.groupBy("project", "file", "needle").agg((F.min("pos") + 1).alias("line"))


def _component(df: DataFrame, ecosystem: str, name: Column, version: Column, line: Column,
               license: Column | None = None) -> DataFrame:
    return df.select("project", "file", F.lit(ecosystem).alias("ecosystem"), name.alias("name"),
                     version.alias("version"), line.cast("int").alias("line"),
                     (F.lit("") if license is None else F.coalesce(license, F.lit(""))).alias("license"))


def _located(df: DataFrame, files: DataFrame, token: str, needle: Column, ecosystem: str, name: Column, version: Column,
             license: Column | None = None) -> DataFrame:
    """Components with the first line that holds their needle, else line 1."""
    # the optimizer takes the lines of a compressed corpus for small; they are as large as the corpus
    lines = _first_lines(files, token).hint("merge")
    rows = df.withColumn("needle", needle).join(lines, ["project", "file", "needle"], "left")
    return _component(rows, ecosystem, name, version, F.coalesce("line", F.lit(1)), license)


def _tokens(token: str) -> Column:
    """Every token of ``text`` with its line, in order of both."""
    found = F.transform(_text_lines(F.col("text")), lambda l, i: F.transform(
        F.regexp_extract_all(l, F.lit(token), F.lit(0)), lambda t: F.struct(t.alias("needle"), (i + 1).alias("line"))))
    return F.sort_array(F.flatten(found))


def _line_of(needle: Column) -> Column:
    """First line of ``needle`` among the sorted ``tokens``, by halving; NULL if there is none."""
    tokens, n = F.col("tokens"), F.size("tokens")

    def halve(at: Column, _: Column) -> Column:
        low, high = at["low"], at["high"]
        mid = F.floor((low + high) / 2).cast("int")
        below = F.get(tokens, mid)["needle"] < needle
        return F.struct(F.when((low < high) & below, mid + 1).otherwise(low).alias("low"),
                        F.when((low < high) & ~below, mid).otherwise(high).alias("high"))

    start = F.struct(F.lit(0).alias("low"), n.alias("high"))
    first = F.get(tokens, F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n))), start, halve)["low"])
    return F.when(first["needle"] == needle, first["line"])


def _explode_located(rows: DataFrame, token: str, items: Column, needle) -> DataFrame:
    """One row per item of a file with its line, the first that holds ``needle(item)``, else 1: no row leaves its file."""
    rows = rows.select("project", "file", items.alias("items"), _tokens(token).alias("tokens"))
    each = F.transform("items", lambda c: F.struct(c.alias("c"), _line_of(needle(c)).alias("line")))
    line = F.when(F.col("project").isNotNull(), F.col("e.line"))
    return rows.select("project", "file", F.explode(each).alias("e")).select(
        "project", "file", "e.c.*", F.coalesce(line, F.lit(1)).alias("line"))


def _by_line(files: DataFrame, name: str) -> DataFrame:
    return _named(files, name).select("project", "file", F.posexplode(_text_lines(F.col("text"))).alias("pos", "line"))


def requirements(files: DataFrame) -> DataFrame:
    rows = _by_line(files, "requirements.txt")
    line = strip(F.substring_index("line", "#", 1))
    rows = rows.withColumn("l", line).filter(~F.startswith("l", F.lit("-")) & F.col("l").rlike(PINNED))
    return _component(rows, "PyPI", F.regexp_extract("l", PINNED, 1), F.regexp_extract("l", PINNED, 2), F.col("pos") + 1)


def package_lock(files: DataFrame) -> DataFrame:
    f = _named(files, "package-lock.json").select("project", "file", "text", F.from_json("text", (
        "packages map<string, struct<version:string, name:string, license:string>>, "
        "dependencies map<string, struct<version:string, dependencies:string>>")).alias("d"))
    usable = F.filter(F.map_entries(F.coalesce("d.packages", F.create_map().cast(
        "map<string,struct<version:string,name:string,license:string>>"))),
        lambda e: (e["key"] != "") & (F.coalesce(e["value"]["version"], F.lit("")) != ""))
    quoted = lambda key: F.concat(F.lit('"'), key, F.lit('"'))
    modern = _explode_located(f, JSON_TOKEN, usable, lambda e: quoted(e["key"]))
    name = F.coalesce("value.name", F.substring_index("key", "node_modules/", -1))
    # a license object is read as its JSON text; only plain names count
    plain = F.when(~F.startswith(F.coalesce("value.license", F.lit("")), F.lit("{")), F.col("value.license"))
    out = _component(modern, "npm", name, F.col("value.version"), F.col("line"), plain)
    # version 1 files nest; used only when the flat map yields nothing
    nested = "map<string, struct<version:string, dependencies:string>>"
    some = F.size(F.coalesce("deps", F.create_map().cast(nested))) > 0
    level = durable(f.filter(F.size(usable) == 0).select("project", "file", F.col("d.dependencies").alias("deps")).filter(some))
    found = None
    # one round for each level that exists; a lockfile may nest as deep as it likes
    while not level.isEmpty():
        rows = level.select("project", "file", F.explode("deps").alias("key", "m")).filter(
            F.coalesce("m.version", F.lit("")) != "")
        nested_rows = rows.select("project", "file", "key", "m.version")
        found = nested_rows if found is None else found.unionByName(nested_rows)
        level = durable(rows.select("project", "file", F.from_json("m.dependencies", nested).alias("deps")).filter(some))
    if found is None:
        return out
    old = _located(found, _named(files, "package-lock.json"), JSON_TOKEN, quoted(F.col("key")), "npm", F.col("key"), F.col("version"))
    return out.unionByName(old)


def _xml_ok(files: DataFrame, max_chars: int | None) -> DataFrame:
    size = F.lit(True) if max_chars is None else F.length("text") <= max_chars
    return files.filter(size & ~F.contains("text", F.lit("<!DOCTYPE"))
                        & ~F.contains("text", F.lit("<!ENTITY")))


def pom(files: DataFrame, max_chars: int | None = MAX_XML_CHARS) -> DataFrame:
    """``max_chars``: longer files are left out (None: none is)."""
    bare = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    blocks = F.regexp_extract_all(bare, F.lit(r"(?s)<dependency(?:\s[^>]*)?>(.*?)</dependency\s*>"), F.lit(1))
    # nested exclusions have their own coordinates
    bodies = F.transform(blocks, lambda b: F.regexp_replace(b, r"(?s)<exclusions(?:\s[^>]*)?>.*?</exclusions\s*>", ""))

    def tag(body: Column, name: str) -> Column:
        return strip(F.regexp_extract(body, rf"(?s)<{name}(?:\s[^>]*)?>\s*(.*?)\s*</{name}\s*>", 1))

    entries = F.transform(bodies, lambda b: F.struct(tag(b, "groupId").alias("g"), tag(b, "artifactId").alias("a"), tag(b, "version").alias("v")))
    items = F.filter(entries, lambda e: (e["g"] != "") & (e["a"] != "") & (e["v"] != "") & ~F.contains(e["v"], F.lit("${")))
    rows = _explode_located(_xml_ok(_named(files, "pom.xml"), max_chars), ARTIFACT_TOKEN, items,
                            lambda e: F.concat(F.lit("<artifactId>"), e["a"], F.lit("<")))
    return _component(rows, "Maven", F.concat_ws(":", "g", "a"), F.col("v"), F.col("line"))


def go_mod(files: DataFrame) -> DataFrame:
    rows = _by_line(files, "go.mod")
    line = strip(F.regexp_replace(strip(F.substring_index("line", "//", 1)), r"^require ", ""))
    rows = rows.withColumn("l", line).filter(F.col("l").rlike(GO_REQUIRE))
    return _component(rows, "Go", F.regexp_extract("l", GO_REQUIRE, 1), F.regexp_extract("l", GO_REQUIRE, 2), F.col("pos") + 1)


def gemfile_lock(files: DataFrame) -> DataFrame:
    """Section state is folded over the lines of one file, so no window over files is needed."""
    state = "struct<inside:boolean,out:array<struct<line:int,text:string>>>"

    def step(acc: Column, item: Column) -> Column:
        bare = strip(item["text"])
        opens, closes = bare == "specs:", bare.isin("GEM", "GIT", "PATH")
        inside = F.when(opens, True).when(closes, False).otherwise(acc["inside"])
        hit = inside & ~opens & item["text"].rlike(GEM_ENTRY)
        return F.struct(inside.alias("inside"), F.when(hit, F.array_append(acc["out"], item)).otherwise(
            acc["out"]).alias("out"))

    lines = F.transform(_text_lines(F.col("text")), lambda l, i: F.struct((i + 1).alias("line"), l.alias("text")))
    start = F.struct(F.lit(False).alias("inside"), F.array().alias("out")).cast(state)
    rows = _named(files, "Gemfile.lock").select("project", "file", F.explode(
        F.aggregate(lines, start, step)["out"]).alias("i"))
    return _component(rows, "RubyGems", F.regexp_extract("i.text", GEM_ENTRY, 1),
                      F.regexp_extract("i.text", GEM_ENTRY, 2), F.col("i.line"))


def composer_lock(files: DataFrame) -> DataFrame:
    one = "array<struct<name:string,version:string,license:string>>"
    f = _named(files, "composer.lock").select("project", "file", "text", F.from_json(
        "text", f"packages {one}, `packages-dev` {one}").alias("d"))
    every = F.concat(F.coalesce("d.packages", F.array().cast(one)),
                     F.coalesce(F.col("d").getField("packages-dev"), F.array().cast(one)))
    items = F.filter(every, lambda p: (F.coalesce(p["name"], F.lit("")) != "") & (F.coalesce(p["version"], F.lit("")) != ""))
    rows = _explode_located(f, JSON_TOKEN, items, lambda p: F.concat(F.lit('"'), p["name"], F.lit('"')))
    # a list of names or one name
    licence = F.coalesce(F.array_join(F.from_json("license", "array<string>"), ", "), F.col("license"))
    return _component(rows, "Packagist", F.col("name"), F.regexp_replace("version", "^v+", ""), F.col("line"), licence)


def packages_config(files: DataFrame, max_chars: int | None = MAX_XML_CHARS) -> DataFrame:
    """``max_chars``: longer files are left out (None: none is)."""
    def attribute(tag: Column, name: str) -> Column:
        quoted = rf"""\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
        return F.concat(F.regexp_extract(tag, quoted, 1), F.regexp_extract(tag, quoted, 2))

    tags = F.regexp_extract_all("text", F.lit(r"<package\b([^>]*)>"), F.lit(1))
    entries = F.transform(tags, lambda t: F.struct(attribute(t, "id").alias("i"), attribute(t, "version").alias("v")))
    items = F.filter(entries, lambda e: (e["i"] != "") & (e["v"] != ""))
    rows = _explode_located(_xml_ok(_named(files, "packages.config"), max_chars), ID_TOKEN, items,
                            lambda e: F.concat(F.lit('id="'), e["i"], F.lit('"')))
    return _component(rows, "NuGet", F.col("i"), F.col("v"), F.col("line"))


PARSERS = (requirements, package_lock, pom, go_mod, gemfile_lock, composer_lock, packages_config)


def components(files: DataFrame) -> DataFrame:
    """All components of a corpus; a malformed file simply yields no rows."""
    own = files.filter(~F.arrays_overlap(F.split("file", "/"), F.array(*[F.lit(d) for d in VENDOR_DIRS])))
    return reduce(DataFrame.unionByName, [parse(own) for parse in PARSERS])
