"""File corpus: scan, exclusions, decoding, lines."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.identity import file_ext, file_name
from ..functions.regex import glob_to_regex

# ---- fixed values: what a scan leaves out, size limits, languages ------------------------

EXCLUDED_DIRS = (
    "node_modules", "bower_components", ".git", ".svn", ".hg", "dist", "build", "out", "target",
    "bin", "obj", "coverage", ".next", ".nuxt", "vendor", "__pycache__", ".pytest_cache",
    ".mypy_cache", ".venv", "venv", "env", ".idea", ".vscode", ".gradle", ".terraform", "Pods",
    ".cache", "logs", "tmp", "temp", "licenses", "jre", "jdk", "third_party", "thirdparty", "3rdparty")

SKIPPED_EXTS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".tif", ".mp3", ".mp4", ".avi",
    ".mov", ".wav", ".mkv", ".flv", ".zip", ".gz", ".tar", ".rar", ".7z", ".bz2", ".xz", ".jar", ".war",
    ".ear", ".exe", ".dll", ".so", ".dylib", ".bin", ".dat", ".o", ".a", ".pyc", ".class", ".pdf", ".doc",
    ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".hwp", ".hwpx", ".ttf", ".otf", ".woff", ".woff2", ".eot",
    ".db", ".sqlite", ".mdb", ".iso", ".img", ".dmg", ".lock", ".map")

SKIPPED_NAME = (r"(?i)(\.min\.(js|css)$|package-lock\.json$|yarn\.lock$|pnpm-lock\.yaml$|"
                r"composer\.lock$|go\.sum$)")

MAX_SOURCE_BYTES = 2_000_000
MAX_TEXT_BYTES = 20_000_000
SNIFFED_BYTES = 4096

GRAMMAR_BY_EXT = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "tsx", ".php": "php", ".phtml": "php", ".inc": "php",
    ".py": "python", ".pyw": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".go": "go", ".rb": "ruby", ".rake": "ruby", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".c": "c", ".h": "c", ".swift": "swift", ".cs": "csharp"}
RULE_LANGUAGE = {"tsx": "typescript", "c": "cpp"}

#: Line ends of Python's str.splitlines().
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# ---- end of fixed values -----------------------------------------------------------------


def read_files(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Recursive corpus scan: one row per file below ``root``."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))
    base = root.rstrip("/") + "/"
    start = F.instr(F.col("path"), base) + len(base)
    rel = F.substr(F.col("path"), start)
    return raw.select(F.lit(project or base.rstrip("/").rsplit("/", 1)[-1]).alias("project"), "path",
                      rel.alias("file"), F.col("length").alias("size"), "content")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def grammar(ext: Column) -> Column:
    return F.element_at(_map(GRAMMAR_BY_EXT), F.lower(ext))


def rule_language(ext: Column) -> Column:
    g = grammar(ext)
    return F.coalesce(F.element_at(_map(RULE_LANGUAGE), g), g)


def in_excluded_dir(rel: Column, excludes: Sequence[str] = EXCLUDED_DIRS) -> Column:
    """Only parts below the scan root count."""
    parts = F.split(rel, "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in excludes])) | F.startswith(
        file_name(rel), F.lit("~$"))


def glob_patterns(globs: Iterable[str]) -> list[str]:
    return [glob_to_regex(g) for pat in globs for g in (pat, pat.rstrip("/") + "/*")]


def matches_glob(rel: Column, globs: Iterable[str]) -> Column:
    patterns = glob_patterns(globs)
    return rel.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def drop_project_globs(files: DataFrame, settings: DataFrame) -> DataFrame:
    """Per-project path globs (``settings(project, glob)``); ``*`` crosses ``/``.

    All globs of a project are folded into one pattern first, so the join adds no rows
    and a project with many files is not multiplied by its globs.
    """
    def piece(token: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(F.substr(token, F.lit(2)), r"([\\\[&^])", r"\\$1"), r"^!", "^")
        return (F.when(token == "*", ".*").when(token == "?", ".")
                .when(F.startswith(token, F.lit("[")) & (F.length(token) > 1), F.concat(F.lit("["), inner))
                .otherwise(F.regexp_replace(token, r"([.\\+^$|(){}\[\]])", r"\\$1")))

    # a class such as [ab] or [!ab] is one token, every other character is one
    tokens = F.regexp_extract_all("glob", F.lit(r"(?s)\[!?\]?[^\]]*\]|."), F.lit(0))
    body = F.array_join(F.transform(tokens, piece), "")
    stem = F.regexp_replace(body, "/+$", "")
    per_project = (settings.select("project", F.concat(F.lit("(?:"), body, F.lit("|"), stem, F.lit("/.*)")).alias("p"))
                   .groupBy("project").agg(F.array_join(F.sort_array(F.collect_set("p")), "|").alias("_globs")))
    joined = files.join(per_project, "project", "left")
    return joined.filter(F.col("_globs").isNull() | ~F.rlike(
        F.col("file"), F.concat(F.lit(r"(?s)\A(?:"), F.col("_globs"), F.lit(r")\z")))).drop("_globs")


def is_text(files: DataFrame, content: str = "content", max_bytes: int | None = MAX_TEXT_BYTES,
            sniffed_bytes: int | None = SNIFFED_BYTES) -> Column:
    """Text candidate: not empty, at most ``max_bytes`` (None: any size), no skipped extension or name, no NUL
    in the first ``sniffed_bytes`` (None: anywhere)."""
    head = F.col(content) if sniffed_bytes is None else F.substring(F.col(content), 1, sniffed_bytes)
    return ((F.col("size") >= 1) & (F.lit(True) if max_bytes is None else F.col("size") <= max_bytes)
            & ~file_ext(F.col("file")).isin(list(SKIPPED_EXTS))
            & ~file_name(F.col("file")).rlike(SKIPPED_NAME)
            & ~F.contains(head, F.lit(b"\x00")))


def is_source(files: DataFrame, max_bytes: int | None = MAX_SOURCE_BYTES) -> Column:
    """Source candidate; ``max_bytes`` None takes files of any size."""
    known = grammar(file_ext(F.col("file"))).isNotNull()
    return known if max_bytes is None else known & (F.col("size") <= max_bytes)


@F.pandas_udf(T.StringType())
def _legacy_text(content: pd.Series) -> pd.Series:
    """Bytes that are not UTF-8: the Korean code page first, Latin-1 always fits."""
    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return raw.decode("cp949")
        except UnicodeDecodeError:
            return raw.decode("latin-1")
    return content.map(one)


def decode(files: DataFrame) -> DataFrame:
    """Adds ``text``.  Only the contents that are not UTF-8 visit Python."""
    utf8 = F.expr("is_valid_utf8(cast(content as string))")
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    # one pass: rows that are UTF-8 hand a NULL to Python
    return files.withColumn("text", F.coalesce(_legacy_text(F.when(~utf8, F.col("content"))), F.when(utf8, text)))


def split_lines(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One row per line, 1-based.  ``max_chars`` cuts each line where a caller asks for it."""
    # a line end at the very end of the text does not open another line
    parts = F.split(F.regexp_replace("text", f"(?:{LINE_END})\\z", ""), LINE_END)
    line = F.col("line") if max_chars is None else F.substring("line", 1, max_chars)
    keep = [c for c in files.columns if c not in ("text", "content")]
    return (files.filter(F.length("text") > 0).select(*keep, F.posexplode(parts).alias("pos", "line"))
            .select(*keep, (F.col("pos") + 1).alias("line_no"), line.alias("line")))


def code_lines(text: Column) -> Column:
    """Newlines + 1 for a non-empty file."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).otherwise(0)


def scan_key(path: Column, content: Column, version: str) -> Column:
    """Identity of (path, content) under one rule/normaliser version."""
    return F.concat(F.sha1(F.concat(path.cast("binary"), F.lit(b"\x00"), content.cast("binary"))),
                    F.lit("-v" + version))


def incremental_skip(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, content, version) was not seen before; ``scan_key`` is unique per file."""
    return files.join(manifest.select("scan_key"), "scan_key", "left_anti")


def carried_over(previous: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of unchanged files, reused as they are."""
    return previous.join(files.select("scan_key"), "scan_key", "left_semi")
