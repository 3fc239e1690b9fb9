"""Finding identity and other small scalar expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed order of severities, most severe first.
SEVERITIES = ("critical", "high", "medium", "low", "info")

#: Fixed whitespace class: what Python's str.split() treats as blank.
BLANKS = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def severity_rank(severity: Column, unknown: int = 9) -> Column:
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == name, F.lit(i)).otherwise(out)
    return F.coalesce(out, F.lit(unknown))


def severity_from_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def strip(text: Column) -> Column:
    """Both ends without any whitespace, not only blanks."""
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def squeezed(code: Column) -> Column:
    return F.regexp_replace(code, BLANKS, "")


def fingerprint(canonical_rule: Column, rel_file: Column, sink_code: Column) -> Column:
    """Line-number-free identity of an issue across snapshots: 16 hex characters."""
    return F.substring(F.sha1(F.concat_ws("|", canonical_rule, rel_file, squeezed(sink_code))), 1, 16)


#: Fixed value: what is cut from an archive name to get the project name.
ARCHIVE_SUFFIX = r"(?i)[-_ ](?:main|master|dev|develop|v?\d+(?:\.\d+)*|\d{8}|\d{6})$"


def file_stem(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def project_name(archive: Column) -> Column:
    stem = file_stem(archive)
    cut = strip(F.regexp_replace(stem, ARCHIVE_SUFFIX, ""))
    return F.when(cut == "", stem).otherwise(cut)


def csv_safe(cell: Column) -> Column:
    """Neutralise a cell a spreadsheet would run as a formula."""
    return F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)
