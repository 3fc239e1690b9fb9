"""Rule patterns: Python ``re`` syntax on the way in, Java syntax on the way out."""
from __future__ import annotations

import re

try:  # the parse tree of a rule pattern, used only to find literals it cannot match without
    from re import _constants as _ops, _parser
except ImportError:  # pragma: no cover - other interpreters
    _ops = _parser = None

from pyspark.sql import Column, functions as F

#: Case-insensitive with Unicode classes, which is what a str pattern means in Python.
JAVA_FLAGS = "(?iU)"


def to_java(pattern: str, flags: str = JAVA_FLAGS) -> str:
    """Rewrite the few constructs Java spells differently."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i:i + 2]
            out.append({"\\Z": "\\z"}.get(pair, pair))
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
                out.append(ch)
            elif ch == "[" or (ch == "&" and pattern[i:i + 2] == "&&"):
                out.append("\\" + ch)
            else:
                out.append(ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            if pattern[i:i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i:i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        named = re.match(r"\(\?P<(\w+)>", pattern[i:])
        if named:
            out.append("(?<" + named.group(1).replace("_", "") + ">")
            i += named.end()
            continue
        back = re.match(r"\(\?P=(\w+)\)", pattern[i:])
        if back:
            out.append("\\k<" + back.group(1).replace("_", "") + ">")
            i += back.end()
            continue
        out.append(ch)
        i += 1
    return flags + "".join(out)


def sql_text(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _better(a, b):
    """Prefer the set whose shortest literal is longest, then the smaller set."""
    if a is None or b is None:
        return a or b
    return min((a, b), key=lambda s: (-min(map(len, s)), len(s)))


def _required(items) -> set[str] | None:
    found, run = None, ""
    for op, arg in items:
        if op is _ops.LITERAL and (chr(arg).isascii() or chr(arg).lower() == chr(arg).upper()):
            run += chr(arg).lower()
            continue
        if op in (_ops.AT, _ops.ASSERT, _ops.ASSERT_NOT):
            continue
        if run:
            found, run = _better(found, {run}), ""
        inner = None
        if op is _ops.BRANCH:
            alternatives = [_required(branch) for branch in arg[1]]
            if all(alternatives):
                inner = set().union(*alternatives)
        elif op is _ops.SUBPATTERN:
            inner = _required(arg[3])
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and arg[0] >= 1:
            inner = _required(arg[2])
        if inner:
            found = _better(found, inner)
    return _better(found, {run}) if run else found


def required_literals(pattern: str) -> set[str] | None:
    """Lower-case literals, one of which is inside every match.  None when there is no such set."""
    if _parser is None:
        return None
    try:
        found = _required(_parser.parse(pattern))
    except Exception:
        return None
    # a single letter or digit is on nearly every line and would only cost time
    return found if found and all(len(x) > 1 or not x.isalnum() for x in found) else None


def _digit_item(op, arg) -> bool:
    if op is _ops.LITERAL:
        return chr(arg).isdigit()
    if op is _ops.IN:
        return all((kind is _ops.CATEGORY and what is _ops.CATEGORY_DIGIT)
                   or (kind is _ops.RANGE and chr(what[0]).isdigit() and chr(what[1]).isdigit())
                   or (kind is _ops.LITERAL and chr(what).isdigit()) for kind, what in arg)
    if op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT):
        return arg[0] >= 1 and _digit_sequence(arg[2])
    if op is _ops.SUBPATTERN:
        return _digit_sequence(arg[3])
    if op is _ops.BRANCH:
        return all(_digit_sequence(branch) for branch in arg[1])
    return False


def _digit_sequence(items) -> bool:
    return any(_digit_item(op, arg) for op, arg in items)


def requires_digit(pattern: str) -> bool:
    if _parser is None:
        return False
    try:
        return _digit_sequence(_parser.parse(pattern))
    except Exception:
        return False


def gate_columns(text: Column) -> dict[str, Column]:
    """Per-line columns the gates of all rules share."""
    # these letters fold onto plain s and i; a line that has one skips the literal gate
    odd = F.contains(text, F.lit("ſ")) | F.contains(text, F.lit("ı")) | F.contains(text, F.lit("İ"))
    return {"_lower": F.lower(text), "_odd": odd, "_digit": text.rlike(r"(?U)\d")}


def gate(pattern: str) -> str | None:
    """Cheap necessary condition for a match over ``gate_columns`` as SQL text; None when there is none."""
    literals = required_literals(pattern)
    digit = "_digit" if requires_digit(pattern) else None
    if not literals:
        return digit
    some = "(_odd OR " + " OR ".join(f"contains(_lower, {sql_text(x)})" for x in sorted(literals)) + ")"
    return some if digit is None else f"{digit} AND {some}"


def glob_to_regex(glob: str) -> str:
    """Shell glob over a whole relative path; ``*`` crosses ``/``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in glob[i + 1:]:
            end = glob.index("]", i + 1)
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(ch))
    return "(?s)\\A" + "".join(out) + "\\z"
