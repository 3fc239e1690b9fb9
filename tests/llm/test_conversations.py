"""Conversation repair against every edit script, on rows that are hostile in every column."""
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from corpusflow.llm import conversations

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
PATTERN, BEGUN = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"s?(ua)*u?\Z")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        black = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def scripts(rows, found):
    """(cost, audit, repaired turns) of every edit script with at most two insertions in a gap."""
    def go(i, gap, cost, audit, turns):
        if not BEGUN.match("".join(r[:1] for r, _ in turns)):
            return
        if i == len(rows) and PATTERN.match("".join(r[:1] for r, _ in turns)) and all(r for r, _ in turns):
            yield cost, audit, turns
        if gap < 2:
            for role in ("user", "assistant"):
                yield from go(i, gap + 1, cost + 3, audit + "I", turns + [(role, "")])
        if i < len(rows):
            _, role, text = rows[i]
            yield from go(i + 1, 0, cost + 4, audit + "D", turns)
            if found[i] not in ("blank", "duplicate"):
                late = 3 * (found[i] == "truncated")
                yield from go(i + 1, 0, cost + late, audit + "K", turns + [(role, text)])
                for new in ("user", "assistant"):
                    yield from go(i + 1, 0, cost + 3 + late, audit + "R", turns + [(new, text)])
    return min(go(0, 0, 0, "", []), key=lambda x: x[:2])


def expected(rows, damaging=True):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        own = [r[1:] for r in (damage(own) if damaging else own)]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found, turns = faults(own), [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, repaired = scripts(own, found)
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"),
                     found.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def hostile(seed, convs, most):
    rng, rows = random.Random(seed), []
    for c in [None, *range(convs)]:
        for _ in range(rng.randint(1, most)):
            rows.append((c, rng.choice([None, *range(6)]), rng.choice([None, "", "user", "assistant", "system", "user", "assistant", "tool", "u"]),
                         rng.choice([None, "", " \t\x0b", "Hi.", "Hi.", "no end", "é!\n", "ok?  ", "x" * 5000 + "."])))
    return rows


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("slice_rows", [1_024, 1, 2])
def test_repair_equals_the_cheapest_of_all_scripts(spark, slice_rows):
    rows = hostile(slice_rows, 30, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert results(conversations.repair(conversations.damaged(df), slice_rows)) == expected(rows)


def test_long_conversations_are_the_same_in_any_slices_and_give_their_turns(spark):
    rng, rows = random.Random(5), []
    for c in range(3):
        rows += [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}!"])) for t in range(150)]
    df = conversations.undamaged(spark.createDataFrame(rows, SCHEMA))
    whole = results(conversations.repair(df))
    assert whole == results(conversations.repair(df, 7))
    turns = {}
    for r in conversations.repaired_turns(df, 7).orderBy("conv_id", "part", "no", "place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, found in whole.items():
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns[conv]).encode()).hexdigest() == found[-1]
        assert PATTERN.match("".join(r[:1] for r, _ in turns[conv]))


def test_the_agenda_prefers_the_least_audit_among_equal_costs():
    # two user turns: re-roling the second leaves it odd, deleting either costs as much as nothing else
    rows = [("u", conversations.SOUND), ("u", conversations.SOUND), ("a", conversations.SOUND)]
    assert conversations.lightest(rows, conversations.START, conversations.ACCEPTED, True) == {conversations.ASSISTANT: (3, "KIKK")}
    assert conversations.lightest([("a", conversations.SOUND)], conversations.START, conversations.ACCEPTED, True) == {conversations.ASSISTANT: (3, "IK")}


def test_empty_tables_extra_columns_and_dropped_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damaged(empty)).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    wide = T.StructType([*SCHEMA.fields, *[T.StructField(n, T.StringType()) for n in ("cost", "audit", "live", "part", "digest", "_k", "turns")]])
    df = spark.createDataFrame([(1, dropped, "user", "a.", "x", "x", "x", "x", "x", "x", "x")], wide)
    out = conversations.repair(conversations.damaged(df))
    assert results(out) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert dict(out.dtypes)["cost"] == "bigint" and out.columns[0] == "conv_id"
