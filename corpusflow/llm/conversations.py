"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A repaired conversation is empty or an optional system turn followed by user/assistant pairs.  What has been read
and written so far is an item: (number of rows read, state of the pattern).  Edits are weighted deductions over
items; each adds a cost that is not negative and a letter to the audit.  Values are (cost, audit), compared by
cost, then by the audit as ASCII.  A deduction's value is never below its antecedents' and keeps their order, so
the agenda may finalise an item the first time it pops it, lightest first, and stops at the goal item.  (Of two
audits of one item and equal cost none is a beginning of the other: both have a letter for every row read, so the
longer one would only add insertions, which cost.)

Rows are range-partitioned on (conversation, turn, role, text) and read in that order.  A conversation that lies inside
one partition and one slice is repaired at once.  Others, such as one that holds a third of all rows, are many slices
repaired in parallel: each slice gives the lightest value from every state to every state.  One row per slice then
goes to the conversation, where a deduction with two antecedents, what was derived before and the slice's item, is
applied slice by slice; the digest of the repaired text is carried along for each state, since a digest over a whole
conversation can only be made from its beginning.  Memory: one slice, and four audits of one conversation.

Defined results
  NULL roles and texts count as one space, also a NULL id or turn in the key that damage is drawn from; a NULL id is
  a conversation of its own.  Rows are ordered by turn (NULL first), then role, then text.  Equal rows are copies.
  A role's initial is its first character; a row whose role is empty can be re-roled or deleted, not kept.
  Very long texts are whole: a slice ends when it holds enough of them.  An empty table gives no rows.
  Extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Scratch, stored

#: Rows and characters of a slice.
SLICE_ROWS, SLICE_CHARS = 1_024, 4_000_000
BLACK = re.compile(r"[^\x20\x09-\x0D]")
ENDED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

#: States of the pattern: nothing written, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The turn that may be written next where it is not a system turn.
NEXT = (USER, USER, ASSISTANT, USER)
WRITTEN = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
ALLOWED = {"su", "ua", "au"}


# ---- the deduction system ----

def lightest(rows: list[tuple[str, int]], start: int, goals: tuple[int, ...], one: bool) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from state ``start`` before the rows to states after them.

    ``rows``: initial of the role and fault.  ``goals``: states wanted; ``one``: the lightest of them only.
    """
    n, done, found = len(rows), set(), {}
    best: dict[int, tuple[int, str]] = {start: (0, "")}
    agenda = [(0, "", start)]  # an item is 4 * rows read + state

    def deduce(cost: int, audit: str, item: int) -> None:
        if item not in done and ((old := best.get(item)) is None or (cost, audit) < old):
            best[item] = (cost, audit)
            heapq.heappush(agenda, (cost, audit, item))

    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in done:
            continue
        done.add(item)
        i, state = divmod(item, 4)
        if i == n and state in goals:
            found[state] = (cost, audit)
            if one or len(found) == len(goals):
                break
        deduce(cost + INSERT_COST, audit + "I", 4 * i + NEXT[state])
        if i == n:
            continue
        initial, fault = rows[i]
        deduce(cost + DELETE_COST, audit + "D", 4 * (i + 1) + state)
        if fault in (BLANK, DUPLICATE):
            continue
        left = TRUNCATED_COST if fault == TRUNCATED else 0
        kept = KEEP.get((state, initial))
        if kept is not None:
            deduce(cost + left, audit + "K", 4 * (i + 1) + kept)
        deduce(cost + REROLE_COST + left, audit + "R", 4 * (i + 1) + NEXT[state])
    return found


def applied(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that an audit writes from ``state`` on."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            state = KEEP[state, roles[i][:1]]
            out.append((roles[i], texts[i]))
        else:
            state = NEXT[state]
            out.append((WRITTEN[state], texts[i] if edit == "R" else ""))
        i += edit != "I"
    return out


class Digest:
    """SHA-256 of turns as ``role:text`` lines, growing turn by turn."""

    def __init__(self, sha=None, empty: bool = True):
        self.sha, self.empty = sha or hashlib.sha256(), empty

    def plus(self, turns: list[tuple[str, str]]) -> "Digest":
        out = Digest(self.sha.copy(), self.empty)
        for role, text in turns:
            out.sha.update(f"{'' if out.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            out.empty = False
        return out


# ---- rows in order ----

def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, live``: rows damaged by the checksum of ``conv_id:turn``; dropped rows are not live."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce(F.col("text"), space), F.coalesce(F.col("role"), space)
    return (rows.withColumn("_k", F.crc32(key.cast("binary")) % 20)
            .withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", F.col("turn").cast("long").alias("turn"),
                    F.when(F.col("_k") == 4, "user").otherwise(role).alias("role"),
                    F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                    (F.col("_k") != 0).alias("live")))


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns from rows as they are."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.lit(True).alias("live"))


def _marked(rows: DataFrame) -> DataFrame:
    """With ``again``: the conversation has the same role and text at an earlier turn."""
    digest = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    keyed = rows.withColumn("digest", digest).withColumn("at", at)
    # few texts of a conversation occur at two turns: only those meet the rows
    early = (keyed.filter("live").groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last"))
             .filter(F.col("first") < F.col("last")).select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first"))
    met = keyed.join(early, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return met.select("conv_id", "turn", "role", "text", "live", F.coalesce(F.col("first") < F.col("at"), F.lit(False)).alias("again"))


FACTS = ("blank", "duplicate", "truncated", "illegal")
TABLE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _slice_schema(conv: T.DataType) -> T.StructType:
    longs = [T.StructField(n, T.LongType()) for n in ("part", "no", "low", "high", "turns", *FACTS, "cost")]
    strings = [T.StructField(n, T.StringType()) for n in ("first", "last", "audit", "repaired_sha256")]
    return T.StructType([T.StructField("conv_id", conv), T.StructField("whole", T.BooleanType()), *longs, *strings,
                         T.StructField("table", TABLE), T.StructField("rows", TURNS)])


class Slice:
    """Consecutive rows of one conversation with their faults."""

    def __init__(self):
        self.turns, self.roles, self.texts, self.faults, self.chars = [], [], [], [], 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.chars += len(text)

    def full(self, rows: int) -> bool:
        return len(self.turns) >= rows or self.chars >= SLICE_CHARS

    def items(self) -> list[tuple[str, int]]:
        return [(r[:1], f) for r, f in zip(self.roles, self.faults)]

    def facts(self) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {"low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)),
                "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(TRUNCATED),
                "illegal": sum(a + b not in ALLOWED for a, b in zip(initials, initials[1:])),
                "first": initials[0] if initials else None, "last": initials[-1] if initials else None}

    def repaired(self, with_rows: bool) -> dict:
        """The lightest repair of a whole conversation."""
        (cost, audit), = lightest(self.items(), START, ACCEPTED, True).values()
        turns = applied(audit, START, self.roles, self.texts)
        return {"whole": True, "cost": cost, "audit": audit, "repaired_sha256": Digest().plus(turns).sha.hexdigest(),
                "rows": [{"role": r, "text": t} for r, t in turns] if with_rows else None}

    def table(self) -> dict:
        """The lightest value from each state to each state, and the rows for whoever chooses among them."""
        items, states = self.items(), (START, SYSTEM, USER, ASSISTANT)
        found = [(a, b, *value) for a in states for b, value in sorted(lightest(items, a, states, False).items())]
        return {"whole": False, "table": [dict(zip(("start", "end", "cost", "audit"), x)) for x in found],
                "rows": [{"role": r, "text": t} for r, t in zip(self.roles, self.texts)]}


def _fault(text: str, duplicate: bool) -> int:
    if not BLACK.search(text):
        return BLANK
    if duplicate:
        return DUPLICATE
    return SOUND if ENDED.search(text) else TRUNCATED


def _slices(batches, schema: pa.Schema, slice_rows: int, with_rows: bool):
    """One row per slice; a conversation inside the partition and one slice is repaired already."""
    from pyspark import TaskContext
    part, out = TaskContext.get().partitionId(), []
    nothing = object()
    conv, now, number, opened, before = nothing, Slice(), 0, True, None

    def close(ends: bool) -> dict:
        whole = ends and number == 0 and not opened
        return {"conv_id": conv, "part": part, "no": number, **now.facts(), **(now.repaired(with_rows) if whole else now.table())}

    first = True
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(6))
        for c, turn, role, text, live, again in zip(*columns):
            if conv is nothing or c != conv:
                if conv is not nothing:
                    out.append(close(True))
                    first = False
                # the partition's first conversation may have begun in the partition before
                conv, now, number, opened, before = c, Slice(), 0, first, None
            elif now.full(slice_rows):
                out.append(close(False))
                now, number = Slice(), number + 1
            if live:
                now.add(turn, role, text, _fault(text, again or before == (turn, role, text)))
                before = (turn, role, text)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if conv is not nothing:
        # the partition's last conversation may go on in the next one
        yield pa.RecordBatch.from_pylist([close(False)], schema=schema)


class Derived:
    """What has been derived of a conversation up to some slice: the lightest value for each state."""

    def __init__(self):
        self.low = self.high = self.last = None
        self.turns, self.facts = 0, dict.fromkeys(FACTS, 0)
        self.items = {START: (0, "", Digest())}
        self.path: list[dict[int, int]] = []

    def add(self, row: dict) -> None:
        roles, texts = [r["role"] for r in row["rows"]], [r["text"] for r in row["rows"]]
        for name in FACTS:
            self.facts[name] += row[name]
        if self.last is not None and row["first"] is not None and self.last + row["first"] not in ALLOWED:
            self.facts["illegal"] += 1
        self.last = self.last if row["last"] is None else row["last"]
        if row["low"] is not None:
            self.turns += row["turns"] - (self.high == row["low"])
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        # two antecedents each: the item before the slice and the slice's own
        agenda = [(self.items[x["start"]][0] + x["cost"], self.items[x["start"]][1] + x["audit"], x["end"], x["start"], x["audit"])
                  for x in row["table"] if x["start"] in self.items]
        heapq.heapify(agenda)
        items, chosen = {}, {}
        while agenda:
            cost, audit, end, start, own = heapq.heappop(agenda)
            if end not in items:
                items[end] = (cost, audit, self.items[start][2].plus(applied(own, start, roles, texts)))
                chosen[end] = start
        self.items = items
        self.path.append(chosen)

    def result(self) -> dict:
        end = min((s for s in ACCEPTED if s in self.items), key=lambda s: self.items[s][:2])
        cost, audit, digest = self.items[end]
        states = [end]
        for chosen in reversed(self.path):
            states.append(chosen[states[-1]])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.facts, "cost": cost, "audit": audit, "repaired_sha256": digest.sha.hexdigest(), "states": states[::-1]}


def _fold(batches, schema: pa.Schema):
    nothing = object()
    conv, derived = nothing, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if conv is nothing or row["conv_id"] != conv:
                if conv is not nothing:
                    yield pa.RecordBatch.from_pylist([{"conv_id": conv, **derived.result()}], schema=schema)
                conv, derived = row["conv_id"], Derived()
            derived.add(row)
    if conv is not nothing:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, **derived.result()}], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


RESULT = ["gaps", *FACTS, "cost", "audit", "repaired_sha256"]


def _repaired(rows: DataFrame, scratch: Scratch, slice_rows: int, with_rows: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results of whole conversations and open slices; results of the open ones, with the states between their slices."""
    conv = rows.schema["conv_id"].dataType
    ordered = (_marked(rows).repartitionByRange("conv_id", "turn", "role", "text")
               .sortWithinPartitions("conv_id", "turn", "role", "text"))
    schema = _slice_schema(conv)
    arrow = _arrow(schema)
    slices = scratch.keep(ordered.mapInArrow(lambda b: _slices(b, arrow, slice_rows, with_rows), schema), "slices")
    folded = T.StructType([T.StructField("conv_id", conv), *[T.StructField(n, T.LongType()) for n in RESULT[:6]],
                           *[T.StructField(n, T.StringType()) for n in RESULT[6:]], T.StructField("states", T.ArrayType(T.IntegerType()))])
    folded_arrow = _arrow(folded)
    open_slices = slices.filter(~F.col("whole"))
    results = scratch.keep(open_slices.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
                           .mapInArrow(lambda b: _fold(b, folded_arrow), folded), "folded")
    return slices.filter("whole"), open_slices, results


def _whole_columns(whole: DataFrame) -> DataFrame:
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    return whole.select("conv_id", gaps.alias("gaps"), *RESULT[1:])


def repair(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per conversation of ``damaged`` or ``undamaged`` rows: ``gaps``, counts of faults, ``cost``, ``audit``, ``repaired_sha256``."""
    scratch = Scratch(rows.sparkSession, "conversations")
    whole, _, folded = _repaired(rows, scratch, slice_rows, False)
    out = stored(_whole_columns(whole).unionByName(folded.drop("states")), "conversations-repaired")
    scratch.close()
    return out


def repaired_turns(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``conv_id, part, no, place, role, text``: the turns of the repaired conversations, in order of part, no and place."""
    scratch = Scratch(rows.sparkSession, "conversations")
    whole, open_slices, folded = _repaired(rows, scratch, slice_rows, True)
    # the states between the slices say which of a slice's derivations was taken
    taken = folded.select(F.col("conv_id").alias("c"), "states")
    place = F.row_number().over(_order()) - 1
    chosen = (open_slices.withColumn("at", place).join(taken, F.col("conv_id").eqNullSafe(F.col("c")))
              .withColumn("own", F.filter("table", lambda t: (t["start"] == F.col("states")[F.col("at")])
                                          & (t["end"] == F.col("states")[F.col("at") + 1]))[0]))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                turns = applied(row["own"]["audit"], row["own"]["start"], [r["role"] for r in row["rows"]], [r["text"] for r in row["rows"]])
                yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "part": row["part"], "no": row["no"],
                                                   "rows": [{"role": r, "text": t} for r, t in turns]}], schema=arrow)
    conv = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("part", T.LongType()), T.StructField("no", T.LongType()),
                           T.StructField("rows", TURNS)])
    arrow = _arrow(schema)
    done = whole.select("conv_id", "part", "no", "rows").unionByName(
        chosen.select("conv_id", "part", "no", "rows", "own").mapInArrow(run, schema))
    out = stored(done.select("conv_id", "part", "no", F.posexplode("rows").alias("place", "turn"))
                 .select("conv_id", "part", "no", "place", "turn.role", "turn.text"), "conversations-turns")
    scratch.close()
    return out


def _order():
    from pyspark.sql import Window as W
    # one row per slice of a conversation that lies in several
    return W.partitionBy("conv_id").orderBy("part", "no")
