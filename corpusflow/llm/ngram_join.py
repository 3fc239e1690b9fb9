"""Documents whose word n-gram sets have a Jaccard similarity of a threshold or more.

Sets of equal hashes are one class from the start, so exact copies are never paired.  Classes meet
in size bands: with threshold t a linked pair has sizes within a factor 1/t, so it lies in one band
or in two neighbours.  For the larger set's band, t bounds the number k of n-grams that the two sets
do not share.  Both are dealt by hash into k + 1 + e parts; a linked pair then has 1 + e parts exactly
alike.  Every part that is not empty is a key (a set with more than e empty parts also gives those),
so a linked pair always has keys in common, and each of the two has at least 1 + e keys, less its empty
parts, that some other class has too.  Classes with fewer are linked with nothing, and their keys count no
more, which may leave others with too few: keys are counted in packed messages to hash ranges, answered with
one bit each, until few more fall away.  Only then do the keys left join classes to groups.  Nothing is
emitted per pair.

A group is cut into size-ordered tiles of bounded total size, and only pairs of tiles whose sizes can
link are compared.  In a pair of tiles each set has a hashed bitmap, one bit per n-gram, bits toggled.
Differing bits cannot outnumber the n-grams not shared, so their count bounds the overlap from above.
A first round compares the bitmaps alone, which are small, and splits groups that no possible link holds
together; in the second, pairs that pass, and are not yet connected inside the task, are decided by
intersecting the sorted arrays.  Tasks return a spanning forest of the links they find; components of those forests are the
result, the same as components of all links.

N-grams are 64-bit hashes; classes are told apart by 128 bits of their sets.

Defined results
  NULL, empty texts and texts without words have no n-grams, are linked with nothing and form their
  own component (NULL id: NULL).  Fewer than n words: the whole sequence is the one n-gram.
  Equal sets have similarity 1.  Rows of one id are one document in the result's numbering, but each
  row is judged.  Ties and order of rows do not matter: a component's id is its smallest document id.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.slices import running_sum
from .common import BLACK, Scratch, folded, maybe_listed, slices, stored, take_worker
from .components import components
from .suffix_array import exchange, narrow, pack, unpack

#: N-grams of a tile at most, unless a single set has more; two tiles are one task's memory.
TILE = 1_000_000
#: Times as much in tiles of bitmaps alone.
MARKED = 4
#: Text characters hashed at once.
HASHED_CHARS = 1_000_000
#: Counting goes on while this share of the keys falls away.
FALLING = 0.1

_M64 = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all lines, and the number of words before each line (one more than lines)."""
    raw = b" ".join([b"", *lines, b""])
    text = np.frombuffer(raw, np.uint8)
    edges = np.diff((text != 0x20).view(np.int8))
    first, last = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * _powers(_BASE, len(text)), dtype=np.uint64)))
    value = (prefix[last] - prefix[first]) * _powers(_INVERSE, len(text))[first]
    starts = 1 + np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines]))).astype(np.int64)
    return _mix(value + (last - first).astype(np.uint64)), np.searchsorted(first, starts)


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    out = []
    for start, stop in slices(texts, HASHED_CHARS):
        words, cuts = word_hashes([folded(t, BLACK) for t in texts[start:stop]])
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for j in range(n):
            grams += words[j:j + len(grams)] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & _M64)
        grams = _mix(grams)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(grams[a:b - n + 1]))
            elif b > a:
                few = hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest()
                out.append(np.frombuffer(few, np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


class Bands:
    """Size bands and part schemes for a threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.high = [1], [max(1, den * den // (num * num))]

    def reach(self, size: int) -> None:
        while self.high[-1] < size:
            low = self.high[-1] + 1
            self.low.append(low)
            self.high.append(max(low, low * self.den * self.den // (self.num * self.num)))

    def unshared(self, sizes: int) -> int:
        """Most n-grams that two linked sets of this total size do not share."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def schemes(self, size: int) -> list[tuple[int, int, int]]:
        """``scheme, parts, spare`` of the bands in which a set of this size can meet others."""
        self.reach(size * self.den // self.num + 1)
        band = int(np.searchsorted(self.high, size))
        found = [band]
        if size * self.den // self.num > self.high[band]:
            found.append(band + 1)
        out = []
        for b in found:
            k = self.unshared(2 * self.high[b])
            spare = 2 + k // 8
            out.append((b, k + 1 + spare, spare))
        return out


def part_keys(grams: np.ndarray, bands: Bands) -> tuple[np.ndarray, int]:
    """Keys of a set, as signed 64-bit, and the fewest of them that it has in common with any set it is linked to."""
    keys, need = [], []
    second, third = _mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), _mix(grams + np.uint64(0x632BE59BD9B4E019))
    for scheme, parts, spare in bands.schemes(len(grams)):
        part = (second % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, third)
        count = np.bincount(part, minlength=parts)
        tag = np.arange(parts, dtype=np.uint64) + np.uint64(scheme << 40)
        key = _mix(sums ^ _mix(tag * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64)))
        full = count > 0
        empty = int(parts - full.sum())
        keys.append(key if empty > spare else key[full])
        # 1 + spare parts are alike, of which at most the empty ones give no key
        need.append(max(1, 1 + spare - empty))
    return np.concatenate(keys).view(np.int64), min(need)


CLASSES = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("key", T.BinaryType()), T.StructField("node", T.LongType()),
                        T.StructField("unit", T.LongType()), T.StructField("load", T.BinaryType())])
SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType()),
                     T.StructField("n", T.LongType()), T.StructField("grams", T.BinaryType())])
LINKS = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])


def set_key(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _read_sets(batches, n: int):
    for whole in batches:
        for start, stop in slices(whole.column("text")):
            yield whole.column("id").slice(start, stop - start), ngram_sets(whole.column("text").slice(start, stop - start).to_pylist(), n)


def _classes(batches, n: int, num: int, den: int):
    """A row per document, and a row per slice of text with the keys of its classes."""
    from pyspark import TaskContext
    take_worker("n-gram join")
    bands, seen, unit = Bands(num, den), set(), TaskContext.get().partitionId() << 32
    arrow = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("node", pa.int64()), ("unit", pa.int64()), ("load", pa.binary())])
    for ids, sets in _read_sets(batches, n):
        keys = [set_key(s) for s in sets]
        nodes = [int.from_bytes(k[:8], "little", signed=True) if k else None for k in keys]
        nothing = pa.nulls(len(sets))
        yield pa.RecordBatch.from_arrays([
            ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64()),
            nothing.cast(pa.int64()), nothing.cast(pa.binary())], schema=arrow)
        own, parts, need = [], [], []
        for key, node, s in zip(keys, nodes, sets):
            # a set gives its keys once in a task: copies are combined before anything is sent
            if len(s) and key not in seen:
                seen.add(key)
                found, least = part_keys(s, bands)
                own.append(node)
                parts.append(found)
                need.append(least)
        if own:
            load = pack(np.array(own, np.int64), narrow(np.array(need)), narrow(np.array([len(p) for p in parts])), np.concatenate(parts))
            yield pa.RecordBatch.from_pylist([{"unit": unit, "load": load}], schema=arrow)
            unit += 1


def _sets(batches, n: int):
    take_worker("n-gram join")
    for ids, sets in _read_sets(batches, n):
        yield pa.RecordBatch.from_arrays([
            ids, pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([s.tobytes() for s in sets], pa.binary())], names=SETS.names)


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Toggled bits of one set, about two to four for an n-gram."""
    bits = max(64, 1 << (2 * len(grams) - 1).bit_length())
    toggled = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(toggled.astype(np.uint8), bitorder="little").view(np.uint64)


def _marks(batches, n: int):
    take_worker("n-gram join")
    for ids, sets in _read_sets(batches, n):
        yield pa.RecordBatch.from_arrays([
            ids, pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary())], names=SETS.names)


def compare_marks(sizes: np.ndarray, marks: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that the bitmaps do not rule out, of sets ordered by size (so also by bits)."""
    words = np.array([len(m) for m in marks])
    first = {w: int(np.searchsorted(words, w)) for w in np.unique(words).tolist()}
    tables = {(w, w): np.stack(marks[a:a + int((words == w).sum())]) for w, a in first.items()}

    def table(w: int, to: int) -> np.ndarray:
        # halves of toggled bits fold onto each other
        if (w, to) not in tables:
            wide = table(w, 2 * to)
            tables[w, to] = wide[:, :to] ^ wide[:, to:]
        return tables[w, to]

    label, forest, crossing = np.arange(len(sizes)), [], len(np.unique(side)) > 1
    for i in range(len(sizes) - 1):
        rest = np.arange(i + 1, np.searchsorted(sizes, sizes[i] * den // num, "right"))
        rest = rest[label[rest] != label[i]]
        if crossing:
            rest = rest[side[rest] != side[i]]
        for w in np.unique(words[rest]).tolist():
            part = rest[words[rest] == w]
            apart = np.bitwise_count(table(w, int(words[i]))[part - first[w]] ^ marks[i]).sum(axis=1, dtype=np.int64)
            total = sizes[part] + sizes[i]
            for j in part[den * (total - apart) >= num * (total + apart)].tolist():
                if label[j] != label[i]:
                    forest.append((i, j))
                    label[label == label[j]] = label[i]
    return forest


def _compare_marks_of(group: pa.Table, num: int, den: int) -> pa.Table:
    found = {k: (n, g, s) for k, n, g, s in zip(*(group.column(c).to_pylist() for c in ("key", "n", "grams", "side")))}
    keys = sorted(found, key=lambda k: (found[k][0], k))
    forest = compare_marks(np.array([found[k][0] for k in keys], np.int64), [np.frombuffer(found[k][1], np.uint64) for k in keys],
                           np.array([found[k][2] for k in keys]), num, den)
    return pa.table({"u": pa.array([keys[i] for i, _ in forest], pa.binary()), "v": pa.array([keys[j] for _, j in forest], pa.binary())})


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    bits = max(64, 1 << (2 * max(map(len, sets)) - 1).bit_length())
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        toggled = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(toggled.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def compare(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between sets ordered by size; ``side`` 0 or 1: only pairs of different
    sides count, where both occur."""
    sizes = np.array([len(s) for s in sets], np.int64)
    marks, label = _bitmaps(sets), np.arange(len(sets))
    crossing = len(np.unique(side)) > 1
    forest = []
    for i in range(len(sets) - 1):
        stop = np.searchsorted(sizes, sizes[i] * den // num, "right")
        rest = np.arange(i + 1, stop)
        rest = rest[label[rest] != label[i]]
        if crossing:
            rest = rest[side[rest] != side[i]]
        if not len(rest):
            continue
        apart = np.bitwise_count(marks[rest] ^ marks[i]).sum(axis=1, dtype=np.int64)
        total = sizes[rest] + sizes[i]
        # overlap <= (total - apart) / 2 from above
        for j in rest[den * (total - apart) >= num * (total + apart)].tolist():
            if label[j] == label[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * common >= num * (sizes[i] + sizes[j] - common):
                forest.append((i, j))
                label[label == label[j]] = label[i]
    return forest


def _compare_group(group: pa.Table, num: int, den: int) -> pa.Table:
    found: dict[bytes, tuple[np.ndarray, int]] = {}
    for key, grams, side in zip(group.column("key").to_pylist(), group.column("grams").to_pylist(), group.column("side").to_pylist()):
        found[key] = (np.frombuffer(grams, np.uint64), side)
    keys = sorted(found, key=lambda k: (len(found[k][0]), k))
    forest = compare([found[k][0] for k in keys], np.array([found[k][1] for k in keys]), num, den)
    return pa.table({"u": pa.array([keys[i] for i, _ in forest], pa.binary()),
                     "v": pa.array([keys[j] for _, j in forest], pa.binary())})


class Keys:
    """Keys of a unit's classes; those still counted are marked."""

    def __init__(self, row: dict, ranges: int):
        self.nodes, self.need, counts, self.keys = unpack(row["load"])
        self.owner = np.repeat(np.arange(len(self.nodes)), counts)
        self.ranges = ranges

    def part(self, hashed: np.ndarray) -> np.ndarray:
        return ((hashed >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)

    def hashed(self, which: np.ndarray) -> np.ndarray:
        return _mix(self.keys[which].view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))

    def in_ranges(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the messages, and the number of entries for each range."""
        part = self.part(hashed)
        return np.argsort(part, kind="stable"), np.bincount(part, minlength=self.ranges)

    def answered(self, hashed: np.ndarray, replies) -> np.ndarray:
        order, sizes = self.in_ranges(hashed)
        flags = [np.unpackbits(np.frombuffer(load, np.uint8))[:sizes[k]] for k, load in replies if k >= 0]
        out = np.zeros(len(hashed), bool)
        out[order] = np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)
        return out


def _messages(unit: int, keys: Keys, hashed: np.ndarray, keep: list[np.ndarray]) -> list[dict]:
    order, sizes = keys.in_ranges(hashed)
    six = np.ascontiguousarray(hashed[order].astype("<u8").view(np.uint8).reshape(len(order), 8)[:, :6])
    ends = np.cumsum(sizes)
    return [*({"unit": unit, "range": k, "load": six[ends[k] - sizes[k]:ends[k]].tobytes()} for k in np.flatnonzero(sizes).tolist()),
            {"unit": unit, "range": -2 - unit, "load": pack(*keep)}]


def _unpacked(loads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    table = np.zeros((sum(map(len, loads)) // 6, 8), np.uint8)
    table[:, :6] = np.frombuffer(b"".join(loads), np.uint8).reshape(-1, 6)
    return table.view("<u8").ravel(), np.cumsum([len(x) // 6 for x in loads])[:-1]


def _first_of_each(loads: list[bytes]) -> tuple[list[bytes], int]:
    nodes, cuts = np.frombuffer(b"".join(loads), np.int64), np.cumsum([len(x) // 8 for x in loads])[:-1]
    first = np.zeros(len(nodes), bool)
    first[np.unique(nodes, return_index=True)[1]] = True
    return [np.packbits(x).tobytes() for x in np.split(first, cuts)], 0


def _seen_twice(loads: list[bytes]) -> tuple[list[bytes], int]:
    hashed, cuts = _unpacked(loads)
    order = np.argsort(hashed)
    same = hashed[order][1:] == hashed[order][:-1]
    twice = np.empty(len(hashed), bool)
    twice[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return [np.packbits(x).tobytes() for x in np.split(twice, cuts)], int(twice.sum())


def _groups(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, group``: classes connected by common keys."""
    units = classes.filter(F.col("unit").isNotNull()).select("unit", "load")
    ranges = max(1, units.count() // 4)

    def nodes(row: dict, _) -> list[dict]:
        own = Keys(row, ranges)
        order, sizes = own.in_ranges(_mix(own.nodes.view(np.uint64)))
        ends = np.cumsum(sizes)
        return [{"unit": row["unit"], "range": k, "load": own.nodes[order[ends[k] - sizes[k]:ends[k]]].tobytes()} for k in np.flatnonzero(sizes).tolist()]

    # copies of a class in several units count once
    answers, _ = exchange(scratch, "key-classes", units, None, nodes, _first_of_each)

    def counted(row: dict, replies, begin: bool) -> tuple[Keys, np.ndarray]:
        """The keys that count, after the answers."""
        own = Keys(row, ranges)
        if begin:
            first = own.answered(_mix(own.nodes.view(np.uint64)), replies)
            return own, np.flatnonzero(first[own.owner])
        (asked,) = unpack(next(load for k, load in replies if k == -1))
        asked = asked.astype(np.int64)
        shared = asked[own.answered(own.hashed(asked), replies)]
        enough = np.bincount(own.owner[shared], minlength=len(own.nodes)) >= own.need
        return own, shared[enough[own.owner[shared]]]

    def keys(row: dict, replies, begin: bool) -> list[dict]:
        own, which = counted(row, replies, begin)
        return _messages(row["unit"], own, own.hashed(which), [narrow(which)])

    total, turn = None, 0
    while True:
        before, turn = total, turn + 1
        answers, counts = exchange(scratch, f"keys{turn % 2}", units, answers, lambda row, r, t=turn: keys(row, r, t == 1), _seen_twice)
        total = int(counts[-1])
        if not total or before is not None and total > (1 - FALLING) * before:
            break

    def left(key, unit: pa.Table, got: pa.Table) -> pa.Table:
        own, which = counted(unit.to_pylist()[0], sorted(zip(got.column("range").to_pylist(), got.column("load").to_pylist())), False)
        return pa.table({"part": pa.array(own.keys[which]), "node": pa.array(own.nodes[own.owner[which]])})

    rest = scratch.keep(units.groupBy("unit").cogroup(answers.filter(F.col("unit") >= 0).groupBy("unit")).applyInArrow(left, "part long, node long"), "keys")
    scratch.drop("key-classes", "keys1", *(["keys0"] if turn > 1 else []))
    least = rest.groupBy(F.struct("part").alias("k")).agg(F.min("node").alias("least"), F.max("node").alias("most")).filter(F.col("least") != F.col("most"))
    edges = rest.join(least.select(F.col("k.part").alias("part"), "least"), "part").select(F.col("least").alias("u"), F.col("node").alias("v"))
    groups = components(edges, scratch, "groups").select("node", F.col("root").alias("group"))
    scratch.drop("keys")
    return groups


def _tiles(members: DataFrame, num: int, den: int, tile: int, scratch: Scratch) -> DataFrame:
    """``key, id, task, side``: each class with the tile pairs it takes part in."""
    total = members.groupBy("group").agg(F.sum("weight").alias("total"))
    members = scratch.keep(members.join(total, "group"), "members")
    small = members.filter(F.col("total") <= tile).select(
        "key", "id", F.struct("group", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("task"), F.lit(0).alias("side"))
    big = members.filter(F.col("total") > tile)
    if big.isEmpty():
        return small
    placed = scratch.keep(running_sum(big, ["group"], ["n", "key"], "weight", "upto")
                          .withColumn("tile", F.floor((F.col("upto") - F.col("weight")) / tile)), "placed")
    spans = placed.groupBy("group", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = spans.select("group", F.col("tile").alias("a"), F.col("high").alias("a_high"))
    right = spans.select(F.col("group").alias("g"), F.col("tile").alias("b"), F.col("low").alias("b_low"))
    pairs = left.join(right, (F.col("group") == F.col("g")) & (F.col("a") <= F.col("b"))
                      & (F.col("a_high") * den >= F.col("b_low") * num)).select("group", "a", "b")
    ends = pairs.select("group", F.col("a").alias("tile"), "a", "b", F.lit(0).alias("side")).union(
        pairs.filter(F.col("a") < F.col("b")).select("group", F.col("b").alias("tile"), "a", "b", F.lit(1).alias("side")))
    large = placed.join(ends, ["group", "tile"]).select("key", "id", F.struct("group", "a", "b").alias("task"), "side")
    return small.union(large)


def join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text",
         tile: int = TILE) -> DataFrame:
    """``id, n_shingles, component_id`` per document; links are similarities of ``num / den`` or more."""
    scratch = Scratch(docs.sparkSession, "ngram")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = scratch.keep(rows.mapInArrow(lambda b: _classes(b, n, num, den), CLASSES), "found")
    classes = scratch.keep(found.filter(F.col("unit").isNull()).select("id", "n", "key", "node"), "classes")
    groups = _groups(found, scratch)
    scratch.drop("found")
    least = classes.filter(F.col("n") > 0).groupBy("key").agg(
        F.min("id").alias("id"), F.first("node").alias("node"), F.first("n").alias("n"))
    members = least.join(groups, "node").select("key", "id", "n", "group", (F.col("n") + 64).alias("weight"))
    # first the bitmaps alone, a twentieth of the sets: groups that only chance keys tie fall apart
    tiles = scratch.keep(_tiles(members, num, den, MARKED * tile, scratch), "tiles")
    marks = _wanted(rows, tiles).mapInArrow(lambda b: _marks(b, n), SETS)
    possible = (marks.select("key", "n", "grams").join(tiles.select("key", "task", "side"), "key")
                .groupBy("task").applyInArrow(lambda t: _compare_marks_of(t, num, den), LINKS))
    close = components(possible, scratch, "close").select(F.col("node").alias("key"), F.col("root").alias("group"))
    members = least.join(close, "key").select("key", "id", "n", "group", (F.col("n") + 64).alias("weight"))
    tiles = scratch.keep(_tiles(members, num, den, tile, scratch), "tiles")
    sets = _wanted(rows, tiles).mapInArrow(lambda b: _sets(b, n), SETS).select("key", "grams")
    links = (sets.join(tiles.select("key", "task", "side"), "key")
             .groupBy("task").applyInArrow(lambda t: _compare_group(t, num, den), LINKS))
    roots = components(links, scratch, "roots")
    ids = least.select("key", "id").join(roots.withColumnRenamed("node", "key"), "key", "left")
    ids = scratch.keep(ids.select("key", "id", F.coalesce("root", "key").alias("root")), "ids")
    smallest = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    named = ids.join(smallest, "root").select("key", "component_id")
    out = stored(classes.select("id", "n", "key").join(named, "key", "left")
                 .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                         F.coalesce("component_id", "id").alias("component_id")), "ngram-components")
    scratch.close()
    return out


def _wanted(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """The documents that take part in some tile; of the others few texts move."""
    ids = tiles.select(F.col("id").alias("wanted")).distinct()
    near = maybe_listed(rows, ids.withColumnRenamed("wanted", "id"), ["id"], "maybe").filter("maybe").drop("maybe")
    return near.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")


def keep_one(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are linked, directly or through others, to one of a smaller id.

    Rows of one id stay or go together; they go only if each of them is linked to a smaller id.  Texts that a filter of
    fixed size shows to stay are not moved.
    """
    judged = join(docs, n, num, den, id_col, text_col)
    drop = stored(judged.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col("component_id") < F.col(id_col)).alias("goes"))
                  .filter("goes").select("id"), "near-copies")
    # all columns travel as one, so that no name can clash
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("id"))
    flagged = maybe_listed(whole, drop, ["id"], "maybe")
    met = flagged.filter("maybe").join(drop.hint("merge"), "id", "left_anti")
    return flagged.filter(~F.col("maybe")).select("doc").unionAll(met.select("doc")).select("doc.*")
