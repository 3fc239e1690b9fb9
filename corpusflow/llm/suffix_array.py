"""Distributed suffix sorting with a difference cover, and the least owner of every string of a given length.

The texts are segments, held by units; every suffix start belongs to a segment of some unit.  A character is ``c``
consecutive bytes, so each segment is ``c`` strings of characters, one for each offset.  Positions 1 and 2 modulo 3
of a string are its difference cover.

1.  Sampled triples, ``3 c`` bytes each, are sorted and named by their rank.
2.  The names are a shorter string, of which again positions 1 and 2 modulo 3 are sampled; its triples, ``9 c`` bytes
    or more than the length asked for, are sorted and named.
3.  Going up, the remaining suffixes are merged with the sampled ones: two suffixes are compared by one or two
    characters and the ranks of sampled suffixes behind them.
4.  In the merged order, adjacent prefixes of the length asked for are compared; each run of equal ones gets the
    least owner among its segments.

Sorting is by ranges: splitters come from a bounded sample of the texts, each unit sends its entries to the ranges as
packed arrays, each range sorts and answers in the order of the message.  A unit sends equal entries once, so a string
that stands everywhere is one entry per unit.  Ranks are exact for the length asked for; the order of suffixes that
agree further than that is arbitrary.

Memory: one unit, or one range (about ``RANGE`` entries).  The driver gets the sample (at most ``SAMPLED`` prefixes)
and one count per range.  Every exchange is stored in the shared folder, so a lost executor costs one exchange.
"""
from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch

#: Entries of a range, about.
RANGE = 1 << 19
#: Prefixes in the sample at most.
SAMPLED = 400_000
#: The last merge moves most: it is done for a part of the ranges at a time.
ROUNDS = 3

LOAD = "unit long, range long, load binary"
LOAD_ARROW = pa.schema([("unit", pa.int64()), ("range", pa.int64()), ("load", pa.binary())])
#: Range of the rows that a unit sends to itself, and unit of the rows that hold a range's count.
OWN, COUNT = -1, -1


# ---- packed arrays ----

def pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return out.getvalue()


def unpack(raw: bytes) -> list[np.ndarray]:
    source, out = io.BytesIO(raw), []
    while source.tell() < len(raw):
        out.append(np.lib.format.read_array(source, allow_pickle=False))
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers that are not negative, in the least width."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def least_bytes(a: np.ndarray, size: int) -> np.ndarray:
    """The lowest ``size`` bytes of numbers, one row each."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(len(a), 8)[:, :size])


def number(a: np.ndarray) -> np.ndarray:
    """Numbers from an array of numbers or from ``least_bytes``."""
    if a.ndim == 1:
        return a.astype(np.uint64)
    out = np.zeros((len(a), 8), np.uint8)
    out[:, :a.shape[1]] = a
    return out.view("<u8").ravel()


def rows_of(table: np.ndarray) -> np.ndarray:
    """Byte rows as fixed-width strings, which compare like the bytes."""
    return np.ascontiguousarray(table).view(f"S{table.shape[1]}").ravel()


# ---- a unit's layout ----

class Unit:
    """Segments of a unit, each followed by zero bytes so that windows may reach past its end."""

    def __init__(self, data: bytes, starts: np.ndarray, length: int, c: int):
        self.length, self.c = length, c
        pad = 12 * c + 8
        sizes = starts + (length - 1)
        raw, at = np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(sizes + pad)))
        self.text = np.zeros(int(at[-1]) + length + pad, np.uint8)
        first = at[:-1]
        inside = np.arange(len(raw)) + np.repeat(first - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes)
        self.text[inside] = raw
        #: positions that hold a byte, and their offset in the segment
        self.position, self.offset = inside, inside - np.repeat(first, sizes)
        self.left = np.repeat(starts, sizes) - self.offset  # more than zero: a suffix starts here
        self.segment = np.repeat(np.arange(len(starts)), sizes)
        third = self.offset // c % 3
        self.third, self.ninth = third, self.offset // (3 * c) % 3

    def windows(self, position: np.ndarray, width: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.text, width)[position]

    def big(self, position: np.ndarray, width: int) -> np.ndarray:
        """The ``width`` bytes from each position as one number, order kept."""
        out = np.zeros(len(position), np.uint64)
        for k in range(width):
            out = (out << np.uint64(8)) | self.text[position + k]
        return out

    def ranges(self, position: np.ndarray, splitters: np.ndarray, width: int) -> np.ndarray:
        """Number of splitters (rows of bytes) that are not above the first ``width`` bytes from each position."""
        if not len(splitters):
            return np.zeros(len(position), np.int64)
        cut = splitters[:, :width]
        head = np.zeros(len(cut), np.uint64)
        for k in range(8):
            head = (head << np.uint64(8)) | (cut[:, k] if k < width else 0)
        own = self.big(position, min(8, width)) << np.uint64(8 * max(0, 8 - width))
        out, low = np.searchsorted(head, own, "right"), np.searchsorted(head, own, "left")
        unsure = np.flatnonzero(out != low)
        for k in range(0, len(unsure), 1 << 18):
            part = unsure[k:k + (1 << 18)]
            out[part] = np.searchsorted(rows_of(cut), rows_of(self.windows(position[part], width)), "right")
        return out

    def spread(self, position: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Values by position; zero elsewhere, which is below every name and rank."""
        out = np.zeros(len(self.text), np.int64)
        out[position] = value
        return out


# ---- exchange between units and ranges ----

def _by_range(unit: int, part: np.ndarray, loads) -> list[dict]:
    """Messages of a unit: ``loads(indices)`` packs the entries of one range, ``part`` is each entry's range."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [{"unit": unit, "range": int(part[x[0]]), "load": loads(x)} for x in np.split(order, cuts) if len(x)]


def _settled(group: pa.Table, settle) -> pa.Table:
    number = group.column("range")[0].as_py()
    if number < 0:  # what a unit keeps for itself
        return pa.table({"unit": group.column("unit"), "range": pa.array([OWN] * len(group), pa.int64()), "load": group.column("load")}, schema=LOAD_ARROW)
    group = group.sort_by("unit")
    units, loads = group.column("unit").to_pylist(), group.column("load").to_pylist()
    answers, count = settle(loads)
    return pa.table({"unit": [COUNT, *units], "range": [number] * (len(units) + 1), "load": [count.to_bytes(8, "little"), *answers]}, schema=LOAD_ARROW)


def exchange(scratch: Scratch, name: str, units: DataFrame, answers: DataFrame | None, send, settle) -> tuple[DataFrame, np.ndarray]:
    """``send(unit row, its answers)`` gives messages, ``settle`` answers those of one range.

    The answers with what units keep for themselves, and the number of entries before each range.
    """
    def sent(key, unit: pa.Table, got: pa.Table) -> pa.Table:
        if not len(unit):
            return LOAD_ARROW.empty_table()
        replies = sorted(zip(got.column("range").to_pylist(), got.column("load").to_pylist()))
        return pa.Table.from_pylist(send(unit.to_pylist()[0], replies), schema=LOAD_ARROW)

    if answers is None:
        answers = units.sparkSession.createDataFrame([], LOAD)
    messages = units.groupBy("unit").cogroup(answers.filter(F.col("unit") != COUNT).groupBy("unit")).applyInArrow(sent, LOAD)
    out = scratch.keep(messages.groupBy("range").applyInArrow(lambda g: _settled(g, settle), LOAD), name)
    counts = dict((r["range"], int.from_bytes(r["load"], "little")) for r in out.filter(F.col("unit") == COUNT).select("range", "load").collect())
    before = np.zeros(max(counts, default=0) + 2, np.int64)
    for k, n in counts.items():
        before[k + 1] = n
    return out, np.cumsum(before)


def _own(replies) -> list[np.ndarray]:
    return unpack(next(load for number, load in replies if number == OWN))


def _ranks(replies, before: np.ndarray) -> list[np.ndarray]:
    """Global ranks from 1, per range in the order of the message."""
    return [unpack(load)[0].astype(np.int64) + before[number] + 1 for number, load in replies if number >= 0]


# ---- naming ----

def _name(loads: list[bytes]) -> tuple[list[bytes], int]:
    """Dense ranks of the keys of a range."""
    tables = [unpack(x)[0] for x in loads]
    unique, inverse = np.unique(np.concatenate([rows_of(t) for t in tables]), return_inverse=True)
    cuts = np.cumsum([len(t) for t in tables])[:-1]
    return [pack(narrow(x)) for x in np.split(inverse, cuts)], len(unique)


def _send_keys(unit: int, layout: Unit, position: np.ndarray, keys: np.ndarray, splitters: np.ndarray, width: int, keep: list[np.ndarray]) -> list[dict]:
    """Each distinct key once, sorted, so that ranges are runs; what brings the names back to positions is kept."""
    unique, first, inverse = np.unique(rows_of(keys), return_index=True, return_inverse=True)
    part = layout.ranges(position[first], splitters, width)
    table = unique.view(np.uint8).reshape(len(unique), keys.shape[1])
    return [*_by_range(unit, part, lambda x: pack(table[x])), {"unit": unit, "range": -2 - unit, "load": pack(narrow(inverse), *keep)}]


# ---- merging ----

def _dense(*arrays: np.ndarray) -> list[np.ndarray]:
    """The same order in numbers below 2^32."""
    if all(int(a.max(initial=0)) < 1 << 32 for a in arrays):
        return [a.astype(np.uint64) for a in arrays]
    inverse = np.unique(np.concatenate(arrays), return_inverse=True)[1].astype(np.uint64)
    return np.split(inverse, np.cumsum([len(a) for a in arrays])[:-1])


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(32)) | b


def merge(zero: list[np.ndarray], one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
    """Places of three classes of suffixes in their common order.

    ``zero``: character, next character, rank one on, rank two on.  ``one``: own rank, character, rank one on.
    ``two``: own rank, character, next character, rank two on.
    """
    n0, n1, n2 = len(zero[0]), len(one[0]), len(two[0])
    letter0, letter1, letter2, next0, next2 = _dense(zero[0], one[1], two[1], zero[1], two[2])
    after0, after1 = _dense(zero[2], one[2])
    later0, later2 = _dense(zero[3], two[3])
    sampled = np.argsort(np.concatenate((one[0], two[0])), kind="stable")
    key0 = _pairs(letter0, after0)
    order = np.argsort(key0, kind="stable")
    # against class one: character and rank of the next; the classes' own ranks put them in this order already,
    # but for suffixes that agree further than ranks tell
    from_one = sampled[sampled < n1]
    before_one = np.searchsorted(np.maximum.accumulate(_pairs(letter1, after1)[from_one]) if n1 else np.empty(0, np.uint64), key0[order])
    # against class two: two characters and the rank behind them
    couple0, couple2 = _dense(*np.split(np.unique(np.concatenate((_pairs(letter0, next0), _pairs(letter2, next2))), return_inverse=True)[1], [n0]))
    from_two = sampled[sampled >= n1] - n1
    key2 = np.maximum.accumulate(_pairs(couple2, later2)[from_two]) if n2 else np.empty(0, np.uint64)
    before_two = np.searchsorted(key2, _pairs(couple0, later0)[order])
    place0 = np.empty(n0, np.int64)
    place0[order] = np.arange(n0) + before_one + (np.maximum.accumulate(before_two) if n0 else before_two)
    free = np.ones(n0 + n1 + n2, bool)
    free[place0] = False
    place12 = np.empty(n1 + n2, np.int64)
    place12[sampled] = np.flatnonzero(free)
    return [place0, place12[:n1], place12[n1:]]


def _gather(loads: list[bytes]) -> tuple[list[list[np.ndarray]], list[list[int]]]:
    """The fields of the three classes over all messages of a range, and the entries of each message and class."""
    messages = [unpack(x) for x in loads]
    fields, sizes, at = [], [], 0
    for count in (4, 3, 4):
        fields.append([np.concatenate([number(m[at + k]) for m in messages]) for k in range(count)])
        sizes.append([len(m[at]) for m in messages])
        at += count
    return fields, sizes


def _back(places: list[np.ndarray], sizes: list[list[int]]) -> list[list[np.ndarray]]:
    """Values of the three classes back in the order of the messages: per message, class after class."""
    split = [np.split(p, np.cumsum(s)[:-1]) for p, s in zip(places, sizes)]
    return [[c[k] for c in split] for k in range(len(sizes[0]))]


def _merge_ranks(loads: list[bytes]) -> tuple[list[bytes], int]:
    fields, sizes = _gather(loads)
    places = merge(*fields)
    return [pack(narrow(np.concatenate(x))) for x in _back(places, sizes)], sum(len(p) for p in places)


def _least_owners(loads: list[bytes]) -> tuple[list[bytes], int]:
    """Merge, compare adjacent prefixes and answer where a prefix has an owner below the entry's own."""
    fields, sizes = _gather(loads)
    places = merge(*fields)
    place = np.concatenate([np.concatenate(x) for x in _back(places, sizes)])
    tails = [unpack(x)[11:] for x in loads]
    prefix, owner = np.concatenate([number(t[0]) for t in tails]), np.concatenate([t[2][t[1]] for t in tails])
    order = np.empty(len(place), np.int64)
    order[place] = np.arange(len(place))
    same = prefix[order][1:] == prefix[order][:-1]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), ~same)))
    least = np.minimum.reduceat(owner[order], first) if len(order) else owner
    found = np.empty(len(order), np.int64)
    found[order] = np.repeat(least, np.diff(np.concatenate((first, [len(order)]))))
    out, at = [], 0
    for k in range(len(loads)):
        n = sum(s[k] for s in sizes)
        lower = found[at:at + n] < owner[at:at + n]
        out.append(pack(np.packbits(lower), found[at:at + n][lower]))
        at += n
    return out, len(place)


# ---- the algorithm ----

def character(length: int) -> int:
    """Bytes of a character: two levels of triples cover nine of them."""
    c = -(-length // 9)
    if not 1 <= c <= 7:
        raise ValueError("strings of 2 to 63 bytes")
    return c


def splitters_of(units: DataFrame, n_units: int, ranges: int, length: int) -> np.ndarray:
    """``ranges - 1`` prefixes that cut the suffixes into about equal ranges."""
    each = max(2, min(64, SAMPLED // ranges) * ranges // max(1, n_units))

    def some(batches):
        for batch in batches:
            for row in batch.to_pylist():
                layout = Unit(row["data"], np.frombuffer(row["starts"], np.int64), length, character(length))
                here = layout.position[layout.left > 0]
                rng = np.random.default_rng(row["unit"] & (1 << 62) - 1)
                chosen = here[rng.integers(0, len(here), min(each, len(here)))]
                yield pa.RecordBatch.from_pydict({"load": [x.tobytes() for x in layout.windows(chosen, length)]}, schema=pa.schema([("load", pa.binary())]))
    sample = sorted(r.load for r in units.mapInArrow(some, "load binary").collect())
    chosen = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []
    return np.frombuffer(b"".join(chosen), np.uint8).reshape(len(chosen), length)


def _prefix_hash(layout: Unit, position: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the ``length`` bytes from each position."""
    out = np.zeros(len(position), np.uint64)
    for k in range(0, length, 8):
        word = layout.big(position + k, min(8, length - k))
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def least_owners(units: DataFrame, length: int, scratch: Scratch, range_size: int = RANGE) -> tuple[DataFrame, object]:
    """For every suffix start the least owner among segments that hold its first ``length`` bytes.

    ``units``: ``unit``, ``data`` (segments one after the other, each with ``length - 1`` bytes behind its last start),
    ``starts`` (number of starts per segment, int64), ``owners`` (owner per segment, int64).  The answers per unit,
    and the function that turns a unit's row and answers into an int64 array over its starts.
    """
    c = character(length)
    wide = min(length, 3 * c)
    size = units.agg(F.count(F.lit(1)).alias("n"), F.sum("n_starts").alias("starts")).first()
    ranges = max(1, -(-(size.starts or 0) // range_size))
    splitters = splitters_of(units, size.n, ranges, length)

    def layout(row: dict) -> Unit:
        return Unit(row["data"], np.frombuffer(row["starts"], np.int64), length, c)

    def sampled(u: Unit) -> np.ndarray:
        return u.third != 0

    def triples(row: dict, _) -> list[dict]:
        u = layout(row)
        at = u.position[sampled(u)]
        return _send_keys(row["unit"], u, at, u.windows(at, 3 * c), splitters, wide, [])

    first, before_names = exchange(scratch, "names", units, None, triples, _name)

    def named(u: Unit, names: np.ndarray) -> np.ndarray:
        return u.spread(u.position[sampled(u)], names)

    def triples_of_names(row: dict, replies) -> list[dict]:
        u = layout(row)
        names = np.concatenate([np.zeros(0, np.int64), *_ranks(replies, before_names)])[_own(replies)[0]]
        name = named(u, names)
        at = u.position[sampled(u) & (u.ninth != 0)]
        size = 8 if before_names[-1] >= 1 << 32 else 4
        table = np.stack([name[at], name[at + 3 * c], name[at + 6 * c]], axis=1).astype(f">u{size}")
        return _send_keys(row["unit"], u, at, table.view(np.uint8).reshape(len(at), 3 * size), splitters, length, [narrow(names)])

    second, before_triples = exchange(scratch, "triples", units, first, triples_of_names, _name)
    scratch.drop("names")

    def remaining_names(row: dict, replies) -> list[dict]:
        u = layout(row)
        inverse, names = _own(replies)
        name = named(u, names)
        ranks = np.concatenate([np.zeros(0, np.int64), *_ranks(replies, before_triples)])[inverse]
        rank = u.spread(u.position[sampled(u) & (u.ninth != 0)], ranks)
        wanted = sampled(u) & (u.left > -2 * c)
        at = [u.position[wanted & (u.ninth == k)] for k in range(3)]
        zero = np.stack([name[at[0]], name[at[0] + 3 * c], rank[at[0] + 3 * c], rank[at[0] + 6 * c]], axis=1)
        # equal entries of a unit are sent once
        _, first0, inverse0 = np.unique(rows_of(zero.astype(">u8").view(np.uint8).reshape(len(zero), 32)), return_index=True, return_inverse=True)
        _, first1, inverse1 = np.unique(rank[at[1]], return_index=True, return_inverse=True)
        _, first2, inverse2 = np.unique(rank[at[2]], return_index=True, return_inverse=True)
        p0, p1, p2 = at[0][first0], at[1][first1], at[2][first2]
        fields = [name[p0], name[p0 + 3 * c], rank[p0 + 3 * c], rank[p0 + 6 * c],
                  rank[p1], name[p1], rank[p1 + 3 * c], rank[p2], name[p2], name[p2 + 3 * c], rank[p2 + 6 * c]]
        return _send_classes(row["unit"], u, (p0, p1, p2), fields, splitters, length,
                             [narrow(inverse0), narrow(inverse1), narrow(inverse2)])

    third, before_ranks = exchange(scratch, "ranks", units, second, remaining_names, _merge_ranks)
    scratch.drop("triples")

    def suffixes(u: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts whose prefix is the unit's first of its kind, by class; of every start the number of its prefix."""
        start = np.flatnonzero(u.left > 0)
        prefix = _prefix_hash(u, u.position[start], length)
        _, first, inverse = np.unique(prefix, return_index=True, return_inverse=True)
        order = np.lexsort((first, u.third[start[first]]))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        return start[first][order], prefix[first][order], number[inverse]

    def remaining(row: dict, replies, turn: int) -> list[dict]:
        u = layout(row)
        order, inverse0, inverse1, inverse2 = _own(replies)
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.concatenate([np.zeros(0, np.int64), *_ranks(replies, before_ranks)])
        wanted = sampled(u) & (u.left > -2 * c)
        rank = np.zeros(len(u.text), np.int64)
        at = 0
        for k, inverse in enumerate((inverse0, inverse1, inverse2)):
            n = int(inverse.max()) + 1 if len(inverse) else 0
            rank[u.position[wanted & (u.ninth == k)]] = ranks[at:at + n][inverse]
            at += n
        chosen, prefix, number = suffixes(u)
        owner = np.full(len(chosen), np.iinfo(np.int64).max)
        start = np.flatnonzero(u.left > 0)
        np.minimum.at(owner, number, np.frombuffer(row["owners"], np.int64)[u.segment[start]])
        p = u.position[chosen]
        kind = u.third[chosen]
        p0, p1, p2 = p[kind == 0], p[kind == 1], p[kind == 2]
        fields = [u.big(p0, c), u.big(p0 + c, c), rank[p0 + c], rank[p0 + 2 * c], rank[p1], u.big(p1, c), rank[p1 + c],
                  rank[p2], u.big(p2, c), u.big(p2 + c, c), rank[p2 + 2 * c]]
        return _send_classes(row["unit"], u, (p0, p1, p2), fields, splitters, length, [], [prefix, owner], turn)

    last = None
    for turn in range(ROUNDS):
        some, _ = exchange(scratch, f"owners{turn}", units, third, lambda row, replies, t=turn: remaining(row, replies, t), _least_owners)
        last = some if last is None else last.unionByName(some)
    scratch.drop("ranks")

    def minima(row: dict, replies) -> np.ndarray:
        u = layout(row)
        chosen, _, number = suffixes(u)
        owners = np.frombuffer(row["owners"], np.int64)
        start = np.flatnonzero(u.left > 0)
        own = np.full(len(chosen), np.iinfo(np.int64).max)
        np.minimum.at(own, number, owners[u.segment[start]])
        part = u.ranges(u.position[chosen], splitters, length)
        order, entries = np.argsort(part, kind="stable"), np.bincount(part, minlength=ranges)
        ordered, at = own[order], 0
        for k, load in replies:
            if k < 0:
                continue
            bits, values = unpack(load)
            n = int(entries[k])
            lower = np.unpackbits(bits)[:n].astype(bool)
            ordered[at:at + n][lower] = values
            at += n
        own[order] = ordered
        return own[number]

    return last, minima


def _short(a: np.ndarray) -> np.ndarray:
    """Numbers in the least width; those of five to seven bytes as bytes."""
    top = int(a.max(initial=0))
    return narrow(a) if top < 1 << 32 or top >= 1 << 56 else least_bytes(a, (top.bit_length() + 7) // 8)


def _send_classes(unit: int, u: Unit, at: tuple, fields: list[np.ndarray], splitters: np.ndarray, length: int,
                  keep: list[np.ndarray], tails: list[np.ndarray] = (), turn: int | None = None) -> list[dict]:
    """Messages with the fields of each class, then prefix and owner over all classes; kept: the order of entries.

    ``turn``: only for ranges of that round.
    """
    sizes = [len(p) for p in at]
    bounds = np.cumsum([0, *sizes])
    part = u.ranges(np.concatenate(at), splitters, length)
    counts = (4, 3, 4)

    def load(x: np.ndarray) -> bytes:
        own, k = [], 0
        for cls, count in enumerate(counts):
            inside = x[(x >= bounds[cls]) & (x < bounds[cls + 1])] - bounds[cls]
            own += [_short(fields[k + j][inside]) for j in range(count)]
            k += count
        if not tails:
            return pack(*own)
        # few owners in a message: a table of them and a number per entry
        names, name = np.unique(tails[1][x], return_inverse=True)
        return pack(*own, least_bytes(tails[0][x], 6), narrow(name), names)
    if turn is not None:
        mine = np.flatnonzero(part % ROUNDS == turn)
        return _by_range(unit, part[mine], lambda x: load(mine[x]))
    order = np.argsort(part, kind="stable")
    return [*_by_range(unit, part, load), {"unit": unit, "range": -2 - unit, "load": pack(narrow(order), *keep)}]
