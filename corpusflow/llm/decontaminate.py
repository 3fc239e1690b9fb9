"""Benchmark decontamination with one Aho-Corasick automaton.

Every run of ``n`` consecutive words of a benchmark item (question and answer text, folded) is a
pattern; an item of fewer words, but not none, is one pattern.  Patterns carry a space at each end,
so that they match at word borders only.  Documents are folded the same way and scanned once; word
positions map back to character offsets of the original text.

The benchmark is not assumed to be small: it is cut into blocks of ``BLOCK_BYTES`` of text by a hash
of its rows.  Each block is one automaton, broadcast as text and built once per Python worker.  A
benchmark of one block, the usual case, is one automaton and one narrow pass over the documents;
with more blocks the documents are stored between passes, so that a worker holds one automaton.

Defined results
  NULL and empty texts have no words and no hits.  Items without words give no pattern.
  Items with equal ids count once; an item without an id marks words but is not listed.
  Very long texts are scanned whole.  Repeated rows are judged each.  An empty table gives no rows.
  Columns of the documents with the names of the results are replaced.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import add_columns, folded, packed, slices, stored, take_worker, unpacked, with_columns

WINDOW = 10
#: Benchmark text per automaton; at about 3 KB of automaton per word, some 200 MB.
BLOCK_BYTES = 400_000

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.LongType())),
                     T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(SPAN))])

#: block id -> automaton, one per Python worker
_BUILT: dict = {}


def patterns(items: list[tuple[str | None, str | None]], n: int) -> dict[str, tuple[int, set]]:
    """Pattern text -> number of words, ids of the items that have it."""
    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = folded(text).split()
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            key = (b" " + b" ".join(words[i:i + size]) + b" ").decode("latin-1")
            found.setdefault(key, (size, set()))[1].update([item] if item is not None else [])
    return found


def _automaton(key: str, items: list, n: int):
    if key not in _BUILT:
        import ahocorasick
        _BUILT.clear()
        tree = ahocorasick.Automaton()
        for text, value in patterns(items, n).items():
            tree.add_word(text, value)
        if len(tree):
            tree.make_automaton()
        _BUILT[key] = tree
    return _BUILT[key]


def _word_offsets(text: str, raw: bytes, words: np.ndarray) -> list[dict]:
    """Character spans in ``text`` of runs of consecutive ``words`` (sorted word numbers)."""
    solid = np.frombuffer(raw, np.uint8) != 0x20
    edges = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    chars = np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)
    chars = np.concatenate(([0], chars))
    breaks = np.flatnonzero(np.diff(words) > 1)
    starts, ends = words[np.concatenate(([0], breaks + 1))], words[np.concatenate((breaks, [len(words) - 1]))]
    return [{"start": int(chars[first[a]]), "end": int(chars[last[b]])} for a, b in zip(starts, ends)]


def scan_text(text: str | None, tree) -> tuple[int, np.ndarray, set]:
    """Number of words, sorted numbers of the words inside a match, ids of the items that occur."""
    words = folded(text).split()
    if not words or not len(tree):
        return len(words), np.empty(0, np.int64), set()
    line = b" " + b" ".join(words) + b" "
    ends, sizes, items = [], [], set()
    for end, (size, ids) in tree.iter(line.decode("latin-1")):
        ends.append(end)
        sizes.append(size)
        items |= ids
    if not ends:
        return len(words), np.empty(0, np.int64), set()
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    stop = np.searchsorted(spaces, ends)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, stop - np.asarray(sizes), 1)
    np.add.at(change, stop, -1)
    return len(words), np.flatnonzero(np.cumsum(change)[:-1] > 0), items


def _scan_block(docs: DataFrame, text_col: str, key: str, block, n: int, schema: T.StructType, merge: bool) -> DataFrame:
    kind = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()),
            pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches):
        take_worker("decontamination")
        tree = _automaton(key, block.value, n)
        for whole in batches:
            for start, stop in slices(whole.column(text_col)):
                batch = whole.slice(start, stop - start)
                texts = batch.column(text_col).to_pylist()
                before = [(batch.column("hit_words").to_pylist(), batch.column("items").to_pylist())] if merge else []
                out = [[], [], [], []]
                for i, text in enumerate(texts):
                    count, hits, items = scan_text(text, tree)
                    for words, ids in before:
                        hits = np.union1d(hits, np.asarray(words[i], np.int64))
                        items = items | set(ids[i])
                    out[0].append(count)
                    out[1].append(hits.tolist())
                    out[2].append(sorted(items))
                    out[3].append(_word_offsets(text, folded(text), hits.astype(np.int64)) if len(hits) else [])
                yield add_columns(batch, {f.name: pa.array(v, k) for f, v, k in zip(HITS, out, kind)})
    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", id_col: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (numbers from 0), ``items`` (ids as sorted strings) and
    ``spans`` (character offsets of the hit runs in the original text)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    schema = with_columns(docs.schema, HITS)
    context = docs.sparkSession.sparkContext
    for b in range(blocks):
        rows = [(r.i, r.t) for r in items.filter(F.col("b") == b).collect()]
        key = hashlib.sha256(repr((n, sorted(map(repr, rows)))).encode()).hexdigest()
        docs = _scan_block(docs, text_col, key, context.broadcast(rows), n, schema, b > 0)
        if b < blocks - 1:
            docs = stored(docs, "scanned")
    return docs


def report(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and the digest of the item list, one row per document."""
    hits = F.size("hit_words").cast("long")
    return scanned.select(
        F.col(doc_id), "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents that share no window with the benchmark, with their own columns."""
    scanned = scan(packed(docs, text_col), benchmark, n)
    return unpacked(scanned.filter(F.size("hit_words") == 0), docs, text_col)
