"""Token-id files: all ids one after the other, document boundaries in Elias-Fano code.

A part file holds::

    magic, version, bytes per id, number of documents without an id column value
    the ids of all its documents, little-endian, 2 bytes each where the vocabulary allows it, else 4
    Elias-Fano: the documents' boundaries (one more than documents, the first is 0)
    Elias-Fano: the documents' ids, ascending
    footer: byte positions of both sequences, number of ids, magic

Documents are range-partitioned on their id, so the parts in order hold the ids ascending.  Each task
streams one part: its memory is one slice of text, the boundaries of its part and the worker's
dictionary.  A part is written under a name of its attempt and renamed when complete, so a repeated
or speculative task never leaves half a part under the final name.  The manifest has one row per
part; the start of a part among all ids is a running sum over the manifest.

Defined results
  NULL counts as the empty text, which has the end id alone.  Documents without an id come first.
  Equal ids keep one entry per row.  Very long texts are whole.  An empty table gives no part with documents.
"""
from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import elias_fano
from .common import file_system, shared_folder, slices, stored, take_worker

MAGIC = b"TOKPART1"
HEAD = struct.Struct("<8sIIQ")
FOOT = struct.Struct("<QQQ8s")
END_ID = 1
#: Words a worker keeps encoded.
KEPT = 1_200_000
#: Words of letters given to the library as one text.
TOGETHER = 1_000

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("part", T.LongType()),
                         T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: A full stop or comma beside another mark: only there does white space around it change a token.
BESIDE = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))")
#: White space to Python, not to the vocabulary.
CONTROLS = "\x1c\x1d\x1e\x1f"


class WordEncoder:
    """The tokenizers library behind a bounded dictionary of words.

    The vocabulary normalises characters one by one and never makes a token across white space, so a
    text's ids are those of its words.  New words go to the library once.  Words of letters are one
    piece each, whose last token is marked as a word end: many go to the library as one text, and
    the marks part the ids again.  Texts with characters that Python and the vocabulary do not both
    call white space go to the library whole.
    """

    def __init__(self, path: str, kept: int = KEPT):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        size = max(vocab.values(), default=0) + 1
        self.width = "<u2" if size <= 65536 else "<u4"
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kept = kept
        self.words: dict[str, bytes] = {}

    @staticmethod
    def split(text: str) -> list[str]:
        """Words that encode one by one as the text does; those of Latin-1 texts are lower-cased and
        parted from stops and commas first, which makes far fewer of them new."""
        if "<|" in text:  # may be a special token, which has one spelling
            return text.split()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        text = text.lower()
        if not BESIDE.search(text):
            text = text.replace(",", " , ").replace(".", " . ")
        return text.split()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only."""
        out = []
        for k in range(0, len(words), TOGETHER):
            part = words[k:k + TOGETHER]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.width)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                out += self._whole(part)
                continue
            raw, cuts = ids.tobytes(), (stops * ids.itemsize).tolist()
            out += [raw[a:b] for a, b in zip([0] + cuts[:-1], cuts)]
        return out

    def learn(self, lists: list[list[str]]) -> None:
        if len(self.words) > self.kept:
            self.words = {}
        new = set().union(*lists) - self.words.keys()
        plain = [w for w in new if w.isalpha()]
        rest = [w for w in new if not w.isalpha()]
        self.words.update(zip(plain, self._together(plain)))
        self.words.update(zip(rest, self._whole(rest)))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes, without the end id."""
        texts = [t or "" for t in texts]
        odd = [i for i, t in enumerate(texts) if any(c in t for c in CONTROLS)]
        lists = [self.split(t) for t in texts]
        for i in odd:
            lists[i] = []
        self.learn(lists)
        out = [b"".join(map(self.words.__getitem__, words)) for words in lists]
        for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = ids
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _forget() -> None:
    for enc in _ENCODERS.values():
        enc.words = {}


class PartWriter:
    """Streams one part to the shared folder; the file gets its name when it is complete."""

    def __init__(self, folder: str, part: int, path: str, end_id: int):
        self.folder, self.part, self.enc = folder, part, encoder(path)
        self.system, self.place = file_system(folder)
        self.system.create_dir(self.place, recursive=True)
        self.attempt = f"{self.place}/.{uuid.uuid4().hex}"
        self.size = np.dtype(self.enc.width).itemsize
        self.end = np.array([end_id], self.enc.width).tobytes()
        self.out = self.system.open_output_stream(self.attempt, compression=None)
        self.out.write(HEAD.pack(MAGIC, 1, self.size, 0))
        self.bounds, self.names, self.nulls, self.total = [np.zeros(1, np.int64)], [], 0, 0

    def add(self, names: pa.Array, texts: list[str | None]) -> None:
        coded = [c + self.end for c in self.enc.encode_all(texts)]
        self.bounds.append(self.total + np.cumsum(np.array([len(c) // self.size for c in coded], np.int64)))
        self.total = int(self.bounds[-1][-1])
        self.out.write(b"".join(coded))
        self.nulls += names.null_count
        self.names.append(names.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))

    def close(self) -> dict:
        starts = HEAD.size + self.total * self.size
        bounds = np.concatenate(self.bounds)
        first, second = elias_fano.encode(bounds), elias_fano.encode(np.concatenate(self.names))
        self.out.write(first + second + struct.pack("<Q", self.nulls) + FOOT.pack(starts, starts + len(first), self.total, MAGIC))
        self.out.close()
        name = f"part-{self.part:06d}-{uuid.uuid4().hex}.tok"
        self.system.move(self.attempt, f"{self.place}/{name}")
        return {"path": [f"{self.folder}/{name}"], "part": [self.part], "n_docs": [len(bounds) - 1], "n_ids": [self.total]}


def _write_part(batches, folder: str, path: str, end_id: int):
    from pyspark import TaskContext
    take_worker("token files", _forget)
    writer = None
    for batch in batches:
        for start, stop in slices(batch.column("text")):
            writer = writer or PartWriter(folder, TaskContext.get().partitionId(), path, end_id)
            writer.add(batch.column("id").slice(start, stop - start), batch.column("text").slice(start, stop - start).to_pylist())
    if writer:
        yield pa.RecordBatch.from_pydict(writer.close(), schema=pa.schema(
            [("path", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, id_col: str = "doc_id",
          text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the documents as part files into ``folder`` (shared); the manifest, one row per part in order."""
    folder, path = folder or shared_folder(docs.sparkSession, "token-files"), path or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id")
    # stored: only the attempt that counts is in the manifest
    return stored(ranged.mapInArrow(lambda batches: _write_part(batches, folder, path, end_id), MANIFEST), "token-manifest")


class Part:
    """One part file, opened by position: any document costs two selects and one read."""

    def __init__(self, path: str):
        system, place = file_system(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        magic, _, self.id_bytes, _ = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        bounds, names, self.n_ids, again = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{path} is not a complete token file")
        tail = self.file.read_at(size - FOOT.size - bounds, bounds)
        self.bounds = elias_fano.Sequence(tail)
        self.names = elias_fano.Sequence(tail, names - bounds)
        (self.nulls,) = struct.unpack_from("<Q", tail, names - bounds + self.names.size)
        self.width = "<u2" if self.id_bytes == 2 else "<u4"

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.file.read_at((stop - start) * self.id_bytes, HEAD.size + start * self.id_bytes)
        return np.frombuffer(raw, self.width)

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds[i], self.bounds[i + 1])

    def name(self, i: int) -> int | None:
        return None if i < self.nulls else self.names[i - self.nulls]

    def run_names(self, first: int, stop: int) -> list[int | None]:
        nulls = max(0, min(stop, self.nulls) - first)
        return [None] * nulls + self.names.run(first + nulls - self.nulls, stop - self.nulls).tolist() if nulls < stop - first else [None] * nulls


def _places(manifest: DataFrame) -> list[tuple[str, int]]:
    """Path of each part and the number of ids before it; one row per part, not per document."""
    total, out = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        out.append((r.path, total))
        total += r.n_ids
    return out


READ = T.StructType([T.StructField("id", T.LongType()), T.StructField("start", T.LongType()),
                     T.StructField("ids", T.ArrayType(T.LongType()))])
#: Ids of a part that a reading task holds at once.
READ_IDS = 2_000_000
#: Documents of a run at most, many of which may be empty.
READ_DOCS = 100_000


def _runs(part: Part):
    """Documents of a part as runs: number of the first, their boundaries, their ids."""
    first = 0
    while first < len(part):
        full = bisect.bisect_right(part.bounds, part.bounds[first] + READ_IDS, first + 1, min(len(part), first + READ_DOCS) + 1) - 1
        last = max(first + 1, full)
        bounds = part.bounds.run(first, last + 1)
        yield first, bounds, part.ids(int(bounds[0]), int(bounds[-1]))
        first = last


def _each(spark: SparkSession, manifest: DataFrame, schema: T.StructType, columns, arrow: pa.Schema) -> DataFrame:
    places = _places(manifest)

    def run(batches):
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                part = Part(path)
                for first, bounds, ids in _runs(part):
                    names = part.run_names(first, first + len(bounds) - 1)
                    docs = [(names[k], before + int(bounds[k]), ids[bounds[k] - bounds[0]:bounds[k + 1] - bounds[0]])
                            for k in range(len(bounds) - 1)]
                    yield pa.RecordBatch.from_pydict(columns(docs), schema=arrow)
    rows = spark.createDataFrame(places, "path string, before long")
    return rows.repartition(max(1, len(places))).mapInArrow(run, schema)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``id, start, ids`` of every document."""
    arrow = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    return _each(spark, manifest, READ, lambda docs: {
        "id": [d[0] for d in docs], "start": [d[1] for d in docs], "ids": [d[2].astype(np.int64) for d in docs]}, arrow)


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, checksums over 32-bit ids."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    arrow = pa.schema([(n, pa.int64()) for n in schema.names])
    return _each(spark, manifest, schema, lambda docs: {
        "doc_id": [d[0] for d in docs], "start": [d[1] for d in docs], "n_tokens": [len(d[2]) for d in docs],
        "ids_crc32": [zlib.crc32(d[2].astype("<u4").tobytes()) for d in docs]}, arrow)
