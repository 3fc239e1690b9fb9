"""Helpers the corpus operators share: shared-folder storage, word folding, names that cannot clash."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..plans.durable import checkpoint_dir, shuffles_dropped

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Characters of text that a Python task works on at once.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    writer = df.write.option("compression", compression) if compression else df.write
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe against lost executors,
    and Spark knows its size when it plans what follows."""
    return _written(df, shared_folder(df.sparkSession, label))


class Scratch:
    """Intermediate tables of one run in the shared folder, deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths = spark, shared_folder(spark, label), {}

    def keep(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """``df`` written and read back.  A table kept under the same name before is deleted once this one is written."""
        path, before = f"{self.root}/{name}-{uuid.uuid4().hex}", self.paths.get(name)
        out = _written(df, path, compression)
        self.paths[name] = path
        if before:
            delete_folder(before)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            delete_folder(self.paths.pop(name))

    def close(self) -> None:
        """Delete everything; results that outlive the run are stored elsewhere first."""
        if self.paths:
            delete_folder(self.root)
        self.paths = {}


#: What operators keep in a worker between their tasks, and how each lets go of it.
_KEPT_BY: dict[str, Callable[[], None]] = {}


def take_worker(operator: str, let_go: Callable[[], None] | None = None) -> None:
    """First thing in a task: the worker now serves ``operator``; whatever others kept in it goes.

    ``let_go`` drops what this operator will keep for its own next tasks.
    """
    for other in [k for k in _KEPT_BY if k != operator]:
        _KEPT_BY.pop(other)()
    if let_go:
        _KEPT_BY[operator] = let_go


def with_columns(schema: StructType, more: StructType) -> StructType:
    """``schema`` with the fields of ``more``; a field of the same name is replaced."""
    new = {f.name.lower() for f in more}
    return StructType([f for f in schema if f.name.lower() not in new] + list(more))


def fold_case(text: Column) -> Column:
    """A-Z to a-z and nothing else; NULL becomes the empty text."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def byte_table(word: str) -> bytes:
    """Translation that lower-cases A-Z and turns every byte outside words into a space.

    ``alnum``: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing, that is 0-9, a-z and
    everything beyond ASCII.  ``black``: words are ``[^\\x20\\x09-\\x0D]+``.
    """
    table = bytearray(range(256))
    for c in UPPER:
        table[ord(c)] = ord(c.lower())
    for b in range(128):
        separates = not chr(table[b]).isalnum() if word == "alnum" else b == 0x20 or 0x09 <= b <= 0x0D
        if separates:
            table[b] = 0x20
    return bytes(table)


ALNUM, BLACK = byte_table("alnum"), byte_table("black")


def folded(text: str | None, table: bytes = ALNUM) -> bytes:
    """The text's UTF-8 with separators as spaces; byte positions stay those of the original."""
    return (text or "").encode("utf-8", "surrogatepass").translate(table)


def words_of(text: str | None, table: bytes = ALNUM) -> list[bytes]:
    # after the translation the only separators left are spaces; other bytes that split() treats
    # as white space were separators already
    return folded(text, table).split()


def slices(texts: pa.Array | list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive [start, end) runs of about ``chars`` characters (bytes of an Arrow column); one very long text is
    a run alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    start = size = 0
    for i, n in enumerate(sizes):
        n += 64
        if i > start and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def add_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns set, those of the same name (in any case) replaced; matches ``with_columns``."""
    new = {c.lower() for c in columns}
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() not in new]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(columns.values()),
                                      names=[batch.schema.names[i] for i in keep] + list(columns))


def packed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_doc`` (every other column) and ``text``: results added beside them clash with no name."""
    rest = [F.col(c) for c in docs.columns if c != text_col]
    return docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("_doc"), F.col(text_col).cast("string").alias("text"))


def unpacked(rows: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return rows.select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col("_doc")[c].alias(c)
                         for c in docs.columns])


#: Bitmaps of 4 KB in a filter at most, so 4 MB whatever the tables hold.
FILTER_MAPS, MAP_BITS = 1_024, 32_768


def maybe_listed(rows: DataFrame, listed: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """``rows`` with ``flag``: false where the row's ``columns`` are certainly not among those of ``listed``.

    The filter is one bit per hash value in bitmaps of a fixed total size, which alone may be broadcast.  Rows that
    miss it need not move to meet the list; with a list that outgrows the filter more rows hit it, results stay.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(FILTER_MAPS * MAP_BITS))
    bits = (listed.select(place.alias("place")).groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("_map"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("_bits")))
    placed = rows.withColumn("_place", place)
    met = placed.join(F.broadcast(bits), F.bitmap_bucket_number(F.col("_place") + 1) == F.col("_map"), "left")
    byte = F.expr(f"conv(hex(substring(_bits, CAST(_place % {MAP_BITS} AS INT) DIV 8 + 1, 1)), 16, 10)").cast("long")
    hit = F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1
    return met.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_place", "_map", "_bits")


def as_uri(path: str) -> str:
    """``file:/x`` as the ``file:///x`` that file system libraries expect; a plain path gets the scheme."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    return "file://" + path if path.startswith("/") else path


def file_system(path: str):
    """File system and path inside it for a shared folder's URI, usable in tasks."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(as_uri(path))


def delete_folder(path: str) -> None:
    system, place = file_system(path)
    system.delete_dir(place)
