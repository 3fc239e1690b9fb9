"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch of documents is hashed once, its
digests are counted map-side, new digests are found by a sort-merge anti-join whose index side is
read bucket by bucket without a shuffle, and appended.  ``dedup`` moves digests and ids only.
``drop_duplicates`` returns texts: those that a filter of fixed size shows to have no copy stay where they
are; the others move once, to meet the list of copies by digest and id.  No Python runs on the executors.

Defined results
  NULL text counts as the empty text; NULL id sorts before every id.
  Of equal texts the row with the largest id stays; of rows with that same id exactly one stays.
  A text the index already holds from an earlier batch stays there: every row of this batch is dropped.
  An empty table gives no rows and appends nothing.  Columns named like the results are replaced.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType

from .common import Scratch, fold_case, maybe_listed, shared_folder, shuffles_dropped, stored

BUCKETS = 64


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes."""
    return F.unhex(F.sha2(fold_case(text).cast("binary"), 256))


class DigestIndex:
    """``(digest, keep_id, batch)`` per text ever seen, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, id_type: DataType, path: str | None = None,
                 buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        self.id_type = id_type

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def append(self, rows: DataFrame) -> None:
        """``rows`` (digest, keep_id, batch): one file per touched bucket and batch."""
        writer = (rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
                  .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest"))
        if self.path and not self.exists():
            writer = writer.option("path", self.path)
        with shuffles_dropped(self.spark):
            writer.mode("append").saveAsTable(self.name)

    def read(self) -> DataFrame:
        if not self.exists():
            self.append(self.spark.range(0).select(
                F.unhex(F.lit("")).alias("digest"), F.lit(None).cast(self.id_type).alias("keep_id"),
                F.lit("").alias("batch")))
        return self.spark.table(self.name)


def fresh_index(spark: SparkSession, id_type: DataType, buckets: int = BUCKETS) -> DigestIndex:
    """An index of its own in the shared folder, for one corpus that is judged alone."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, id_type, shared_folder(spark, name), buckets)


def _digests(docs: DataFrame, id_col: str, text_col: str, numbered: bool = True) -> DataFrame:
    # the row number tells rows of equal id and text apart; it is stable because it is stored
    number = F.monotonically_increasing_id() if numbered else F.lit(0).cast("long")
    return docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), number.alias("row"))


def register(rows: DataFrame, index: DigestIndex, scratch: Scratch) -> tuple[DataFrame, str]:
    """Add a batch's new digests to the index; the batch's groups and its name."""
    batch = uuid.uuid4().hex
    groups = scratch.keep(rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("last"),
                                                     F.count(F.lit(1)).alias("group_size")), "groups")
    new = groups.join(index.read().select("digest").hint("merge"), "digest", "left_anti")
    index.append(new.select("digest", F.col("last.id").alias("keep_id"), F.lit(batch).alias("batch")))
    return groups, batch


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``.

    Digests and groups stay in the shared folder, as the result is read from them and, bucket by bucket, from the index.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    rows = scratch.keep(_digests(docs, id_col, text_col), "digests")
    groups, batch = register(rows, index, scratch)
    known = index.read().select("digest", "keep_id", (F.col("batch") == batch).alias("new"))
    judged = groups.join(known.hint("merge"), "digest")
    return rows.join(judged, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("new") & (F.col("row") == F.col("last.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns.

    Texts that hit the filter meet the list of (digest, id) that do not stay; that join is by both, so copies of one
    text spread.  A kept id that bears the same text in several rows is rare; those rows alone are reduced to one.
    """
    scratch = Scratch(docs.sparkSession, "drop-duplicates")
    rows = scratch.keep(_digests(docs, id_col, text_col, False), "digests")
    groups, batch = register(rows, index, scratch)
    new = index.read().filter(F.col("batch") == batch).select("digest")
    last = groups.join(new.hint("merge"), "digest").select(F.col("digest").alias("d"), F.col("last.id").alias("i"))
    copies = stored(rows.join(last, (rows["digest"] == last["d"]) & rows["id"].eqNullSafe(last["i"]), "left")
                    .groupBy("digest", "id").agg(F.max(F.col("d").isNotNull()).alias("stays"), F.count(F.lit(1)).alias("n"))
                    .filter(~F.col("stays") | (F.col("n") > 1)).select("digest", "id", "stays"), "digest-copies")
    scratch.close()
    # all columns travel as one, so that no name can clash
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), digest(F.col(text_col)).alias("digest"), F.col(id_col).alias("id"))
    flagged = maybe_listed(whole, copies, ["digest", "id"], "maybe")
    listed = copies.select(F.col("digest").alias("d"), F.col("id").alias("i"), "stays")
    met = flagged.filter("maybe").join(listed.hint("merge"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")), "left")
    kept = flagged.filter(~F.col("maybe")).select("doc").unionAll(met.filter(F.col("d").isNull()).select("doc"))
    if not copies.filter("stays").isEmpty():
        kept = kept.unionAll(met.filter("stays").dropDuplicates(["digest", "id"]).select("doc"))
    return kept.select("doc.*")
