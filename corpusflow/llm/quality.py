"""Document quality by a regularised quadratic discriminant.

Each document is reduced to a few statistics of its whole text, transformed so that each is near to
normal within a class.  A class is a normal density whose covariance is shrunk twice: towards the
covariance both classes share, then towards its own diagonal.  The Cholesky factor of each class is
kept with the model; a score is the logistic function of the difference of the log densities, that
is of half the difference of the Mahalanobis distances, the log determinants and the priors.

The texts are read once; the statistics are stored, training adds up first and second moments inside
the tasks (their size does not depend on the rows), and scoring is a narrow map.

Defined results
  NULL and empty texts have the statistics of an empty text and get a score.  Very long texts are read whole.
  Training skips rows without a label; a document with several labels counts once for each.
  Without labelled rows of both classes the score is the share of class 1, or 0.5 without any.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import add_columns, packed, slices, stored, take_worker, unpacked, with_columns

STATISTICS = ("words", "letters_per_word", "distinct_words", "commonest_word", "repeats_previous", "distinct_pairs",
              "symbols", "capitals", "digits", "ends", "commas", "lines_repeated", "words_per_line", "byte_entropy",
              "first_word_cap", "long_words")
#: Weight of the shared covariance in a class's own, and then of its diagonal.
SHARED, DIAGONAL = 0.1, 0.05
#: Smallest variance of a statistic.
FLOOR = 1e-3
#: Rows that each class is given beside its own in the prior.
PRIOR = 1.0

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BEYOND = np.zeros(256, bool)
_BEYOND[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_USUAL = np.zeros(256, bool)
_USUAL[[ord(c) for c in ".,;:'\"-?()"]] = True
_OTHER = ~(_UPPER | _LOWER | _DIGIT | _BEYOND | _SPACE | _USUAL)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".?!"]] = True


def _odds(share: float, total: float) -> float:
    """Log odds of a share, held finite by half a count."""
    hits = share * total
    return float(np.log((hits + 0.5) / (total - hits + 0.5)))


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, size = len(words), max(1, int(counts.sum()))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    letters = max(1, int(counts[_UPPER | _LOWER].sum()))
    solid = max(1, int(size - counts[_SPACE].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    part = counts[counts > 0] / size
    again = sum(map(bytes.__eq__, words, words[1:]))
    return np.array([
        np.log1p(n), np.log1p(solid / max(1, n)), _odds(len(tally) / max(1, n), n), _odds(max(tally.values(), default=0) / max(1, n), n),
        _odds(again / max(1, n - 1), max(0, n - 1)), _odds(pairs / max(1, n - 1), max(0, n - 1)),
        np.sqrt(counts[_OTHER].sum() / solid), np.sqrt(counts[_UPPER].sum() / letters), np.sqrt(counts[_DIGIT].sum() / solid),
        np.sqrt(counts[_ENDS].sum() / max(1, n)), np.sqrt(counts[ord(",")] / max(1, n)),
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))) if lines else 0.0, np.log1p(n / max(1, len(lines))),
        float(-(part * np.log2(part)).sum()),
        np.sqrt(sum(w[:1].isupper() for w in words) / max(1, n)), np.sqrt(sum(len(w) > 15 for w in words) / max(1, n))])


def describe(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``statistics``, an array of doubles."""
    def run(batches):
        take_worker("quality")
        for whole in batches:
            for start, stop in slices(whole.column(text_col)):
                batch = whole.slice(start, stop - start)
                rows = [statistics(t) for t in batch.column(text_col).to_pylist()]
                yield add_columns(batch, {"statistics": pa.array(rows, pa.list_(pa.float64()))})
    return docs.mapInArrow(run, with_columns(docs.schema, T.StructType([T.StructField("statistics", T.ArrayType(T.DoubleType()))])))


@dataclass
class Model:
    """Per class its mean, the Cholesky factor of its covariance, log determinant and log prior."""
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    share: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if not self.factors:
            return np.full(len(rows), self.share)
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            solved = np.linalg.solve(factor, (rows - mean).T)
            density.append(offset - 0.5 * (solved ** 2).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shared: float = SHARED, diagonal: float = DIAGONAL) -> Model:
    """``moments``: class -> rows, sum, sum of outer products."""
    rows = {c: moments[c][0] for c in (0, 1) if c in moments and moments[c][0] > 0}
    total = sum(rows.values())
    if len(rows) < 2:
        return Model([], [], [], (rows.get(1, 0) / total) if total else 0.5)
    means = {c: moments[c][1] / rows[c] for c in rows}
    spread = {c: moments[c][2] / rows[c] - np.outer(means[c], means[c]) for c in rows}
    pooled = sum(rows[c] * spread[c] for c in rows) / total
    size = len(pooled)
    factors, offsets = [], []
    for c in (0, 1):
        own = (1 - shared) * spread[c] + shared * pooled
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + FLOOR * np.eye(size)
        factor = np.linalg.cholesky(own)
        factors.append(factor)
        offsets.append(float(np.log((rows[c] + PRIOR) / (total + 2 * PRIOR)) - np.log(np.diag(factor)).sum()))
    return Model([means[0], means[1]], factors, offsets, rows[1] / total)


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, sums and sums of outer products per class of ``label, statistics``, added up in the tasks."""
    size = len(STATISTICS)
    schema = "label int, part array<double>"

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = np.array(batch.column("statistics").to_pylist(), float).reshape(-1, size)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for c in np.unique(label):
                x = np.hstack([np.ones((int((label == c).sum()), 1)), rows[label == c]])
                sums[int(c)] = sums.get(int(c), 0) + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64()))],
                                         names=["label", "part"])
    added = (labelled.filter(F.col("label").isin(0, 1)).select(F.col("label").cast("int").alias("label"), "statistics")
             .mapInArrow(run, schema).select("label", F.posexplode("part").alias("at", "value"))
             .groupBy("label", "at").agg(F.sum("value").alias("value")).collect())
    out = {}
    for c in {r.label for r in added}:
        flat = np.zeros((size + 1) ** 2)
        for r in added:
            if r.label == c:
                flat[r.at] = r.value
        grid = flat.reshape(size + 1, size + 1)
        out[c] = (grid[0, 0], grid[0, 1:], grid[1:, 1:])
    return out


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"))
             .filter(F.col("label").isNotNull() & ~held_out(F.col("_id"))))
    return fit(moments(described.join(known, F.col(id_col) == F.col("_id")).select("label", "statistics")))


def apply(described: DataFrame, model: Model) -> DataFrame:
    """``described`` with ``score`` and ``predicted`` in place of the statistics."""
    def run(batches):
        for batch in batches:
            rows = np.array(batch.column("statistics").to_pylist(), float).reshape(-1, len(STATISTICS))
            score = model.score(rows)
            yield add_columns(batch, {"score": pa.array(score, pa.float64()),
                                      "predicted": pa.array((score >= 0.5).astype(np.int32), pa.int32())})
    more = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return described.mapInArrow(run, with_columns(described.schema, more)).drop("statistics")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` per document."""
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    described = stored(describe(narrow).drop("text"), "statistics")
    model = train(described, labels, id_col)
    return apply(described, model).select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents predicted to be of class 1, with their own columns; learns as ``judge`` does."""
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    model = train(stored(describe(narrow).drop("text"), "statistics"), labels, id_col)
    return unpacked(_accepted(packed(docs, text_col), model), docs, text_col)


def _accepted(rows: DataFrame, model: Model) -> DataFrame:
    """Rows whose ``text`` the model puts in class 1, described and scored in one pass."""
    def run(batches):
        for whole in batches:
            for start, stop in slices(whole.column("text")):
                batch = whole.slice(start, stop - start)
                found = np.array([statistics(t) for t in batch.column("text").to_pylist()])
                yield batch.filter(pa.array(model.score(found) >= 0.5))
    return rows.mapInArrow(run, rows.schema)
