"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language, one row per (language, bucket), which is the only thing that is shuffled.
The matrix of log probabilities, buckets by languages, is broadcast; a batch of texts is scored as sums of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.llm import arrays

BITS = 16
SIZES = (1, 2, 3)
SMOOTHING = 0.5
#: Labelled texts of a language used for training: a bounded hash sample of its training rows.
TRAIN_PER_LANGUAGE = 5_000
UNKNOWN = "und"


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that nothing is learned from: the crc32 of the id as text leaves two by four."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Languages in order, their log shares, and log probabilities per bucket and language."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Most likely language and its posterior probability; ``und`` with 0 for a text without a letter."""
        names, scores = [], []
        for _, run in arrays.runs(texts):
            owner, bucket, has = arrays.ngram_codes(run, SIZES, BITS)
            if not self.languages:
                names += [UNKNOWN] * len(run)
                scores.append(np.zeros(len(run)))
                continue
            total = self.prior[None, :] + np.stack([
                np.bincount(owner, weights=self.matrix[:, at][bucket], minlength=len(run))
                for at in range(len(self.languages))], axis=1)
            best = total.argmax(axis=1)
            chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names += [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
            scores.append(np.where(has, chance, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        known = sorted(set(languages))
        number = np.array([known.index(name) for name in languages])
        for first, texts in arrays.runs(batch.column("text").to_pylist()):
            owner, bucket, _ = arrays.ngram_codes(texts, SIZES, BITS)
            cells, counts = np.unique((number[first + owner] << BITS) | bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([known[c] for c in (cells >> BITS).tolist()], pa.string()),
                 pa.array(cells & ((1 << BITS) - 1)), pa.array(counts.astype(np.int64))],
                ["lang", "bucket", "n"])


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Learn from rows with a language, text and id that are not held out; none give an empty model.

    About ``per_language`` texts of each language count n-grams, all of them where there are no more, so a rare language
    is learned as well. How frequent a language is, is counted over all rows.
    """
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return Model([], np.zeros(0), np.zeros((0, 0)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(part) for lang, n in shares.items() for part in (lang, min(1.0, per_language / n))])
    sample = rows.where(draw < share[F.col("lang")])
    # At most one row per language and bucket reaches the driver.
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(shares)
    matrix = np.full((1 << BITS, len(languages)), SMOOTHING)
    if len(counts):
        matrix[counts["bucket"].to_numpy(np.int64), counts["lang"].map(languages.index).to_numpy(np.int64)] += (
            counts["n"].to_numpy(np.float64))
    matrix = np.log(matrix) - np.log(matrix.sum(axis=0))
    prior = np.log(np.array([shares[name] for name in languages], np.float64) / sum(shares.values()))
    return Model(languages, prior, matrix)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of every whole text; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["lang_pred", "score"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            kept = [c for c in batch.schema.names if c not in new]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*kept, *new])

    plain = docs.select(*[f"`{f}`" for f in docs.columns if f not in new])
    return plain.mapInArrow(apply, T.StructType([
        *plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
