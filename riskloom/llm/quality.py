"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse row: one indicator per statistic and metadata column, for the range its value falls into, and its
distinct words that were screened, with their weights scaled to length one. The score is a logistic function of a
bias, a weight per feature, and all pairwise interactions ``<v_i, v_j> x_i x_j`` of low-rank factors. These take time
linear in the number of features, by ``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2``.

Counts that choose the words are taken on Spark; the driver gets one row per sampled text with the chosen words only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskloom.llm import arrays
from riskloom.llm.toxicity import held_out
from riskloom.session import stored

BITS = 16
RANK = 4
#: Labelled texts used for training, per class: a bounded hash sample of the training rows.
TRAIN_PER_CLASS = 2_500
#: Words that enter training: the buckets that tell most about the class, seen in this many texts or more.
SCREENED = 1_000
LEAST_TEXTS = 5
#: Ranges of a statistic, even ones among the training rows.
RANGES = 12
ROUNDS = 150
STEP = 0.05
L2_WEIGHT, L2_FACTOR = 1e-4, 1e-3
METADATA = ("n_chars",)
STATISTICS = ("chars", "words", "word_length", "upper", "digits", "symbols", "blanks", "distinct_words", "top_word",
              "lines", "repeated_lines", "sentence_ends", "long_words")
_SENTENCE_ENDS = np.array([ord(c) for c in ".!?"], np.uint32)


def statistics(texts: Sequence[str]) -> np.ndarray:
    """One row per text, in the order of ``STATISTICS``; all are 0 for an empty text."""
    codes, ends = arrays.code_points(texts)
    starts = np.concatenate(([0], ends[:-1]))
    chars = (ends - starts - 1).astype(np.float64)
    some = np.maximum(chars, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), starts) / some

    space = arrays._table("isspace")[codes]
    # The line feed behind each text is not part of it.
    space[ends - 1] = False
    plain = arrays._table("isalnum")[codes] | space
    plain[ends - 1] = True
    words = arrays.Words(texts)
    count = words.counts.astype(np.float64)
    least = np.maximum(count, 1)
    length = np.bincount(words.texts, weights=words.lengths, minlength=len(texts))
    order = np.lexsort((words.hashes(), words.texts))
    key, owner = words.hashes()[order], words.texts[order]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(key)))
    top = np.zeros(len(texts))
    np.maximum.at(top, owner[first], often)
    lines = [t.split("\n") for t in texts]
    n_lines = np.array([len(own) for own in lines], np.float64)
    different = np.array([len(set(own)) for own in lines], np.float64)
    return np.stack([
        np.log1p(chars), np.log1p(count), length / least, share(arrays._table("isupper")[codes]),
        share(arrays._table("isdigit")[codes]), share(~plain), share(space),
        np.bincount(owner[first], minlength=len(texts)) / least, top / least, np.where(chars > 0, np.log(n_lines), 0),
        1 - different / n_lines, np.add.reduceat(np.isin(codes, _SENTENCE_ENDS).astype(np.int64), starts) / least,
        np.bincount(words.texts, weights=words.lengths > 12, minlength=len(texts)) / least], axis=1)


def _buckets(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the words, each pair once."""
    words = arrays.Words(texts)
    bucket = (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique((words.texts.astype(np.int64) << BITS) | bucket)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """Bias, cuts of every statistic and metadata column, buckets of the words, weights and factors of all features.

    Features are numbered column by column, ``RANGES`` and one for a missing value each, then come the words.
    """

    bias: float
    metadata: tuple[str, ...]
    cuts: list[np.ndarray]
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def rows(self, values: np.ndarray, owner: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, feature, value) of some texts, in order of texts; ``values`` are statistics and metadata."""
        n, width = len(values), RANGES + 1
        ranges = np.stack([np.where(np.isnan(column), RANGES, np.searchsorted(cuts, column, side="right"))
                           for cuts, column in zip(self.cuts, values.T)], axis=1) + np.arange(len(self.cuts)) * width
        place = np.searchsorted(self.buckets, bucket)
        known = place < len(self.buckets)
        known[known] = self.buckets[place[known]] == bucket[known]
        owner, place = owner[known], place[known]
        size = np.bincount(owner, minlength=n)
        text = np.concatenate((np.repeat(np.arange(n), len(self.cuts)), owner))
        feature = np.concatenate((ranges.ravel(), place + len(self.cuts) * width))
        value = np.concatenate((np.ones(ranges.size), 1 / np.sqrt(size[owner])))
        order = np.argsort(text, kind="stable")
        return text[order], feature[order].astype(np.int64), value[order]

    def margin(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Every text has its ranges, so none is without features."""
        margin, _ = _machine(self.bias, self.weights, self.factors, _firsts(text), feature, value)
        return margin

    def score(self, texts: Sequence[str | None], metadata: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1; ``metadata`` has a column each, missing values are nan."""
        if not self.cuts:
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        parts = []
        for first, run in arrays.runs(texts):
            values = np.concatenate((statistics(run), metadata[first:first + len(run)]), axis=1)
            parts.append(self.margin(*self.rows(values, *_buckets(run))))
        margin = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _firsts(text: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, text[1:] != text[:-1]))


def _machine(bias, weights, factors, firsts, feature, value) -> tuple[np.ndarray, np.ndarray]:
    """The margin of every row, and the sums of its factors."""
    scaled = factors[feature] * value[:, None]
    sums = np.add.reduceat(scaled, firsts, axis=0)
    squares = np.add.reduceat((scaled * scaled).sum(axis=1), firsts)
    return bias + np.add.reduceat(weights[feature] * value, firsts) + ((sums * sums).sum(axis=1) - squares) / 2, sums


def _fit(model: Model, rows: tuple[np.ndarray, ...], label: np.ndarray, weight: np.ndarray) -> Model:
    """Full-batch Adam on the weighted log loss."""
    text, feature, value = rows
    firsts, size = _firsts(text), len(model.weights)
    state = [np.array(model.bias), model.weights.copy(), model.factors.copy()]
    mean, square = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    by_feature = np.argsort(feature, kind="stable")
    starts = _firsts(feature[by_feature])
    present = feature[by_feature][starts]
    for turn in range(1, ROUNDS + 1):
        bias, weights, factors = state
        margin, sums = _machine(bias, weights, factors, firsts, feature, value)
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label)
        pull = error[text] * value
        slope = np.bincount(feature, weights=pull, minlength=size) + L2_WEIGHT * weights
        push = pull[:, None] * (sums[text] - factors[feature] * value[:, None])
        slopes = L2_FACTOR * factors
        slopes[present] += np.add.reduceat(push[by_feature], starts, axis=0)
        for at, gradient in enumerate((error.sum(), slope, slopes)):
            mean[at] = 0.9 * mean[at] + 0.1 * gradient
            square[at] = 0.999 * square[at] + 0.001 * gradient * gradient
            state[at] = state[at] - STEP * (mean[at] / (1 - 0.9**turn)) / (
                np.sqrt(square[at] / (1 - 0.999**turn)) + 1e-8)
    return Model(float(state[0]), model.metadata, model.cuts, model.buckets, state[1], state[2])


def _examples(metadata: tuple[str, ...]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = _metadata(batch, metadata)
            for first, texts in arrays.runs(batch.column("text").to_pylist()):
                values = np.concatenate((statistics(texts), given[first:first + len(texts)]), axis=1)
                owner, bucket = _buckets(texts)
                own = np.split(bucket.astype("<i4"), np.searchsorted(owner, np.arange(1, len(texts))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(first, len(texts)), pa.array([v.tobytes() for v in values], pa.binary()),
                     pa.array([b.tobytes() for b in own], pa.binary())], ["label", "values", "buckets"])
    return read


def _metadata(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    columns = [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]
    return np.stack(columns, axis=1) if columns else np.zeros((len(batch), 0))


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for label, own in zip(batch.column("label").to_pylist(), batch.column("buckets")):
            seen[label][np.frombuffer(own.as_py(), "<i4")] += 1
    label, bucket = np.nonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label, pa.int32()), pa.array(bucket, pa.int32()), pa.array(seen[label, bucket])],
        ["label", "bucket", "n"])


def _chosen(buckets: np.ndarray):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(np.frombuffer(b.as_py(), "<i4"), buckets).astype("<i4").tobytes()
                   for b in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("values"), pa.array(own, pa.binary())],
                ["label", "values", "buckets"])
    return choose


def _screen(counts, rates: np.ndarray) -> np.ndarray:
    """The buckets whose presence tells most about the class; ``rates``: weight of a row by class, summing to one."""
    n = np.zeros((2, 1 << BITS))
    n[counts["label"].to_numpy(np.int64), counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    joint, share = n * rates[0][:, None], rates[1]
    gain, held = np.zeros(1 << BITS), joint.sum(axis=0)
    for label in (0, 1):
        for cell, side in ((joint[label], held), (share[label] - joint[label], 1 - held)):
            gain += np.where(cell > 1e-12, cell * np.log(np.maximum(cell, 1e-12) / np.maximum(
                side * share[label], 1e-12)), 0)
    gain[n.sum(axis=0) < LEAST_TEXTS] = 0
    best = np.argsort(-gain, kind="stable")[:SCREENED]
    return np.sort(best[gain[best] > 1e-9])


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, metadata: Sequence[str] = METADATA,
) -> Model:
    """Fit on labelled rows outside the held-out fold, ``per_class`` or about as many of either class.

    Of several labels of one document the highest counts; rows without a label or an id teach nothing, and a null
    text counts as empty. Without examples of both classes every score is 1 or 0, 0 if there are none.
    """
    metadata = tuple(metadata)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(
        "doc_id").agg((F.max("quality") > 0).cast("int").alias("label"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    constant = Model(50.0 if sizes.get(1) else -50.0, metadata, [], np.zeros(0, np.int64), np.zeros(0),
                     np.zeros((0, RANK)))
    if not sizes.get(1) or not sizes.get(0):
        return constant
    draw = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / sizes[1]))).otherwise(
        F.lit(min(1.0, per_class / sizes[0])))
    # The sample has about 2 * per_class rows of two numbers, whatever the size of the tables.
    chosen = F.broadcast(known.where(draw < share))
    given = [F.col(f"`{m}`").cast("double").alias(m) for m in metadata]
    sample = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *given).join(
        chosen, "doc_id").select("label", "text", *metadata).mapInArrow(
        _examples(metadata), "label int, values binary, buckets binary"), "quality_sample")
    counts = sample.mapInArrow(_count_buckets, "label int, bucket int, n long").groupBy("label", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    drawn = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(drawn) < 2:
        return constant
    # Rows count as often as their class occurs among all labels.
    share_of = np.array([sizes[0], sizes[1]]) / (sizes[0] + sizes[1])
    per_row = share_of / np.array([drawn[0], drawn[1]])
    buckets = _screen(counts, (per_row, share_of))
    rows = sample.mapInArrow(_chosen(buckets), sample.schema).toPandas()
    # A fixed order makes training repeatable, whichever task was first.
    rows = rows.sort_values(["label", "values", "buckets"], kind="stable").reset_index(drop=True)
    values = np.stack([np.frombuffer(v) for v in rows["values"]])
    cuts = []
    for column in values.T:
        here = column[~np.isnan(column)]
        cuts.append(np.unique(np.quantile(here, np.arange(1, RANGES) / RANGES)) if len(here) else np.zeros(0))
    own = [np.frombuffer(b, "<i4").astype(np.int64) for b in rows["buckets"]]
    size = len(cuts) * (RANGES + 1) + len(buckets)
    start = Model(float(np.log(share_of[1] / share_of[0])), metadata, cuts, buckets, np.zeros(size),
                  np.random.default_rng(0).normal(0, 0.05, (size, RANK)))
    label = rows["label"].to_numpy(np.int64)
    return _fit(start, start.rows(values, np.repeat(np.arange(len(own)), [len(o) for o in own]),
                                  np.concatenate(own)), label.astype(np.float64), per_row[label])


def score(docs: DataFrame, model: Model, column: str = "quality") -> DataFrame:
    """``docs`` with a quality score of every whole text in ``column``; a null text is scored as an empty one.

    The metadata columns of the model have to be there; nulls in them are a range of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name != column]
    plain = docs.select(*[f"`{f.name}`" for f in fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column("text").to_pylist(), _metadata(batch, shared.value.metadata))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             [*batch.schema.names, column])

    return plain.mapInArrow(apply, T.StructType([*plain.schema.fields, T.StructField(column, T.DoubleType())]))
