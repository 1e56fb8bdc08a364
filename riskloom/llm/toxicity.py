"""Toxicity: a logistic classifier that is held to the same score when a group's name is swapped for another.

Features are the distinct words of a text and their first three to six letters, hashed. Training minimises the log
loss on labelled texts, an L1 penalty, and the squared change of the score when the identity terms of a labelled
text are swapped for others of the same kind, so a group that is only mentioned often in toxic texts gets no
weight of its own. The model is sparse: a handful of buckets with a weight, which every task holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.llm import arrays

BITS = 20
PREFIXES = (3, 4, 5, 6)
#: Labelled texts used for training, per class: a bounded hash sample of the training rows.
TRAIN_PER_CLASS = 3_000
#: Buckets that enter training: those that separate the classes best, seen in this many texts or more.
SCREENED = 4_000
LEAST_TEXTS = 3
L1 = 1e-4
#: How much more a toxic text counts than its share, since most texts are clean.
TOXIC_WEIGHT = 3.0
COUNTERFACTUAL = 1.0
ROUNDS = 400

#: Names of groups of people that may stand for each other, by kind. Fixed values.
IDENTITY_TERMS = {
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist"],
    "origin": ["african", "asian", "european", "american", "mexican", "chinese", "indian", "arab", "turkish"],
    "colour": ["black", "white", "brown"],
    "gender": ["women", "men", "girls", "boys"],
    "person": ["woman", "man", "girl", "boy"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "transgender"],
    "state": ["deaf", "blind", "disabled", "autistic"],
    "age": ["old", "young", "elderly", "teenage"],
}
_NEXT = {term: kind[(at + 1) % len(kind)] for kind in IDENTITY_TERMS.values() for at, term in enumerate(kind)}
_TERM = re.compile(r"\b(?:" + "|".join(map(re.escape, _NEXT)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str:
    """The text with every identity term replaced by the next one of its kind."""
    return _TERM.sub(lambda m: _NEXT[m[0].lower()], text)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no label is learned from: the crc32 of the id as text leaves no remainder by five."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 5 == 0, F.lit(False))


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), each pair once. ``wanted`` marks the only buckets to return."""
    words = arrays.Words(texts)
    owners, buckets = [words.texts], [words.hashes()]
    for length in PREFIXES:
        hashes, which = words.prefix_hashes(length)
        owners.append(words.texts[which])
        buckets.append(hashes)
    owner = np.concatenate(owners)
    bucket = (np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int64)
    if wanted is not None:
        keep = wanted[bucket]
        owner, bucket = owner[keep], bucket[keep]
    pairs = np.unique((owner.astype(np.int64) << BITS) | bucket)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """Bias, and the buckets with a weight."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def scorer(self):
        """Function from texts to scores between 0 and 1."""
        table = np.zeros(1 << BITS)
        table[self.buckets] = self.weights
        wanted = table != 0

        def score(texts: list[str | None]) -> np.ndarray:
            parts = []
            for _, run in arrays.runs(texts):
                owner, bucket = features(run, wanted)
                parts.append(np.bincount(owner, weights=table[bucket], minlength=len(run)))
            margin = np.concatenate(parts) + self.bias if parts else np.zeros(0)
            return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

        return score


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic")
        for first, texts in arrays.runs(batch.column("text").to_pylist()):
            plain = _per_text(texts)
            others = [swapped(t) for t in texts]
            changed = [at for at, (a, b) in enumerate(zip(texts, others)) if a.lower() != b.lower()]
            swaps = dict(zip(changed, _per_text([others[at] for at in changed])))
            yield pa.RecordBatch.from_arrays(
                [toxic.slice(first, len(texts)), pa.array([p.tobytes() for p in plain], pa.binary()),
                 pa.array([swaps[at].tobytes() if at in swaps else None for at in range(len(texts))], pa.binary())],
                ["toxic", "buckets", "swapped"])


def _per_text(texts: list[str]) -> list[np.ndarray]:
    if not texts:
        return []
    owner, bucket = features(texts)
    return np.split(bucket.astype(np.int32), np.searchsorted(owner, np.arange(1, len(texts))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """Fit on labelled rows outside the held-out fold, ``per_class`` or about as many of either class.

    Of several labels of one document the highest counts; rows without a label or an id teach nothing. Without
    examples of both classes the score is the share of toxic ones, or 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(
        "doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model(50.0 if sizes.get(1) else -50.0, np.zeros(0, np.int64), np.zeros(0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / sizes[1]))).otherwise(
        F.lit(min(1.0, per_class / sizes[0])))
    # The sample has about 2 * per_class rows of two numbers, whatever the size of the tables.
    sample = F.broadcast(known.where(draw < share))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").select(
        "toxic", "text").mapInArrow(_examples, "toxic int, buckets binary, swapped binary").toPandas()
    if rows["toxic"].nunique() < 2:
        return Model(-50.0, np.zeros(0, np.int64), np.zeros(0))
    label = rows["toxic"].to_numpy(np.float64)
    # Rows count as often as their class occurs, toxic ones more.
    weight = np.where(label == 1, TOXIC_WEIGHT * sizes[1] / (label == 1).sum(), sizes[0] / (label == 0).sum())
    plain = [np.frombuffer(b, np.int32) for b in rows["buckets"]]
    pairs = [(at, np.frombuffer(b, np.int32)) for at, b in enumerate(rows["swapped"]) if b is not None]
    return _fit(plain, label, weight / weight.sum(), pairs)


def _screen(plain: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The buckets whose presence tells most about the class, by the mutual information with it."""
    flat, owner = np.concatenate(plain), np.repeat(np.arange(len(plain)), [len(p) for p in plain])
    seen = np.bincount(flat, minlength=1 << BITS)
    with_toxic = np.bincount(flat, weights=(weight * label)[owner], minlength=1 << BITS)
    with_any = np.bincount(flat, weights=weight[owner], minlength=1 << BITS)
    toxic = (weight * label).sum()
    gain = np.zeros(1 << BITS)
    for joint, row, column in ((with_toxic, with_any, toxic), (with_any - with_toxic, with_any, 1 - toxic),
                               (toxic - with_toxic, 1 - with_any, toxic),
                               (1 - toxic - with_any + with_toxic, 1 - with_any, 1 - toxic)):
        gain += np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(row * column, 1e-12)), 0)
    gain[seen < LEAST_TEXTS] = -1
    best = np.argsort(-gain, kind="stable")[:SCREENED]
    return np.sort(best[gain[best] > 0])


def _fit(plain: list[np.ndarray], label: np.ndarray, weight: np.ndarray, pairs: list) -> Model:
    chosen = _screen(plain, label, weight)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cols = [place[r][place[r] >= 0] for r in rows]
        return (np.repeat(np.arange(len(rows)), [len(c) for c in cols]),
                np.concatenate(cols) if cols else np.zeros(0, int))

    row, col = matrix(plain)
    # A counterfactual row is the features gained less those lost by the swap.
    gained_row, gained_col = matrix([np.setdiff1d(s, plain[at]) for at, s in pairs])
    lost_row, lost_col = matrix([np.setdiff1d(plain[at], s) for at, s in pairs])
    swap_weight = np.full(len(pairs), COUNTERFACTUAL / max(1, len(pairs)))
    size = len(chosen)
    w, b = np.zeros(size), float(np.log((weight * label).sum() / (weight * (1 - label)).sum()))
    # Step lengths per weight, from the diagonal of the curvature bound times the features of a row.
    rows_nnz = np.bincount(row, minlength=len(plain))
    bound = np.bincount(col, weights=(weight * 0.25 * (rows_nnz + 1))[row], minlength=size)
    swap_nnz = (np.bincount(gained_row, minlength=len(pairs)) + np.bincount(lost_row, minlength=len(pairs)))
    for r, c in ((gained_row, gained_col), (lost_row, lost_col)):
        bound += np.bincount(c, weights=(2 * swap_weight * swap_nnz)[r], minlength=size)
    step = 1 / np.maximum(bound, 1e-9)
    bias_step = 1 / (0.25 * (weight * (rows_nnz + 1)).sum())
    ahead_w, ahead_b, momentum = w.copy(), b, 1.0
    for _ in range(ROUNDS):
        margin = ahead_b + np.bincount(row, weights=ahead_w[col], minlength=len(plain))
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label)
        gradient = np.bincount(col, weights=error[row], minlength=size)
        if pairs:
            change = (np.bincount(gained_row, weights=ahead_w[gained_col], minlength=len(pairs))
                      - np.bincount(lost_row, weights=ahead_w[lost_col], minlength=len(pairs)))
            pull = 2 * swap_weight * change
            gradient += np.bincount(gained_col, weights=pull[gained_row], minlength=size)
            gradient -= np.bincount(lost_col, weights=pull[lost_row], minlength=size)
        new = ahead_w - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_b = ahead_b - bias_step * error.sum()
        nxt = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead_w = new + (momentum - 1) / nxt * (new - w)
        ahead_b = new_b + (momentum - 1) / nxt * (new_b - b)
        w, b, momentum = new, new_b, nxt
    used = np.flatnonzero(w)
    return Model(b, chosen[used], w[used])


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` with a toxicity score of every whole text in ``column``; a null text is scored as an empty one."""
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = weights.value.scorer()
        for batch in batches:
            scores = rate(batch.column("text").to_pylist())
            kept = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())],
                                             [*kept, column])

    fields = [f for f in docs.schema.fields if f.name != column]
    plain = docs.select(*[f"`{f.name}`" for f in fields])
    return plain.mapInArrow(apply, T.StructType([*plain.schema.fields, T.StructField(column, T.DoubleType())]))
