"""Benchmark decontamination: short test items inside long documents, by size-partitioned min-hash containment.

Containment is the share of an item's word five-grams that a document holds. Items are partitioned by size, in
powers of two. A partition whose items have at most ``u`` shingles keeps the ``floor((1 - t) u) + 1`` smallest
min-hashes of each item as its sketch: a document that holds a share ``t`` of an item can miss at most
``(1 - t) n`` of its shingles, so it holds one of the sketch. A document is therefore a candidate exactly if one of
its shingles is in a sketch of a partition whose items are small enough to fit into it; nothing is lost, whatever
the size of the document. Candidates are verified on the words themselves.

Documents are read once and never shuffled. The index goes to every task; it is measured, and a larger one is cut
into blocks, each searched by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm import arrays
from riskloom.llm.jaccard_join import row_key
from riskloom.session import stored

THRESHOLD = 0.8
#: Shingles of one block of the index: 4 MB of hashes, and about as many words.
INDEX_SHINGLES = 500_000
_FILTER_BITS = 20
_WORD = re.compile(r"[^\W_]+")


def word_shingles(text: str, width: int = arrays.WORDS_PER_SHINGLE) -> set[tuple[str, ...]]:
    """The distinct word n-grams themselves; fewer words than ``width`` make one."""
    words = _WORD.findall(text.lower())
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[at:at + width]) for at in range(len(words) - width + 1)}


def _sizes(width: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in arrays.runs(batch.column("text").to_pylist()):
                count = [len(s) for s in arrays.shingles(texts, width)]
                rows = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(count, pa.int64())],
                                                 [*rows.schema.names, "n_shingles"])
    return measure


class _Partition:
    """The sketches of items of similar size, and a bit table that most shingles fail."""

    def __init__(self, items: list[int], sets: list[np.ndarray], threshold: float):
        sizes = [len(sets[i]) for i in items]
        upper = 1 << (max(sizes) - 1).bit_length()
        kept = int((1 - threshold) * upper + 1e-9) + 1
        order = [sets[i][np.argsort(arrays.mix(sets[i]))[:kept]] for i in items]
        owner = np.repeat(items, [len(o) for o in order])
        hashes = np.concatenate(order)
        rank = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[rank], owner[rank]
        self.least = min(sizes) * threshold - 1e-9
        self.present = np.zeros(1 << _FILTER_BITS, bool)
        self.present[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def candidates(self, shingles: np.ndarray) -> np.ndarray:
        if len(shingles) < self.least:
            return self.owner[:0]
        likely = shingles[self.present[shingles >> np.uint64(64 - _FILTER_BITS)]]
        low = np.searchsorted(self.hashes, likely, side="left")
        high = np.searchsorted(self.hashes, likely, side="right")
        found = [self.owner[a:b] for a, b in zip(low, high) if b > a]
        return np.unique(np.concatenate(found)) if found else self.owner[:0]


def _searcher(texts_of_items, threshold: float, width: int):
    """``texts_of_items``: broadcast list of item texts; the result names items by their place in it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = texts_of_items.value
        sets = [s for _, run in arrays.runs(items) for s in arrays.shingles(run, width)]
        by_size: dict[int, list[int]] = {}
        for at, s in enumerate(sets):
            if len(s):
                by_size.setdefault((len(s) - 1).bit_length(), []).append(at)
        partitions = [_Partition(members, sets, threshold) for members in by_size.values()]
        words: dict[int, set] = {}
        for batch in batches:
            found = []
            for first, texts in arrays.runs(batch.column("text").to_pylist()):
                for at, shingles in enumerate(arrays.shingles(texts, width)):
                    candidates = [i for p in partitions for i in p.candidates(shingles).tolist()]
                    own = word_shingles(texts[at], width) if candidates else None
                    for item in candidates:
                        if item not in words:
                            words[item] = word_shingles(items[item], width)
                        shared = len(words[item] & own)
                        if shared / len(words[item]) >= threshold:
                            found.append((first + at, item, shared, len(words[item])))
            rows, *figures = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "row_key")]
                + [pa.array(f, pa.int64()) for f in figures],
                ["doc_id", "row_key", "item", "n_shared", "n_item_shingles"])

    return search


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = arrays.WORDS_PER_SHINGLE,
    index_shingles: int = INDEX_SHINGLES,
) -> DataFrame:
    """One row per document and benchmark item it holds: ``doc_id``, ``row_key``, ``item_id``, ``n_shared``,
    ``n_item_shingles``, ``containment``.

    Clean documents do not appear. Words are runs of letters and digits in any case. An item of fewer than
    ``width`` words is one shingle, which only a document of just these words holds; null texts and texts without
    words match nothing. Repeated rows and repeated items are reported each. Only doc_id and text, item_id and text
    are read, whatever other columns there are.
    """
    spark = docs.sparkSession
    items = stored(
        benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(_sizes(width), f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, text string, "
                                    "n_shingles long")
        .where("n_shingles > 0").withColumn("item_row", F.monotonically_increasing_id()), "items")
    total, largest = items.agg(F.sum("n_shingles"), F.max("n_shingles")).head()
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", row_key())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, row_key long, item long, n_shared long, n_item_shingles long"
    # Blocks by hash, as many as it takes for each to fit; an item beyond the limit makes a block of its size.
    blocks = max(1, -(-(total or 0) // index_shingles))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(blocks)))
        most = dealt.groupBy("block").agg(F.sum("n_shingles").alias("n")).agg(F.max("n")).head()[0] or 0
        if most <= max(2 * index_shingles, largest or 0):
            break
        blocks *= 2
    found = []
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).orderBy("item_row").select("item_row", "text").collect()
        if not rows and block:
            continue
        texts = spark.sparkContext.broadcast([r.text for r in rows])
        numbers = F.lit([r.item_row for r in rows]) if rows else F.array().cast("array<bigint>")
        found.append(source.mapInArrow(_searcher(texts, threshold, width), schema)
                     .withColumn("item_row", F.get(numbers, F.col("item").cast("int"))))
    hits = reduce(DataFrame.union, found)
    return hits.join(items.select("item_row", "item_id"), "item_row").select(
        "doc_id", "row_key", "item_id", "n_shared", "n_item_shingles",
        (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))
