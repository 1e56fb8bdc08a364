"""Ranked lexical search: one automaton of all item terms reads every document and counts term frequencies.

The terms of the items, each between two guards, make an Aho-Corasick automaton that is broadcast. A document is
brought to the automaton's alphabet (lower case, every separator a guard) and read once; each match ends at a whole
word, since both its guards matched, and two words may share the guard between them. No index of documents exists.
Outputs of the automaton are term numbers, and a list per term maps them to the items that hold it.

Documents are read twice: for the corpus statistics, and, with these, for the scores. Either pass is a map; what
leaves a task is a count per term, and then its own best documents per item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.session import stored

TOP = 10
#: Characters of the terms of one automaton, some 100 bytes of memory each.
AUTOMATON_CHARS = 1_000_000
#: Bytes of text read at once, apart from a single text that is longer by itself.
_RUN_BYTES = 1 << 20
#: Scores held at once (documents by items), and rows a task gathers before it goes back to the best ones.
_CELLS = 1 << 20
_PENDING = 100_000
#: A task's best rows meet in this many parts per item before the last ranking.
_PARTS = 64
_DOCUMENTS, _TERMS = -1, -2
_GUARD = 0x20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The bytes of a term are digits, letters and all bytes of other scripts; only A-Z change their case.
_ALPHABET = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _GUARD for b in range(256))
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text):
    """Column of the distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(
        F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(TERM_PATTERN), F.lit(0)))


def _automaton(terms: list[str]):
    """Automaton over bytes, one character each, whose outputs are places in ``terms``."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for at, term in enumerate(terms):
        automaton.add_word(f" {term.encode().decode('latin-1')} ", at)
    automaton.make_automaton()
    return automaton


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    first, run, size = 0, [], 0
    for at, text in enumerate(batch.column("text").cast(pa.binary())):
        raw = (text.as_py() or b"").translate(_ALPHABET)
        if run and size + len(raw) > _RUN_BYTES:
            yield first, run
            first, run, size = at, [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield first, run


def _read(automaton, run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text, and (text, term) of every match."""
    joined = b" " + b" ".join(run) + b" "
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in run), np.int64, len(run)))
    guard = np.frombuffer(joined, np.uint8) == _GUARD
    starts = np.flatnonzero(guard[:-1] & ~guard[1:])
    counts = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(run))
    flat = np.fromiter(chain.from_iterable(automaton.iter(joined.decode("latin-1"))), np.int64).reshape(-1, 2) \
        if len(automaton) else np.zeros((0, 2), np.int64)
    # A match ends at the guard behind its word.
    return counts, np.searchsorted(ends, flat[:, 0] - 1, side="right"), flat[:, 1]


def _statistics(terms):
    """Per task how many documents hold each term, how many hold any, and how many terms there are in all."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, size = _automaton(terms.value), len(terms.value)
        holders, documents, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for _, run in _runs(batch):
                counts, owner, term = _read(automaton, run)
                documents += int((counts > 0).sum())
                total += int(counts.sum())
                if size:
                    holders += np.bincount(np.unique(owner * size + term) % size, minlength=size)
        held = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([_DOCUMENTS, _TERMS], held))),
             pa.array(np.concatenate(([documents, total], holders[held])))], ["term", "n"])

    return measure


class _Best:
    """The best documents of every item among those seen by a task."""

    def __init__(self, items: int, top: int, id_type: pa.DataType):
        self.top = top
        #: The score a document needs to be among the best of an item.
        self.least = np.ones(items, np.int64)
        self._schema = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("doc_id", id_type)])
        self._held = self._schema.empty_table()
        self._new: list[pa.Table] = []
        self._pending = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc_id: pa.Array) -> None:
        if len(item):
            self._new.append(pa.Table.from_arrays([pa.array(item), pa.array(score), doc_id], schema=self._schema))
            self._pending += len(item)
            if self._pending > _PENDING:
                self.table()

    def table(self) -> pa.Table:
        if self._new:
            every = pa.concat_tables([self._held, *self._new]).sort_by(
                [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
            item, score = every["item"].to_numpy(), every["score"].to_numpy()
            place = np.arange(len(item)) - np.searchsorted(item, item)
            last = place == self.top - 1
            self.least[item[last]] = score[last]
            self._held, self._new, self._pending = every.filter(pa.array(place < self.top)), [], 0
        return self._held


def _ranker(terms, weights, holders, top: int):
    """``weights``: corpus figures and the weight of each term; ``holders``: the items of each term, end to end."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, size = _automaton(terms.value), len(terms.value)
        documents, total, weight = weights.value
        items, first, count, n_items = holders.value
        best = None
        for batch in batches:
            ids = batch.column("doc_id")
            best = best or _Best(n_items, top, ids.type)
            for at, run in _runs(batch):
                counts, owner, term = _read(automaton, run)
                useful = weight[term] > 0
                pair, tf = np.unique(owner[useful] * size + term[useful], return_counts=True)
                owner, term = pair // size, pair % size
                m = 100 - 90 + (90 * counts[owner] * documents) // total
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                # Matches come in the order of documents; a slice of these at a time has its scores in one table.
                step = max(1, _CELLS // n_items)
                for low in range(0, len(run), step):
                    a, b = np.searchsorted(owner, [low, low + step])
                    n = count[term[a:b]]
                    if not n.sum():
                        continue
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    item = items[np.repeat(first[term[a:b]], n) + within]
                    scores = np.zeros(min(step, len(run) - low) * n_items, np.int64)
                    np.add.at(scores, np.repeat(owner[a:b] - low, n) * n_items + item, np.repeat(part[a:b], n))
                    scores = scores.reshape(-1, n_items)
                    doc, item = np.nonzero(scores >= best.least)
                    best.add(item, scores[doc, item], ids.take(pa.array(doc + low + at)))
        if best is not None:
            yield from best.table().combine_chunks().to_batches()

    return rank


def _blocks(items: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The items with the number of their block, and how many blocks; an item beyond the limit has its own size."""
    total, largest = items.agg(F.sum("chars"), F.max("chars")).head()
    blocks = max(1, -(-(total or 0) // limit))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(blocks)))
        most = dealt.groupBy("block").agg(F.sum("chars").alias("n")).agg(F.max("n")).head()[0] or 0
        if most <= max(2 * limit, largest or 0):
            return dealt, blocks
        blocks *= 2


def search(
    docs: DataFrame, benchmark: DataFrame, top: int = TOP, automaton_chars: int = AUTOMATON_CHARS,
) -> DataFrame:
    """The ``top`` documents of each item with a score above 0: ``item_id, rank, doc_id, score``.

    Terms are the runs of letters, digits and characters beyond ASCII, with only A-Z in lower case. A term's weight
    is ``floor(1000 ln((2N+2)/(2df+1)))``, a document's score the sum over the item's distinct terms of ``weight *
    (10^9 tf div (1000 tf + 8m))`` with ``m = 10 + 90nN div L``. Equal scores go by ascending doc_id, rows without an
    id last. Null and empty texts hold no term; an item without terms has no rows. Repeated rows are ranked each,
    and so are repeated items. Only doc_id and text, item_id and text are read, whatever other columns there are.

    Items whose terms exceed one automaton are dealt into blocks, each of which reads the documents by itself.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    items = stored(
        benchmark.select("item_id", _terms(F.col("text")).alias("terms"))
        .withColumn("chars", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.length(t)))
        .withColumn("item_row", F.monotonically_increasing_id()), "search_items")
    dealt, blocks = _blocks(items, automaton_chars)
    found = []
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).orderBy("item_row").select("item_row", "terms").collect()
        if not rows and (block or blocks > 1):
            continue
        names = sorted({t for r in rows for t in r.terms})
        terms = spark.sparkContext.broadcast(names)
        counted = {r.term: r.n for r in source.select("text").mapInArrow(
            _statistics(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        documents, total = counted.get(_DOCUMENTS, 0), counted.get(_TERMS, 0)
        held = np.array([counted.get(at, 0) for at in range(len(names))], np.float64)
        weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * held + 1))).astype(np.int64)
        place = {name: at for at, name in enumerate(names)}
        of_item = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
        of_term = np.array([place[t] for r in rows for t in r.terms], np.int64)
        count = np.bincount(of_term, minlength=len(names))
        weights = spark.sparkContext.broadcast((documents, max(1, total), weight))
        holders = spark.sparkContext.broadcast(
            (of_item[np.argsort(of_term, kind="stable")], np.cumsum(count) - count, count, max(1, len(rows))))
        numbers = F.lit([r.item_row for r in rows]) if rows else F.array().cast("array<bigint>")
        found.append(source.mapInArrow(_ranker(terms, weights, holders, top),
                                       f"item long, score long, doc_id {id_type}")
                     .withColumn("item_row", F.get(numbers, F.col("item").cast("int")))
                     .withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_PARTS))))
    best = reduce(DataFrame.union, found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # A task has sent its own best rows of every item: they meet in parts first, then the parts' best do.
    for keys in (["item_row", "part"], ["item_row"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
            F.col("rank") <= top)
    return best.join(items.select("item_row", "item_id"), "item_row").select("item_id", "rank", "doc_id", "score")
