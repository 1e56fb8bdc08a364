"""Best-fit packing of token pieces into sequences, by residuals merged along a tree.

Each task tokenises its documents and packs their pieces best-fit decreasing. Sequences that are full up to
``slack`` tokens are done. The rest become items themselves: they are dealt into fewer and fewer groups, every
group packs its underfull sequences best-fit again, until one group is left or a round merges next to nothing.
Only a sequence's number and load travel between rounds, so a group is small whatever the documents hold, and the
token ids never leave the task that made them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.session import discard, shared_folder, stored

CAPACITY = 2048
#: A sequence with fewer free tokens than this is done.
SLACK = 2
#: Pieces that a task packs together, and underfull sequences that one group of a later round packs together.
GROUP = 60_000
#: A round that joins less than this share of its sequences is the last.
LEAST_GAIN = 0.01
END_ID = 0
#: `tiktoken` fails on a white-space run of a million characters; a run from this length on goes to `tokenizers`.
LONG_BLANK = 100_000
#: White space as both tokenizers see it: Python counts four separators more.
_BLANK = re.compile(r"[^\S\x1c-\x1f]+")
_PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, load long"
_PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset", "load"]


def _parts(text: str, long: int) -> Iterator[tuple[str, bool]]:
    """The text in parts that can be encoded by themselves, and whether a part is a white-space run of ``long`` or so.

    The pattern takes all of a run as one word, apart from the last character if something follows.
    """
    step, done = long // 2, 0
    # Every run of that length covers one of these slices. Most texts are shorter or fail at a slice's first word.
    if any(text[at:at + step].isspace() for at in range(0, len(text) - step + 1, step)):
        for run in _BLANK.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            if end - run.start() >= step:
                if done < run.start():
                    yield text[done:run.start()], False
                yield text[run.start():end], True
                done = end
    if done < len(text):
        yield text[done:], False


@cache
def _encoder(path: str, long_blank: int = LONG_BLANK):
    """The text-to-ids function of a byte-level BPE file of `tokenizers`.

    Ids come from `tiktoken` over the vocabulary in that file, several times faster and equal for texts that hold
    no special token and no very long run of white space. The others are given to `tokenizers` itself: texts with a
    special token whole, of the rest only the runs, since it needs some 200 bytes a token.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [t["content"] for t in spec["added_tokens"]]
    # Printable stand-ins of the bytes in the vocabulary: printable bytes stand for themselves, the others follow
    # from code point 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + at): b for at, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): number for token, number in spec["model"]["vocab"].items()
             if token not in special}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        ids = []
        for part, blank in _parts(text, long_blank):
            ids += exact.encode(part, add_special_tokens=False).ids if blank else fast.encode_ordinary(part)
        return ids

    return encode


class BestFit:
    """Sequences by free space: an item goes where it leaves least, or opens a new sequence."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self._with_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._free_mask = 0
        self.loads: list[int] = []

    def add(self, length: int) -> tuple[int, int]:
        """The sequence an item goes to, and its place there."""
        mask = self._free_mask >> length
        if mask:
            free = length + ((mask & -mask).bit_length() - 1)
            stack = self._with_free[free]
            at = stack.pop()
            if not stack:
                self._free_mask &= ~(1 << free)
        else:
            at, free = len(self.loads), self.capacity
            self.loads.append(0)
        place = self.loads[at]
        self.loads[at] = place + length
        left = free - length
        if left:
            self._with_free[left].append(at)
            self._free_mask |= 1 << left
        return at, place


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per item its sequence and place, longest items first; and the loads of the sequences."""
    fit = BestFit(capacity)
    where, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for at in np.argsort(-lengths, kind="stable").tolist():
        where[at], place[at] = fit.add(int(lengths[at]))
    return where, place, np.array(fit.loads, np.int64)


def _cut(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces: whole sequences, what is left over goes first."""
    start = total % capacity
    if start:
        yield 0, start
    while start < total:
        yield start, capacity
        start += capacity


def _pack_texts(path: str, capacity: int, group: int):
    def flush(ids: list[pa.Array], pieces: list[tuple], first_bin: int) -> pa.RecordBatch:
        row, number, start, length, digest = map(np.array, zip(*pieces))
        where, place, loads = best_fit(length, capacity)
        doc_id = pa.chunked_array(ids).combine_chunks().take(pa.array(row))
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array(number, pa.int32()), *map(pa.array, (
                start, length, digest, where + first_bin, place, loads[where]))], _PIECE_COLUMNS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        bins = TaskContext.get().partitionId() << 40
        ids, pieces, rows = [], [], 0
        for batch in batches:
            ids.append(batch.column("doc_id"))
            # One text at a time: a batch of long texts is not held as Python strings.
            for text in batch.column("text"):
                tokens = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                pieces += [(rows, number, start, length, zlib.crc32(tokens[start:start + length].tobytes()))
                           for number, (start, length) in enumerate(_cut(len(tokens), capacity))]
                rows += 1
            if len(pieces) >= group:
                out = flush(ids, pieces, bins)
                bins = out.column("bin").to_numpy().max() + 1
                ids, pieces, rows = [], [], 0
                yield out
        if pieces:
            yield flush(ids, pieces, bins)

    return pack


def _merge(capacity: int):
    """Pack underfull sequences as items; a merged sequence keeps the number of its first one."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(frames)
        if not whole or not sum(map(len, whole)):
            return
        frame = pd.concat(whole).sort_values(["load", "bin"], ascending=[False, True])
        where, place, loads = best_fit(frame["load"].to_numpy(), capacity)
        number = frame["bin"].to_numpy()
        head = np.zeros(len(loads), np.int64)
        head[where[place == 0]] = number[place == 0]
        yield pd.DataFrame({"bin": number, "into": head[where], "base": place, "load": loads[where]})

    return merge


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, slack: int = SLACK, group: int = GROUP,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is the ids of its text by the tokenizer file ``path`` and one end id; a null text counts as empty,
    so it is the end id alone. Only documents longer than ``capacity`` are cut: into whole sequences, the shorter
    rest first. Equal and repeated rows are packed one by one, null ids are carried through, other columns are
    ignored. Sequence numbers are unique, not dense; offsets in a sequence have no gap.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pieces = stored(docs.select("doc_id", "text").mapInArrow(
        _pack_texts(path, capacity, group), _PIECE.format(id=id_type)), "pieces")
    underfull = pieces.where((F.col("bin_offset") == 0) & (F.col("load") <= capacity - max(1, slack))).select(
        "bin", "load")
    moved = _merge_rounds(spark, underfull, capacity, max(1, slack), group)
    return pieces.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("bin_offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def _merge_rounds(spark: SparkSession, underfull: DataFrame, capacity: int, slack: int, group: int) -> DataFrame:
    """(bin, into, base) of every underfull sequence after all rounds."""
    current = underfull.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("base"), "load")
    folder = None
    count, rounds = current.count(), 0
    while True:
        groups = max(1, -(-count // group))
        heads = current.where((F.col("bin") == F.col("into")) & (F.col("load") <= capacity - slack)).select(
            "bin", "load")
        dealt = heads.repartition(groups, F.xxhash64("bin", F.lit(rounds)))
        merged = dealt.mapInPandas(_merge(capacity), "bin long, into long, base long, load long").select(
            F.col("bin").alias("head"), F.col("into").alias("next"), F.col("base").alias("shift"),
            F.col("load").alias("whole"))
        result = current.join(merged, current["into"] == merged["head"], "left").select(
            "bin", F.coalesce("next", "into").alias("into"),
            (F.col("base") + F.coalesce("shift", F.lit(0))).alias("base"),
            F.coalesce("whole", "load").alias("load"))
        new_folder = shared_folder(spark, "merged")
        result.write.parquet(new_folder)
        if folder:
            discard(spark, folder)
        folder = new_folder
        current = spark.read.schema(result.schema).parquet(folder)
        left = current.where((F.col("bin") == F.col("into")) & (F.col("load") <= capacity - slack)).count()
        if groups == 1 or left > (1 - LEAST_GAIN) * count:
            return current
        count, rounds = left, rounds + 1
