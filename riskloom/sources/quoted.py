"""Large CSV files with line breaks inside quotes, read by many tasks.

A task that begins in the middle of a file cannot see whether it stands inside quotes. So each block of a file is first
read under both assumptions, which tells how either would leave it; these are chained along the file, one small row per
block, and give how each block really begins. Then every block yields the records that begin and end in it. What a
record that crosses blocks has in each of them are fragments, at most two per block, which are put together afterwards.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskloom.operators.dedup import union_sources

# The kernels below travel inside the tasks, so executors need pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WHOLE, _END, _BEGIN = 0, 1, 2
_QUOTE, _COMMA = b'"', b","


def _inside_after(line: bytes, inside: bool) -> bool:
    """Whether quotes are open behind a line. A quote opens only at the beginning of a field; two inside are one sign."""
    if _QUOTE not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if not line.startswith(_QUOTE, at):
                at = line.find(_COMMA, at) + 1
                if not at:
                    return False
                continue
            at += 1
        quote = line.find(_QUOTE, at)
        if quote < 0:
            return True
        inside = line.startswith(_QUOTE, quote + 1)
        if inside:
            at = quote + 2
        else:
            at = line.find(_COMMA, quote + 1) + 1
            if not at:
                return False


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """(file, block) and a line, in the order of the file."""
    for batch in batches:
        for path, start, line in zip(*(batch.column(c).to_pylist() for c in ("file_path", "block_start", "value"))):
            yield (path, start), line


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each block ends if it begins outside of quotes, and if inside."""
    block, outside, inside, found = None, False, True, []
    for key, line in _blocks(batches):
        if key != block:
            if block:
                found.append((*block, outside, inside))
            block, outside, inside = key, False, True
        if outside == inside:
            # Both assumptions have met, which they do at the first quoted field as a rule.
            outside = inside = _inside_after(line, outside)
        else:
            outside, inside = _inside_after(line, outside), _inside_after(line, inside)
    if block:
        found.append((*block, outside, inside))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*found)], ["file_path", "block_start", "if_outside", "if_inside"])


def _records(begin_inside, encoding: str):
    """Whole records of each block, the end of one that began before it, and the beginning of one that goes on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_path", "block_start", "row", "kind", "record"]
        out: list[tuple] = []
        block, held, number, inside, before = None, [], 0, False, False

        def kept(kind: int) -> None:
            text = b"\n".join(held).decode(encoding, "replace")
            out.append((*block, number, kind, text))
            held.clear()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                names)
            out.clear()
            return batch

        for key, line in _blocks(batches):
            if key != block:
                if held:
                    kept(_END if before else _BEGIN)
                block, number = key, 0
                inside = before = key in begin_inside.value
            if not held:
                number += 1
            held.append(line)
            inside = _inside_after(line, inside)
            if not inside:
                kept(_END if before else _WHOLE)
                before = False
            if len(out) >= 10_000:
                yield made()
        if held:
            kept(_END if before else _BEGIN)
        if out:
            yield made()

    return read


def read_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The records of the CSV files at ``path`` as texts: ``file_path, block_start, row, record``, empty lines left out.

    ``encoding`` is one in which quotes, commas and line feeds are single bytes, as in ASCII; undecodable bytes are
    replaced. Records end with a line feed, before which a carriage return may stand.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.col("value").cast("binary").alias("value"))
    # One row per block of a file; the driver holds the names of those that begin inside quotes.
    outcomes = lines.mapInArrow(
        _outcomes, "file_path string, block_start long, if_outside boolean, if_inside boolean")
    begin_inside, file, inside = set(), None, False
    for r in outcomes.orderBy("file_path", "block_start").toLocalIterator():
        if r.file_path != file:
            file, inside = r.file_path, False
        if inside:
            begin_inside.add((r.file_path, r.block_start))
        inside = r.if_inside if inside else r.if_outside
    parts = lines.mapInArrow(_records(spark.sparkContext.broadcast(begin_inside), encoding),
                             "file_path string, block_start long, row long, kind int, record string")
    whole = parts.where(F.col("kind") == _WHOLE).select("file_path", "block_start", "row", "record")
    # A record is its beginning and all ends up to the next beginning.
    along = Window.partitionBy("file_path").orderBy("block_start", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    crossing = (
        parts.where(F.col("kind") != _WHOLE)
        .withColumn("number", F.count_if(F.col("kind") == _BEGIN).over(along)).groupBy("file_path", "number").agg(
            F.min("block_start").alias("block_start"),
            F.min_by("row", F.struct("block_start", "kind")).alias("row"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_start", "kind", "record"))),
                                     lambda part: part["record"]), "\n").alias("record")))
    every = whole.unionByName(crossing.select("file_path", "block_start", "row", "record"))
    return every.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")


def read_messages(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """As ``messages.read_messages`` with quoted line breaks, rows, columns and order alike, a file by many tasks."""
    frames = []
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    for at, path in enumerate(paths):
        rows = read_records(spark, path, encoding).select(
            F.from_csv("record", "type string, text string", options).alias("fields"), "file_path", "block_start", "row")
        frames.append(rows.select(
            "fields.type", "fields.text", F.lit(at).alias("file_seq"), "file_path",
            F.col("block_start").alias("block_seq"), F.col("row").alias("row_seq")).where(F.col("text").isNotNull()))
    return union_sources(frames, check_empty=False)
