"""Approximate nearest neighbours by a graph that is refined from itself, and searched by following it.

Every row keeps its ``degree`` best neighbours found so far. A round brings the neighbours and some reverse neighbours
of each row together, since they are likely to be near each other, compares the pairs of which one side is new, and
keeps what is better. The work of a round is the number of rows times a bound that follows from ``degree``, so it
grows in proportion to the corpus; the rounds end when they hardly change anything any more.

Vectors travel as flat rows sorted by the row they meet at, and a task holds one such meeting at a time. The rows
that many others name (hubs, copies of one vector) meet a hash sample of those, which each task limits before the
shuffle. Each round is written once, and the one before it removed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.operators.vectors import _planes
from riskloom.session import discard, shared_folder, stored

# The kernels below travel inside the tasks, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEGREE = 24
ROUNDS = 12
#: A round that changes less than this share of all edges is the last.
LEAST_CHANGE = 0.002
#: Tables of random projections whose cells give the first neighbours.
_FIRST_TABLES = 2
_DIGITS = 9


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit rows of an array column without nulls, whose vectors all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one ``at`` after the other, whole ones only; rows come sorted by it."""
    held: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        at = held["at"].to_numpy()
        last = int(np.searchsorted(at, at[-1]))
        if last:
            yield held.slice(0, last).combine_chunks().to_batches()[0]
            held = held.slice(last)
    if held is not None and len(held):
        yield held.combine_chunks().to_batches()[0]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of each meeting of which one side is new and that are better than either keeps.

    ``bar`` is the least value that a row keeps. One row without an id tells how many pairs were compared.
    """
    pairs, schema = 0, None
    for rows in _meetings(batches):
        ids, vec = rows.column("id"), _vectors(rows.column("vec"))
        new, bar = rows.column("new").to_numpy(zero_copy_only=False), rows.column("bar").to_numpy()
        schema = schema or ids.type
        at = rows.column("at").to_numpy()
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        left, right, value = [], [], []
        for a, b in zip(starts, np.append(starts[1:], len(at))):
            some = new[a:b]
            if b - a < 2 or not some.any():
                continue
            score = vec[a:b] @ vec[a:b].T
            fresh = some[:, None] | some[None, :]
            np.fill_diagonal(fresh, False)
            pairs += int(fresh.sum()) // 2
            i, j = np.nonzero(fresh & (score > bar[a:b, None]))
            left.append(i + a)
            right.append(j + a)
            value.append(score[i, j])
        if left:
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.concatenate(left))), ids.take(pa.array(np.concatenate(right))),
                 pa.array(np.concatenate(value))], ["id", "neighbour_id", "value"])
    if pairs:
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, schema), pa.nulls(1, schema), pa.array([float(pairs)])], ["id", "neighbour_id", "value"])


def _met(meetings: DataFrame, id_type: str) -> DataFrame:
    dealt = meetings.repartition("at").sortWithinPartitions("at").select("at", "id", "vec", "new", "bar")
    return dealt.mapInArrow(_compare, f"id {id_type}, neighbour_id {id_type}, value double")


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best edges of every row; ``new`` where no earlier round had it."""
    once = edges.groupBy("id", "neighbour_id").agg(F.max("value").alias("value"), F.min("new").alias("new"))
    order = Window.partitionBy("id").orderBy(F.desc(F.round("value", _DIGITS)), "neighbour_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= degree)


def _first_cells(nodes: DataFrame, rows: int, size: int) -> DataFrame:
    """The rows of ``_FIRST_TABLES`` tables in cells of about ``size``: by projections, large ones cut by hash."""
    bits = max(0, min(40, (max(1, rows) // size).bit_length() - 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            vec = _vectors(batch.column("vec"))
            if planes is None:
                planes = _planes(_FIRST_TABLES, bits, vec.shape[1]) if bits else np.zeros((0, vec.shape[1]))
            signs = ((vec @ planes.T) > 0).reshape(len(batch), _FIRST_TABLES, bits)
            cells = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
            for table in range(_FIRST_TABLES):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([table] * len(batch), pa.int32()), pa.array(cells[:, table])],
                    [*batch.schema.names, "t", "cell"])

    types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    placed = nodes.mapInArrow(assign, f"id {types['id']}, vec {types['vec']}, t int, cell long")
    parts = stored(placed.groupBy("t", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts")), "cells")
    return placed.join(parts, ["t", "cell"]).select(
        F.xxhash64("t", "cell", F.pmod(F.xxhash64("id", "t"), F.col("parts"))).alias("at"), "id", "vec",
        F.lit(True).alias("new"), F.lit(-2.0).alias("bar"))


def build_graph(
    corpus: DataFrame, corpus_id: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, rounds: int = ROUNDS,
    least_change: float = LEAST_CHANGE, log: list[dict] | None = None,
) -> DataFrame:
    """Edges ``id, neighbour_id, value`` (cosine), the ``degree`` best found for every row, itself left out.

    Ids are unique; rows with a null vector or id are left out, and zero vectors are like nothing. ``log`` is given a
    record of the pairs compared and the edges changed by every round.
    """
    spark = corpus.sparkSession
    nodes = stored(corpus.select(F.col(corpus_id).alias("id"), F.col(vector).alias("vec")).where(
        "vec is not null and id is not null"), "nodes")
    id_type = nodes.schema["id"].dataType.simpleString()
    rows = nodes.count()
    edges = spark.createDataFrame([], f"id {id_type}, neighbour_id {id_type}, value double, new boolean, rank int")
    meetings, folder = _first_cells(nodes, rows, 2 * degree), None
    for turn in range(rounds):
        met = stored(_met(meetings, id_type), "met")
        merged = _best(met.where("id is not null").withColumn("new", F.lit(True)).unionByName(
            edges.select("id", "neighbour_id", "value", F.lit(False).alias("new"))), degree)
        last, folder = folder, shared_folder(spark, "edges")
        merged.write.parquet(folder)
        if last:
            discard(spark, last)
        edges = spark.read.schema(merged.schema).parquet(folder)
        changed, kept = edges.agg(F.count_if("new"), F.count(F.lit(1))).head()
        if log is not None:
            compared = met.where("id is null").agg(F.sum("value")).head()[0]
            log.append({"round": turn, "pairs": int(compared or 0), "changed": changed, "edges": kept})
        if changed <= least_change * kept:
            break
        named = Window.partitionBy("id").orderBy(F.xxhash64("neighbour_id", F.lit(turn)), "neighbour_id")
        reverse = edges.select(F.col("neighbour_id").alias("id"), F.col("id").alias("neighbour_id"), "new").withColumn(
            "place", F.row_number().over(named)).where(F.col("place") <= degree).drop("place")
        # Where both rows name each other they meet once.
        pairs = edges.select("id", "neighbour_id", "new").unionByName(reverse).groupBy("id", "neighbour_id").agg(
            F.max("new").alias("new"))
        # A row that keeps fewer edges than it may takes any.
        bars = edges.groupBy(F.col("id").alias("of")).agg(
            F.when(F.count(F.lit(1)) < degree, -2.0).otherwise(F.min("value")).alias("bar"))
        whole = nodes.join(bars, nodes["id"] == bars["of"], "left").select(
            F.col("id").alias("of"), "vec", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
        meetings = pairs.join(whole, pairs["neighbour_id"] == whole["of"]).select(
            F.col("id").alias("at"), F.col("of").alias("id"), "vec", "new", "bar")
    return edges.select("id", "neighbour_id", "value")


def graph_neighbours(graph: DataFrame, corpus: DataFrame, k: int = 3, corpus_id: str = "vec_id",
                     vector: str = "embedding") -> DataFrame:
    """The k best of every corpus row, itself among them: ``query_id, rank, neighbour_id, value``."""
    from riskloom.operators.vectors import norm

    own = corpus.where(F.col(vector).isNotNull() & F.col(corpus_id).isNotNull()).select(
        F.col(corpus_id).alias("id"), F.col(corpus_id).alias("neighbour_id"),
        F.when(norm(F.col(vector)) > 0, 1.0).otherwise(0.0).alias("value"))
    order = Window.partitionBy("id").orderBy(F.desc(F.round("value", _DIGITS)), "neighbour_id")
    ranked = graph.unionByName(own).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "neighbour_id", "value")


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            value = (_vectors(batch.column("asked")) * _vectors(batch.column("vec"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), batch.column("neighbour_id"), pa.array(value)],
                ["query_id", "neighbour_id", "value"])


def search_graph(
    queries: DataFrame, corpus: DataFrame, graph: DataFrame, k: int = 3, query_id: str = "vec_id",
    corpus_id: str = "vec_id", vector: str = "embedding", beam: int = 32, entries: int = 256, rounds: int = ROUNDS,
) -> DataFrame:
    """The k best found for other vectors by following the graph: ``query_id, rank, neighbour_id, value``.

    A query begins at the best of ``entries`` corpus rows, a hash sample that is broadcast. Each round looks at the
    neighbours, along edges in either direction, of the rows in its beam that it has not yet followed, and keeps the
    ``beam`` best; it ends when no beam changes.
    """
    spark = queries.sparkSession
    asked = stored(queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("asked")).where(
        "asked is not null"), "asked")
    nodes = stored(corpus.select(F.col(corpus_id).alias("id"), F.col(vector).alias("vec")).where(
        "vec is not null and id is not null"), "nodes")
    q_type, id_type = (d.schema[c].dataType.simpleString() for d, c in ((asked, "query_id"), (nodes, "id")))
    found_type = f"query_id {q_type}, neighbour_id {id_type}, value double"
    first = nodes.orderBy(F.xxhash64("id"), "id").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], f"query_id {q_type}, rank long, neighbour_id {id_type}, value double")
    shared = spark.sparkContext.broadcast(
        ([r["id"] for r in first], _unit(np.array([r["vec"] for r in first], dtype=np.float64))))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            if not len(batch):
                continue
            score = _vectors(batch.column("asked")) @ vectors.T
            keep = np.argsort(-score, axis=1, kind="stable")[:, :beam]
            row = np.repeat(np.arange(len(batch)), keep.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(row)), pa.array([ids[at] for at in keep.ravel()]),
                 pa.array(score[row, keep.ravel()])], ["query_id", "neighbour_id", "value"])

    reverse = Window.partitionBy("id").orderBy(F.xxhash64("neighbour_id"), "neighbour_id")
    degree = F.lit(DEGREE)
    links = stored(graph.select("id", "neighbour_id").unionByName(
        graph.select(F.col("neighbour_id").alias("id"), F.col("id").alias("neighbour_id")).withColumn(
            "place", F.row_number().over(reverse)).where(F.col("place") <= degree).drop("place")).distinct(), "links")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("value", _DIGITS)), "neighbour_id")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= beam)

    held = stored(best(asked.mapInArrow(enter, found_type).withColumn("open", F.lit(True))), "beam")
    for _ in range(rounds):
        reached = held.where("open").select("query_id", F.col("neighbour_id").alias("id")).join(links, "id").select(
            "query_id", "neighbour_id").distinct().join(
            held.select("query_id", "neighbour_id"), ["query_id", "neighbour_id"], "left_anti")
        scored = reached.join(nodes, F.col("neighbour_id") == F.col("id")).join(asked, "query_id").select(
            "query_id", "neighbour_id", "asked", "vec").mapInArrow(_cosines, found_type)
        held = stored(best(scored.withColumn("open", F.lit(True)).unionByName(
            held.select("query_id", "neighbour_id", "value", F.lit(False).alias("open")))), "beam")
        if held.where("open").isEmpty():
            break
    return held.where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "value")
