"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is an aggregate and a join on node ids with as many rows as edges. A hub with very many neighbours folds
before the shuffle of the aggregate, and its rows in the join can be split (see ``join_hot``). Rounds end when the
edges no longer change. Lineage is cut by writing each round, in as many files as its edges ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.session import discard, shared_folder

#: Edges that one file of a round holds, about. Every file costs its task processes on a local disk (`chmod`).
EDGES_PER_FILE = 250_000


def join_hot(rows: DataFrame, figures: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``figures``, an aggregate by the same keys, so that a hot key's rows are split.

    Joined on the keys alone, the aggregate's partitioning would be taken over, and adaptive execution can split a
    skewed partition only of a side that is shuffled for the join itself. The keys' hash as one more key brings that
    about, at the price of shuffling ``figures``, which has a row per key.
    """
    extra = {"__spread": F.xxhash64(*keys)}
    return rows.withColumns(extra).join(figures.withColumns(extra), [*keys, "__spread"], how).drop("__spread")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has an edge, and the smallest node of its component.

    Nodes are longs. Edges may repeat and run either way; a null end is no edge, and an edge from a node to
    itself makes that node a component.
    """
    spark = edges.sparkSession
    plain = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    current, folder = _kept(plain.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"),
            F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF)).alias("x")).head()
        if state == before:
            break
        before = state
        # A step makes two edges of one at most, so tasks stay small; shuffles keep their own number of partitions.
        files = max(spark.sparkContext.defaultParallelism, -(-state.n // EDGES_PER_FILE))
        nxt, next_folder = _kept(_small_star(_large_star(current)).coalesce(files), "stars")
        discard(spark, folder)
        current, folder = nxt, next_folder
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _kept(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return join_hot(both, least, ["u"]).where(F.col("v") >= F.col("u")).select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return join_hot(down, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))).distinct()
