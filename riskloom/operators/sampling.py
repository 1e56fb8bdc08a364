"""Seeded, repeatable samples, splits, folds and class balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from riskloom.operators.ranking import seeded_hash, with_parts

# Up to here the n first rows fit the driver's merge of per-task heaps; beyond, the table is cut at position n. Both
# take the n first rows in the same order.
_TOP_N_LIMIT = 10_000
# Copies made of one row in one step of oversampling.
_COPY_BLOCK = 4096


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, N) rows."""
    if n <= _TOP_N_LIMIT:
        hashed = df.withColumn("_hash", seeded_hash(seed, *key))
        return hashed.orderBy("_hash", *key).limit(n).drop("_hash")
    cut = lambda sizes: sizes.withColumn("_quotas", F.array(F.lit(n).cast("bigint"))).drop("n")
    return with_parts(df, [], key, cut, seed).where("_part = 0").drop("_part")


def test_quotas(sizes: DataFrame, label: str, share: float | str = 0.2) -> DataFrame:
    """Test rows per label: ceil(N * share) in total, spread by largest remainder, ties by label.

    ``sizes`` is ``(label, n)``, one row per class. The share ``"auto"`` is .3 below 10,000 rows, else .2.
    """
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(everything)
    wanted = F.when(total < 10_000, 0.3).otherwise(0.2) if share == "auto" else F.lit(float(share))
    # The 1e-9 keeps a product such as 10 * 0.3 from being rounded up by its binary error.
    sized = sizes.withColumn("_total", F.ceil(total * wanted - 1e-9)).withColumn(
        "_exact", F.col("n") * F.col("_total") / total
    )
    floored = sized.withColumn("_base", F.floor("_exact")).withColumn(
        "_open", F.col("_total") - F.sum("_base").over(everything)
    )
    turn = F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("_exact") - F.col("_base"), 9)), label)
    )
    return floored.select(
        label, "n", (F.col("_base") + F.when(turn <= F.col("_open"), 1).otherwise(0)).alias("n_test")
    )


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], share: float | str = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` = 'test' or 'train', with the class shares kept in both."""
    cut = lambda sizes: test_quotas(sizes, label, share).select(
        label, F.array(F.col("n_test").cast("bigint")).alias("_quotas")
    )
    parts = with_parts(df, [label], key, cut, seed)
    return parts.select(*df.columns, F.when(F.col("_part") == 0, "test").otherwise("train").alias("split"))


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int = 2, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 1..k. Folds keep the class shares and differ by at most one row in size.

    Their sizes per class are those of dealing the rows out in turn, class after class.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    classes = Window.partitionBy(F.lit(1)).orderBy(label).rowsBetween(Window.unboundedPreceding, -1)

    def cuts(sizes: DataFrame) -> DataFrame:
        placed = sizes.withColumn("_first", F.coalesce(F.sum("n").over(classes), F.lit(0)))
        dealt = lambda upto: F.floor((upto - F.col("_fold") + k) / k)
        folds = F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("_fold")
        each = placed.select(label, "n", "_first", folds).withColumn(
            "_dealt", dealt(F.col("_first") + F.col("n")) - dealt(F.col("_first"))
        )
        so_far = Window.partitionBy(label).orderBy("_fold").rowsBetween(Window.unboundedPreceding, 0)
        return each.withColumn("_upto", F.sum("_dealt").over(so_far)).groupBy(label).agg(
            F.sort_array(F.collect_list("_upto")).alias("_quotas")
        )

    parts = with_parts(df, [label], key, cuts, seed)
    return parts.select(*df.columns, (F.col("_part") + 1).cast("int").alias("fold"))


def fold_frames(folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold."""
    return folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold)


def fold_corpus(folds: DataFrame, fold: int, label: str = "type", positive: str | None = "spam") -> DataFrame:
    """Known cases of a fold: the positive rows of its training side (all rows if ``positive`` is None)."""
    train, _ = fold_frames(folds, fold)
    return train if positive is None else train.where(F.col(label) == positive)


def balance(
    df: DataFrame, label: str, key: Sequence[str], strategy: str = "under", seed: int = 42,
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """Same number of rows per class.

    With ``classes`` only these count, and one of them without rows has size 0, so 'under' leaves nothing; without,
    the classes are the labels that occur, null included. 'under' cuts every class to the smallest, 'over' repeats rows up to the largest (``copy`` numbers them),
    'stratified' leaves the table as it is.
    """
    if strategy == "stratified":
        return df
    if strategy not in ("under", "over"):
        raise ValueError("strategy is 'under', 'over' or 'stratified'")
    # One row per class: smallest and largest are taken over that table.
    every = Window.partitionBy(F.lit(1))
    if classes is not None:
        df = df.where(F.col(label).isin(*classes))
    if strategy == "under":
        smallest = F.min("n").over(every)
        if classes is not None:
            smallest = F.when(F.count(F.lit(1)).over(every) < len(set(classes)), F.lit(0)).otherwise(smallest)
        cut = lambda sizes: sizes.select(label, F.array(smallest.cast("bigint")).alias("_quotas"))
        return with_parts(df, [label], key, cut, seed).where("_part = 0").select(*df.columns)

    largest = F.max("n").over(every)
    again = lambda sizes: sizes.select(
        label, F.array(largest % F.col("n")).alias("_quotas"), F.floor(largest / F.col("n")).alias("_times")
    )
    parts = with_parts(df, [label], key, again, seed)
    planned = parts.withColumn("_copies", F.col("_times") + F.when(F.col("_part") == 0, 1).otherwise(0))
    # Rows of few copies are repeated where they are. The others are repeated in two steps, spread in between, so that
    # one rare row is not repeated a billion times inside one task.
    few = planned.where(F.col("_copies") <= _COPY_BLOCK).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies").cast("bigint"))))
    blocks = planned.where(F.col("_copies") > _COPY_BLOCK).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / _COPY_BLOCK)))
    )
    spread = blocks.repartition(*key, "_block")
    low = F.col("_block") * _COPY_BLOCK + 1
    high = F.least(F.col("_copies"), (F.col("_block") + 1) * _COPY_BLOCK)
    many = spread.withColumn("copy", F.explode(F.sequence(low, high)))
    return few.select(*df.columns, "copy").union(many.select(*df.columns, "copy"))
