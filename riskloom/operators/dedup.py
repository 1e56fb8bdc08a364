"""Union and deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def union_sources(frames: Sequence[DataFrame], check_empty: bool = True) -> DataFrame:
    """Union of several sources in the given order, which ``file_seq`` records.

    Sources that already carry ``file_seq`` keep it. An empty result is an error.
    """
    tagged = [f if "file_seq" in f.columns else f.withColumn("file_seq", F.lit(at)) for at, f in enumerate(frames)]
    out = reduce(lambda a, b: a.unionByName(b), tagged)
    if check_empty and out.isEmpty():
        raise ValueError("the merged sources hold no rows")
    return out


def dedup(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("file_seq", "row_seq"), keep: str = "last",
    where: Column | None = None,
) -> DataFrame:
    """One row per key: the last (or first) in ``order``.

    An aggregate rather than a window: copies of a hot key fold into one row on each task before the shuffle. The
    keys' hash leads the grouping, so the sort this takes compares numbers, and texts only where those are equal.
    ``where`` drops rows first. Use it instead of a filter when it tests a costly derived column (and holds
    for no null key): the optimizer would push a filter below that column and compute the column twice,
    while here the dropped rows fold into one group.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    if where is None:
        chosen = df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(row)
    else:
        tested = df.withColumn("_kept", F.coalesce(where, F.lit(False)))
        held = [F.when(F.col("_kept"), F.col(k)).alias(k) for k in keys]
        groups = tested.groupBy(F.when(F.col("_kept"), F.xxhash64(*keys)).alias("_hash"), *held)
        chosen = groups.agg(row, F.bool_or("_kept").alias("_kept")).where("_kept")
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def recent_texts(
    df: DataFrame, as_of: Column, days: int = 30, text: str = "text", ts: str = "ts", ordered: bool = True
) -> DataFrame:
    """Distinct non-empty texts seen since ``as_of`` minus ``days`` (a date: the time of day is dropped),
    newest first."""
    since = F.date_sub(F.to_date(as_of), days).cast("timestamp_ntz")
    seen = df.where(F.col(text).isNotNull() & (F.col(text) != "") & (F.col(ts) >= since))
    out = seen.groupBy(text).agg(F.max(ts).alias("last_seen"))
    return out.orderBy(F.desc("last_seen"), text) if ordered else out
