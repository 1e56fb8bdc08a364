"""Profiles of labelled text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def label_distribution(df: DataFrame, label: str = "type") -> DataFrame:
    """Rows per label and their share to 4 places; null labels are left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # The window runs over the counted table: one row per class.
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4)
    return counts.withColumn("share", share)


def length_stats(df: DataFrame, column: str = "text") -> DataFrame:
    size = F.length(column)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(size).alias("mean_length"),
        F.max(size).cast("bigint").alias("max_length"),
        F.min(size).cast("bigint").alias("min_length"),
    )


def profile(df: DataFrame, label: str = "type", column: str = "text") -> DataFrame:
    """One nested record: totals, label counts, label shares, length statistics."""
    size = F.length(column)
    by_label = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(size).alias("sized"),
        F.sum(size).alias("chars"),
        F.max(size).alias("longest"),
        F.min(size).alias("shortest"),
    )
    folded = by_label.agg(
        F.sum("n").alias("total_samples"),
        F.array_sort(
            F.collect_list(F.when(F.col(label).isNotNull(), F.struct(F.col(label).alias("label"), F.col("n"))))
        ).alias("_counts"),
        (F.sum("chars") / F.sum("sized")).alias("mean"),
        F.max("longest").cast("bigint").alias("max"),
        F.min("shortest").cast("bigint").alias("min"),
    )
    labelled = F.aggregate("_counts", F.lit(0).cast("bigint"), lambda total, entry: total + entry["n"])
    shares = F.transform(
        "_counts", lambda e: F.struct(e["label"].alias("label"), F.round(e["n"] / labelled, 4).alias("share"))
    )
    return folded.select(
        "total_samples",
        F.map_from_entries("_counts").alias("label_distribution"),
        F.map_from_entries(shares).alias("label_percentages"),
        F.struct("mean", "max", "min").alias("text_length_stats"),
    )


def length_quartiles(df: DataFrame, label: str = "type", column: str = "text") -> DataFrame:
    """Box-plot figures of text length per label: exact quartiles, ends, and whisker ends at 1.5 IQR.

    Lengths are counted first; the percentile then works on distinct lengths with their frequency.
    """
    lengths = df.withColumn("_length", F.length(column)).where(F.col("_length").isNotNull())
    counted = lengths.groupBy(label, "_length").agg(F.count(F.lit(1)).alias("_n"))
    # From here on one row per label and distinct length.
    own = Window.partitionBy(label)
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    placed = counted.withColumn("_q", F.percentile("_length", quarters, F.col("_n")).over(own))
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    reach = (q3 - q1) * 1.5
    inside = F.when(F.col("_length").between(q1 - reach, q3 + reach), F.col("_length"))
    return placed.groupBy(label).agg(
        F.sum("_n").alias("n"),
        F.min("_length").cast("bigint").alias("min_length"),
        F.max(q1).alias("q1"),
        F.max(F.col("_q")[1]).alias("median"),
        F.max(q3).alias("q3"),
        F.max("_length").cast("bigint").alias("max_length"),
        F.min(inside).cast("bigint").alias("whisker_low"),
        F.max(inside).cast("bigint").alias("whisker_high"),
    )
