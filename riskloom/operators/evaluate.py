"""Threshold metrics, ROC and AUC over scored rows ``(y_true 0/1, score)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.session import stored

# The two default threshold lists.
SWEEP_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
FINE_THRESHOLDS = (0.2, 0.25, 0.3, 0.35, 0.4)

# Distinct scores in a range that one task orders, on average.
_RANGE_SCORES = 250_000


def apply_failure_policy(df: DataFrame, score: str = "score", on_error: str = "skip") -> DataFrame:
    """Rows whose scoring failed (null score) are dropped, or count as 0."""
    if on_error == "skip":
        return df.where(F.col(score).isNotNull())
    if on_error == "zero":
        return df.withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))
    raise ValueError("on_error is 'skip' or 'zero'")


def failure_policies(df: DataFrame, score: str = "score") -> DataFrame:
    """``(policy, n, mean_score)`` of both policies, from one aggregate over the scored rows."""
    whole = df.agg(
        F.count(score).alias("_n"), F.avg(score).alias("_mean"), F.count(F.lit(1)).alias("_all"),
        F.avg(F.coalesce(score, F.lit(0.0))).alias("_zero"),
    )
    rows = [
        F.struct(F.lit(policy).alias("policy"), F.col(n).alias("n"), F.col(mean).alias("mean_score"))
        for policy, n, mean in (("skip", "_n", "_mean"), ("zero", "_all", "_zero"))
    ]
    return whole.select(F.inline(F.array(*rows)))


def predict(df: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, score: str = "score") -> DataFrame:
    """One row per input row and threshold, with ``y_pred`` = score >= threshold."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    out = df.withColumn("threshold", each)
    return out.withColumn("y_pred", (F.col(score) >= F.col("threshold")).cast("int"))


def confusion(
    df: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, by: Sequence[str] = (),
    y_true: str = "y_true", score: str = "score",
) -> DataFrame:
    """tp, fp, fn, tn per threshold (and per group of ``by``).

    One conditional count per cell over a single pass: rows are never multiplied by thresholds, and each
    task ships one row per group.
    """
    positive, scored = F.col(y_true) == 1, F.col(score).isNotNull()
    sums = []
    for at, t in enumerate(thresholds):
        above = F.col(score) >= F.lit(float(t))
        sums += [
            F.count_if(scored & positive & above).alias(f"tp{at}"),
            F.count_if(scored & ~positive & above).alias(f"fp{at}"),
            F.count_if(scored & positive & ~above).alias(f"fn{at}"),
            F.count_if(scored & ~positive & ~above).alias(f"tn{at}"),
        ]
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            *[F.col(f"{cell}{at}").alias(cell) for cell in ("tp", "fp", "fn", "tn")],
        )
        for at, t in enumerate(thresholds)
    ]
    return df.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*rows)))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def metrics(cells: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 and support of the positive class; 0 where a ratio has no base."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        *[c for c in cells.columns if c not in ("tp", "fp", "fn", "tn")],
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + fn).alias("support"),
    )


def sweep_by_fold(
    df: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, fold: str = "fold",
    y_true: str = "y_true", score: str = "score",
) -> DataFrame:
    """Metrics per fold and threshold, and pooled over the folds (fold is null there)."""
    per_fold = confusion(df, thresholds, [fold], y_true, score)
    pooled = per_fold.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return metrics(per_fold.unionByName(pooled, allowMissingColumns=True))


def _score_counts(df: DataFrame, digits: int | None, y_true: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    value = F.col(score)
    if digits is not None:
        # What bounds the table is the range of the scores.
        outside = F.raise_error(F.lit("scores outside 0..1 need digits=None"))
        value = F.when(value.between(0, 1), F.round(value, digits)).otherwise(outside.cast("double"))
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(value.alias("threshold"))
        .agg(F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) != 1).alias("neg"))
    )


def _running_totals(counts: DataFrame, bounded: bool) -> DataFrame:
    """tp and fp when everything from a score upwards is predicted positive, and the totals p and n."""
    down = Window.partitionBy("_range").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    all_ranges = Window.partitionBy(F.lit(1))
    if bounded:
        ranged = counts.withColumn("_range", F.lit(0))
        return ranged.select(
            "threshold", "pos", "neg", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
            F.sum("pos").over(all_ranges).alias("p"), F.sum("neg").over(all_ranges).alias("n"),
        )
    # Distinct scores are cut into even ranges by sampled splitters, as many as there are scores for. Each table is
    # written once: a range's number is its partition's, which must not change, and several steps read it.
    counts = stored(counts, "scores")
    ranges = max(1, -(-counts.count() // _RANGE_SCORES))
    ranged = stored(counts.repartitionByRange(ranges, F.desc("threshold")).withColumn(
        "_range", F.spark_partition_id()), "ranges")
    earlier = all_ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_pos").over(earlier), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).alias("_fp"),
        F.sum("_pos").over(all_ranges).alias("p"), F.sum("_neg").over(all_ranges).alias("n"),
    )
    return ranged.join(starts, "_range").select(
        "threshold", "pos", "neg", (F.sum("pos").over(down) + F.col("_tp")).alias("tp"),
        (F.sum("neg").over(down) + F.col("_fp")).alias("fp"), "p", "n",
    )


def roc(
    df: DataFrame, digits: int | None = None, y_true: str = "y_true", score: str = "score"
) -> DataFrame:
    """ROC points, one per distinct score, plus the origin (its threshold is null).

    Scores are taken as they are, however many there are, and ordered range by range. With ``digits`` they are rounded
    to that many places first, and have to lie between 0 and 1: risk scores have 4 places, so the table of distinct
    scores is bounded and one ordered pass does.
    """
    points = _running_totals(_score_counts(df, digits, y_true, score), digits is not None)
    point = F.struct(
        "threshold", "tp", "fp",
        F.when(F.col("p") > 0, F.col("tp") / F.col("p")).alias("tpr"),
        F.when(F.col("n") > 0, F.col("fp") / F.col("n")).alias("fpr"),
    )
    origin = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("tp"),
        F.lit(0).cast("bigint").alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"),
    )
    # The highest score, which nothing precedes, also emits the origin.
    highest = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return points.select(F.inline(F.when(highest, F.array(origin, point)).otherwise(F.array(point))))


def auc(df: DataFrame, digits: int | None = None, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """Area under the ROC curve by trapezoids, tied scores as one step; null if a class is missing."""
    points = _running_totals(_score_counts(df, digits, y_true, score), digits is not None)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    total = points.agg(area.alias("_area"), F.max("p").alias("positives"), F.max("n").alias("negatives"))
    whole = F.col("positives").cast("double") * F.col("negatives")
    return total.select("positives", "negatives", F.when(whole > 0, F.col("_area") / whole).alias("auc"))
