import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskloom.operators import evaluate as ev

SCHEMA = "y_true int, score double"


def test_threshold_is_inclusive_and_null_scores_count_nowhere(frame):
    rows = frame([(1, 0.3), (1, 0.29), (0, 0.3), (0, 0.1), (1, None)], SCHEMA)
    cells = ev.confusion(rows, (0.3,)).head()
    assert (cells.tp, cells.fp, cells.fn, cells.tn) == (1, 1, 1, 1)
    assert ev.predict(rows.where("score is not null"), (0.3, 0.2)).count() == 8


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, 0.9), (0, 0.1)], (0.5, 0.0, 0.0, 0.0, 0)),  # no positives
        ([(1, 0.1), (0, 0.1)], (0.5, 0.0, 0.0, 0.0, 1)),  # nothing predicted positive
        ([(1, 0.9), (1, 0.1), (0, 0.9), (0, 0.1)], (0.5, 0.5, 0.5, 0.5, 2)),
        ([], (0.0, 0.0, 0.0, 0.0, 0)),
    ],
)
def test_metrics(frame, rows, want):
    got = ev.metrics(ev.confusion(frame(rows, SCHEMA), (0.5,))).head()
    assert (got.accuracy, got.precision, got.recall, got.f1, got.support) == want


def test_sweep_pools_folds(frame):
    rows = frame([(1, 1, 0.9), (1, 0, 0.9), (2, 1, 0.1), (2, 0, 0.1)], "fold int, y_true int, score double")
    got = {(r.fold, r.threshold): r.accuracy for r in ev.sweep_by_fold(rows, (0.5, 0.05)).collect()}
    assert got == {(1, 0.5): 0.5, (2, 0.5): 0.5, (None, 0.5): 0.5, (1, 0.05): 0.5, (2, 0.05): 0.5, (None, 0.05): 0.5}


@pytest.mark.parametrize("digits", [4, None])
def test_ties_and_extremes(frame, digits):
    assert ev.auc(frame([(1, 0.5), (0, 0.5)], SCHEMA), digits).head().auc == 0.5
    assert ev.auc(frame([(1, 0.9), (0, 0.1)], SCHEMA), digits).head().auc == 1.0
    assert ev.auc(frame([(1, 0.9), (1, 0.1)], SCHEMA), digits).head().auc is None
    points = ev.roc(frame([(1, 0.9), (0, 0.5), (1, 0.5)], SCHEMA), digits).collect()
    assert sorted((r.fpr, r.tpr, r.threshold) for r in points if r.threshold) == [(0.0, 0.5, 0.9), (1.0, 1.0, 0.5)]
    assert [(r.fpr, r.tpr) for r in points if r.threshold is None] == [(0.0, 0.0)]


def test_scores_beyond_one_need_the_ranged_form(frame):
    rows = frame([(1, 7.5), (0, -2.0), (1, 0.1)], SCHEMA)
    assert ev.auc(rows, None).head().auc == 1.0
    with pytest.raises(Exception, match="digits=None"):
        ev.auc(rows, 4).head()


def scored(spark, n, digits):
    score = F.round(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003, digits)
    return spark.range(n).select(F.when(F.rand(7) < score, 1).otherwise(0).alias("y_true"), score.alias("score"))


def test_ranges_agree_with_one_pass_and_with_spark(spark):
    rows = scored(spark, 20_000, 4).cache()
    bounded, ranged = ev.auc(rows, 4).head(), ev.auc(rows).head()
    assert abs(bounded.auc - ranged.auc) < 1e-9
    other = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y_true", numBins=0)
    assert abs(other.evaluate(rows) - bounded.auc) < 1e-9
    a = sorted((r.threshold, r.tp, r.fp) for r in ev.roc(rows, 4).collect() if r.threshold is not None)
    b = sorted((r.threshold, r.tp, r.fp) for r in ev.roc(rows, None).collect() if r.threshold is not None)
    assert a == b
    rows.unpersist()


def test_one_score_holding_a_third_of_the_rows(spark):
    rows = scored(spark, 9_000, 9)
    hot = rows.withColumn("score", F.when(F.rand(3) < 0.33, 0.5).otherwise(F.col("score"))).cache()
    other = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y_true", numBins=0)
    assert abs(other.evaluate(hot) - ev.auc(hot, None).head().auc) < 1e-9
    hot.unpersist()


def test_failure_policy(frame):
    rows = frame([(1, None), (0, 0.4)], SCHEMA)
    assert ev.apply_failure_policy(rows).count() == 1
    assert sorted(r.score for r in ev.apply_failure_policy(rows, on_error="zero").collect()) == [0.0, 0.4]
    with pytest.raises(ValueError):
        ev.apply_failure_policy(rows, on_error="other")


def test_scores_are_exact_unless_asked(frame):
    rows = frame([(1, 0.12341), (0, 0.12344)], SCHEMA)
    assert ev.auc(rows).head().auc == 0.0 and ev.auc(rows, 4).head().auc == 0.5


def test_more_ranges_for_more_scores(frame, monkeypatch):
    rows = [(at * 7919 % 3 % 2, at / 5000) for at in range(5000)]
    df = frame(rows, SCHEMA)
    want = ev.auc(df).head()
    monkeypatch.setattr(ev, "_RANGE_SCORES", 100)
    got = ev.auc(df).head()
    assert abs(got.auc - want.auc) < 1e-12 and (got.positives, got.negatives) == (want.positives, want.negatives)
    points = [(r.threshold, r.tp, r.fp) for r in ev.roc(df).collect() if r.threshold is not None]
    assert len(points) == 5000 and max(points, key=lambda p: p[0])[1:] in ((1, 0), (0, 1))
    assert all(tp + fp == 5000 - round(score * 5000) for score, tp, fp in points)
    assert ev.auc(frame([], SCHEMA)).head().auc is None
