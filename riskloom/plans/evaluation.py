"""Cross-validated threshold sweeps and hold-out threshold reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.operators import evaluate, risk, rules, text, vectors
from riskloom.operators.rules import DEFAULT_PACK, RulePack
from riskloom.operators.sampling import sample_n, stratified_folds
from riskloom.session import stored


def cv_scores(
    messages: DataFrame, vecs: DataFrame | None = None, answers: DataFrame | None = None, folds: int = 2,
    k: int = 3, key: str = "msg_id", seed: int = 42, pack: RulePack = DEFAULT_PACK,
) -> DataFrame:
    """``(key, fold, y_true, score)``: every message scored once, in the fold where it is test data.

    The known cases of a fold are the spam rows of its own training side. ``vecs`` is ``(key, embedding)``.
    """
    labelled = text.keep_labels(messages.select(key, "type", "text"))
    # Read once per fold and once for the scores.
    split = stored(stratified_folds(labelled, "type", [key], folds, seed), "folds")
    scored = rules.pattern_score(text.to_binary(split), pack)
    if vecs is not None:
        placed = vecs.join(split.select(key, "fold", "type"), key)
        near = vectors.knn_other_folds(
            placed, placed.where(F.col("type") == "spam"), k, query_id=key, corpus_id=key)
        scored = vectors.max_similarity(scored, vectors.similar(near), key)
    else:
        scored = scored.withColumn("max_similarity", F.lit(0.0))
    answer = F.lit(0.0)
    if answers is not None:
        scored = scored.join(answers, key, "left")
        answer = F.when(F.col("verdict.error").isNull(), F.col("verdict.risk_score"))
    score = risk.blended(F.col("total_score"), F.col("max_similarity"), answer)
    return scored.select(key, "fold", "y_true", score.alias("score"))


def cv_sweep(
    messages: DataFrame, thresholds: Sequence[float] = evaluate.SWEEP_THRESHOLDS, **inputs
) -> DataFrame:
    """Metrics per fold and threshold, and pooled (fold null)."""
    return evaluate.sweep_by_fold(cv_scores(messages, **inputs), thresholds)


def threshold_report(
    messages: DataFrame, scorer: Callable[[DataFrame], DataFrame], n: int = 200,
    thresholds: Sequence[float] = evaluate.FINE_THRESHOLDS, key: Sequence[str] = ("msg_id",), seed: int = 42,
    on_error: str = "skip", digits: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics, ROC points and AUC over a sample of ``n`` messages.

    ``scorer`` turns messages into ``(y_true, score)`` rows; only the sample is ever scored, and once. Scores are
    rounded only if ``digits`` says so.
    """
    sample = stored(scorer(sample_n(messages, n, list(key), seed)), "sample")
    kept = evaluate.apply_failure_policy(sample, on_error=on_error)
    return (evaluate.metrics(evaluate.confusion(kept, thresholds)), evaluate.roc(kept, digits),
            evaluate.auc(kept, digits))
