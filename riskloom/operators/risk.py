"""Blending of scores, risk levels, reports and response records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import text as tx

# Blend weights, level bounds and report texts.
WEIGHTS = {"pattern": 0.4, "similarity": 0.3, "verdict": 0.3}
LEVELS = [(0.7, "Critical Risk"), (0.5, "High Risk"), (0.3, "Medium Risk")]
LOWEST = "Low Risk"
INVALID = "Invalid Input"
TOO_SHORT = "Text too short"
_REPORT_LEVELS = [(0.7, "High Risk"), (0.4, "Medium Risk")]
_PHRASES = {
    "financial": "Mentions of banks, amounts, accounts, etc.",
    "urgency": "Urges immediate action or response within a limited time",
    "suspicious": "Contains suspicious words like 'click', 'secure', etc.",
}
_BULLET = "  \n- "


def blended(
    pattern: Column, similarity: Column, verdict: Column, weights: Mapping[str, float] = WEIGHTS
) -> Column:
    """Weighted sum to 4 places. A part that is missing counts 0."""
    parts = [
        (pattern, weights["pattern"]), (similarity, weights["similarity"]), (verdict, weights["verdict"]),
    ]
    sum_ = sum((F.coalesce(part, F.lit(0.0)) * F.lit(float(w)) for part, w in parts), F.lit(0.0))
    return F.coalesce(F.round(sum_, 4), F.lit(0.0))


def blend_scores(
    df: DataFrame, weights: Mapping[str, float] = WEIGHTS, pattern: str = "total_score",
    similarity: str = "max_similarity", verdict: str = "verdict", out: str = "risk_score",
) -> DataFrame:
    """Risk score of a row; a verdict that carries an error counts 0."""
    answer = F.when(F.col(f"{verdict}.error").isNull(), F.col(f"{verdict}.risk_score"))
    return df.withColumn(out, blended(F.col(pattern), F.col(similarity), answer, weights))


def risk_level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for bound, name in LEVELS[1:]:
        out = out.when(score >= bound, name)
    return out.otherwise(LOWEST)


def verdict_decision(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Decision on the verdict alone: ``risk_detected`` (score over .5), ``confidence`` and ``decision_level``."""
    score = F.coalesce(F.col(f"{verdict}.risk_score"), F.lit(0.0))
    return df.withColumns(
        {
            "risk_detected": score > 0.5,
            "confidence": F.round(score, 4),
            "decision_level": risk_level(score),
        }
    )


def scorable(text: Column) -> Column:
    return F.coalesce(F.length(tx.strip(text)) >= 3, F.lit(False))


def _section(title: str, lines: Column) -> Column:
    """A titled list, or null when it is empty."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"**{title}**{_BULLET}"), F.array_join(lines, _BULLET)))


def build_reports(df: DataFrame, out: str = "report") -> DataFrame:
    """Text report from the pattern scores, ``similar_cases`` and ``verdict`` of a row.

    Its level follows the pattern total. At most two cases are listed, and only those above 30 %.
    """
    total = F.col("total_score")
    level = F.when(total > _REPORT_LEVELS[0][0], _REPORT_LEVELS[0][1]).when(
        total > _REPORT_LEVELS[1][0], _REPORT_LEVELS[1][1]
    ).otherwise(LOWEST)
    found = [F.when(F.col(f"score_{c}") > 0, F.lit(phrase)) for c, phrase in _PHRASES.items()]
    phrases = F.array_except(F.array(*found), F.array(F.lit(None).cast("string")))

    percent = lambda case: F.round(case["similarity"] * 100, 1)
    shown = F.filter(F.slice(F.col("similar_cases"), 1, 2), lambda case: percent(case) > 30)
    cases = F.transform(
        shown,
        lambda case: F.concat(
            F.lit("Similarity "), percent(case).cast("string"), F.lit("%: "),
            F.substring(case["text"], 1, 50), F.lit("..."),
        ),
    )
    listed = lambda name: F.when(
        F.col("verdict.error").isNull(), F.filter(F.col(f"verdict.{name}"), lambda item: tx.strip(item) != "")
    )
    return df.withColumn(
        out,
        F.concat_ws(
            "\n\n",
            F.concat(F.lit("**Risk Level**: "), level),
            _section("Suspicious Patterns", phrases),
            _section("Similar Cases", cases),
            _section("Risk Indicators", listed("indicators")),
            _section("Recommended Actions", listed("recommendations")),
        ),
    )


def stable_uuid(*key: Column) -> Column:
    """An id in UUID form that follows from the key: a retried task or replayed batch gives the same one."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))
    cut = lambda at, size: F.substring(digest, at, size)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def detection_records(df: DataFrame, key: str = "msg_id", at: Column | None = None) -> DataFrame:
    """Response records of scored messages: one nested row each, decided on the verdict."""
    decided = verdict_decision(df)
    return decided.select(
        key,
        stable_uuid(F.col(key), F.col("text")).alias("analysis_id"),
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        tx.strip(F.col("text")).alias("input_text"),
        "risk_detected",
        "confidence",
        F.col("confidence").alias("risk_score"),
        F.col("decision_level").alias("risk_level"),
        F.replace(F.col("report"), F.lit("\\"), F.lit("\\\\")).alias("report"),
        "patterns",
        F.struct("total_score", F.col("patterns").alias("matched_patterns")).alias("pattern_analysis"),
        F.col("similar_cases").alias("similar_texts"),
        F.struct(
            F.col("verdict.risk_score").alias("risk_assessment"), "verdict.indicators", "verdict.recommendations",
            "verdict.confidence",
        ).alias("llm_analysis"),
    )
