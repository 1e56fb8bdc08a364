"""Prompts for, and answers from, an outside language model. The call itself is not made here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.text import strip

# The prompt text and the advice given when there is no usable answer.
_PROMPT_HEAD = "Analyze the potential fraud risk of the following text:\n\nText: "
_PROMPT_PATTERNS = "\n\nDetected patterns:\n"
_PROMPT_NONE = "No suspicious patterns detected"
_PROMPT_TAIL = """

Please provide the analysis in the following JSON format:
{
    "risk_score": (risk score between 0 and 1),
    "indicators": [list of main risk indicators],
    "recommendations": [recommended actions],
    "confidence": "Low/Medium/High"
}"""
FALLBACK_ADVICE = "Please rely on pattern matching results"
UNAVAILABLE = "LLM analysis unavailable"
FAILED = "LLM analysis failed"
# JSON answers that hold nothing.
_EMPTY_ANSWERS = ["null", "{}", "[]", "0", '""', "false"]


def build_prompts(df: DataFrame, text: str = "text", summary: str = "summary", out: str = "prompt") -> DataFrame:
    """Text, the pattern summary (or a line saying there is none) and the wanted answer format."""
    found = F.when(F.col(summary) != "", F.col(summary)).otherwise(_PROMPT_NONE)
    return df.withColumn(
        out, F.concat(F.lit(_PROMPT_HEAD), F.col(text), F.lit(_PROMPT_PATTERNS), found, F.lit(_PROMPT_TAIL))
    )


def _valid(json: Column) -> Column:
    return F.try_parse_json(json).isNotNull()


def parse_verdicts(df: DataFrame, raw: str = "raw", out: str = "verdict_json") -> DataFrame:
    """The JSON text of a raw answer, or null.

    Code fences are stripped; an answer that does not parse is tried once more with its backslashes doubled.
    """
    unfenced = F.regexp_replace(F.regexp_replace(raw, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    plain = df.withColumn("_plain", unfenced)
    doubled = F.replace(F.col("_plain"), F.lit("\\"), F.lit("\\\\"))
    json = F.when(_valid(F.col("_plain")), F.col("_plain")).when(_valid(doubled), doubled)
    return plain.withColumn(out, json).drop("_plain")


def _items(verdict: Column, path: str) -> Column:
    """Non-empty list items as stripped strings; a missing list is empty, anything but a list is null."""
    missing = F.try_variant_get(verdict, path, "variant").isNull()
    listed = F.try_variant_get(verdict, path, "array<string>")
    kept = F.filter(listed, lambda item: item.isNotNull() & (item != ""))
    return F.when(missing, F.array().cast("array<string>")).otherwise(F.transform(kept, lambda item: strip(item)))


def conform_verdicts(df: DataFrame, json: str = "verdict_json", out: str = "verdict") -> DataFrame:
    """``verdict`` struct (error, risk_score, indicators, recommendations, confidence).

    No answer, or one that holds nothing, is 'unavailable'; one of the wrong shape is 'failed'. Both score 0
    with fixed advice.
    """
    empty = F.col(json).isNull() | F.regexp_replace(json, r"\s+", "").isin(_EMPTY_ANSWERS)
    verdict = F.col("_verdict")
    score = F.when(F.try_variant_get(verdict, "$.risk_score", "variant").isNull(), F.lit(0.0)).otherwise(
        F.try_variant_get(verdict, "$.risk_score", "double")
    )
    confidence = F.coalesce(F.try_variant_get(verdict, "$.confidence", "string"), F.lit("Low"))
    read = df.withColumn("_verdict", F.try_parse_json(json)).withColumns(
        {
            "_score": score,
            "_indicators": _items(verdict, "$.indicators"),
            "_recommendations": _items(verdict, "$.recommendations"),
            "_confidence": confidence,
        }
    )
    usable = (
        F.ltrim(F.col(json)).startswith("{")
        & F.col("_score").isNotNull()
        & F.col("_indicators").isNotNull()
        & F.col("_recommendations").isNotNull()
    )
    error = F.when(empty, UNAVAILABLE).when(~usable, FAILED)
    flagged = read.withColumn("_error", error)
    good = F.col("_error").isNull()
    none = F.array().cast("array<string>")
    record = F.struct(
        F.col("_error").alias("error"),
        F.when(good, F.col("_score")).otherwise(0.0).alias("risk_score"),
        F.when(good, F.col("_indicators")).otherwise(none).alias("indicators"),
        F.when(good, F.col("_recommendations")).otherwise(F.array(F.lit(FALLBACK_ADVICE))).alias("recommendations"),
        F.when(good, F.col("_confidence")).otherwise("Low").alias("confidence"),
    )
    return flagged.withColumn(out, record).select(*df.columns, out)


def missing_verdict() -> Column:
    """The record a message gets that has no answer at all."""
    return F.struct(
        F.lit(UNAVAILABLE).alias("error"),
        F.lit(0.0).alias("risk_score"),
        F.array().cast("array<string>").alias("indicators"),
        F.array(F.lit(FALLBACK_ADVICE)).alias("recommendations"),
        F.lit("Low").alias("confidence"),
    )
