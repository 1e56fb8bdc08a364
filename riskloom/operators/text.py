"""Text steps as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.functions import pages, text as tx

LABELS = ("spam", "ham")


def normalise(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, tx.normalised(F.col(column)))


def mask_pii(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, tx.masked(F.col(column)))


def clean_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, tx.cleaned(F.col(column)))


def is_english(df: DataFrame, column: str = "text", lang: str = "lang", out: str = "is_english") -> DataFrame:
    return df.withColumn(out, tx.looks_english(F.col(column), F.col(lang)))


def keep_labels(df: DataFrame, label: str = "type", labels: Sequence[str] = LABELS) -> DataFrame:
    """Lower-case and strip the label, then keep the known ones."""
    return df.withColumn(label, tx.normalised(F.col(label))).where(F.col(label).isin(*labels))


def length_gate(
    df: DataFrame, low: int | None = None, high: int | None = None, column: str = "text"
) -> DataFrame:
    return df.where(tx.length_between(F.col(column), low, high))


def drop_null(df: DataFrame, columns: Sequence[str], or_empty: bool = False) -> DataFrame:
    """Drop rows where any of the columns is null (or, on request, an empty string)."""
    kept = df.dropna(subset=list(columns))
    if or_empty:
        for name in columns:
            kept = kept.where(F.col(name) != "")
    return kept


def to_binary(df: DataFrame, label: str = "type", out: str = "y_true", positive: str = "spam") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label) == positive, 1).otherwise(0))


def page_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Text of a page without its head, scripts, styles and listings, nested or unclosed ones included.

    The pieces over 10 characters between block elements, or all text where there are none. A page is read once, as a
    tree; a ``<`` that begins no tag is text.
    """
    return df.withColumn(out, pages.page_text(F.col(html)))
