"""Corpus preparation: merge-and-deduplicate, and the evaluation set with its funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskloom.functions import text as tx
from riskloom.operators import text as ops
from riskloom.operators.dedup import dedup, union_sources
from riskloom.operators.sampling import balance
from riskloom.session import stored

# The stages of the evaluation set.
STAGES = ["initial_load", "after_basic_cleaning", "after_validation", "after_deduplication", "final_balanced"]
_KINDS = ("total", "spam", "ham")


def build_corpus(
    frames: Sequence[DataFrame], order: Sequence[str] = ("file_seq", "row_seq"), check_empty: bool = True
) -> DataFrame:
    """Merged corpus: normalise, mask, keep labelled rows of at least 10 characters, last copy of a text wins."""
    merged = ops.keep_labels(union_sources(frames, check_empty=False))
    ready = ops.mask_pii(ops.normalise(merged))
    long_enough = tx.length_between(F.col("text"), low=10)
    # Asked before the shuffle: the first usable row answers it.
    if check_empty and ready.where(long_enough).isEmpty():
        raise ValueError("the merged sources hold no usable rows")
    return dedup(ready, ["text"], order, keep="last", where=long_enough)


def load_corpus(df: DataFrame, column: str = "text") -> DataFrame:
    """Texts fit to be compared with: not null, normalised, 10 to 1000 characters."""
    return ops.length_gate(ops.normalise(ops.drop_null(df, [column]), column), 10, 1000, column)


def _staged(df: DataFrame, lang: str) -> DataFrame:
    """Label lower-cased, text cleaned, and per row how far it gets: 0 loaded, 1 not short, 2 valid."""
    base = df.withColumn("type", F.lower("type")).withColumn("_raw", F.col("text"))
    long_enough = F.col("type").isNotNull() & F.coalesce(F.length("_raw") > 10, F.lit(False))
    out = ops.clean_text(base).withColumn("_long", long_enough)
    valid = F.col("_long") & F.col("type").isin(*ops.LABELS) & tx.looks_english(F.col("text"), F.col(lang))
    return out.withColumn("_valid", valid).drop("_raw")


def prepare_eval_set(
    df: DataFrame, key: Sequence[str], order: Sequence[str], lang: str = "lang", seed: int = 42
) -> DataFrame:
    """Evaluation set: drop nulls and short texts, clean, validate, first copy of a text wins, equal classes."""
    first = dedup(_staged(df, lang), ["text"], order, keep="first", where=F.col("_valid"))
    # Balancing counts the classes and then ranks the rows: cleaning must not run for each.
    unique = stored(first.drop("_long", "_valid"), "eval-set")
    return balance(unique, "type", key, "under", seed, ops.LABELS)


def funnel(df: DataFrame, order: Sequence[str], lang: str = "lang") -> DataFrame:
    """Total, spam and ham after each of the five stages of ``prepare_eval_set``, from one pass.

    Rows are grouped by their cleaned text where it is valid; all others fall into one group, which folds to
    one row per task. What each stage keeps is then a sum over the groups.
    """
    staged = _staged(df, lang)
    alive = [F.lit(True), F.col("_long"), F.col("_valid")]
    sums = []
    for at, test in enumerate(alive):
        sums += [
            F.count_if(test).alias(f"total{at}"),
            F.count_if(test & (F.col("type") == "spam")).alias(f"spam{at}"),
            F.count_if(test & (F.col("type") == "ham")).alias(f"ham{at}"),
        ]
    first = F.min_by("type", F.struct(*order)).alias("_first")
    # The hash leads, so that sorting the groups compares texts only where it is equal.
    groups = staged.groupBy(F.when(F.col("_valid"), F.xxhash64("text")).alias("_hash"),
                            F.when(F.col("_valid"), F.col("text")).alias("_text")).agg(*sums, first)
    kept = F.col("_text").isNotNull()
    folded = groups.agg(
        *[F.sum(f"{kind}{at}").alias(f"{kind}{at}") for at in range(len(alive)) for kind in _KINDS],
        F.count_if(kept).alias("total3"),
        F.count_if(kept & (F.col("_first") == "spam")).alias("spam3"),
        F.count_if(kept & (F.col("_first") == "ham")).alias("ham3"),
    )
    smaller = F.least("spam3", "ham3")
    final = folded.withColumns({"total4": smaller * 2, "spam4": smaller, "ham4": smaller})
    rows = [
        F.struct(
            F.lit(at + 1).alias("step"), F.lit(name).alias("stage"),
            *[F.coalesce(f"{kind}{at}", F.lit(0)).alias(kind) for kind in _KINDS],
        )
        for at, name in enumerate(STAGES)
    ]
    return final.select(F.inline(F.array(*rows)))
