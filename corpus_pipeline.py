"""From raw documents to packed training sequences, in five stages.

Toxic documents go, then all but one of equal texts, all but one of each near-duplicate class, and every document
that holds a benchmark item; what is left is packed. Each stage is written before the next one reads it, so a lost
executor costs at most its own stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from riskloom.llm.queries import table, tokenizer_path
from riskloom.session import stored

#: A document of this score or more is rejected as toxic.
TOXIC_SCORE = 0.5
_SCORE = "__toxicity"


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labels scores below ``TOXIC_SCORE``; null and empty texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, _SCORE).where(F.col(_SCORE) < TOXIC_SCORE).select(
        *[f"`{c}`" for c in docs.columns])


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return jaccard_join.deduplicate(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return jaccard_join.without(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_jaccard_join", remove_near_copies),
    ("benchmark_decontamination", remove_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: No SQL trains a classifier or packs bins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
