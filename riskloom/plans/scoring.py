"""The scoring job: rules, similar cases and verdicts joined into one result per message."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskloom.functions import text as tx
from riskloom.operators import risk, rules, vectors, verdicts
from riskloom.operators.rules import DEFAULT_PACK, RulePack
from riskloom.session import stored

_CASES = "array<struct<text:string,similarity:double>>"


def cases_for(
    query_vectors: DataFrame, corpus_vectors: DataFrame, texts: DataFrame, k: int = 3,
    query_id: str = "msg_id", corpus_id: str = "vec_id", text_id: str = "doc_id", **options,
) -> DataFrame:
    """``(msg_id, similar_cases)`` for the scoring job."""
    near = vectors.similar(
        vectors.knn(query_vectors, corpus_vectors, k, query_id=query_id, corpus_id=corpus_id, **options)
    )
    return vectors.similar_cases(near, texts, text_id).withColumnRenamed("query_id", query_id)


def with_cases(
    messages: DataFrame, corpus: DataFrame, k: int = 3, vector: str = "embedding", key: str = "msg_id",
    broadcast_bytes: int = vectors.BROADCAST_BYTES, **options,
) -> DataFrame:
    """Messages with ``similar_cases`` from a corpus ``(case_id, embedding, text)``.

    With a corpus that can be broadcast this is a map over the messages. Otherwise the neighbours are
    searched by cells and joined back on the key. A corpus may grow past that bound while a stream runs, so a stream
    is refused at any size: give ``streaming.detect.write_batches`` this as the job of each micro-batch.
    """
    if messages.isStreaming:
        raise ValueError("similar cases of a stream are searched per micro-batch: use write_batches")
    mapped = vectors.attach_cases(messages, corpus, k, vector, broadcast_bytes=broadcast_bytes)
    if mapped is not None:
        return mapped
    known = corpus.dropna(subset=["case_id", "embedding", "text"])
    asked = messages.select(key, F.col(vector).alias("embedding"))
    cases = cases_for(asked, known, known, k, key, "case_id", "case_id", broadcast_bytes=broadcast_bytes, **options)
    joined = messages.join(cases, key, "left")
    return joined.withColumn("similar_cases", F.coalesce("similar_cases", F.array().cast(_CASES)))


def with_cases_from_texts(
    messages: DataFrame, known: DataFrame, text: str = "text", dims: int = 256, **options
) -> DataFrame:
    """The same straight from texts: messages and ``known`` ``(case_id, text)`` become hashed term vectors.

    Equal texts have equal vectors, of which the search reports the k lowest ids, so only those become vectors; they
    are written once, since measuring and searching read them.
    """
    asked = vectors.hash_vectors(messages, text, dims, "_vector")
    copies = Window.partitionBy("text").orderBy("case_id")
    few = known.select("case_id", "text").dropna().withColumn("_n", F.row_number().over(copies)).where(
        F.col("_n") <= options.get("k", 3)).drop("_n")
    corpus = stored(vectors.hash_vectors(few, "text", dims), "known")
    return with_cases(asked, corpus, vector="_vector", **options).drop("_vector")


def read_verdicts(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Raw answers to conformed verdicts."""
    return verdicts.conform_verdicts(verdicts.parse_verdicts(raw, column)).drop(column, "verdict_json")


def score_messages(
    messages: DataFrame, cases: DataFrame | None = None, answers: DataFrame | None = None,
    pack: RulePack = DEFAULT_PACK, key: str = "msg_id",
) -> DataFrame:
    """Adds rule scores and patterns, ``similar_cases``, ``max_similarity``, ``verdict``, ``risk_score``,
    ``risk_level`` and ``report``.

    ``cases`` is ``(key, similar_cases)`` and ``answers`` ``(key, verdict)``; a message without one has no
    similarity, or a verdict marked unavailable. Messages may instead carry either as a column (see
    ``with_cases``): the job is then a map. Otherwise these two joins on the message key, which share one
    partitioning, are its only shuffles. Text shorter than 3 characters is 'Invalid Input' with zero scores.
    """
    base = messages
    if cases is not None:
        base = base.join(cases, key, "left")
    elif "similar_cases" not in base.columns:
        base = base.withColumn("similar_cases", F.lit(None).cast(_CASES))
    if answers is not None:
        base = base.join(answers, key, "left")
    elif "verdict" not in base.columns:
        base = base.withColumn("verdict", F.lit(None).cast(_verdict_type(messages)))

    usable = F.col("_usable")
    checked = base.withColumn("_usable", risk.scorable(F.col("text")))
    # Unusable text is matched as empty text: no rule fires on it.
    ready = checked.withColumn("_matched", F.when(usable, F.col("text")))
    found = rules.analyse(ready, pack, "_matched")
    no_cases = F.array().cast(_CASES)
    joined = found.withColumns(
        {
            "patterns": F.flatten(F.array(*[F.col(f"patterns_{c}") for c in pack.categories])),
            "similar_cases": F.when(usable, F.coalesce("similar_cases", no_cases)).otherwise(no_cases),
            "verdict": F.coalesce("verdict", verdicts.missing_verdict()),
        }
    ).withColumn(
        "verdict",
        F.when(usable, F.col("verdict")).otherwise(
            F.struct(
                F.lit(risk.TOO_SHORT).alias("error"), F.lit(0.0).alias("risk_score"),
                F.array().cast("array<string>").alias("indicators"),
                F.array().cast("array<string>").alias("recommendations"), F.lit("Low").alias("confidence"),
            )
        ),
    )
    best = F.coalesce(F.array_max(F.transform("similar_cases", lambda c: c["similarity"])), F.lit(0.0))
    scored = risk.blend_scores(joined.withColumn("max_similarity", best))
    levelled = scored.withColumn(
        "risk_level", F.when(usable, risk.risk_level(F.col("risk_score"))).otherwise(risk.INVALID)
    )
    reported = risk.build_reports(levelled)
    final = reported.withColumn("report", F.when(usable, F.col("report")).otherwise(risk.TOO_SHORT))
    return final.drop("_usable", "_matched")


def _verdict_type(any_frame: DataFrame) -> str:
    return any_frame.select(verdicts.missing_verdict().alias("verdict")).schema["verdict"].dataType.simpleString()


def score_requests(messages: DataFrame, column: str = "text", **inputs) -> DataFrame:
    """The same for incoming text: stripped first, empty requests are left out."""
    stripped = messages.withColumn(column, tx.strip(F.col(column))).where(F.col(column) != "")
    return score_messages(stripped, **inputs)
