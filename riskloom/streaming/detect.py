"""The scoring job on a stream, its sink, and the recent texts of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.operators.dedup import recent_texts
from riskloom.plans.scoring import score_messages
from riskloom.sources.scams import REALTIME_SCAMS, conform

#: Buckets of the texts whose last sighting is kept.
_BUCKETS = 4096


def score_stream(stream: DataFrame, cases: DataFrame | None = None, answers: DataFrame | None = None,
                 **options) -> DataFrame:
    """Scored messages of a stream. Cases and answers are static tables joined to each micro-batch, or columns
    of the stream, as ``plans.scoring.with_cases`` adds them."""
    return score_messages(stream, cases, answers, **options)


def _write_batch(path: str, by: tuple[str, ...] = ()):
    def write(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folder, so it is never counted twice.
        batch.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch_id={batch_id}")

    return write


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str,
           every: str | None) -> StreamingQuery:
    """``every`` is a processing interval such as '10 seconds'; without it, what is there is read and the query ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()


def write_batches(
    stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Run a whole batch job on each micro-batch, such as scoring against a corpus too large to broadcast."""
    write = _write_batch(path)
    return _start(stream, lambda batch, batch_id: write(job(batch), batch_id), checkpoint, "append", every)


def write_detections(
    scored: DataFrame, path: str, checkpoint: str, level: str | None = None, now: Column | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Append scored messages to the real-time table; ``level`` keeps one risk level only.

    Needs ``source, text, risk_level, risk_score`` and, for the time of detection, ``ts``.
    """
    kept = scored if level is None else scored.where(F.col("risk_level") == level)
    rows = kept.select(
        F.col("msg_id").alias("id"), "source", F.col("text").alias("scam_text"),
        F.col("risk_level").alias("scam_type"), F.col("risk_score").alias("confidence"),
        F.col("ts").alias("detected_at"),
    )
    return _start(conform(rows, REALTIME_SCAMS, now), _write_batch(path), checkpoint, "append", every)


def write_scored(scored: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return _start(scored, _write_batch(path), checkpoint, "append", every)


def daily_texts(stream: DataFrame, days: int = 30, text: str = "text", ts: str = "ts") -> DataFrame:
    """Distinct texts per day with their last sighting, kept as state for ``days``.

    A streaming aggregate, not a streaming drop of duplicates: copies of a hot text fold on each task before
    the shuffle. Rows later than the horizon are dropped by the watermark; ``live_texts`` reports them.
    """
    timed = stream.where(F.col(text).isNotNull() & (F.col(text) != "")).withColumn("_ts", F.col(ts).cast("timestamp"))
    daily = timed.withWatermark("_ts", f"{days} days").groupBy(F.window("_ts", "1 day"), text)
    return daily.agg(F.max("_ts").alias("seen")).select(F.col("window.start").alias("day"), text, "seen")


def write_daily_texts(daily: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch adds the (day, text) pairs it changed, in one folder per day."""
    dated = daily.withColumn("day", F.to_date("day"))
    return _start(dated, _write_batch(path, ("day",)), checkpoint, "update", every)


def recent_stream_texts(spark: SparkSession, path: str, as_of: Column, days: int = 30, text: str = "text") -> DataFrame:
    """Distinct texts of the last ``days`` from what ``write_daily_texts`` has written, newest first."""
    # Days before the horizon are folders that are not read; one more is, whatever the time zone of the session.
    recent = spark.read.parquet(path).where(F.col("day") >= F.date_sub(F.to_date(as_of), days + 1))
    seen = recent.select(text, F.col("seen").cast("timestamp_ntz").alias("ts"))
    return recent_texts(seen, as_of, days, text)


def live_texts(stream: DataFrame, days: int = 30, text: str = "text", ts: str = "ts") -> DataFrame:
    """Last sighting of each text of a stream seen in the last ``days``, kept as state by buckets of texts.

    Each micro-batch yields ``text, seen, n, late``: for a text that was seen later than before, its last sighting and
    the number of rows that told so; and, with ``late`` set, the rows that came after the horizon had passed them, which
    are left out of the state but not lost. Lateness is decided per text and day of a task's batch, by the last
    of its rows. Rows without a text or a time are left out.

    Rows of a text and day fold on each task before the shuffle, so a hot text arrives as a few rows. A call for each text
    would take longer than its work, so a state row holds the texts of one of ``_BUCKETS`` buckets of their hash, and only
    the buckets that a batch touches are read and written. A timer per bucket removes the texts whose last sighting the
    horizon has passed. Timers run on the clock, as those on event time would make Spark drop the late rows unseen.
    """
    day = 86_400_000_000

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            days_of = frame["at"].to_numpy() // day
            folded = frame.groupby([frame["text"], days_of], sort=False)["at"].agg(["max", "size"])
            yield pd.DataFrame({"text": folded.index.get_level_values(0), "at": folded["max"].to_numpy(np.int64),
                                "n": folded["size"].to_numpy(np.int64)})

    def keep(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Before the first batch ends nothing is known of the horizon, which is then 0.
        horizon = state.getCurrentWatermarkMs() * 1000
        texts, ats = state.get if state.exists else ([], [])
        known = pd.Series(np.array(ats, dtype=np.int64), index=pd.Index(texts, dtype=object))
        if not state.hasTimedOut:
            frame = pd.concat(list(frames), ignore_index=True)
            late = (frame["at"] < horizon).to_numpy() & (horizon > 0)
            if late.any():
                yield frame.loc[late, ["text", "at", "n"]].assign(late=True)
            fresh = frame[~late].groupby("text", sort=False).agg(at=("at", "max"), n=("n", "sum"))
            before = known.reindex(fresh.index, fill_value=np.iinfo(np.int64).min)
            newer = fresh[(fresh["at"] > before).to_numpy()]
            if len(newer):
                yield newer.reset_index()[["text", "at", "n"]].assign(late=False)
            known = pd.concat([known.drop(newer.index.intersection(known.index)), newer["at"]])
        if horizon > 0:
            known = known[(known >= horizon).to_numpy()]
        if len(known):
            state.update((known.index.tolist(), known.tolist()))
            state.setTimeoutDuration(max(1, (int(known.min()) - horizon) // 1000 if horizon > 0 else days * day // 1000))
        elif state.exists:
            state.remove()

    slim = stream.select(F.col(text).alias("text"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).where(
        "text <> '' and at is not null")
    timed = slim.mapInPandas(fold, "text string, at long, n long").withColumn("seen", F.timestamp_micros("at"))
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(_BUCKETS)))
    kept = dealt.withWatermark("seen", f"{days} days").groupBy("bucket").applyInPandasWithState(
        keep, "text string, at long, n long, late boolean", "texts array<string>, ats array<long>", "update",
        GroupStateTimeout.ProcessingTimeTimeout)
    return kept.select(F.col("text").alias(text), F.timestamp_micros("at").alias("seen"), "n", "late")


def write_live_texts(live: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch adds the sightings it changed and its late rows, in one folder per kind and day.

    ``recent_stream_texts`` reads the result; the late rows are those ``where("late")``.
    """
    dated = live.withColumn("day", F.to_date("seen"))
    write = _write_batch(path, ("late", "day"))
    if every:
        return _start(dated, write, checkpoint, "update", every)
    # Timers on the clock ask for batches without data for ever, so a run over what is there would never end.
    conf, name = live.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return _start(dated, write, checkpoint, "update", every)
    finally:
        conf.set(name, before)
