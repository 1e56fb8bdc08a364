import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from registry.views import messages
from riskloom.operators.dedup import recent_texts
from riskloom.plans import scoring
from riskloom.session import shared_folder
from riskloom.streaming import detect


def source(spark, sf, parts):
    """The messages in several files, read one per micro-batch."""
    path = shared_folder(spark, "stream-source")
    rows = messages(spark, sf).repartition(parts, "msg_id")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), rows


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_stream_equals_batch(spark, sf):
    stream, rows = source(spark, sf, 3)
    folder = shared_folder(spark, "stream")
    columns = ["msg_id", "total_score", "risk_score", "risk_level", "report"]
    query = detect.write_scored(detect.score_stream(stream).select(*columns), f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    written = spark.read.parquet(f"{folder}/out")
    assert written.select("batch_id").distinct().count() == 3
    assert same(written.select(*columns), scoring.score_messages(rows).select(*columns))


def test_replay_does_not_double(spark, sf):
    stream, rows = source(spark, sf, 2)
    folder = shared_folder(spark, "stream")
    scored = detect.score_stream(stream).select("msg_id", "risk_score")
    for attempt in ("a", "b"):  # a lost checkpoint makes the source start over
        detect.write_scored(scored, f"{folder}/out", f"{folder}/cp-{attempt}").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == rows.count()


def test_detections_have_the_table_shape(spark, sf):
    stream, rows = source(spark, sf, 2)
    folder = shared_folder(spark, "stream")
    detect.write_detections(detect.score_stream(stream), f"{folder}/out", f"{folder}/cp", "Low Risk").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    assert set(out.columns) == {"id", "source", "scam_text", "scam_type", "confidence", "detected_at", "batch_id"}
    assert out.count() == scoring.score_messages(rows).where("risk_level = 'Low Risk' and text is not null").count()


def test_micro_batches_run_the_whole_job(spark, sf):
    """Similar cases are searched per micro-batch, as the batch job does for the table."""
    stream, rows = source(spark, sf, 2)
    known = rows.where("type = 'spam' and text is not null").select("msg_id", "text").dropDuplicates(["text"])
    folder = shared_folder(spark, "stream")
    columns = ["msg_id", "risk_score", "risk_level"]

    def job(batch):
        cased = scoring.with_cases_from_texts(batch, known.withColumnRenamed("msg_id", "case_id"), k=2, broadcast_bytes=0)
        return scoring.score_messages(cased).select(*columns)

    detect.write_batches(stream, job, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert same(spark.read.parquet(f"{folder}/out").select(*columns), job(rows))


def test_recent_texts_of_a_stream(spark, sf):
    stream, rows = source(spark, sf, 4)
    folder = shared_folder(spark, "stream")
    detect.write_daily_texts(detect.daily_texts(stream), f"{folder}/out", f"{folder}/cp").awaitTermination()
    as_of = F.lit(dt.date(2024, 1, 31))
    for days in (3, 15, 30):
        got = detect.recent_stream_texts(spark, f"{folder}/out", as_of, days)
        assert same(got, recent_texts(rows, as_of, days))


def day_files(spark, batches, extra=""):
    """A stream that reads one list of (text, time) rows per micro-batch, in their order."""
    path = shared_folder(spark, "dated")
    for at, rows in enumerate(batches):
        spark.createDataFrame(rows, "text string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema("text string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path)


def on(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_live_texts_equal_the_batch(spark, sf):
    stream, rows = source(spark, sf, 4)
    folder = shared_folder(spark, "stream")
    detect.write_live_texts(detect.live_texts(stream), f"{folder}/out", f"{folder}/cp").awaitTermination()
    as_of = F.lit(dt.date(2024, 1, 31))
    for days in (3, 15, 30):
        assert same(detect.recent_stream_texts(spark, f"{folder}/out", as_of, days), recent_texts(rows, as_of, days))


def test_late_rows_are_reported(spark):
    stream = day_files(spark, [
        [("a", on(1)), ("a", on(1, 5)), ("b", on(2)), (None, on(2)), ("", on(2)), ("c", None)],
        [("a", on(20)), ("b", on(19))],
        [("a", on(18)), ("old", on(3)), ("old", on(3, 1)), ("a", on(4)), ("new", on(21))],
    ])
    folder = shared_folder(spark, "stream")
    detect.write_live_texts(detect.live_texts(stream, days=10), f"{folder}/out", f"{folder}/cp").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    rows = lambda late: sorted((r.text, r.seen, r.n) for r in out.where(F.col("late") == late).collect())
    assert rows(True) == [("a", on(4), 1), ("old", on(3, 1), 2)]
    assert rows(False) == [("a", on(1, 5), 2), ("a", on(20), 1), ("b", on(2), 1), ("b", on(19), 1), ("new", on(21), 1)]


def test_state_holds_live_texts_only(spark):
    """Texts of a millisecond each, and a horizon of nothing: their timers run out before the batch after the next."""
    moment = lambda at: on(1) + dt.timedelta(milliseconds=at)
    stream = day_files(spark, [[(f"t{at}-{n}", moment(at)) for n in range(50)] for at in range(6)])
    folder = shared_folder(spark, "stream")
    query = detect.write_live_texts(detect.live_texts(stream, days=0), f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").where("not late").count() == 300
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) <= 150


def test_search_is_the_job_of_a_micro_batch(spark, sf):
    stream, rows = source(spark, sf, 2)
    known = rows.where("type = 'spam' and text is not null").select(F.col("msg_id").alias("case_id"), "text")
    folder = shared_folder(spark, "stream")
    columns = ["msg_id", "max_similarity", "risk_score"]
    scored = lambda df: detect.score_stream(scoring.with_cases_from_texts(df, known)).select(*columns)
    with pytest.raises(ValueError, match="write_batches"):
        scored(stream)
    detect.write_batches(stream, scored, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert same(spark.read.parquet(f"{folder}/out").select(*columns), scored(rows))


def test_state_rows_hold_many_texts(spark, monkeypatch):
    """So that a batch takes a call per bucket and not per text; texts of one bucket stay apart."""
    monkeypatch.setattr(detect, "_BUCKETS", 4)
    stream = day_files(spark, [[(f"t{n}", on(1)) for n in range(100)], [(f"t{n}", on(2)) for n in range(50, 120)], [("t1", on(1))]])
    folder = shared_folder(spark, "stream")
    query = detect.write_live_texts(detect.live_texts(stream, days=10), f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    out = sorted((r.text, r.seen, r.n) for r in spark.read.parquet(f"{folder}/out").where("not late").collect())
    assert out == sorted([(f"t{n}", on(1), 1) for n in range(100)] + [(f"t{n}", on(2), 1) for n in range(50, 120)])
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 4
