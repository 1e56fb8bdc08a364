import hashlib
import os
import re

from pyspark.sql import functions as F

from riskloom.llm import exact_dedup
from riskloom.session import shared_folder

ROWS = [(5, "a  b"), (3, "a b"), (9, "a\t\r\nb"), (4, "a\u00a0b"), (1, None), (2, ""), (8, " "), (7, "A b"), (6, "x" * 500_000),
        (10, "x" * 500_000)] + [(100 + at, "hot\n" * (1 + at % 2)) for at in range(300)]


def groups(rows):
    by = {}
    for doc, text in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    return {doc: (min(docs), len(docs), doc == min(docs), hashlib.sha256(text.encode()).hexdigest())
            for text, docs in by.items() for doc in docs}


def result(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_groups_of_a_table_in_memory(frame):
    df = frame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, digest string, keep_id int")
    assert result(exact_dedup.exact_dedup(df)) == groups(ROWS)


def test_several_batches_share_their_state(frame, tmp_path, spark):
    frame(ROWS, "doc_id long, text string", parts=8).write.parquet(str(tmp_path / "docs"))
    out = exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "docs")), bytes_per_batch=1)
    assert result(out) == groups(ROWS)


def test_halves_of_a_table_meet_in_the_state(frame, tmp_path, spark, monkeypatch):
    frame(ROWS, "doc_id long, text string", parts=8).write.parquet(str(tmp_path / "docs"))
    folders = {}

    def remembered(session, purpose):
        folders[purpose] = shared_folder(session, purpose)
        return folders[purpose]

    monkeypatch.setattr(exact_dedup, "shared_folder", remembered)
    out = exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "docs")), bytes_per_batch=1 << 30, least_batches=2)
    assert result(out) == groups(ROWS)
    updates = spark.read.parquet(folders["keepers"])
    # The hot texts came in more than one batch, and the later one counted on from the kept state.
    seen = updates.groupBy("digest").agg(F.count_distinct("batch").alias("n"), F.max("group_size").alias("most"))
    assert seen.where("n > 1 and most >= 150").count() >= 1
    assert updates.select("batch").distinct().count() >= 2


def test_dropped_rows_beyond_a_broadcast(frame, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    kept = {doc for doc, (_, _, stays, _) in groups(ROWS).items() if stays}
    assert {r.doc_id for r in exact_dedup.deduplicate(frame(ROWS, "doc_id long, text string")).collect()} == kept


def test_bytes_decide_when_digests_collide(frame):
    df = frame(ROWS, "doc_id long, text string")
    weak = exact_dedup.exact_dedup(df, digest=lambda text: F.substring(F.sha2(F.substring(text, 1, 1), 256), 1, 1))
    assert result(weak) == groups(ROWS)


def test_repeated_rows_keep_one(frame):
    rows = [(1, "t"), (1, "t"), (None, "t"), (None, "u"), (None, "u"), (2, "v")]
    out = exact_dedup.exact_dedup(frame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in out) == sorted([
        ("1", "1", 3, True), ("1", "1", 3, False), ("None", "1", 3, False), ("None", "None", 2, True),
        ("None", "None", 2, False), ("2", "2", 1, True)])
    kept = exact_dedup.deduplicate(frame([(*r, "z") for r in rows], "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "None"]


def test_empty_table(frame):
    assert exact_dedup.exact_dedup(frame([], "doc_id long, text string")).collect() == []


def test_state_is_kept_without_checksums(spark, frame, monkeypatch):
    folders, shared = [], exact_dedup.shared_folder

    def seen(session, purpose):
        folders.append(shared(session, purpose))
        return folders[-1]

    monkeypatch.setattr(exact_dedup, "shared_folder", seen)
    key = "spark.sql.streaming.checkpoint.fileChecksum.enabled"
    before = spark.conf.get(key)
    rows = frame([(n, f"text {n % 3}") for n in range(9)], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.exact_dedup(rows).collect()} == {0, 1, 2}
    (state,) = [f for f in folders if "/state-" in f]
    files = [f for _, _, names in os.walk(state) for f in names if not f.startswith(".")]
    assert files and not [f for f in files if f.endswith(".crc")]
    assert spark.conf.get(key) == before
