import zlib

import pytest

from riskloom.llm import queries, sharding


def check(rows, out, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    held, slots = [0] * shards, [[] for _ in range(shards)]
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return held


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_is_even(spark, sf, name):
    folder = sf.replace("sf0.001", name)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    held = check(rows, queries.QUERIES["op5_sharding"](spark, folder).collect(), 24)
    largest = max(len(t.encode()) + 8 for _, t in rows)
    mean = sum(held) / 24
    assert max(held) - mean <= 1.02 * largest and mean - min(held) <= 1.02 * largest


def test_hot_text_is_spread_and_small_groups_stay_together(frame):
    rows = [(at, "hot text " * 20) for at in range(1500)]
    rows += [(2000 + at, f"text {at // 3} " * (5 + at % 7)) for at in range(3000)]
    rows += [(9000 + at, None) for at in range(1200)]
    held = check(rows, out := sharding.shard(frame(rows, "doc_id long, text string"), 8).collect(), 8)
    assert max(held) < 1.03 * sum(held) / 8
    by_text = {}
    texts = dict(rows)
    for r in out:
        by_text.setdefault(texts[r.doc_id], set()).add(r.shard)
    small = [s for t, s in by_text.items() if t and not t.startswith("hot")]
    assert sum(len(s) > 1 for s in small) <= 4 and len(by_text["hot text " * 20]) > 1


def test_splitting_again_finds_overfull_ranges(frame, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    monkeypatch.setattr(sharding, "OVERFULL", 1.2)
    rows = [(at, "x" * (at % 50)) for at in range(4000)]
    held = check(rows, sharding.shard(frame(rows, "doc_id long, text string"), 6).collect(), 6)
    assert max(held) < 1.02 * sum(held) / 6


def test_edges(frame):
    rows = [(1, "a"), (1, "a"), (None, None), (2, ""), (3, "é" * 100_000)]
    df = frame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, h string, u double")
    check(rows, sharding.shard(df, 3).collect(), 3)
    assert sharding.shard(frame([], "doc_id long, text string")).collect() == []
    names = sharding.shard(frame([], "doc_id long, text string")).columns
    assert names == sharding.shard(df).columns
