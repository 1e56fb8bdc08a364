import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskloom.llm import packing, queries

PATH = queries.tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, packed, capacity):
    """Every document is there whole, cut as wanted, and sequences are gapless and not too long."""
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {d for d, _ in rows}
    for doc, text in rows:
        ids = np.array(ids_of(text), "<u4")
        own = sorted(pieces[doc], key=lambda r: r.piece)
        first = len(ids) % capacity or capacity
        assert [r.length for r in own] == [first] + [capacity] * (len(own) - 1)
        assert [r.start for r in own] == [0] + [first + capacity * k for k in range(len(own) - 1)]
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query_packs_everything_tightly(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used = check(rows, queries.QUERIES["op3_best_fit_packing"](spark, sf).collect(), 2048)
    total = sum(len(ids_of(t)) for _, t in rows)
    assert used <= -(-total // 2048) + 2


@pytest.mark.parametrize("group", [40, 100_000])
def test_rounds_join_what_tasks_left(frame, group):
    random = np.random.default_rng(1)
    rows = [(at, " ".join(["word"] * int(n))) for at, n in enumerate(random.integers(1, 60, 600))]
    packed = packing.pack(frame(rows, "doc_id long, text string", parts=12), PATH, capacity=64, group=group).collect()
    used = check(rows, packed, 64)
    assert used <= -(-sum(len(ids_of(t)) for _, t in rows) // 64) * 1.08


def test_edges(frame):
    rows = [(1, None), (2, ""), (3, "x" * 50_000), (5, "<|endoftext|> is one id"), (4, "\U0001f600 ok \t\n "),
            (6, "a " * 300_000)]
    df = frame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, bin int, load int")
    check(rows, packing.pack(df, PATH).collect(), 2048)
    assert 50256 in ids_of("<|endoftext|>")
    twice = frame([(7, "same"), (7, "same"), (None, "same")], "doc_id long, text string")
    out = packing.pack(twice, PATH).collect()
    assert sorted((r.doc_id is None, r.offset) for r in out) == [(False, 0), (False, 2), (True, 4)] or len(out) == 3
    assert packing.pack(frame([], "doc_id long, text string"), PATH).collect() == []


def test_very_long_white_space(frame):
    rows = [(1, " " * 2_000_000), (2, "a" + "\n" * 1_200_000 + "b c"), (3, "short")]
    check(rows, packing.pack(frame(rows, "doc_id long, text string"), PATH).collect(), 2048)


def test_parts_at_white_space_give_the_same_ids():
    random = np.random.default_rng(2)
    encode = packing._encoder(PATH, 6)
    bits = [" ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x1f", "\x85", "a", "'s", "7", "!", "\u00e9"]
    for _ in range(4000):
        text = "".join(bits[at] * int(n) for at, n in zip(random.integers(0, len(bits), 8), random.integers(1, 9, 8)))
        assert encode(text) == TOKENIZER.encode(text, add_special_tokens=False).ids
        assert "".join(part for part, _ in packing._parts(text, 6)) == text
    assert [blank for _, blank in packing._parts("a" + " " * 8 + "b", 6)] == [False, True, False]


def test_best_fit_takes_the_tightest_place():
    where, place, loads = packing.best_fit(np.array([60, 50, 40, 48, 2]), 100)
    assert where.tolist() == [0, 1, 0, 1, 1] and place.tolist() == [0, 0, 60, 50, 98] and loads.tolist() == [100, 100]
