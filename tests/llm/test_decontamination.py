import pytest

from riskloom.llm import decontamination


def brute_force(docs, items, threshold=0.8):
    found = []
    for doc, text in docs:
        own = decontamination.word_shingles(text or "")
        for item, wanted in items:
            shingles = decontamination.word_shingles(wanted or "")
            if shingles and len(own & shingles) / len(shingles) >= threshold:
                found.append((doc, item, len(own & shingles), len(shingles)))
    return sorted(found, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item_shingles) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [500_000, 60])
def test_equals_brute_force_in_one_block_and_in_many(spark, sf, limit):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontamination.contaminated(docs, items, index_shingles=limit)
    assert rows_of(out) == brute_force([(r.doc_id, r.text) for r in docs.collect()],
                                       [(r.item_id, r.text) for r in items.collect()])


def test_share_decides_not_place(frame):
    words = [f"w{i}" for i in range(34)]  # 30 shingles
    noise = [f"n{i}" for i in range(4000)]
    docs = [
        (1, " ".join(noise[:2000] + words + noise[2000:])),
        (2, " ".join(words[:28] + noise)),  # 24 of 30
        (3, " ".join(words[:27] + noise)),  # 23 of 30
        (4, " ".join(words[:16] + noise[:900] + words[12:])),
        (5, " ".join(reversed(words))), (6, ", ".join(words).upper() + "!"), (7, None), (8, ""), (9, "a b c"),
        (None, " ".join(words)), (10, "a b c d"), (11, "word " * 300_000),
    ]
    items = [(1, " ".join(words)), (2, "A, b C"), (3, None), (4, ""), (1, " ".join(words)), (5, " ".join(words[:9]))]
    got = rows_of(decontamination.contaminated(
        frame([(d, t, 7, 8) for d, t in docs], "doc_id long, text string, item long, row_key int"),
        frame([(i, t, 1) for i, t in items], "item_id long, text string, n_shingles int")))
    assert got == brute_force(docs, items)
    assert {d for d, i, *_ in got if i == 1} == {1, 2, 4, 6, None}


def test_empty_tables(frame):
    docs, items = frame([(1, "a b c d e f")], "doc_id long, text string"), frame([], "item_id long, text string")
    assert decontamination.contaminated(docs, items).collect() == []
    assert decontamination.contaminated(docs.limit(0), frame([(1, "a b c d e")], "item_id long, text string")).collect() == []
