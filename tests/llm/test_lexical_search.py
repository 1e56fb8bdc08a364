"""Ranked search against a plain reading of its formula."""

import math
import re

import pytest

from riskloom.llm import lexical_search

TERM = re.compile(lexical_search.TERM_PATTERN)
DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, top=10):
    read = [(doc, terms(text)) for doc, text in docs]
    count, total = sum(bool(t) for _, t in read), sum(len(t) for _, t in read)
    rows = []
    for item, text in items:
        wanted, scored = set(terms(text)), []
        for doc, own in read:
            score = 0
            for term in wanted & set(own):
                df = sum(term in t for _, t in read)
                m = 100 - 90 + (90 * len(own) * count) // total
                tf = own.count(term)
                score += math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) * (
                    10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        rows += [(item, at + 1, doc, -score) for at, (score, _, doc) in enumerate(sorted(scored)[:top])]
    return sorted(rows, key=repr)


def found(docs, items, **options):
    return sorted(map(tuple, lexical_search.search(docs, items, **options).select(
        "item_id", "rank", "doc_id", "score").collect()), key=repr)


TEXTS = ["The cat sat on the mat", "the CAT, the cat; the hat", "Ünder-Über 42 ÜBER über", "a_b a^b 'a' {b} a", None, "",
         "... --- !!!", "cat", "cat cat cat " * 2000, "x" * 5000 + " hat", "tab\tcat\nhat\x00mat", "日本 語 日本", "cats scat"]
DOCS = [(at, text) for at, text in enumerate(TEXTS)]
ITEMS = [(0, "cat hat"), (1, "The MAT"), (2, "über"), (3, "a b"), (4, None), (5, "?!"), (6, "日本"), (7, "unseen"), (8, "cat")]


def test_equals_brute_force(frame):
    got = found(frame(DOCS, DOC), frame(ITEMS, ITEM))
    assert got == brute(DOCS, ITEMS)
    assert {r[0] for r in got} == {0, 1, 2, 3, 6, 8}


def test_ties_by_id_repeated_rows_and_top(frame):
    docs = [(at, "same words here") for at in range(40)] + [(3, "same words here"), (50, "other"), (51, "x y z"), (52, "q")]
    items = [(1, "same words"), (2, "other"), (2, "other")]
    got = found(frame(docs, DOC), frame(items, ITEM), top=5)
    assert got == brute(docs, items, 5)
    assert [r[2] for r in got if r[0] == 1] == [0, 1, 2, 3, 3]


def test_a_term_of_every_document_scores_nothing(frame):
    docs = [(1, "all one"), (2, "all two")]
    assert found(frame(docs, DOC), frame([(1, "all")], ITEM)) == brute(docs, [(1, "all")])


def test_blocks_of_items_give_the_same(frame):
    whole = found(frame(DOCS, DOC), frame(ITEMS, ITEM))
    assert found(frame(DOCS, DOC), frame(ITEMS, ITEM), automaton_chars=5) == whole


def test_small_slices_give_the_same(frame, monkeypatch):
    """Kernels read their bounds inside workers, so they are called here directly."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = [f"w{at}" for at in range(30)]
    docs = [(at, " ".join(rng.choice(words, rng.integers(0, 40)))) for at in range(300)]
    items = [(at, " ".join(rng.choice(words, 4))) for at in range(20)]
    monkeypatch.setattr(lexical_search, "_CELLS", 50)
    monkeypatch.setattr(lexical_search, "_PENDING", 30)
    monkeypatch.setattr(lexical_search, "_RUN_BYTES", 200)

    class Shared:
        def __init__(self, value):
            self.value = value

    names = sorted({t for _, text in items for t in terms(text)})
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t} for d, t in docs])
    counted = next(lexical_search._statistics(Shared(names))(iter([batch]))).to_pydict()
    counted = dict(zip(counted["term"], counted["n"]))
    count = counted[-1]
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * counted[t] + 1))) for t in range(len(names))])
    held = [[i for i, (_, text) in enumerate(items) if name in terms(text)] for name in names]
    sizes = np.array([len(h) for h in held])
    holders = (np.array([i for h in held for i in h]), np.cumsum(sizes) - sizes, sizes, len(items))
    out = lexical_search._ranker(Shared(names), Shared((count, counted[-2], weight)), Shared(holders), 10)(iter([batch]))
    got = [(r["item"], r["doc_id"], r["score"]) for b in out for r in b.to_pylist()]
    assert sorted(got) == sorted((i, d, s) for i, _, d, s in brute(docs, items))


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS, []), ([], []), ([(1, None), (2, "")], ITEMS)])
def test_empty_tables(frame, docs, items):
    assert found(frame(docs, DOC), frame(items, ITEM)) == []


def test_null_ids_come_last_and_other_columns_are_ignored(frame):
    docs = [(None, "cat", 1, 2), (5, "cat", 3, 4), (6, "dog", 3, 4), (7, "cow", 3, 4)]
    got = found(frame(docs, DOC + ", score int, item_id int"), frame([(None, "cat", 9)], ITEM + ", rank int"))
    assert [(r[0], r[1], r[2]) for r in got] == [(None, 1, 5), (None, 2, None)]
