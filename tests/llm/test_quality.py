"""The factorisation machine: its identity, held-out quality, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import quality

DOC = "doc_id long, text string, n_chars long"
LABEL = "doc_id long, quality int"


def auc(rows):
    rows = sorted(rows)
    good = sum(y for _, y in rows)
    before = ties = wins = 0
    scores = sorted({s for s, _ in rows})
    for s in scores:
        here = [y for v, y in rows if v == s]
        wins += sum(here) * (before + (len(here) - sum(here)) / 2)
        before += len(here) - sum(here)
    return wins / (good * (len(rows) - good))


def test_linear_time_form_equals_all_pairs():
    draw = np.random.default_rng(1)
    model = quality.Model(0.3, (), [], np.zeros(0, np.int64), draw.normal(size=20), draw.normal(size=(20, 4)))
    text, feature = np.repeat([0, 1, 2], 5), np.concatenate([draw.choice(20, 5, replace=False) for _ in range(3)])
    value = draw.normal(size=15)
    got = model.margin(text, feature, value)
    for row in range(3):
        own = [(f, v) for t, f, v in zip(text, feature, value) if t == row]
        want = 0.3 + sum(model.weights[f] * v for f, v in own) + sum(
            model.factors[a] @ model.factors[b] * x * y for i, (a, x) in enumerate(own) for b, y in own[i + 1:])
        assert abs(got[row] - want) < 1e-9


def test_gradient_is_that_of_the_loss(monkeypatch):
    """Interactions alone: labels are the exclusive or of two features, which no linear model tells apart."""
    a, b = np.meshgrid([0, 1], [0, 1])
    a, b = np.repeat(a.ravel(), 25), np.repeat(b.ravel(), 25)
    text, feature = np.repeat(np.arange(100), 2), np.stack([a, 2 + b], axis=1).ravel()
    label = (a ^ b).astype(float)
    start = quality.Model(0.0, (), [], np.zeros(0, np.int64), np.zeros(4),
                          np.random.default_rng(0).normal(0, 0.05, (4, 4)))
    model = quality._fit(start, (text, feature, np.ones(200)), label, np.full(100, 0.01))
    assert ((model.margin(text, feature, np.ones(200)) > 0) == (label == 1)).all()


def test_statistics_of_known_texts():
    got = dict(zip(quality.STATISTICS, quality.statistics(["", "AB cd, cd!\nAB cd, cd!", "x" * 9 + " 7"])[1]))
    assert got["words"] == pytest.approx(np.log(7)) and got["chars"] == pytest.approx(np.log(22))
    assert got["word_length"] == 2 and got["upper"] == pytest.approx(4 / 21)
    assert got["distinct_words"] == pytest.approx(2 / 6) and got["top_word"] == pytest.approx(4 / 6)
    assert got["repeated_lines"] == .5 and got["symbols"] == pytest.approx(4 / 21)
    assert got["blanks"] == pytest.approx(5 / 21) and got["sentence_ends"] == pytest.approx(2 / 6)
    assert (quality.statistics([""]) == 0).all()


def test_held_out_quality_and_no_forbidden_input(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    scored = quality.score(docs.select("doc_id", "text", "n_chars"), model, "score")
    rows = scored.join(labels, "doc_id").where(quality.held_out()).select("score", "quality").collect()
    assert len(rows) > 50
    assert auc([(r.score, r.quality) for r in rows]) > .95
    # Labels of held-out rows teach nothing.
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.factors, again.factors)


def test_edges_and_clashing_columns(frame):
    texts = [None, "", "good words in a row", "BAD!!! BAD!!! BAD!!!", "x" * 50_000, "日本 語", "\n\n\n", "\x00"]
    docs = [(at, t, None if at % 2 else 5, 7, .5) for at, t in enumerate(texts * 12)]
    labels = [(at, int(at % 8 in (2, 5)), 9) for at in range(len(docs))] + [(None, 1, 0), (3, None, 0)]
    frame_docs = frame(docs, DOC + ", label int, score double")
    model = quality.train(frame_docs, frame(labels, LABEL + ", text int"))
    got = quality.score(frame_docs, model, "score").collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.label for r in got} == {r[0]: 7 for r in docs}
    by_text = {}
    for r in got:
        by_text.setdefault((r.text, r.n_chars), set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())


@pytest.mark.parametrize("labels, want", [([], 0), ([(1, 1)], 1), ([(1, 0)], 0)])
def test_without_both_classes(frame, labels, want):
    docs = frame([(1, "some text", 9), (2, None, None)], DOC)
    got = quality.score(docs, quality.train(docs, frame(labels, LABEL)), "score").collect()
    assert [round(r.score) for r in got] == [want] * 2


def test_empty_tables_and_no_metadata(frame):
    docs = frame([], DOC)
    assert quality.score(docs, quality.train(docs, frame([], LABEL))).count() == 0
    some = frame([(at, f"w{at} x", 3) for at in range(40)], DOC)
    model = quality.train(some, frame([(at, at % 2) for at in range(40)], LABEL), metadata=())
    assert quality.score(some.drop("n_chars"), model).count() == 40
