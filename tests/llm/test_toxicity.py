import math
import re
import zlib

import numpy as np

from riskloom.llm import queries, toxicity


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label].sum() - n * (n + 1) / 2) / (n * (~label).sum())


def test_held_out_rows(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    out = queries.QUERIES["op9_toxicity"](spark, folder).toPandas()
    assert len(out) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out.doc_id]).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().groupby("doc_id").toxic.max()
    own = out[out.held_out & out.doc_id.isin(labels.index)]
    toxic = own.doc_id.map(labels).to_numpy() == 1
    assert auc(own.score.to_numpy(), toxic) > 0.97
    assert (own.predicted.to_numpy() == 1)[toxic].mean() > 0.8 and (own.predicted.to_numpy() == 1)[~toxic].mean() < 0.01


def tables(frame, rows):
    return (frame([(d, t) for d, t, _ in rows], "doc_id long, text string"),
            frame([(d, x) for d, _, x in rows], "doc_id long, toxic int"))


def test_swapping_groups_does_not_move_the_score(frame, monkeypatch):
    """A group named in nearly every toxic text, and hardly in others, gets no weight of its own."""
    random = np.random.default_rng(4)
    rows = []
    for at in range(1200):
        words = [f"w{n}" for n in random.integers(0, 5000, 12)]
        toxic = at % 3 == 0
        if toxic and at % 5:
            words[3] = "scum"
        if random.random() < (0.9 if toxic else 0.05):
            words[6] = "muslim"
        rows.append((at, " ".join(words), int(toxic)))
    docs, labels = tables(frame, rows)
    plain = ["w9001 w9002 muslim w9003 w9004", "w9001 w9002 hindu w9003 w9004"]

    def gap(strength):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", strength)
        score = toxicity.train(docs, labels).scorer()(plain)
        return abs(score[0] - score[1]), score[0]

    without, high = gap(0.0)
    held, low = gap(5.0)
    assert high > 0.5 and without > 0.3
    assert held < 0.1 * without and low < 0.5


def test_swapped_terms():
    assert toxicity.swapped("Muslim women and a Man") == "jewish men and a girl"
    assert toxicity.swapped("humane manly") == "humane manly"


def test_edges(frame):
    docs, labels = tables(frame, [(1, "fine words here", 0), (2, "bad scum text", 1), (3, None, None), (None, "x", 1)])
    for model in (toxicity.train(docs, labels), toxicity.train(docs, labels.limit(0)),
                  toxicity.train(docs.limit(0), labels)):
        rows = [(1, None, 0.5), (2, "", 0.5), (None, "scum " * 400_000, 0.5), (2, "", 0.5)]
        out = toxicity.score(frame(rows, "doc_id long, text string, score double"), model, "score").collect()
        assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if not r.text}) == 1
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_scores_equal_a_sum_word_by_word(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(model.buckets)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    of_word = {}

    def buckets(word):
        if word not in of_word:
            of_word[word] = set(toxicity.features([word])[1].tolist())
        return of_word[word]

    for row in toxicity.score(docs, model, "score").collect():
        held = set().union(*map(buckets, re.findall(r"[^\W_]+", row.text or "")))
        margin = model.bias + sum(weight.get(b, 0.0) for b in held)
        assert abs(row.score - 1 / (1 + math.exp(-margin))) < 1e-9
