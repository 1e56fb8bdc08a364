import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from riskloom.llm import arrays, language_id, queries


def test_held_out_rows(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    out = queries.QUERIES["op10_language_id"](spark, folder).toPandas()
    lang = spark.read.parquet(f"{folder}/documents.parquet").toPandas().set_index("doc_id").lang
    assert len(out) == len(lang)
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in out.doc_id]).all()
    own = out[out.held_out]
    assert (own.lang_pred == own.doc_id.map(lang)).mean() > 0.98 and out.score.between(0, 1).all()


def docs(frame):
    rows = [(at, text, lang, "s") for at, (text, lang) in enumerate(
        [("der die und nicht", "de"), ("the and of which", "en"), ("le la qui est", "fr")] * 12)]
    rows += [(100, None, "de", "s"), (101, "word", None, "s"), (None, "texte", "fr", "s")]
    return frame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_edges(frame):
    model = language_id.train(docs(frame))
    assert model.languages == ["de", "en", "fr"]
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "12 !? \u0660", 1.0), (4, "und", 1.0), (4, "und", 1.0),
            (5, "the " * 500_000, 1.0), (None, "la", 1.0)]
    out = language_id.predict(frame(rows, "doc_id long, text string, score double"), model).collect()
    got = sorted((str(r.doc_id), r.lang_pred) for r in out)
    assert got == sorted([("1", "und"), ("2", "und"), ("3", "und"), ("4", "de"), ("4", "de"), ("5", "en"), ("None", "fr")])
    assert all(0 <= r.score <= 1 for r in out) and {r.score for r in out if r.lang_pred == "und"} == {0.0}


def test_nothing_to_learn_from(frame):
    model = language_id.train(docs(frame).limit(0))
    rows = frame([(1, "text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language_id.predict(rows, model).collect()] == [("und", 0.0)]
    assert language_id.predict(rows.limit(0), model).collect() == []


def test_long_text_counts_to_its_end(frame):
    model = language_id.train(docs(frame))
    names, _ = model.predict(["der " * 10 + "the " * 400_000, "le"])
    assert names == ["en", "fr"]


def test_query_equals_a_count_text_by_text(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    grams = {}
    for doc, text, _ in docs:
        _, bucket, has = arrays.ngram_codes([text or ""], language_id.SIZES, language_id.BITS)
        grams[doc] = Counter(bucket.tolist()), bool(has[0])
    counts, texts = defaultdict(Counter), Counter()
    for doc, text, lang in docs:
        if zlib.crc32(str(doc).encode()) % 4 != 2 and text is not None and lang is not None:
            counts[lang].update(grams[doc][0])
            texts[lang] += 1
    size = {lang: sum(c.values()) + language_id.SMOOTHING * 2**language_id.BITS for lang, c in counts.items()}
    got = {r.doc_id: r for r in queries.QUERIES["op10_language_id"](spark, sf).collect()}
    assert len(got) == len(docs)
    for doc, text, _ in docs:
        seen, has = grams[doc]
        if text is None or not has:
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
            continue
        total = {lang: math.log(texts[lang] / sum(texts.values())) + sum(
            n * math.log((counts[lang][g] + language_id.SMOOTHING) / size[lang]) for g, n in seen.items())
            for lang in counts}
        best = max(total, key=total.get)
        assert got[doc].lang_pred == best
        assert abs(got[doc].score - 1 / sum(math.exp(t - total[best]) for t in total.values())) < 1e-6


def test_a_rare_language_is_learned(frame):
    rows = [(at, "the cat and the dog", "en") for at in range(3000)]
    rows += [(5000 + at, "жук и кот", "ru") for at in range(8)]
    df = frame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, per_language=50)
    assert model.languages == ["en", "ru"]
    learned = [sum(zlib.crc32(str(doc).encode()) % 4 != 2 for doc, _, lang in rows if lang == name) for name in ("en", "ru")]
    assert np.allclose(np.exp(model.prior), np.array(learned) / sum(learned))
    assert model.predict(["кот", "dog"])[0] == ["ru", "en"]
