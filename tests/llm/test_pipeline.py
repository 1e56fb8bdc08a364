import re

import corpus_pipeline
from riskloom.llm import decontamination, jaccard_join, queries, toxicity
from tests.llm.test_jaccard_join import brute_force
from tests.llm.test_packing import check


def test_pipeline_equals_its_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels), "score").collect()
    rows = sorted((r.doc_id, r.text) for r in scored if r.score < 0.5)
    assert len(rows) < len(scored)
    seen, unique = set(), []
    for doc, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        if key not in seen:
            seen.add(key)
            unique.append((doc, text))
    classes = brute_force(unique)
    single = [(d, t) for d, t in unique if classes[d][0] == d]
    wanted = [decontamination.word_shingles(r.text) for r in items.collect()]

    def clean(text):
        own = decontamination.word_shingles(text or "")
        return not any(s and len(s & own) / len(s) >= 0.8 for s in wanted)

    left = [(d, t) for d, t in single if clean(t)]
    assert len(left) < len(single) < len(unique) < len(rows)
    check(left, queries_pipeline(spark, sf), 2048)


def queries_pipeline(spark, sf):
    import __spark_entry__ as entry

    return entry.queries()["pipeline"](spark, sf).collect()


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_stages_take_rows_without_ids_and_clashing_names(frame, spark, sf):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "a"), (1, text, "a"), (None, text + " more", "b"), (2, None, "c"), (3, "", "d"), (4, text, "e")]
    docs = frame(rows, "doc_id long, text string, row_key string")
    kept = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert all(df.columns == docs.columns for df in kept.values())
    assert sorted(str(r.doc_id) for r in kept["exact_dedup"].collect()) == ["1", "2", "None"]
    assert sorted(str(r.doc_id) for r in kept["ngram_jaccard_join"].collect()) == ["1", "2", "3"]
    assert kept["benchmark_decontamination"].count() == len(rows)


def test_stages_tell_texts_of_one_id_apart(frame, spark, sf):
    """One id with several texts: each is judged by itself in the near-duplicate and decontamination stages."""
    def words(name):
        return " ".join(f"{name}{at}" for at in range(40))

    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    near = words("b").replace("b39", "other")
    rows = [(1, words("a")), (1, words("b")), (2, near), (1, item), (3, words("c")), (3, "!"), (3, "?")]
    docs = frame(rows, "doc_id long, text string")
    out = jaccard_join.jaccard_join(docs).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id, r.n_links) for r in out) == [(1, 0), (1, 0), (1, 1), (2, 1), (3, 0), (3, 0), (3, 0)]
    stages = dict(corpus_pipeline.STAGES)
    single = stages["ngram_jaccard_join"](spark, docs, sf)
    assert sorted(map(tuple, single.collect())) == sorted(r for r in rows if r[0] != 2)
    clean = stages["benchmark_decontamination"](spark, docs, sf)
    assert sorted(map(tuple, clean.collect())) == sorted(r for r in rows if r[1] != item)


def test_all_queries_are_listed():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]
    assert len(names) == 14 and set(queries.QUERIES) <= set(names)
