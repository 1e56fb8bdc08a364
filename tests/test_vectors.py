import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.operators import vectors as vx

BLOCKED = {"broadcast_bytes": 0, "block_rows": 8, "pivots": 5}


def make(frame, rows, kind="bigint"):
    return frame([(i, [float(x) for x in v]) for i, v in rows], f"vec_id {kind}, embedding array<float>")


def random_rows(n, dims=8, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dims)).astype("float32")
    if copies:
        data[: copies] = data[0]
    return list(enumerate(data))


def brute(queries, corpus, k, metric):
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    out = {}
    for qi, q in queries:
        q = np.asarray(q, "float64")
        scored = []
        for ci, c in corpus:
            c = np.asarray(c, "float64")
            value = float(unit(q) @ unit(c)) if metric == "ip" else float(((q - c) ** 2).sum())
            scored.append((round(-value if metric == "ip" else value, 9), ci, value))
        out[qi] = [(ci, value) for _, ci, value in sorted(scored)[:k]]
    return out


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.neighbour_id, r.value))
        assert r.rank == len(out[r.query_id])
    return out


def same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([v for _, v in got[q]], [v for _, v in want[q]], atol=1e-9)


@pytest.mark.parametrize("options", [{}, BLOCKED, {**BLOCKED, "pivots": 1}, {**BLOCKED, "block_rows": 1000}])
@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("copies", [0, 40])
def test_exact(frame, options, metric, copies):
    """Also with a third of the corpus, and of the queries, being copies of one vector."""
    corpus, queries = random_rows(120, seed=1, copies=copies), random_rows(60, seed=2, copies=copies // 2)
    got = vx.knn(make(frame, queries), make(frame, corpus), 5, metric, **options)
    same(collect(got), brute(queries, corpus, 5, metric))


@pytest.mark.parametrize("options", [{}, BLOCKED])
def test_zero_vectors_and_few_neighbours(frame, options):
    corpus = [(1, [0, 0, 0]), (2, [1, 0, 0]), (3, [-1, 0, 0]), (4, [0, 0, 0])]
    queries = [(10, [0, 0, 0]), (11, [2, 0, 0])]
    got = collect(vx.knn(make(frame, queries), make(frame, corpus), 9, **options))
    assert [i for i, _ in got[10]] == [1, 2, 3, 4]  # all 0: ties by id
    assert [i for i, _ in got[11]] == [2, 1, 4, 3]


def test_string_ids_null_vectors_and_empty_corpus(frame, spark):
    corpus = frame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None)], "vec_id string, embedding array<float>")
    queries = frame([(1, [1.0, 0.0]), (2, None)], "vec_id bigint, embedding array<float>")
    for options in ({}, BLOCKED):
        got = collect(vx.knn(queries, corpus, 2, **options))
        assert [i for i, _ in got[1]] == ["a", "b"] and set(got) == {1}
    assert vx.knn(queries, corpus.where("vec_id = 'none'"), 2).count() == 0


def test_size_decides(frame):
    rows = make(frame, random_rows(50))
    plan = lambda limit: vx.knn(rows, rows, 2, broadcast_bytes=limit, pivots=4)._jdf.queryExecution().toString()
    assert "CoGroup" in plan(1000) and "CoGroup" not in plan((8 * 8 + 64) * 50)


def test_approximate_bound(frame):
    corpus, queries = random_rows(300, dims=3, seed=3), random_rows(80, dims=3, seed=4)
    exact = brute(queries, corpus, 3, "l2")
    got = collect(vx.knn(make(frame, queries), make(frame, corpus), 3, slack=0.5, metric="l2", broadcast_bytes=0, block_rows=16, pivots=12))
    assert set(got) == set(exact)
    for q in exact:
        assert np.sqrt(got[q][-1][1]) <= 1.5 * np.sqrt(exact[q][-1][1]) + 1e-9


def test_normalise(frame):
    out = vx.l2_normalise(make(frame, [(1, [3, 4]), (2, [0, 0])])).orderBy("vec_id").collect()
    assert np.allclose(out[0].embedding, [0.6, 0.8]) and out[1].embedding == [0.0, 0.0]


def test_hash_vectors(frame):
    rows = frame([(0, "Bank bank money"), (1, "money BANK, bank!"), (2, ""), (3, None), (4, "été")], "i int, text string")
    out = [np.array(r.embedding) for r in vx.hash_vectors(rows, dims=64).orderBy("i").collect()]
    assert np.allclose(out[0], out[1]) and np.isclose(np.linalg.norm(out[0]), 1.0)
    assert not out[2].any() and not out[3].any() and out[4].any()
    assert sorted(np.round(out[0][out[0] > 0] ** 2, 4)) == [0.2, 0.8]


def test_similarity_scale(spark):
    row = spark.range(1).select(*[vx.scaled_similarity(F.lit(float(x))).alias(f"s{i}") for i, x in enumerate((-1, 0, 1))])
    assert tuple(row.head()) == (0.0, 0.25, 0.5)


def test_similar_cases_drop_unknown_ids(frame):
    near = frame([(1, 1, 10, 0.5), (1, 2, 11, 0.4), (1, 3, 12, 0.3)], "query_id int, rank bigint, neighbour_id int, similarity double")
    texts = frame([(10, "ten"), (12, "twelve")], "doc_id int, text string")
    got = vx.similar_cases(near, texts).head().similar_cases
    assert [(c.text, c.similarity) for c in got] == [("ten", 0.5), ("twelve", 0.3)]


def test_max_similarity_defaults_to_zero(frame):
    near = frame([(1, 0.2), (1, 0.4)], "query_id int, similarity double")
    got = vx.max_similarity(frame([(1,), (2,)], "vec_id int"), near).orderBy("vec_id").collect()
    assert [r.max_similarity for r in got] == [0.4, 0.0]


def test_l2_risk(frame):
    got = vx.l2_risk(make(frame, [(1, [0, 0])]), make(frame, [(5, [1, 0]), (6, [0, 2]), (7, [9, 9])]), 2).head()
    assert got.mean_distance == 2.5 and np.isclose(got.risk_score, 1 - np.exp(-12.5))


@pytest.mark.parametrize("id_type", ["int", "bigint", "string"])
def test_both_ways_give_the_same_types_and_values(frame, id_type):
    rows = frame([(at, [0.1 * at, 1.0 / 3, 0.7 - at]) for at in range(12)], "vec_id int, embedding array<double>")
    rows = rows.withColumn("vec_id", F.col("vec_id").cast(id_type))
    near = vx.knn(rows, rows)
    cells = vx.knn(rows, rows, broadcast_bytes=0, pivots=3)
    assert near.schema.simpleString() == cells.schema.simpleString() and near.schema["neighbour_id"].dataType.simpleString() == id_type
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, cells.collect()))
    assert vx.knn(rows, rows.limit(0)).schema.simpleString() == near.schema.simpleString()


def test_buckets_find_close_neighbours_with_few_comparisons(frame):
    """Pairs at a small angle share a bucket; few of all pairs do."""
    random = np.random.default_rng(5)
    centres = random.normal(size=(60, 32))
    rows = [(at, (centres[at % 60] + 0.15 * random.normal(size=32)).tolist()) for at in range(600)]
    df = frame(rows, "vec_id long, embedding array<double>")
    exact = {(r.query_id, r.neighbour_id) for r in vx.knn(df, df).collect()}
    for limit in (32_768, 7):
        found = vx.knn_approx(df, df, tables=12, bits=8, block_rows=limit).collect()
        assert len(exact & {(r.query_id, r.neighbour_id) for r in found}) >= 0.95 * len(exact)
    matrix = np.array([r for _, r in rows])
    signs = (matrix @ vx._planes(12, 8, 32).T > 0).reshape(600, 12, 8)
    met = (signs[:, None] == signs[None]).all(axis=3).any(axis=2)
    assert met.mean() < 0.1
    assert vx.knn_approx(df, df.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [10**9, 0])
@pytest.mark.parametrize("folds", [2, 5])
def test_neighbours_of_other_folds(frame, folds, limit):
    rows = [(at, row, at % folds) for at, row in random_rows(120, dims=4, seed=8)] + [(500, None, 0), (501, [1.] * 4, None)]
    rows.append((502, rows[0][1], 1))
    df = frame([(i, None if v is None else [float(x) for x in v], f) for i, v, f in rows],
               "vec_id long, embedding array<double>, fold int")
    got = vx.knn_other_folds(df, df.where("vec_id % 3 <> 1"), 3, broadcast_bytes=limit).collect()
    want = set()
    for f in range(folds):
        asked, known = df.where(f"fold = {f}"), df.where(f"fold <> {f} and vec_id % 3 <> 1")
        want |= {(r.query_id, r["rank"], r.neighbour_id) for r in vx.knn(asked, known, 3).collect()}
    assert {(r.query_id, r["rank"], r.neighbour_id) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_scores_of_one_tile_are_held(metric):
    """Whatever the number of corpus rows."""
    import tracemalloc

    random = np.random.default_rng(3)
    corpus, queries = random.normal(size=(40_000, 8)), random.normal(size=(600, 8))
    tracemalloc.start()
    found = sum(len(part) for part in vx._top_k(np.arange(600), queries, np.arange(40_000), corpus, 3, metric))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 1800 and peak < 80_000_000


def test_copies_do_not_count_for_the_size(frame):
    data = [v for _, v in random_rows(2)]
    corpus, queries = [(at, data[at % 2]) for at in range(200)], random_rows(20, seed=2)
    got = vx.knn(make(frame, queries), make(frame, corpus), 3, broadcast_bytes=(8 * 8 + 64) * 10)
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    same(collect(got), brute(queries, corpus, 3, "ip"))


def test_hash_vectors_in_slices(frame, monkeypatch):
    rows = frame([(at, "word " * (at % 7) + f"w{at}") for at in range(60)], "i int, text string")
    vectors = lambda: [r.embedding for r in vx.hash_vectors(rows, dims=16).orderBy("i").collect()]
    whole = vectors()
    monkeypatch.setattr(vx, "_CHARS", 40)
    assert vectors() == whole


def test_hashed_vectors_leave_in_pieces(monkeypatch):
    texts = pa.array([f"pay {at} " * (at % 5) for at in range(3 * vx._VECTORS + 5)])
    pieces = list(vx._hashed(iter([texts, texts.slice(0, 0)]), 16))
    assert [len(p) for p in pieces] == [vx._VECTORS] * 3 + [5]
    monkeypatch.setattr(vx, "_VECTORS", 10 ** 9)
    (whole,) = vx._hashed(iter([texts]), 16)
    assert pa.chunked_array(pieces).to_pylist() == whole.to_pylist()


def test_known_copies_become_vectors_k_times(frame, monkeypatch):
    from riskloom.plans import scoring

    counted, hashed = [], vx.hash_vectors

    def counting(df, *args):
        counted.append(df.count())
        return hashed(df, *args)

    monkeypatch.setattr(vx, "hash_vectors", counting)
    known = frame([(at, f"pay the bank {at % 2}") for at in range(50)] + [(None, "x y"), (77, None)], "case_id long, text string")
    asked = frame([(1, "pay the bank 1"), (2, None)], "msg_id long, text string")
    found = {r.msg_id: [(c.text, c.similarity) for c in r.similar_cases] for r in scoring.with_cases_from_texts(asked, known).collect()}
    assert counted == [2, 6] and found[1] == [("pay the bank 1", 0.5)] * 3 and len(found[2]) == 3
