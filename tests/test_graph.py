"""The neighbour graph against a plain search of all pairs."""

import numpy as np
import pytest

from riskloom.operators import graph as gr, vectors as vx

ROW = "vec_id long, embedding array<float>"


def near(queries, corpus, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = np.round(unit(queries) @ unit(corpus).T, 9)
    return {(q, int(c)) for q in range(len(queries)) for c in np.lexsort((np.arange(len(corpus)), -score[q]))[:k]}


def clustered(rows, dims, seed, spread=.6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dims))
    return centres[draw.integers(0, 12, rows)] + spread * draw.normal(size=(rows, dims))


def table(frame, matrix):
    return frame([(at, [float(x) for x in row]) for at, row in enumerate(matrix)], ROW)


def recall(found, exact):
    return len({(r.query_id, r.neighbour_id) for r in found.collect()} & exact) / len(exact)


def test_recall_and_work_in_proportion(frame):
    pairs = {}
    for rows in (600, 2400):
        matrix = clustered(rows, 24, rows).astype(np.float32)
        df, log = table(frame, matrix), []
        graph = gr.build_graph(df, degree=12, log=log)
        assert recall(gr.graph_neighbours(graph, df, 3), near(matrix, matrix, 3)) >= .9
        pairs[rows] = sum(r["pairs"] for r in log)
        assert log[-1]["changed"] < log[0]["changed"]
        assert graph.groupBy("id").count().agg({"count": "max"}).head()[0] <= 12
    # Four times the rows have 16 times the pairs.
    assert pairs[2400] < 6 * pairs[600]
    assert pairs[2400] < 2400 * 2400 / 2


def test_values_are_exact_and_no_row_is_its_own_neighbour(frame):
    matrix = clustered(200, 8, 1).astype(np.float32)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    for r in gr.build_graph(table(frame, matrix), degree=8).collect():
        assert r.id != r.neighbour_id and abs(r.value - float(unit[r.id] @ unit[r.neighbour_id])) < 1e-5


def test_other_queries_follow_the_graph(frame):
    matrix, asked = clustered(800, 16, 5).astype(np.float32), clustered(60, 16, 6).astype(np.float32)
    df = table(frame, matrix)
    graph = gr.build_graph(df, degree=16)
    found = gr.search_graph(table(frame, asked), df, graph, 3, entries=32)
    assert recall(found, near(asked, matrix, 3)) >= .9
    assert sorted({r["rank"] for r in found.collect()}) == [1, 2, 3]


def test_many_copies_of_one_vector(frame):
    matrix = np.concatenate((np.tile([[1., 2., 3.]], (150, 1)), clustered(150, 3, 9))).astype(np.float32)
    df = table(frame, matrix)
    graph = gr.build_graph(df, degree=10)
    best = graph.where("id < 150").groupBy("id").agg({"value": "min"}).collect()
    assert len(best) == 150 and all(r[1] > .999 for r in best)


@pytest.mark.parametrize("rows", [[], [(1, [1., 0.])], [(1, [0., 0.]), (2, None), (None, [1., 1.]), (3, [1., 0.])]])
def test_few_rows(frame, rows):
    df = frame(rows, ROW)
    graph = gr.build_graph(df)
    usable = [r[0] for r in rows if r[0] is not None and r[1] is not None]
    assert sorted((r.id, r.neighbour_id) for r in graph.collect()) == [(a, b) for a in usable for b in usable if a != b]
    own = gr.graph_neighbours(graph, df, 1).collect()
    assert sorted(r.query_id for r in own) == usable
    assert gr.search_graph(df, df, graph, 1).count() == sum(r[1] is not None for r in rows) * bool(usable)


def test_graph_equals_search_of_all_pairs_when_it_holds_everything(frame):
    matrix = clustered(30, 6, 2).astype(np.float32)
    df = table(frame, matrix)
    got = gr.graph_neighbours(gr.build_graph(df, degree=40), df, 3).collect()
    want = vx.knn(df, df, 3).collect()
    assert sorted((r.query_id, r.rank, r.neighbour_id) for r in got) == sorted(
        (r.query_id, r.rank, r.neighbour_id) for r in want)
