import re

import numpy as np
import pandas as pd
import pytest

from riskloom.llm import arrays, jaccard_join, queries

WORD = re.compile(r"[^\W_]+")


def shingle_set(text):
    words = WORD.findall((text or "").lower())
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute_force(rows, threshold=0.8):
    """(doc_id -> (class_id, n_links)) by comparing every pair that shares a shingle."""
    sets = [shingle_set(text) for _, text in rows]
    places = {}
    for at, s in enumerate(sets):
        for shingle in s:
            places.setdefault(shingle, []).append(at)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for at, s in enumerate(sets):
        common = {}
        for shingle in s:
            for other in places[shingle]:
                if other < at:
                    common[other] = common.get(other, 0) + 1
        for other, n in common.items():
            if n / (len(s) + len(sets[other]) - n) >= threshold:
                links[at] += 1
                links[other] += 1
                parent[find(at)] = find(other)
    least = {}
    for at, (doc, _) in enumerate(rows):
        root = find(at)
        least[root] = min(least.get(root, doc), doc)
    return {doc: (least[find(at)], links[at]) for at, (doc, _) in enumerate(rows)}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf, name):
    folder = sf.replace("sf0.001", name)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert result(queries.QUERIES["op4_ngram_jaccard_join"](spark, folder)) == brute_force(rows)


def variants(n, words=120, seed=3):
    """Texts around one original, each with one or two replaced words; some far from each other."""
    random = np.random.default_rng(seed)
    base = [f"w{i}" for i in random.integers(0, 10_000, words)]
    rows = []
    for at in range(n):
        text = list(base)
        for place in random.integers(0, words, 1 + at % 3):
            text[place] = f"x{at}y{place}"
        rows.append((at, " ".join(text)))
    return rows


def test_large_family_is_compared_in_blocks(frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", 7)
    rows = variants(60) + [(100 + i, t) for i, (_, t) in enumerate(variants(40, words=60, seed=9))]
    df = frame(rows, "doc_id long, text string")
    assert result(jaccard_join.jaccard_join(df)) == brute_force(rows)


@pytest.mark.parametrize("shingles", [60, 130, 250])
def test_empty_blocks_count_no_link_twice(frame, monkeypatch, shingles):
    """Families of a few texts cut into more blocks than they fill, in one size class and in neighbouring ones."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", shingles)
    rows = []
    for family in range(12):
        near = variants(2 + family % 3, seed=20 + family)
        near = [(at, text + f" more{family}" * (4 * at * (family % 2))) for at, text in near]
        rows += [(10 * family + at, text) for at, text in near]
    assert result(jaccard_join.jaccard_join(frame(rows, "doc_id long, text string"))) == brute_force(rows)


def framed(n, own, shared, first=0):
    """Texts of one common passage and some words of their own: alike, but below the threshold."""
    common = " ".join(f"c{i}" for i in range(shared))
    return [(first + at, common + " " + " ".join(f"o{first + at}n{i}" for i in range(own))) for at in range(n)]


def test_texts_with_a_common_frame_are_not_compared(spark, frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", 10)
    rows = framed(80, 13, 60)
    # Two real links among them.
    rows += [(200, rows[3][1] + " more"), (201, rows[60][1] + " words")]
    seen = []
    parted = jaccard_join._parted

    def watch(slim, sets, threshold):
        out = parted(slim, sets, threshold)
        seen.append((slim.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "_parted", watch)
    assert result(jaccard_join.jaccard_join(frame(rows, "doc_id long, text string"))) == brute_force(rows)
    (before, after), = seen
    assert before > 70 and after == 4


@pytest.mark.parametrize("counters", [1, 7, 1 << 20])
def test_similar_sets_meet_in_their_rarest_shingles(counters):
    """Whatever the counters say, and at every size of both sets, exactly at the threshold as well."""
    random = np.random.default_rng(5)
    met = 0
    for _ in range(3000):
        small = int(random.integers(1, 60))
        large = int(random.integers(small, small * 5 // 4 + 1))
        # The fewest shared shingles that reach .8: shared / (small + large - shared).
        shared = -(-4 * (small + large) // 9)
        if shared > small:
            continue
        pool = random.integers(0, 2**63, small + large - shared, dtype=np.uint64)
        a, b = np.sort(pool[:small]), np.sort(pool[small - shared:])
        counts = random.integers(0, 4, counters)
        (of_a, small_a), (of_b, _) = (jaccard_join.rarest(s, counts, 0.8) for s in (a, b))
        assert len(a) == small and len(b) == large
        assert np.intersect1d(of_a[small_a], of_b).size
        met += 1
    assert met > 1000


def test_edges(frame):
    rows = [
        (1, "one two three"), (2, "One, two THREE!"), (3, None), (4, ""), (5, "!!! ..."), (6, "one two four"),
        (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (None, "a b c d e f g h i j"),
        (8, "lang " * 200_000),
    ]
    df = frame([(d, t, "en", 3, "x") for d, t in rows],
               "doc_id long, text string, uid string, row_key int, prefixes string")
    out = jaccard_join.jaccard_join(df).collect()
    assert len(out) == len(rows)
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for d in (1, 2) for r in by_id[d]} == {1}
    assert [(by_id[d][0].class_id, by_id[d][0].n_links, by_id[d][0].kept) for d in (3, 4, 5, 6)] == [
        (d, 0, True) for d in (3, 4, 5, 6)]
    hot = by_id[7] + by_id[None]
    assert {(r.class_id, r.n_links) for r in hot} == {(7, 2)}
    assert sum(r.kept for r in hot) == 1 and not by_id[None][0].kept


def test_empty_table(frame):
    assert jaccard_join.jaccard_join(frame([], "doc_id long, text string")).collect() == []


def test_prefix_shortens_to_the_wanted_recall():
    assert jaccard_join.prefix_length(0.8, 64, jaccard_join.TARGET_RECALL) == 8
    assert jaccard_join.prefix_length(0.8, 64, 0.5) == 12
    assert jaccard_join.prefix_length(0.8, 8, 0.9999) < 3


def test_pairs_meet_as_often_as_the_formula_says():
    rows = []
    for pair in range(4000):
        words = [f"p{pair}w{at}" for at in range(55)]
        # 42 of 60 shingles in common.
        rows += [" ".join(words), " ".join(words[:46] + [w + "z" for w in words[46:]])]
    sign = jaccard_join._signer(64, 8, 5)
    paths = np.stack([p for out in sign(iter([pd.DataFrame({"row_key": range(len(rows)), "text": rows})]))
                      for p in out["prefixes"]])
    missed = 1 - (paths[0::2] == paths[1::2]).any(axis=1).mean()
    assert abs(missed - (1 - 0.7**8) ** 64) < 0.006


def test_shingles_do_not_depend_on_neighbours():
    texts = ["a b c d e f", "x", "", "É é Ü ü ß 1 2", "a b c d e f"]
    together = arrays.shingles(texts)
    assert all(np.array_equal(s, arrays.shingles([t])[0]) for s, t in zip(together, texts))
    assert np.array_equal(together[0], together[4]) and len(together[2]) == 0


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_rows_go_by_broadcast_or_by_shuffle(frame, broadcast_rows):
    docs = frame([(1, "a"), (1, "b"), (2, None), (2, ""), (None, "c"), (3, "d")], "doc_id long, text string")
    gone = docs.where("text = 'a' or text is null or text = 'c'").select(jaccard_join.row_key().alias("row_key"))
    left = jaccard_join.without(docs, gone.union(gone), broadcast_rows)
    # A null text counts as empty, so both rows of id 2 share a key.
    assert sorted(tuple(r) for r in left.collect()) == [(1, "b"), (3, "d")]
