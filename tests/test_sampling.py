import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.operators import ranking, sampling as sp
from riskloom.operators.ranking import with_parts, with_position


def in_order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def rows_of(frame, counts, parts=3):
    rows, at = [], 0
    for label, n in counts.items():
        rows += [(at + i, label) for i in range(n)]
        at += n
    return frame(rows, "id bigint, label string", parts)


def test_positions_follow_the_hash(frame):
    rows = rows_of(frame, {"a": 50, "b": 1, None: 7})
    got = with_position(rows, ["label"], ["id"]).collect()
    for label, size in (("a", 50), ("b", 1), (None, 7)):
        own = [r for r in got if r.label == label]
        assert [r.id for r in sorted(own, key=lambda r: r._position)] == in_order([r.id for r in own])
        assert {r._size for r in own} == {size}


def test_positions_do_not_depend_on_partitions(frame):
    one = with_position(rows_of(frame, {"a": 300, "b": 200}, 1), ["label"], ["id"])
    many = with_position(rows_of(frame, {"a": 300, "b": 200}, 17), ["label"], ["id"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_a_hot_label_is_spread(spark):
    """A label with nearly all rows is ranked in many cells, none of them large."""
    rows = spark.range(40_000).withColumn("label", F.when(F.col("id") % 1000 == 0, "ham").otherwise("spam"))
    plan = with_position(rows, ["label"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_bucket" in plan and "SinglePartition" not in plan
    hashes = rows.select(F.substring(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), 1, 3).alias("b"))
    assert hashes.groupBy("b").count().agg(F.max("count")).head()[0] < 40


@pytest.mark.parametrize("max_cuts", [10_000, 0])
def test_parts(frame, max_cuts):
    """Cuts found in their buckets, and the numbered fallback, put every row into the part of its position."""
    rows = rows_of(frame, {"a": 400, "b": 30, None: 9})
    quotas = {"a": [0, 17, 17, 399], "b": [30, 31], None: [4]}

    def cut(sizes):
        of = F.when(F.col("label") == "a", F.array(*[F.lit(q) for q in quotas["a"]]))
        of = of.when(F.col("label") == "b", F.array(*[F.lit(q) for q in quotas["b"]])).otherwise(F.array(F.lit(4)))
        return sizes.select("label", of.cast("array<bigint>").alias("_quotas"), (F.col("n") * 2).alias("twice"))

    got = with_parts(rows, ["label"], ["id"], cut, max_cuts=max_cuts).collect()
    assert len(got) == 439
    for label, cuts in quotas.items():
        own = {r.id: r for r in got if r.label == label}
        for place, i in enumerate(in_order(own), 1):
            assert own[i]._part == sum(q < place for q in cuts), (label, place)
        assert {r.twice for r in own.values()} == {2 * len(own)}


def test_splitting_is_a_map(spark):
    rows = spark.range(5_000).withColumn("label", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    plan = sp.stratified_split(rows, "label", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SinglePartition" not in plan


def test_large_sample_is_a_map(spark, monkeypatch):
    monkeypatch.setattr(sp, "_TOP_N_LIMIT", 10)
    plan = sp.sample_n(spark.range(300), 20, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_empty_table(spark, monkeypatch):
    monkeypatch.setattr(sp, "_TOP_N_LIMIT", 10)
    none = spark.createDataFrame([], "id bigint, label string")
    assert sp.sample_n(none, 20, ["id"]).count() == 0
    assert sp.stratified_split(none, "label", ["id"]).count() == 0
    assert sp.balance(none, "label", ["id"], "over").count() == 0


@pytest.mark.parametrize("n", [0, 1, 40, 100])
def test_sample_n(frame, n):
    rows = rows_of(frame, {"a": 60})
    got = sp.sample_n(rows, n, ["id"]).collect()
    assert {r.id for r in got} == set(in_order(range(60))[:n])


def test_large_sample_is_the_same_rule(spark, monkeypatch):
    rows = spark.range(500)
    small = {r.id for r in sp.sample_n(rows, 120, ["id"]).collect()}
    monkeypatch.setattr(sp, "_TOP_N_LIMIT", 100)
    assert {r.id for r in sp.sample_n(rows, 120, ["id"]).collect()} == small


def largest_remainder(counts, share):
    total = sum(counts.values())
    wanted = math.ceil(total * share - 1e-9)
    exact = {k: n * wanted / total for k, n in counts.items()}
    quota = {k: math.floor(x) for k, x in exact.items()}
    order = sorted(counts, key=lambda k: (-round(exact[k] - quota[k], 9), k))
    for k in order[: wanted - sum(quota.values())]:
        quota[k] += 1
    return quota


@pytest.mark.parametrize("counts", [{"a": 7, "b": 3}, {"a": 10, "b": 10, "c": 1}, {"a": 1}, {"x": 333, "y": 333, "z": 333}])
@pytest.mark.parametrize("share", [0.3, 0.25, 0.5])
def test_split_quotas(frame, counts, share):
    got = sp.stratified_split(rows_of(frame, counts), "label", ["id"], share).collect()
    assert len(got) == sum(counts.values())
    tests = Counter(r.label for r in got if r.split == "test")
    assert {k: tests.get(k, 0) for k in counts} == largest_remainder(counts, share)


@pytest.mark.parametrize("n, tests", [(9_999, 3_000), (10_000, 2_000)])
def test_automatic_share(spark, n, tests):
    rows = spark.range(n).withColumn("label", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    assert sp.stratified_split(rows, "label", ["id"], "auto").where("split = 'test'").count() == tests


def test_folds(frame):
    folds = sp.stratified_folds(rows_of(frame, {"spam": 10, "ham": 7, "rare": 1}), "label", ["id"], 3)
    sizes = Counter((r.label, r.fold) for r in folds.collect())
    assert [sizes["ham", f] for f in (1, 2, 3)] == [3, 2, 2] and [sizes["rare", f] for f in (1, 2, 3)] == [0, 1, 0]
    assert [sizes["spam", f] for f in (1, 2, 3)] == [3, 3, 4]
    train, test = sp.fold_frames(folds, 2)
    assert train.count() + test.count() == 18 and test.select("fold").distinct().head().fold == 2
    known = sp.fold_corpus(folds, 2, "label")
    assert {r.label for r in known.collect()} == {"spam"} and known.count() == 7
    assert sp.fold_corpus(folds, 2, "label", None).count() == train.count()
    with pytest.raises(ValueError):
        sp.stratified_folds(folds, "label", ["id"], 1)


def test_balance(frame, monkeypatch):
    rows = rows_of(frame, {"a": 10, "b": 4, "c": 3})
    under = Counter(r.label for r in sp.balance(rows, "label", ["id"], "under").collect())
    assert under == {"a": 3, "b": 3, "c": 3}
    monkeypatch.setattr(sp, "_COPY_BLOCK", 2)  # several blocks of copies
    over = sp.balance(rows, "label", ["id"], "over").collect()
    assert Counter(r.label for r in over) == {"a": 10, "b": 10, "c": 10}
    per_row = Counter(r.id for r in over if r.label == "c")
    assert sorted(per_row.values()) == [3, 3, 4]
    assert len({(r.id, r.copy) for r in over}) == 30
    assert sp.balance(rows, "label", ["id"], "stratified").count() == 17
    with pytest.raises(ValueError):
        sp.balance(rows, "label", ["id"], "other")


@pytest.mark.parametrize("limit", [0, 10_000])
def test_samples_are_exact_when_keys_repeat(frame, monkeypatch, limit):
    monkeypatch.setattr(sp, "_TOP_N_LIMIT", limit)
    same = frame([(1, at) for at in range(100)], "id long, value long")
    assert sp.sample_n(same, 5, ["id"]).count() == 5
    some = frame([(at // 7, at) for at in range(200)], "id long, value long")
    assert [sp.sample_n(some, n, ["id"]).count() for n in (0, 1, 50, 199, 500)] == [0, 1, 50, 199, 200]


@pytest.mark.parametrize("max_cuts", [0, 10_000])
def test_parts_have_their_sizes_when_keys_repeat(frame, max_cuts):
    rows = frame([(at % 2, at // 50, at) for at in range(300)], "label long, id long, value long")
    cut = lambda sizes: sizes.select("label", F.array(F.lit(40), F.lit(90)).cast("array<bigint>").alias("_quotas"))
    got = with_parts(rows, ["label"], ["id"], cut, max_cuts=max_cuts).groupBy("label", "_part").count().collect()
    assert {(r.label, r._part): r["count"] for r in got} == {
        (g, p): n for g in (0, 1) for p, n in ((0, 40), (1, 50), (2, 60))}


def test_a_missing_class_leaves_nothing(frame):
    spam = frame([("spam", at) for at in range(6)] + [(None, 9)], "type string, id long")
    assert sp.balance(spam, "type", ["id"], classes=["spam", "ham"]).count() == 0
    assert sp.balance(spam, "type", ["id"]).count() == 2
    both = spam.union(frame([("ham", 20), ("ham", 21)], "type string, id long"))
    assert sorted(r.type for r in sp.balance(both, "type", ["id"], classes=["spam", "ham"]).collect()) == [
        "ham", "ham", "spam", "spam"]


@pytest.mark.parametrize("broadcast_cells", [0, 10_000])
def test_crowded_cells_are_refined(frame, monkeypatch, broadcast_cells):
    """The same numbers whatever a cell may hold, and no cell beyond that unless its rows share a key."""
    rows = frame([(i, "a" if i % 3 else None) for i in range(3000)] + [(5000, "b")] * 9, "id long, label string")
    plain = [tuple(r) for r in with_position(rows, ["label"], ["id"]).collect()]
    monkeypatch.setattr(ranking, "_NUMBER_DIGITS", 1)
    monkeypatch.setattr(ranking, "_CELL_ROWS", 4)
    monkeypatch.setattr(ranking, "_MAX_CUTS", broadcast_cells)
    seen = []
    cells = ranking._cells

    def watch(*given):
        out = cells(*given)
        seen.extend(out[1].collect())
        return out

    monkeypatch.setattr(ranking, "_cells", watch)
    refined = [tuple(r) for r in with_position(rows, ["label"], ["id"]).collect()]
    key = lambda r: (r[0], str(r[1]), r[2])
    assert sorted(refined, key=key) == sorted(plain, key=key)
    assert sum(r["_rows"] for r in seen) == 3009
    assert max(r["_rows"] for r in seen if r["label"] != "b") <= 4
    assert max(r["_digits"] for r in seen if r["label"] == "b") == ranking._MOST_DIGITS
    # Cells are refined where they are crowded, not everywhere to the end.
    assert len({r["_digits"] for r in seen if r["label"] == "a"}) > 1
    assert len(seen) <= 3009
