"""Indexed packs against every rule run on every text."""

import random
import re
import time

import pytest

from riskloom.operators import rule_index as ix, rules as ops

RULE = "category string, pattern string, weight double"
CAP = "category string, max_score double"


@pytest.mark.parametrize("pattern, needle", [
    (r"\btransfer\b", "transfer"), (r"\$\d[\d,]*", "$"), (r"\burgen(t|cy)\b", "urgen"), (r"\bexpire[sd]?\b", "expire"),
    (r"colou?r", "colo"), (r"a|b", None), (r"x(a|b)yz", "yz"), (r"[abc]+", None), (r"(?i)abc", None), (r"ab{2}cd", "cd"),
    (r"ab*cd", "cd"), (r"ab+cd", "ab"), (r"", None), (r"\d+", None), (r"limited time", "limited time"), (r"a\.b", "a.b"),
    (r"[]x]long", "long"), (r"(abc)?de", "de"), (r"abc{0,}x", "ab")])
def test_needles(pattern, needle):
    assert ix.needle_of(pattern) == needle


def test_every_match_holds_the_needle():
    draw = random.Random(2)
    parts = ["a", "b", r"\b", "ab", "c?", "b*", "a+", "[ab]", "(a|b)", ".", r"\.", "c{2}", r"\d", "|", "(ab)?", " "]
    for _ in range(4000):
        pattern = "".join(draw.choice(parts) for _ in range(draw.randint(1, 5)))
        needle, text = ix.needle_of(pattern), "".join(draw.choice("abc. 1") for _ in range(12))
        for found in re.finditer(pattern, text):
            assert needle is None or needle in found[0], (pattern, text)


def brute(rules, texts):
    out = set()
    for number, text in texts:
        for category, pattern, weight in rules:
            if text and re.search(pattern, text.lower()):
                out.add((number, category, pattern, weight))
    return out


def test_equals_every_rule_on_every_text(frame):
    draw = random.Random(7)
    signs = ["ab", "abc", "b", "é", "日", "a_b", "$", "1", " ", "-", ".", "C"]
    texts = [(at, "".join(draw.choice(signs) for _ in range(draw.randint(0, 12)))) for at in range(300)] + [(900, None)]
    rules = [("x", p, .1) for p in (r"\bab\b", r"\bab", r"ab\b", "ab", r"\bé\b", r"日", r"\$\d", r"a\.b", r"\b-\b", r"\ba_b\b",
                                    r"b+c", r"ab|é", r"[ab]{3}", r"\b\$\b", r"\d", r"abc?\b", r"\$", r"(a|b)c")]
    rules += [("y", r"\bab\b", .5), ("y", "zzz", .9)]
    caps = frame([("x", .6), ("y", .3)], CAP)
    df = frame(texts, "i long, text string")
    for chars in (ix.BLOCK_CHARS, 60):
        pack = ix.IndexedPack.from_frames(frame(rules, RULE), caps, chars)
        got = ix.match_rules(df, pack).select("i", "category", "pattern", "weight").collect()
        assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(rules, texts)
    covered = {(r.category, r.pattern): r.rule_hits for r in ix.rule_coverage(df, frame(rules, RULE), pack).collect()}
    hits = brute(rules, texts)
    assert covered == {(c, p): sum(h[1:3] == (c, p) for h in hits) for c, p, _ in rules}


def test_the_default_pack_gives_the_same_scores(spark, frame, sf):
    from registry.views import messages

    df = messages(spark, sf).select("msg_id", "text")
    rules = frame([(r.category, r.pattern, r.weight) for r in ops.DEFAULT_PACK.rules], RULE)
    pack = ix.IndexedPack.from_frames(rules, frame(list(ops.DEFAULT_PACK.caps.items()), CAP))
    assert pack.unindexed == 0
    columns = ["msg_id", "total_score", *(f"{k}_{c}" for c in pack.categories for k in ("score", "patterns"))]
    want = sorted(map(str, ops.analyse(df).select(columns).collect()))
    assert sorted(map(str, ix.analyse(df, pack).select(columns).collect())) == want


def test_time_is_nearly_flat_in_the_number_of_rules():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(8))
    texts = [" ".join(word() for _ in range(200)) for _ in range(60)]
    took = []
    for size in (300, 30_000):
        index = ix._Index(tuple(("x", rf"\b{word()}\b", .1) for _ in range(size)))
        began = time.process_time()
        for text in texts:
            index.matches(text)
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + .05


def test_edges(frame):
    caps = frame([("x", .5)], CAP)
    empty = ix.IndexedPack.from_frames(frame([], RULE), caps)
    assert ix.match_rules(frame([(1, "a")], "i long, text string"), empty).collect() == []
    got = ix.analyse(frame([(1, None), (2, "")], "i long, text string"), empty).collect()
    assert [(r.score_x, r.patterns_x, r.total_score) for r in got] == [(0.0, [], 0.0)] * 2
    with pytest.raises(ValueError):
        ix.IndexedPack.from_frames(frame([("y", "a", .1)], RULE), caps)
    rules = frame([("x", "a", .9), ("x", "a", .9), ("x", None, .9)], RULE)
    pack = ix.IndexedPack.from_frames(rules, caps)
    rows = ix.analyse(frame([(1, "A" * 100_000, 3)], "i long, text string, score int"), pack).collect()
    assert rows[0].score_x == .5 and rows[0].patterns_x == ["a"] and rows[0].score == 3
    assert ix.analyse(frame([], "i long, text string"), pack).collect() == []


def test_texts_are_read_once_for_all_blocks_of_words(frame):
    blocks = ((("a", r"\bbank\b", .1), ("a", r"\bsec", .2)), (("b", r"\bnote_1\b", .3), ("b", r"ban", .4), ("b", r"\bbank s", .5)))
    pack = ix.IndexedPack(blocks, {"a": 1.0, "b": 1.0})
    df = frame([(1, "Bank secret"), (2, "insect banknote note_1"), (3, None)], "n int, text string")
    hits = ix.match_rules(df, pack)
    assert sorted((r.n, r.pattern) for r in hits.collect()) == [
        (1, r"\bban" + r"k s"), (1, r"\bbank\b"), (1, r"\bsec"), (1, "ban"), (2, r"\bnote_1\b"), (2, "ban")]
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_rule_of_a_word_takes_little_memory(frame):
    """At millions of rules an object of Python for each is what fills an executor or the driver."""
    import pickle
    import tracemalloc

    import pyarrow as pa

    rules = [("x", rf"\bword{at}" + r"\b" * (at % 50 > 0), at / 1e6) for at in range(40_000)]
    pack = ix.IndexedPack.from_frames(frame(rules, RULE), frame([("x", .5)], CAP))
    del rules
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        held = pickle.loads(pickle.dumps(pack.blocks))
        index = ix._Index(held[0])
        found = index.matches("word7 word39999 word100x none")
        used = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert {r["pattern"] for r in found} == {
        r"\bword7\b", r"\bword39999\b", r"\bword100"}
    assert used < 80 * 40_000


def test_a_pack_beyond_one_pass_is_matched_whole(frame):
    draw = random.Random(5)
    signs = ["ab", "abc", "b", "é", "a_b", "$", " ", "-"]
    texts = [(at, "".join(draw.choice(signs) for _ in range(draw.randint(0, 12)))) for at in range(120)] + [(900, None)] * 2
    rules = [(c, p, w) for c, w in (("x", .1), ("y", .5)) for p in (r"\bab\b", r"\bab", r"ab\b", r"\bé", r"\$", r"b+c", "zzz")]
    caps, df = frame([("x", .6), ("y", .3)], CAP), frame(texts, "i long, text string")
    whole, cut = (ix.IndexedPack.from_frames(frame(rules, RULE), caps, chars) for chars in (ix.BLOCK_CHARS, 120))
    assert len(list(whole.passes())) == 1 < len(list(cut.passes()))
    plan = ix.match_rules(df, cut)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == len(list(cut.passes()))
    rows = lambda out: sorted(map(str, out.collect()))
    assert rows(ix.match_rules(df, cut)) == rows(ix.match_rules(df, whole))
    assert rows(ix.analyse(df, cut)) == rows(ix.analyse(df, whole)) and ix.analyse(df, cut).count() == len(texts)


def test_equal_hashes_are_no_matches(monkeypatch):
    import numpy as np

    monkeypatch.setattr(ix, "_multipliers", lambda n: np.ones(n, np.uint64))
    rules = (("x", r"\babc\b", .1), ("x", r"\bcba\b", .2), ("x", r"\bab", .3), ("x", r"\bba", .4), ("y", r"\babc\b", .5))
    assert sorted(r["weight"] for r in ix._Index(rules).matches("abc acb")) == [.1, .3, .5]


def test_words_of_any_length(frame):
    rules = (("x", r"\b" + "a" * 70_000 + r"\b", .1), ("x", r"\baé", .2), ("x", "\\b日本\\b", .3), ("x", r"\bnote\_1\b", .4))
    index = ix._Index(rules)
    texts = ["a" * 70_000, "a" * 70_001, "aéb 日本 日本語", "aè note_1", None, ""]
    assert [sorted(index.rules[at]["weight"].as_py() for at in own) for own in index.fired(texts)] == [[.1], [], [.2, .3], [.4], [], []]


def test_rules_by_category_are_those_of_the_long_form(frame):
    rules = [("x", r"\bab\b", .1), ("x", r"\ba", .4), ("y", r"\bab\b", .5), ("y", "b c", .2), ("z", r"\d", None)]
    caps = frame([(c, .9) for c in "xyz"], CAP)
    df = frame([(1, "ab c 1"), (1, "ab c 1"), (2, "axe"), (3, "none"), (None, "4 ab"), (5, None), (6, "")], "i long, text string")
    for chars in (ix.BLOCK_CHARS, 1):
        pack = ix.IndexedPack.from_frames(frame(rules, RULE), caps, chars)
        out = ix.match_rules(df, pack, by_category=True)
        assert out.columns == ["i", "text", "category", "rules"]
        unfolded = out.selectExpr("i", "text", "category", "inline(rules)").select("i", "text", "category", "pattern", "weight")
        rows = sorted(map(str, unfolded.collect()))
        assert rows == sorted(map(str, ix.match_rules(df, pack).collect())) and len(rows) == 2 * 5 + 1 + 4
        named = ix.match_rules(df, pack, by_category=True, keep=["i"])
        assert named.columns == ["i", "category", "rules"]
        assert sorted(map(str, named.collect())) == sorted(map(str, out.drop("text").collect()))
        assert ix.match_rules(df, pack, keep=[]).count() == len(rows)
        if chars > 1:
            assert out.groupBy("i", "text", "category").count().where("count > 1").collect()[0]["count"] == 2
            assert out.count() == 2 * 3 + 1 + 3
