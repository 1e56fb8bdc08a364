import pytest
from pyspark.sql import functions as F

from riskloom.operators import rules
from riskloom.operators.rules import DEFAULT_PACK, Rule, RulePack


def test_caps_bind(frame):
    pack = RulePack((Rule("a", r"\bx\b", 0.9), Rule("a", r"\by\b", 0.2), Rule("b", r"\bz\b", 0.5)), {"a": 0.6, "b": 0.4})
    rows = frame([(0, "x"), (1, "y"), (2, "x y z"), (3, "none"), (4, None)], "i int, text string")
    got = [(r.score_a, r.score_b, r.total_score) for r in rules.pattern_score(rows, pack).orderBy("i").collect()]
    assert got == [(0.6, 0.0, 0.3), (0.2, 0.0, 0.1), (0.6, 0.4, 0.5), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_whole_words_in_any_case(frame):
    texts = ["BANK", "banks", "banké", "the bank!", "bank_", "ébank", "urgency", "urgent", "urgently", "expired",
             "limited  time", "limited time", "$", "$5", "us$1,000", "transfer", "transferred"]
    rows = frame(list(enumerate(texts)), "i int, text string")
    hit = {r.text for r in rules.match_rules(rows).select("text").distinct().collect()}
    assert hit == {"BANK", "the bank!", "urgency", "urgent", "expired", "limited time", "$5", "us$1,000", "transfer"}


def test_needles_change_nothing(spark, sf):
    from registry.views import messages

    bare = RulePack(tuple(Rule(r.category, r.pattern, r.weight) for r in DEFAULT_PACK.rules), DEFAULT_PACK.caps)
    rows = messages(spark, sf).select("msg_id", "text")
    with_needles = rules.match_rules(rows).select("msg_id", "category", "pattern", "weight")
    without = rules.match_rules(rows, bare).select("msg_id", "category", "pattern", "weight")
    assert with_needles.exceptAll(without).isEmpty() and without.exceptAll(with_needles).isEmpty()


def test_matched_patterns_and_summary(frame):
    rows = frame([(0, "Click to verify your bank account"), (1, "hello")], "i int, text string")
    out = rules.pattern_summary(rules.analyse(rows)).orderBy("i").collect()
    assert out[0].patterns_financial == [r"\baccount\b", r"\bbank\b"]
    assert out[0].summary == "financial: \\baccount\\b, \\bbank\\b\nsuspicious: \\bclick\\b, \\bverify\\b"
    assert out[1].summary == "" and out[1].patterns_urgency == []
    flat = rules.matched_patterns(rows).orderBy("i").collect()
    assert flat[0].patterns == [r"\baccount\b", r"\bbank\b", r"\bclick\b", r"\bverify\b"]


def test_nested_analysis(frame):
    rows = frame([("Transfer $5",)], "text string")
    found = rules.pattern_analysis(rules.analyse(rows)).head().categories
    assert found["financial"].score == 0.5 and found["urgency"].matched_patterns == []
    assert set(found) == {"financial", "urgency", "suspicious"}


def test_coverage_lists_silent_rules(frame):
    rows = frame([("bank and money",), ("bank",), (None,)], "text string")
    got = {r.pattern: (r.rule_hits, r.category_hits) for r in rules.rule_coverage(rows).collect()}
    assert got[r"\bbank\b"] == (2, 2) and got[r"\bmoney\b"] == (1, 2) and got[r"\bclick\b"] == (0, 0)
    assert len(got) == 16


def test_pack_from_tables(frame):
    pack = RulePack.from_frames(
        frame([("a", r"\bx\b", 0.4), ("b", r"y\d", 0.3)], "category string, pattern string, weight double"),
        frame([("a", 0.3), ("b", 1.0)], "category string, max_score double"),
    )
    got = rules.pattern_score(frame([("x y1",)], "text string"), pack).head()
    assert (got.score_a, got.score_b, got.total_score) == (0.3, 0.3, 0.3)


def test_large_pack(frame):
    many = RulePack(tuple(Rule("a", rf"\bw{i}\b", (i + 1) / 100) for i in range(90)), {"a": 1.0})
    rows = frame([(0, "w0 w63 w89"), (1, "w88x")], "i int, text string")
    out = rules.analyse(rows, many).orderBy("i").collect()
    assert out[0].score_a == 0.9 and out[0].patterns_a == [r"\bw0\b", r"\bw63\b", r"\bw89\b"]
    assert out[1].score_a == 0.0


@pytest.mark.parametrize("test", ["total_score >= 0.2", "score_financial > 0.3"])
def test_filters_on_scores(spark, sf, test):
    """A filter that the optimizer pushes below the scores keeps their meaning."""
    from registry.views import messages

    scored = rules.pattern_score(messages(spark, sf).select("msg_id", "text"))
    flagged = scored.select(F.expr(test).alias("t")).groupBy().agg(F.count_if("t").alias("n")).head().n
    assert scored.where(test).count() == flagged > 0


def test_a_category_without_a_cap_is_refused(frame):
    rules = frame([("a", "x", 0.5), ("b", "y", 0.5)], "category string, pattern string, weight double")
    caps = frame([("a", 0.5)], "category string, max_score double")
    with pytest.raises(ValueError, match="b"):
        RulePack.from_frames(rules, caps)
