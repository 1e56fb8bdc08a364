"""Checked queries: rule matching and pattern scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import sql
from registry.views import messages, table
from riskloom.operators import rule_index, rules as ops

KEY = "msg_id"


def match_rules(spark, sf):
    return ops.match_rules(messages(spark, sf).select(KEY, "text")).select(KEY, "category", "pattern", "weight")


def category_scores(spark, sf):
    return ops.category_scores(messages(spark, sf).select(KEY, "text")).drop("text")


def pattern_score(spark, sf):
    return ops.pattern_score(messages(spark, sf).select(KEY, "text")).select(KEY, "total_score")


def matched_patterns(spark, sf):
    out = ops.matched_patterns(messages(spark, sf).select(KEY, "text"))
    listed = [F.array_join(c, " | ").alias(c) for c in out.columns if c.startswith("patterns")]
    return out.select(KEY, *listed)


def pattern_summary(spark, sf):
    return ops.pattern_summary(ops.analyse(messages(spark, sf).select(KEY, "text"))).select(KEY, "summary")


def rule_coverage(spark, sf):
    return ops.rule_coverage(messages(spark, sf).select(KEY, "text"))


def pattern_analysis(spark, sf):
    """The nested form, unfolded to one row per message and category."""
    nested = ops.pattern_analysis(ops.analyse(messages(spark, sf).select(KEY, "text")))
    return nested.select(KEY, F.explode_outer("categories").alias("category", "found")).select(
        KEY, "category", F.col("found.score").alias("score"),
        F.size("found.matched_patterns").cast("bigint").alias("n_patterns"),
        F.array_join("found.matched_patterns", " | ").alias("matched_patterns"),
    )


def _word_pack(spark, sf):
    """A pack of thousands of rules: every word of the corpus that two or more texts hold, whole, or as a beginning."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1)))).alias("word"))
    kept = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    shape = F.when(F.conv(F.substring(F.md5("word"), 1, 2), 16, 10).cast("int") < 2, F.lit("")).otherwise(F.lit("\\b"))
    category = F.concat(F.lit("c"), F.conv(F.substring(F.md5("word"), 3, 1), 16, 10))
    weight = F.conv(F.substring(F.md5("word"), 4, 2), 16, 10).cast("int") / 256
    return kept.select(category.alias("category"), F.concat(F.lit("\\b"), "word", shape).alias("pattern"),
                       weight.alias("weight"))


def large_pack(spark, sf):
    """The rules of a large pack that each document matches, by category."""
    caps = spark.createDataFrame([(f"c{at}", 0.9) for at in range(16)], "category string, max_score double")
    pack = rule_index.IndexedPack.from_frames(_word_pack(spark, sf), caps)
    hits = rule_index.match_rules(
        table(spark, sf, "documents").select("doc_id", "text"), pack, by_category=True, keep=["doc_id"])
    return hits.groupBy("doc_id", "category").agg(
        F.sum(F.size("rules")).alias("rules"), F.least(F.max(F.array_max("rules.weight")), F.lit(0.9)).alias("score"),
        F.md5(F.array_join(F.array_sort(F.flatten(F.collect_list("rules.pattern"))), " ")).alias("patterns_md5"))


# category, shown pattern, RE2 body, weight, whole word
_RULES = [
    ("financial", r"\btransfer\b", "transfer", 0.4, True),
    ("financial", r"\baccount\b", "account", 0.3, True),
    ("financial", r"\$\d[\d,]*", r"\$\p{Nd}", 0.5, False),
    ("financial", r"\bpayment\b", "payment", 0.3, True),
    ("financial", r"\bmoney\b", "money", 0.4, True),
    ("financial", r"\bbank\b", "bank", 0.3, True),
    ("urgency", r"\burgen(t|cy)\b", "urgen(t|cy)", 0.5, True),
    ("urgency", r"\bimmediately\b", "immediately", 0.4, True),
    ("urgency", r"\blimited time\b", "limited time", 0.4, True),
    ("urgency", r"\bexpire[sd]?\b", "expire[sd]?", 0.4, True),
    ("urgency", r"\bquick(ly)?\b", "quick(ly)?", 0.3, True),
    ("suspicious", r"\bverify\b", "verify", 0.5, True),
    ("suspicious", r"\bclick\b", "click", 0.4, True),
    ("suspicious", r"\bsecure\b", "secure", 0.3, True),
    ("suspicious", r"\bconfirm\b", "confirm", 0.4, True),
    ("suspicious", r"\bvalidate\b", "validate", 0.4, True),
]
_CAPS = {"financial": 0.7, "urgency": 0.6, "suspicious": 0.6}

RULES_CTE = "rules(category, pattern) as (values " + ", ".join(
    f"('{c}', '{shown}')" for c, shown, _, _, _ in _RULES
) + ")"
CAPS_CTE = "caps(category, max_score, pos) as (values " + ", ".join(
    f"('{c}', {cap}::double, {at})" for at, (c, cap) in enumerate(_CAPS.items())
) + ")"
MATCHES_CTE = "matches as materialized (" + " union all ".join(
    f"select msg_id, '{c}' as category, '{shown}' as pattern, {w}::double as weight from messages "
    f"where regexp_matches(lower(text), '{sql.EDGE_L + body + sql.EDGE_R if word else body}')"
    for c, shown, body, w, word in _RULES
) + ")"
CATS_CTE = """cats as (
  select m.msg_id, c.category, c.pos, least(coalesce(max(x.weight), 0), c.max_score) as score,
         coalesce(string_agg(distinct x.pattern, ' | ' order by x.pattern), '') as pats,
         coalesce(string_agg(distinct x.pattern, ', ' order by x.pattern), '') as shown,
         count(x.pattern) as n
  from messages m cross join caps c left join matches x on x.msg_id = m.msg_id and x.category = c.category
  group by m.msg_id, c.category, c.pos, c.max_score)"""
SCORES_CTE = """scores as (
  select msg_id, max(score) filter (category = 'financial') as score_financial,
         max(score) filter (category = 'urgency') as score_urgency,
         max(score) filter (category = 'suspicious') as score_suspicious,
         round((max(score) filter (category = 'financial') + max(score) filter (category = 'urgency')
                + max(score) filter (category = 'suspicious')) / 3, 4) as total_score,
         coalesce(string_agg(category || ': ' || shown, chr(10) order by pos) filter (score > 0), '') as summary,
         coalesce(string_agg(pats, ' | ' order by pos) filter (pats <> ''), '') as patterns
  from cats group by msg_id)"""
ALL_CTES = (RULES_CTE, CAPS_CTE, MATCHES_CTE, CATS_CTE, SCORES_CTE)

QUERIES = {
    "q_f1_match_rules": match_rules,
    "q_f1_large_pack": large_pack,
    "q_f2_category_scores": category_scores,
    "q_f3_pattern_score": pattern_score,
    "q_f4_matched_patterns": matched_patterns,
    "q_f4_pattern_analysis": pattern_analysis,
    "q_f5_pattern_summary": pattern_summary,
    "q_f6_rule_coverage": rule_coverage,
}

ORACLES = {
    "q_f1_match_rules": sql.with_messages("select * from matches", RULES_CTE, MATCHES_CTE),
    "q_f1_large_pack": r"""with words as (
       select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as word from documents),
     pack as (select word, md5(word) as h from words group by word having count(*) >= 2),
     rules as (select word, '\b' || word || case when ('0x' || h[1:2])::int < 2 then '' else '\b' end as pattern,
       ('0x' || h[1:2])::int < 2 as open_end, 'c' || ('0x' || h[3:3])::int as category,
       ('0x' || h[4:5])::int / 256 as weight from pack),
     hits as (select doc_id, category, pattern, weight from words join rules using (word)
       union select doc_id, category, pattern, weight from words w join rules r on r.open_end and starts_with(w.word, r.word))
     select doc_id, category, count(*) as rules, least(max(weight), 0.9::double) as score,
       md5(string_agg(pattern, ' ' order by pattern)) as patterns_md5 from hits group by doc_id, category""",
    "q_f2_category_scores": sql.with_messages(
        "select msg_id, score_financial, score_urgency, score_suspicious from scores", *ALL_CTES
    ),
    "q_f3_pattern_score": sql.with_messages("select msg_id, total_score from scores", *ALL_CTES),
    "q_f4_matched_patterns": sql.with_messages(
        """select msg_id, max(pats) filter (category = 'financial') as patterns_financial,
         max(pats) filter (category = 'urgency') as patterns_urgency,
         max(pats) filter (category = 'suspicious') as patterns_suspicious, any_value(s.patterns) as patterns
        from cats join scores s using (msg_id) group by msg_id""",
        *ALL_CTES,
    ),
    "q_f4_pattern_analysis": sql.with_messages(
        "select msg_id, category, score, n as n_patterns, pats as matched_patterns from cats", *ALL_CTES[:4]
    ),
    "q_f5_pattern_summary": sql.with_messages("select msg_id, summary from scores", *ALL_CTES),
    "q_f6_rule_coverage": sql.with_messages(
        """select r.category, r.pattern, count(m.msg_id) as rule_hits,
         (select count(distinct y.msg_id) from matches y where y.category = r.category) as category_hits
        from rules r left join matches m on m.pattern = r.pattern and m.category = r.category
        group by r.category, r.pattern""",
        RULES_CTE, MATCHES_CTE,
    ),
}
