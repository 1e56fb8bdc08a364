"""Checked queries: deduplication, samples, profiles and corpus preparation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry import sql
from registry.views import messages, table
from riskloom.operators import dedup as dd, profile as pf, sampling as sp, text as tx
from riskloom.plans import corpus as plans


def _sequenced(spark, sf):
    return messages(spark, sf).select(
        "msg_id", "type", "text", "ts",
        (F.col("msg_id") % 3).cast("int").alias("file_seq"), F.col("msg_id").alias("row_seq"),
    )


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def load_corpus(spark, sf):
    return plans.load_corpus(messages(spark, sf)).select("msg_id", "text")


def union_sources(spark, sf):
    parts = [
        table(spark, sf, "documents").select(F.col("doc_id").alias("row_seq"), F.md5("text").alias("text_md5")),
        table(spark, sf, "conversations").select(F.col("conv_id").alias("row_seq"), F.md5("text").alias("text_md5")),
        table(spark, sf, "benchmark").select(F.col("item_id").alias("row_seq"), F.md5("text").alias("text_md5")),
    ]
    return dd.union_sources(parts).withColumn("file_seq", F.col("file_seq").cast("bigint"))


def _dedup_documents(spark, sf, keep):
    docs = _docs(spark, sf)
    out = dd.dedup(docs, ["text"], ["doc_id"], keep=keep)
    return out.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


def dedup_last(spark, sf):
    return _dedup_documents(spark, sf, "last")


def dedup_first(spark, sf):
    return _dedup_documents(spark, sf, "first")


def dedup_messages(spark, sf):
    """The last file wins over the last row: order is (file_seq, row_seq)."""
    kept = dd.dedup(_sequenced(spark, sf).where("text is not null"), ["text"], keep="last")
    return kept.select("msg_id", "type", "text")


def distinct_rows(spark, sf):
    return dd.distinct_rows(messages(spark, sf).select("type", "text"))


def recent_texts(spark, sf):
    as_of = F.lit(dt.date(2024, 1, 31))
    return dd.recent_texts(messages(spark, sf), as_of, days=15)


def sample_n(spark, sf):
    return sp.sample_n(messages(spark, sf).select("msg_id", "type", "text"), 200, ["msg_id"])


def sample_large(spark, sf):
    """A sample too large for the driver's top-n merge."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return sp.sample_n(table(spark, sf, "lineitem").select(*key), 20_000, key)


def split_documents(spark, sf):
    return sp.stratified_split(_docs(spark, sf).select("doc_id", "lang"), "lang", ["doc_id"], share="auto")


def split_labels(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return sp.stratified_split(labels, "quality", ["doc_id"], share=0.25)


def folds_labels(spark, sf):
    folds = sp.stratified_folds(table(spark, sf, "labels").select("doc_id", "quality"), "quality", ["doc_id"], 5)
    return folds.withColumn("fold", F.col("fold").cast("bigint"))


def _labelled(spark, sf):
    return tx.keep_labels(messages(spark, sf).select("msg_id", "type", "text"))


def fold_corpus(spark, sf):
    folds = sp.stratified_folds(_labelled(spark, sf), "type", ["msg_id"], 2)
    parts = [sp.fold_corpus(folds, f).withColumn("test_fold", F.lit(f).cast("bigint")) for f in (1, 2)]
    return parts[0].unionByName(parts[1]).select("test_fold", "msg_id", "type")


def balance_under(spark, sf):
    return sp.balance(_labelled(spark, sf), "type", ["msg_id"], "under").select("msg_id", "type")


def balance_over(spark, sf):
    over = sp.balance(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["doc_id"], "over")
    return over.select("doc_id", "lang", "copy")


def balance_keep(spark, sf):
    return sp.balance(_labelled(spark, sf), "type", ["msg_id"], "stratified").select("msg_id", "type")


def concat_samples(spark, sf):
    """Equal samples of both classes, one after the other."""
    rows = _labelled(spark, sf).select("msg_id", "type")
    parts = [sp.sample_n(rows.where(F.col("type") == kind), 150, ["msg_id"]) for kind in ("spam", "ham")]
    return dd.union_sources(parts, check_empty=False).withColumn("file_seq", F.col("file_seq").cast("bigint"))


def label_distribution(spark, sf):
    return pf.label_distribution(tx.keep_labels(messages(spark, sf)))


def length_stats(spark, sf):
    out = pf.length_stats(table(spark, sf, "documents"))
    return out.withColumn("mean_length", F.round("mean_length", 6))


def profile(spark, sf):
    return flat_profile(nested_profile(spark, sf))


def nested_profile(spark, sf):
    return pf.profile(tx.keep_labels(messages(spark, sf)))


def flat_profile(nested):
    return nested.select(
        "total_samples",
        F.col("label_distribution")["spam"].alias("spam"), F.col("label_distribution")["ham"].alias("ham"),
        F.col("label_percentages")["spam"].alias("spam_share"), F.col("label_percentages")["ham"].alias("ham_share"),
        F.round("text_length_stats.mean", 6).alias("mean_length"),
        F.col("text_length_stats.max").alias("max_length"), F.col("text_length_stats.min").alias("min_length"),
    )


def length_quartiles(spark, sf):
    return pf.length_quartiles(table(spark, sf, "documents").select("lang", "text"), "lang")


def build_corpus(spark, sf):
    corpus = plans.build_corpus([_sequenced(spark, sf)])
    return corpus.select("msg_id", "type", "text")


def _eval_source(spark, sf):
    """Messages with the language of the prose they imitate: derived from every row."""
    return messages(spark, sf).select(
        "msg_id", "type", "text", F.when(F.col("source") == "error", "de").otherwise("en").alias("lang")
    )


def prepare_eval_set(spark, sf):
    return plans.prepare_eval_set(_eval_source(spark, sf), ["msg_id"], ["msg_id"]).select("msg_id", "type", "text")


def funnel(spark, sf):
    return plans.funnel(_eval_source(spark, sf), ["msg_id"]).select("stage", "total", "spam", "ham")


QUERIES = {
    "q_a4_load_corpus": load_corpus,
    "q_b10_build_corpus": build_corpus,
    "q_b11_prepare_eval_set": prepare_eval_set,
    "q_c1_union": union_sources,
    "q_c2_dedup_last": dedup_last,
    "q_c2_dedup_messages": dedup_messages,
    "q_c3_dedup_first": dedup_first,
    "q_c4_distinct": distinct_rows,
    "q_c5_recent_texts": recent_texts,
    "q_c6_concat_samples": concat_samples,
    "q_d1_sample": sample_n,
    "q_d1_sample_large": sample_large,
    "q_d2_split_documents": split_documents,
    "q_d2_split_labels": split_labels,
    "q_d3_folds": folds_labels,
    "q_d4_balance_under": balance_under,
    "q_d5_balance_over": balance_over,
    "q_d5_balance_keep": balance_keep,
    "q_d6_fold_corpus": fold_corpus,
    "q_e1_label_distribution": label_distribution,
    "q_e2_length_stats": length_stats,
    "q_e3_profile": profile,
    "q_e4_funnel": funnel,
    "q_e5_length_quartiles": length_quartiles,
}

LABELLED_CTE = """labelled as (
  select msg_id, source, ts, lower(type) as type, text from messages where lower(type) in ('spam', 'ham'))"""
_POSITION = "row_number() over (partition by {g} order by md5('42:' || {k}), {k})"


def _folds(source: str, label: str, key: str, k: int) -> str:
    """Fold of every row: dealing sizes per class, taken as runs of the hash order."""
    dealt = [f"((first + n - {j} + {k}) // {k} - (first - {j} + {k}) // {k})" for j in range(1, k)]
    upto = [" + ".join(dealt[: j + 1]) for j in range(k - 1)]
    fold = " + ".join(f"(pos > {cut})::bigint" for cut in upto)
    return f"""select * exclude (pos, n, first), 1::bigint + {fold} as fold from (
      select s.*, {_POSITION.format(g='s.' + label, k='s.' + key)} as pos, c.n, c.first from {source} s join (
        select {label}, n, (coalesce(sum(n) over (order by {label} rows between unbounded preceding and 1 preceding), 0))::bigint as first
        from (select {label}, count(*) as n from {source} group by 1)) c on c.{label} = s.{label})"""


FOLDS_CTE = f"folds as ({_folds('labelled', 'type', 'msg_id', 2)})"


def _split(source: str, label: str, share: str) -> str:
    return f"""with counts as (select {label}, count(*) as n from {source} group by 1),
      sized as (select {label}, n, ceil(sum(n) over () * {share} - 1e-9) as total,
                       n * ceil(sum(n) over () * {share} - 1e-9) / sum(n) over () as exact from counts),
      quotas as (select {label}, floor(exact) + case when row_number() over (
                     order by round(exact - floor(exact), 9) desc, {label})
                     <= total - sum(floor(exact)) over () then 1 else 0 end as n_test from sized)
      select s.doc_id, s.{label}, case when pos <= n_test then 'test' else 'train' end as split
      from (select doc_id, {label}, {_POSITION.format(g=label, k='doc_id')} as pos from {source}) s
      join quotas q on s.{label} is not distinct from q.{label}"""


_DEDUP_DOCS = """select doc_id, lang, source, md5(text) as text_md5 from (
    select *, row_number() over (partition by text order by doc_id {}) as r from documents) where r = 1"""

_EVAL_CTE = f"""staged as (
  select msg_id, lower(type) as type, text as raw, {sql.cleaned('text')} as clean,
         case when source = 'error' then 'de' else 'en' end as lang from messages),
 flagged as (
  select *, type is not null and coalesce(length(raw) > 10, false) as long_enough,
         type in ('spam', 'ham') and {sql.english('clean', 'lang')} as ok from staged),
 firsts as (
  select * from (select *, row_number() over (partition by clean order by msg_id) as r
                 from flagged where long_enough and ok) where r = 1)"""

ORACLES = {
    "q_a4_load_corpus": sql.with_messages(
        f"""select * from (select msg_id, {sql.normal('text')} as text from messages where text is not null)
        where length(text) between 10 and 1000"""
    ),
    "q_b10_build_corpus": sql.with_messages(
        f"""select msg_id, type, text from (
          select *, row_number() over (partition by text order by msg_id % 3 desc, msg_id desc) as r
          from (select msg_id, type, {sql.masked(sql.normal('text'))} as text from labelled)
          where length(text) >= 10) where r = 1""",
        LABELLED_CTE,
    ),
    "q_b11_prepare_eval_set": sql.with_messages(
        f"""select msg_id, type, text from (
          select msg_id, type, clean as text, {_POSITION.format(g='type', k='msg_id')} as pos from firsts)
        where pos <= (select min(n) from (select count(*) as n from firsts group by type))""",
        _EVAL_CTE,
    ),
    "q_c1_union": """select doc_id as row_seq, md5(text) as text_md5, 0::bigint as file_seq from documents
        union all select conv_id, md5(text), 1 from conversations
        union all select item_id, md5(text), 2 from benchmark""",
    "q_c2_dedup_last": _DEDUP_DOCS.format("desc"),
    "q_c2_dedup_messages": sql.with_messages(
        """select msg_id, type, text from (
          select *, row_number() over (partition by text order by msg_id % 3 desc, msg_id desc) as r
          from messages where text is not null) where r = 1"""
    ),
    "q_c3_dedup_first": _DEDUP_DOCS.format("asc"),
    "q_c4_distinct": sql.with_messages("select distinct type, text from messages"),
    "q_c5_recent_texts": sql.with_messages(
        """select text, max(ts) as last_seen from messages
        where text is not null and text <> '' and ts >= date '2024-01-31' - 15 group by text"""
    ),
    "q_c6_concat_samples": sql.with_messages(
        """select msg_id, type, (type = 'ham')::bigint as file_seq from (
          select msg_id, type, row_number() over (partition by type order by md5('42:' || msg_id), msg_id) as pos
          from labelled) where pos <= 150""",
        LABELLED_CTE,
    ),
    "q_d1_sample": sql.with_messages(
        "select msg_id, type, text from messages order by md5('42:' || msg_id), msg_id limit 200"
    ),
    "q_d1_sample_large": """select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
        order by md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey) limit 20000""",
    "q_d2_split_documents": _split("documents", "lang", "(case when sum(n) over () < 10000 then 0.3 else 0.2 end)::double"),
    "q_d2_split_labels": _split("labels", "quality", "0.25::double"),
    "q_d3_folds": f"select doc_id, quality, fold from ({_folds('labels', 'quality', 'doc_id', 5)})",
    "q_d4_balance_under": sql.with_messages(
        f"""select msg_id, type from (select *, {_POSITION.format(g='type', k='msg_id')} as pos from labelled)
        where pos <= (select min(n) from (select count(*) as n from labelled group by type))""",
        LABELLED_CTE,
    ),
    "q_d5_balance_over": f"""with sizes as (select lang, count(*) as n from documents group by 1),
        ranked as (select doc_id, lang, {_POSITION.format(g='lang', k='doc_id')} as pos from documents)
        select doc_id, r.lang, unnest(range(1, 1 + (select max(n) from sizes) // n
            + case when pos <= (select max(n) from sizes) % n then 1 else 0 end)) as copy
        from ranked r join sizes s on r.lang = s.lang""",
    "q_d5_balance_keep": sql.with_messages("select msg_id, type from labelled", LABELLED_CTE),
    "q_d6_fold_corpus": sql.with_messages(
        """select f.test_fold, msg_id, type from folds cross join (values (1::bigint), (2)) f(test_fold)
        where fold <> f.test_fold and type = 'spam'""",
        LABELLED_CTE, FOLDS_CTE,
    ),
    "q_e1_label_distribution": sql.with_messages(
        "select type, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as share from labelled group by type",
        LABELLED_CTE,
    ),
    "q_e2_length_stats": """select count(*) as total, round(avg(length(text)), 6) as mean_length,
        max(length(text)) as max_length, min(length(text)) as min_length from documents""",
    "q_e3_profile": sql.with_messages(
        """select count(*) as total_samples, count(*) filter (type = 'spam') as spam,
         count(*) filter (type = 'ham') as ham,
         round(count(*) filter (type = 'spam') / count(*), 4) as spam_share,
         round(count(*) filter (type = 'ham') / count(*), 4) as ham_share,
         round(avg(length(text)), 6) as mean_length, max(length(text)) as max_length,
         min(length(text)) as min_length from labelled""",
        LABELLED_CTE,
    ),
    "q_e4_funnel": sql.with_messages(
        """select 'initial_load' as stage, count(*) as total, count(*) filter (type = 'spam') as spam,
           count(*) filter (type = 'ham') as ham from flagged
        union all select 'after_basic_cleaning', count(*), count(*) filter (type = 'spam'),
           count(*) filter (type = 'ham') from flagged where long_enough
        union all select 'after_validation', count(*), count(*) filter (type = 'spam'),
           count(*) filter (type = 'ham') from flagged where long_enough and ok
        union all select 'after_deduplication', count(*), count(*) filter (type = 'spam'),
           count(*) filter (type = 'ham') from firsts
        union all select 'final_balanced',
           2 * least(count(*) filter (type = 'spam'), count(*) filter (type = 'ham')),
           least(count(*) filter (type = 'spam'), count(*) filter (type = 'ham')),
           least(count(*) filter (type = 'spam'), count(*) filter (type = 'ham')) from firsts""",
        _EVAL_CTE,
    ),
    "q_e5_length_quartiles": """with l as (select lang, length(text) as len from documents),
        q as (select lang, count(*) as n, min(len) as min_length, max(len) as max_length,
                quantile_cont(len, 0.25) as q1, quantile_cont(len, 0.5) as median, quantile_cont(len, 0.75) as q3
              from l group by lang)
        select q.lang, n, min_length, q1, median, q3, max_length,
          min(len) as whisker_low, max(len) as whisker_high
        from q join l on l.lang = q.lang and len between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)
        group by all""",
}
