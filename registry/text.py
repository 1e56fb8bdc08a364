"""Checked queries: scalar text steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import sql
from registry.views import messages, table
from riskloom.functions import pages, text as tx
from riskloom.operators import text as ops


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


def normalise_messages(spark, sf):
    return ops.normalise(messages(spark, sf)).select("msg_id", "text")


def normalise_documents(spark, sf):
    return ops.normalise(_docs(spark, sf)).select("doc_id", F.md5("text").alias("text_md5"))


def mask_documents(spark, sf):
    return ops.mask_pii(ops.normalise(_docs(spark, sf))).select("doc_id", F.md5("text").alias("text_md5"))


def mask_messages(spark, sf):
    return ops.mask_pii(ops.normalise(messages(spark, sf))).select("msg_id", "text")


def clean_documents(spark, sf):
    out = ops.clean_text(_docs(spark, sf))
    return out.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("text_md5"))


def english_documents(spark, sf):
    out = ops.is_english(ops.clean_text(_docs(spark, sf)))
    return out.select("doc_id", tx.token_count(F.col("text")).cast("bigint").alias("tokens"), "is_english")


def keep_labels(spark, sf):
    return ops.keep_labels(messages(spark, sf)).select("msg_id", "type")


def length_gates(spark, sf):
    """Messages passing each gate: after masking, before cleaning, corpus range, scorable, page selection."""
    masked = ops.mask_pii(ops.normalise(messages(spark, sf).withColumn("raw", F.col("text"))))
    raw, text = F.col("raw"), F.col("text")
    return masked.select(
        "msg_id",
        F.coalesce(tx.length_between(text, 10), F.lit(False)).alias("after_masking"),
        F.coalesce(tx.length_between(raw, 11), F.lit(False)).alias("before_cleaning"),
        F.coalesce(tx.length_between(tx.normalised(raw), 10, 1000), F.lit(False)).alias("corpus_range"),
        F.coalesce(tx.length_between(tx.strip(raw), 3), F.lit(False)).alias("scorable"),
        F.coalesce(tx.length_between(tx.strip(raw), 50, 2000), F.lit(False)).alias("selectable"),
    )


def length_gate(spark, sf):
    return ops.length_gate(ops.mask_pii(ops.normalise(messages(spark, sf))), 10).select("msg_id", "text")


def drop_null(spark, sf):
    return ops.drop_null(messages(spark, sf), ["type", "text"], or_empty=True).select("msg_id", "type", "text")


def to_binary(spark, sf):
    return ops.to_binary(ops.keep_labels(messages(spark, sf))).select(
        "msg_id", "type", F.col("y_true").cast("bigint").alias("y_true")
    )


def page_text(spark, sf):
    out = ops.page_text(table(spark, sf, "pages").select("page_id", "html"))
    return out.select(
        "page_id",
        F.length("text").cast("bigint").alias("chars"),
        F.size(F.split("text", "\n")).cast("bigint").alias("pieces"),
        F.md5("text").alias("text_md5"),
    )


def page_body(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(pages.page_body(F.col("html"))).alias("body_md5"))


_MARKUP = (
    "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), "
    "'<head\\b.*?</head\\s*>|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<code\\b.*?</code\\s*>|"
    "<pre\\b.*?</pre\\s*>', '', 'gis')"
)


def _decode(x):
    for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                         ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _squeeze(x):
    return f"trim(regexp_replace({x}, '[{sql.SPACE}]+', ' ', 'g'))"


_BODY = _squeeze(_decode(f"regexp_replace({_MARKUP}, '<[^>]*>', ' ', 'g')"))
_BLOCK = (
    "p|div|article|section|main|body|html|header|footer|nav|aside|h[1-6]|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|"
    "td|th|blockquote|figure|form|br|hr"
)
_LINES = _decode(
    f"regexp_replace(regexp_replace(regexp_replace({_MARKUP}, '[{sql.SPACE}]+', ' ', 'g'), "
    f"'</?({_BLOCK})\\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g')"
)
_PIECES = (
    f"array_to_string([{_squeeze('x')} for x in string_split({_LINES}, chr(10)) if length({_squeeze('x')}) > 10], "
    "chr(10))"
)

QUERIES = {
    "q_b1_normalise": normalise_messages,
    "q_b1_normalise_documents": normalise_documents,
    "q_b2_mask": mask_documents,
    "q_b2_mask_messages": mask_messages,
    "q_b3_clean": clean_documents,
    "q_b4_english": english_documents,
    "q_b5_labels": keep_labels,
    "q_b6_length": length_gates,
    "q_b6_length_gate": length_gate,
    "q_b7_drop_null": drop_null,
    "q_b8_binary": to_binary,
    "q_b9_page_text": page_text,
    "q_b9_page_body": page_body,
}

_MASKED = sql.masked(sql.normal("text"))

ORACLES = {
    "q_b1_normalise": sql.with_messages(f"select msg_id, {sql.normal('text')} as text from messages"),
    "q_b1_normalise_documents": f"select doc_id, md5({sql.normal('text')}) as text_md5 from documents",
    "q_b2_mask": f"select doc_id, md5({_MASKED}) as text_md5 from documents",
    "q_b2_mask_messages": sql.with_messages(f"select msg_id, {_MASKED} as text from messages"),
    "q_b3_clean": f"""select doc_id, length(t) as chars, md5(t) as text_md5
        from (select doc_id, {sql.cleaned('text')} as t from documents)""",
    "q_b4_english": f"""select doc_id, {sql.tokens('t')} as tokens, {sql.english('t', 'lang')} as is_english
        from (select doc_id, lang, {sql.cleaned('text')} as t from documents)""",
    "q_b5_labels": sql.with_messages(
        "select msg_id, lower(type) as type from messages where lower(type) in ('spam', 'ham')"
    ),
    "q_b6_length": sql.with_messages(
        f"""select msg_id,
         coalesce(length({_MASKED}) >= 10, false) as after_masking,
         coalesce(length(text) > 10, false) as before_cleaning,
         coalesce(length({sql.normal('text')}) between 10 and 1000, false) as corpus_range,
         coalesce(length({sql.strip('text')}) >= 3, false) as scorable,
         coalesce(length({sql.strip('text')}) between 50 and 2000, false) as selectable
        from messages"""
    ),
    "q_b6_length_gate": sql.with_messages(
        f"select * from (select msg_id, {_MASKED} as text from messages) where length(text) >= 10"
    ),
    "q_b7_drop_null": sql.with_messages(
        "select msg_id, type, text from messages where type <> '' and text <> ''"
    ),
    "q_b8_binary": sql.with_messages(
        """select msg_id, lower(type) as type, (lower(type) = 'spam')::bigint as y_true
        from messages where lower(type) in ('spam', 'ham')"""
    ),
    "q_b9_page_text": f"""select page_id, length(t) as chars, len(string_split(t, chr(10))) as pieces,
        md5(t) as text_md5
        from (select page_id, case when p <> '' then p else b end as t
              from (select page_id, {_PIECES} as p, {_BODY} as b from pages))""",
    "q_b9_page_body": f"select page_id, md5({_BODY}) as body_md5 from pages",
}
