"""Checked queries: files, tables, generated messages and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry import corpus, evaluate, sql
from registry.risk import ORACLES as RISK_ORACLES, answers
from registry.views import MESSAGES_SQL, messages, table
from riskloom.operators import dedup, generate as gen, profile
from riskloom.operators.sampling import stratified_split
from riskloom.plans.corpus import build_corpus
from riskloom.plans.scoring import with_cases
from riskloom.session import shared_folder
from riskloom.sources import messages as files, quoted, scams
from riskloom.streaming import detect

SEED = 42
NOON = dt.datetime(2024, 1, 31, 12)


# --- files -------------------------------------------------------------------------------------------------


def read_messages(spark, sf):
    """All messages through a positional CSV file and back; rows without text are short rows."""
    path = shared_folder(spark, "messages-csv")
    files.write_messages(messages(spark, sf).select("type", "text", "msg_id"), path, header=False)
    return files.read_messages(spark, [path]).select("type", "text")


def read_blocks(spark, sf):
    """Prose with quotes and line breaks through a positional CSV file, read block by block."""
    path = shared_folder(spark, "blocks-csv")
    files.write_messages(table(spark, sf, "documents").select("lang", "text", "doc_id"), path, header=False)
    return quoted.read_messages(spark, [path]).select("type", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def read_documents(spark, sf):
    """Prose with quotes, commas and line breaks through the CSV sink and the header reader."""
    path = shared_folder(spark, "documents-csv")
    files.write_messages(table(spark, sf, "documents").select("text", F.col("lang").alias("type"), "doc_id"), path)
    back = files.read_labelled(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "type", F.md5("text").alias("text_md5"))


def read_latin1(spark, sf):
    """A latin-1 file, first two columns."""
    path = shared_folder(spark, "latin1-csv")
    rows = messages(spark, sf).select("type", "text", "source")
    files.write_messages(rows, path, header=False, encoding="ISO-8859-1")
    return files.read_messages(spark, [path], encoding="ISO-8859-1").select("type", "text")


def corpus_from_files(spark, sf):
    """Two files merged: in the second file, a text that is known already wins over the first."""
    folder = shared_folder(spark, "corpus")
    rows = messages(spark, sf).select("type", "text", "source")
    for name, keep in (("early", F.col("source") != "click"), ("late", F.col("source") == "click")):
        files.write_messages(rows.where(keep).select("type", "text"), f"{folder}/{name}", header=False)
    merged = files.read_messages(spark, [f"{folder}/early", f"{folder}/late"])
    return build_corpus([merged], files.MESSAGE_ORDER).select("type", "text")


def split_files(spark, sf):
    folder = shared_folder(spark, "split")
    rows = table(spark, sf, "documents").select("text", F.col("lang").alias("type"), "doc_id")
    files.write_split(stratified_split(rows, "type", ["doc_id"], share="auto"), folder)
    sides = [
        files.read_split(spark, folder, name).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("split"), "type", "n")
        for name in ("train", "test")
    ]
    return sides[0].unionByName(sides[1])


def _through_file(spark, df):
    """``df`` written as statistics and read again."""
    path = shared_folder(spark, "stats")
    files.write_stats(df, path)
    return spark.read.schema(df.schema).json(path)


def profile_file(spark, sf):
    """The nested profile record."""
    return corpus.flat_profile(_through_file(spark, corpus.nested_profile(spark, sf)))


def funnel_file(spark, sf):
    return _through_file(spark, corpus.funnel(spark, sf))


def thresholds_file(spark, sf):
    """Metrics per threshold."""
    return _through_file(spark, evaluate.QUERIES["q_j3_metrics"](spark, sf))


def stats_file(spark, sf):
    path = shared_folder(spark, "stats")
    files.write_stats(profile.label_distribution(table(spark, sf, "documents"), "lang"), path)
    return spark.read.schema("lang string, n bigint, share double").json(path)


# --- tables ------------------------------------------------------------------------------------------------

_SCAMS = """select msg_id, source, text as scam_text,
  case source when 'click' then 'phishing' when 'purchase' then 'financial' when 'signup' then 'lottery' end as scam_type,
  case when source = 'error' then null else 0.5 end as confidence,
  case when source = 'view' then null else ts end as detected_at from messages"""


def _scam_rows(spark, sf):
    return spark.sql(_SCAMS.replace("from messages", "from {messages}"), messages=messages(spark, sf))


def conform_scams(spark, sf):
    return scams.conform(_scam_rows(spark, sf).withColumn("id", F.col("msg_id")), scams.SCAMS, F.lit(NOON))


def conform_realtime(spark, sf):
    """The time column under its other name."""
    rows = _scam_rows(spark, sf).withColumn("id", F.col("msg_id")).withColumnRenamed("detected_at", "timestamp")
    return scams.conform(rows, scams.REALTIME_SCAMS, F.lit(NOON))


def rejected_rows(spark, sf):
    """Messages that the real-time table does not take, with what they lack; a signup counts as having no source."""
    rows = _scam_rows(spark, sf).withColumn("source", F.expr("nullif(source, 'signup')"))
    return scams.rejected(rows.withColumn("id", F.col("msg_id")), scams.REALTIME_SCAMS, F.lit(NOON)).select(
        "id", "source", "scam_type", F.array_join("missing", ",").alias("missing"))


def assign_ids(spark, sf):
    """Purchases get ids after the highest id of the other messages."""
    rows = _scam_rows(spark, sf)
    known = rows.where("source <> 'purchase'").select(F.col("msg_id").alias("id"))
    fresh = rows.where("source = 'purchase'").select("msg_id", "scam_text")
    return scams.assign_ids(fresh, ["msg_id"], known).select("id", "msg_id")


def read_scams(spark, sf):
    path = shared_folder(spark, "scams")
    conform_scams(spark, sf).write.parquet(path)
    return scams.read_scams(spark, path)


def scams_of_type(spark, sf):
    return scams.scams_of_type(conform_scams(spark, sf), "phishing")


def seed_if_empty(spark, sf):
    """A filled table keeps its rows and gets no seed."""
    columns = ["source", "scam_text", "scam_type", "confidence"]
    return scams.seed_if_empty(conform_realtime(spark, sf).select(*columns), scams.seed_rows(spark))


def seed_empty_types(spark, sf):
    """Per scam type in use: the table restricted to texts of over 100,000 characters, of which there are none."""
    columns = ["source", "scam_text", "scam_type", "confidence"]
    none = conform_realtime(spark, sf).where(F.length("scam_text") > 100_000).select(*columns)
    return scams.seed_if_empty(none, scams.seed_rows(spark))


# --- generated messages ------------------------------------------------------------------------------------


def _ids(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"))


def _drawn(spark, sf):
    return gen.with_draws(_ids(spark, sf), "id", SEED)


def generate_template(spark, sf):
    return _drawn(spark, sf).select("id", gen.template_text().alias("message"))


def generate_links(spark, sf):
    return _drawn(spark, sf).select("id", gen.link().alias("link"))


def generate_rewrites(spark, sf):
    return gen.drop_draws(gen.rewrites(_drawn(spark, sf).withColumn("message", gen.template_text()), "message"))


def generate_noise(spark, sf):
    """Noise on the message texts."""
    rows = messages(spark, sf).where("text is not null").select(F.col("msg_id").alias("id"), F.col("text").alias("message"))
    return gen.drop_draws(gen.noise(gen.with_draws(rows, "id", SEED), "message"))


def generate_all(spark, sf):
    return dedup.distinct_rows(gen.generate_for(_ids(spark, sf), "id", SEED).select("type", "message"))


# --- streams -----------------------------------------------------------------------------------------------


def _stream(spark, sf, files_per_batch=1):
    """The messages as a stream over the event files."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(
        f"{sf}/events*.parquet"
    )
    return spark.sql(MESSAGES_SQL.replace("from events", "from {events}"), events=events)


def score_stream(spark, sf):
    """Scores of the stream, to compare with those of the batch job without similar cases."""
    folder = shared_folder(spark, "scores")
    scored = detect.score_stream(_stream(spark, sf), answers=answers(spark, sf))
    slim = scored.select("msg_id", "total_score", "risk_score", "risk_level")
    detect.write_scored(slim, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch_id")


def score_stream_cases(spark, sf):
    """Scores and reports of the stream with a search for similar cases in each micro-batch."""
    folder = shared_folder(spark, "scores")
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("msg_id"), "embedding")
    spam = messages(spark, sf).where("type = 'spam'").join(vecs, "msg_id")
    corpus = spam.select(F.col("msg_id").alias("case_id"), "embedding", "text")
    given = answers(spark, sf)

    def job(batch):
        cased = with_cases(batch.join(vecs, "msg_id", "left"), corpus)
        return detect.score_stream(cased, answers=given).select(
            "msg_id", "total_score", "max_similarity", F.size("similar_cases").cast("bigint").alias("n_cases"),
            "risk_score", "risk_level", F.md5("report").alias("report_md5"))

    detect.write_batches(_stream(spark, sf), job, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch_id")


def write_detections(spark, sf):
    folder = shared_folder(spark, "detections")
    scored = detect.score_stream(_stream(spark, sf), answers=answers(spark, sf))
    query = detect.write_detections(scored, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch_id")


def recent_stream(spark, sf):
    folder = shared_folder(spark, "daily")
    daily = detect.daily_texts(_stream(spark, sf))
    detect.write_daily_texts(daily, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return detect.recent_stream_texts(spark, f"{folder}/out", F.lit(dt.date(2024, 1, 31)), days=15)


def live_stream(spark, sf):
    folder = shared_folder(spark, "live")
    live = detect.live_texts(_stream(spark, sf))
    detect.write_live_texts(live, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return detect.recent_stream_texts(spark, f"{folder}/out", F.lit(dt.date(2024, 1, 31)), days=15)


QUERIES = {
    "q_a1_read_messages": read_messages,
    "q_a1_read_blocks": read_blocks,
    "q_a2_read_latin1": read_latin1,
    "q_a3_read_labelled": read_documents,
    "q_a5_read_scams": read_scams,
    "q_a6_scams_of_type": scams_of_type,
    "q_a7_conform_scams": conform_scams,
    "q_a7_conform_realtime": conform_realtime,
    "q_a7_rejected": rejected_rows,
    "q_a7_assign_ids": assign_ids,
    "q_a8_seed_filled": seed_if_empty,
    "q_a8_seed_empty": seed_empty_types,
    "q_a9_split_files": split_files,
    "q_a10_stats_file": stats_file,
    "q_a10_profile_file": profile_file,
    "q_a10_funnel_file": funnel_file,
    "q_a10_thresholds_file": thresholds_file,
    "q_b10_corpus_from_files": corpus_from_files,
    "q_k1_templates": generate_template,
    "q_k2_links": generate_links,
    "q_k3_rewrites": generate_rewrites,
    "q_k4_noise": generate_noise,
    "q_k5_generate": generate_all,
    "q_l1_score_stream": score_stream,
    "q_l1_score_stream_cases": score_stream_cases,
    "q_l2_write_detections": write_detections,
    "q_l3_recent_stream": recent_stream,
    "q_l3_live_stream": live_stream,
}


_DRAWS = """category kind scheme host open_tld tld tagged amount id account agency username status benefit action
deadline alert_type transaction_type instruction courier claim verify dollars colon blank shout""".split()


def _number(slot: str, below: int) -> str:
    at = _DRAWS.index(slot)
    first = 1 + at % 5 * 6
    return f"(('0x' || md5('{SEED}:' || id || ':{at // 5}')[{first}:{first + 5}])::bigint % {below})"


def _pick(slot: str, choices) -> str:
    listed = ", ".join("'" + c + "'" for c in choices)
    return f"[{listed}][{_number(slot, len(choices))} + 1]"


_HOST, _TLD = _pick("host", gen.WORDS), _pick("tld", ["com", "net"])
_HASH = f"md5(md5('{SEED}:' || id || ':0') || ':uuid')"
_UUID = " || '-' || ".join(f"{_HASH}[{a}:{b}]" for a, b in ((1, 8), (9, 12), (13, 16), (17, 20), (21, 32)))
_LINK = f"""case {_number('kind', 3)}
  when 0 then regexp_replace({_pick('scheme', ['https://', 'http://', ''])} || {_HOST} || '.' ||
              {_pick('open_tld', ['com', 'net', 'org', 'info'])}, '\\.', '[.]')
  when 1 then translate({_HOST}[1:4], 'oiea', '0134') || {_HOST}[5:] || '.' || {_TLD}
  else {_HOST} || '-redirect.' || {_TLD} || case when {_number('tagged', 100)} < 50 then '?id=' || {_UUID} else '' end end"""
_AMOUNT = f"'$' || ({_number('amount', 900)} + 100)"


def _choice(category: str, slot: str) -> str:
    return _pick(slot, gen.CHOICES[category, slot])


_DRAFT = f"""case {_number('category', 3)}
  when 0 then '[' || {_choice('government', 'agency')} || '] ' || {_pick('username', gen.WORDS)} || ': '
    || {_choice('government', 'status')} || ' ' || {_choice('government', 'benefit')} || ' of ' || {_AMOUNT} || '. '
    || {_choice('government', 'action')} || ' ' || {_pick('deadline', gen.WORDS)} || ': ' || ({_LINK})
  when 1 then {_choice('financial', 'alert_type')} || ': ' || {_AMOUNT} || ' ' || {_choice('financial', 'transaction_type')}
    || ' from Account ****' || ({_number('account', 9000)} + 1000) || '. ' || {_pick('instruction', gen.WORDS)} || ' ' || ({_LINK})
  else {_pick('courier', gen.WORDS)} || ': Package ##' || ({_number('id', 900000)} + 100000) || ' requires '
    || {_choice('shipping', 'action')} || '. ' || {_choice('shipping', 'instruction')} || ' ' || ({_LINK}) end"""
_DRAFTS = f"drafts as (select id, {_DRAFT} as message from (select event_id as id from events))"
_REWRITTEN = f"""rewritten as (
  select id, regexp_replace(message, ':', {_pick('colon', gen.COLON_SWAPS)}) as message from (
  select id, case when {_number('dollars', 100)} < 50 then regexp_replace(message, '(\\d+)', '$\\1', 'g') else message end as message from (
  select id, regexp_replace(message, 'verify', {_pick('verify', ['confirm', 'validate', 'authenticate'])}) as message from (
  select id, regexp_replace(message, 'claim', {_pick('claim', ['collect', 'access', 'secure'])}) as message from drafts))))"""


def _noisy(source: str) -> str:
    return f"""select id, case when {_number('shout', 100)} < 10
        then upper(message[1:length(message) // 2]) || lower(message[length(message) // 2 + 1:]) else message end as message
      from (select id, case when {_number('blank', 100)} < 20 then regexp_replace(message, ' ', '  ') else message end as message
            from {source})"""


_CONFORMED = """select msg_id as id, {source} scam_text, scam_type, coalesce(confidence, {default})::double as confidence,
  coalesce(detected_at, timestamp '2024-01-31 12:00:00') as detected_at
  from ({rows}) where scam_text is not null"""
_SCAM_TABLE = _CONFORMED.format(source="", default=1.0, rows=_SCAMS)
_REALTIME_TABLE = _CONFORMED.format(source="source,", default=0.8, rows=_SCAMS)
_STREAMED = RISK_ORACLES["q_i6_score_messages"].replace("left join cases c on c.query_id = m.msg_id",
                                                        "left join cases c on false")

ORACLES = {
    "q_a1_read_messages": sql.with_messages("select type, text from messages where text is not null"),
    "q_a1_read_blocks": "select lang as type, length(text) as chars, md5(text) as text_md5 from documents",
    "q_a2_read_latin1": sql.with_messages("select type, text from messages where text is not null"),
    "q_a3_read_labelled": "select doc_id, lang as type, md5(text) as text_md5 from documents",
    "q_a5_read_scams": sql.with_messages(_SCAM_TABLE),
    "q_a6_scams_of_type": sql.with_messages(f"select * from ({_SCAM_TABLE}) where scam_type = 'phishing'"),
    "q_a7_conform_scams": sql.with_messages(_SCAM_TABLE),
    "q_a7_conform_realtime": sql.with_messages(_REALTIME_TABLE),
    "q_a7_rejected": sql.with_messages(
        """select msg_id as id, nullif(source, 'signup') as source, case source when 'click' then 'phishing'
             when 'purchase' then 'financial' when 'signup' then 'lottery' end as scam_type,
             concat_ws(',', case when source = 'signup' then 'source' end,
                       case when text is null then 'scam_text' end) as missing
        from messages where source = 'signup' or text is null"""
    ),
    "q_a7_assign_ids": sql.with_messages(
        """select row_number() over (order by md5('42:' || msg_id), msg_id)
             + (select max(msg_id) from messages where source <> 'purchase') as id, msg_id
        from messages where source = 'purchase'"""
    ),
    "q_a8_seed_filled": sql.with_messages(
        f"select source, scam_text, scam_type, confidence from ({_REALTIME_TABLE})"
    ),
    "q_a8_seed_empty": sql.with_messages(
        f"""select source, scam_text, scam_type, confidence from ({_REALTIME_TABLE}) where length(scam_text) > 100000
        union all select * from (values
          ('sample', 'Your account has been compromised, verify now', 'phishing', 0.9::double),
          ('sample', 'Congratulations! You''ve won $1,000,000', 'lottery', 0.95),
          ('sample', 'Urgent: Transfer money to secure account', 'financial', 0.85)) v(a, b, c, d)
        where not exists (select * from ({_REALTIME_TABLE}) where length(scam_text) > 100000)"""
    ),
    "q_a9_split_files": """with counts as (select lang, count(*) as n from documents group by 1),
      sized as (select *, sum(n) over () as all_rows,
                  ceil(sum(n) over () * case when sum(n) over () < 10000 then 0.3::double else 0.2 end - 1e-9) as total from counts),
      quotas as (select *, floor(n * total / all_rows) + case when row_number() over (
                   order by round(n * total / all_rows - floor(n * total / all_rows), 9) desc, lang)
                   <= total - sum(floor(n * total / all_rows)) over () then 1 else 0 end as n_test from sized)
      select 'test' as split, lang as type, n_test::bigint as n from quotas
      union all select 'train', lang, (n - n_test)::bigint from quotas""",
    "q_a10_profile_file": corpus.ORACLES["q_e3_profile"],
    "q_a10_funnel_file": corpus.ORACLES["q_e4_funnel"],
    "q_a10_thresholds_file": evaluate.ORACLES["q_j3_metrics"],
    "q_a10_stats_file": """select lang, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as share
      from documents group by lang""",
    "q_b10_corpus_from_files": sql.with_messages(
        f"""select type, text from (
          select type, text, row_number() over (partition by text order by (source = 'click')::int desc) as r
          from (select lower(type) as type, source, {sql.masked(sql.normal('text'))} as text from messages
                where lower(type) in ('spam', 'ham')) where length(text) >= 10) where r = 1"""
    ),
    "q_k1_templates": f"with {_DRAFTS} select * from drafts",
    "q_k2_links": f"select id, {_LINK} as link from (select event_id as id from events)",
    "q_k3_rewrites": f"with {_DRAFTS}, {_REWRITTEN} select * from rewritten",
    "q_k4_noise": sql.with_messages(
        _noisy("(select msg_id as id, text as message from messages where text is not null)")
    ),
    "q_k5_generate": f"with {_DRAFTS}, {_REWRITTEN} select distinct 'spam' as type, message from ({_noisy('rewritten')})",
    "q_l1_score_stream": f"select msg_id, total_score, risk_score, risk_level from ({_STREAMED})",
    "q_l1_score_stream_cases": RISK_ORACLES["q_i6_score_by_map"],
    "q_l2_write_detections": sql.with_messages(
        f"""select msg_id as id, source, text as scam_text, risk_level as scam_type, risk_score as confidence,
          ts as detected_at
        from messages join ({_STREAMED}) s using (msg_id) where text is not null"""
    ),
    "q_l3_recent_stream": sql.with_messages(
        """select text, max(ts) as last_seen from messages
        where text is not null and text <> '' and ts >= date '2024-01-31' - 15 group by text"""
    ),
}
ORACLES["q_l3_live_stream"] = ORACLES["q_l3_recent_stream"]
