"""Checked queries: verdicts, blended scores, reports, and the whole scoring job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry import sql
from registry.corpus import FOLDS_CTE, LABELLED_CTE
from registry.evaluate import METRICS_SELECT, cells_cte
from registry.rules import ALL_CTES
from registry.vectors import COSINE, SPAM_VECTORS, hashed_terms, nearest
from registry.views import VERDICTS_SQL, messages, raw_verdicts, table
from riskloom.operators import evaluate as ev, risk, rules, text, verdicts
from riskloom.plans import evaluation, scoring


def build_prompts(spark, sf):
    found = rules.pattern_summary(rules.analyse(messages(spark, sf).select("msg_id", "text")))
    out = verdicts.build_prompts(found.where("text is not null"))
    return out.select("msg_id", F.length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("prompt_md5"))


def parse_verdicts(spark, sf):
    return verdicts.parse_verdicts(raw_verdicts(spark, sf)).select("msg_id", "verdict_json")


def answers(spark, sf):
    return scoring.read_verdicts(raw_verdicts(spark, sf))


def conform_verdicts(spark, sf):
    return answers(spark, sf).select(
        "msg_id", "verdict.error", "verdict.risk_score",
        F.array_join("verdict.indicators", " | ").alias("indicators"),
        F.array_join("verdict.recommendations", " | ").alias("recommendations"), "verdict.confidence",
    )


def _prepared(rows, spark, sf):
    """Messages with similar cases and verdicts as columns. Every embedding is the vector of the message with its id;
    the known cases are the spam messages that have one."""
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("msg_id"), "embedding")
    corpus = messages(spark, sf).where("type = 'spam'").join(vecs, "msg_id").select(
        F.col("msg_id").alias("case_id"), "embedding", "text")
    joined = rows.join(vecs, "msg_id", "left").join(raw_verdicts(spark, sf), "msg_id", "left")
    return scoring.with_cases(scoring.read_verdicts(joined), corpus)


def scored(spark, sf):
    return scoring.score_messages(_prepared(messages(spark, sf), spark, sf))


def scored_by_join(spark, sf):
    """The same with similar cases and verdicts kept as tables of their own, joined on the message."""
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("msg_id"), "embedding")
    spam = messages(spark, sf).where("type = 'spam'")
    known = vecs.join(spam.select("msg_id"), "msg_id")
    cases = scoring.cases_for(vecs, known, spam.select("msg_id", "text"), corpus_id="msg_id", text_id="msg_id")
    return scoring.score_messages(messages(spark, sf), cases, answers(spark, sf))


def blend_scores(spark, sf):
    return scored(spark, sf).select("msg_id", "total_score", "max_similarity", "risk_score")


def risk_levels(spark, sf):
    """How many messages fall into each risk level, by label."""
    return scored(spark, sf).groupBy(F.lower("type").alias("type"), "risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("risk_score"), 6).alias("mean_score")
    )


def verdict_decision(spark, sf):
    decided = risk.verdict_decision(answers(spark, sf))
    return decided.select("msg_id", "risk_detected", "confidence", "decision_level")


def invalid_input(spark, sf):
    return scored(spark, sf).where(F.col("risk_level") == risk.INVALID).select(
        "msg_id", "text", "risk_score", "total_score", "report", F.col("verdict.error").alias("error")
    )


def build_reports(spark, sf):
    return scored(spark, sf).select("msg_id", F.md5("report").alias("report_md5"))


def score_messages(spark, sf):
    return scored_by_join(spark, sf).select(
        "msg_id", "score_financial", "score_urgency", "score_suspicious", "total_score", "max_similarity",
        F.size("similar_cases").cast("bigint").alias("n_cases"), F.col("verdict.error").alias("verdict_error"),
        "risk_score", "risk_level",
    )


def score_by_map(spark, sf):
    """The same scores with the search and the raw answer on the message row: no shuffle after the test tables
    are put together."""
    return scored(spark, sf).select(
        "msg_id", "total_score", "max_similarity", F.size("similar_cases").cast("bigint").alias("n_cases"),
        "risk_score", "risk_level", F.md5("report").alias("report_md5"),
    )


def detection_records(spark, sf):
    done = scoring.score_requests(_prepared(messages(spark, sf), spark, sf))
    records = risk.detection_records(done, at=F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz"))
    return records.select(
        "msg_id", "analysis_id", "timestamp", "input_text", "risk_detected", "confidence", "risk_score",
        "risk_level", F.md5("report").alias("report_md5"), F.array_join("patterns", " | ").alias("patterns"),
        F.col("pattern_analysis.total_score").alias("total_score"),
        F.array_join("pattern_analysis.matched_patterns", " | ").alias("analysed_patterns"),
        F.size("similar_texts").cast("bigint").alias("n_cases"),
        F.array_join(F.transform("similar_texts", lambda case: F.concat(
            case["text"], F.lit(" @"), F.round(case["similarity"] * 10_000).cast("bigint").cast("string"))), " | "
        ).alias("similar_texts"),
        F.col("llm_analysis.risk_assessment").alias("risk_assessment"),
        F.array_join("llm_analysis.indicators", " | ").alias("indicators"),
        F.array_join("llm_analysis.recommendations", " | ").alias("recommendations"),
        F.col("llm_analysis.confidence").alias("verdict_confidence"),
    )


def _message_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("msg_id"), "embedding")


TEXT_DIMS = 64
CV_THRESHOLDS = (0.1, 0.2, 0.3, 0.4)


def cv_sweep(spark, sf):
    out = evaluation.cv_sweep(
        messages(spark, sf), CV_THRESHOLDS, vecs=_message_vectors(spark, sf), answers=answers(spark, sf)
    )
    rounded = {c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")}
    return out.withColumns(rounded).withColumn("fold", F.col("fold").cast("bigint"))


def _labelled_scores(rows, spark, sf):
    """Score of a labelled message; null where its answer failed, as a failed request would leave it."""
    done = scoring.score_messages(_prepared(rows, spark, sf))
    failed = F.col("verdict.error").eqNullSafe(verdicts.FAILED)
    return text.to_binary(done).select("msg_id", "y_true", F.when(~failed, F.col("risk_score")).alias("score"))


def _labelled(spark, sf):
    return text.keep_labels(messages(spark, sf))


def threshold_report(spark, sf):
    metrics, _, _ = evaluation.threshold_report(_labelled(spark, sf), lambda rows: _labelled_scores(rows, spark, sf))
    return metrics.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


def threshold_auc(spark, sf):
    _, _, area = evaluation.threshold_report(
        _labelled(spark, sf), lambda rows: _labelled_scores(rows, spark, sf), on_error="zero"
    )
    return area.withColumn("auc", F.round("auc", 6))


def failure_policy(spark, sf):
    """Rows and mean score under either policy, from one pass over the scores."""
    return ev.failure_policies(_labelled_scores(_labelled(spark, sf), spark, sf)).withColumn(
        "mean_score", F.round("mean_score", 6))


def score_from_texts(spark, sf):
    """The job from nothing but texts: messages and known spam become hashed term vectors."""
    known = messages(spark, sf).where("type = 'spam'").select(F.col("msg_id").alias("case_id"), "text")
    cased = scoring.with_cases_from_texts(messages(spark, sf), known, dims=TEXT_DIMS)
    return scoring.score_messages(cased).select("msg_id", "max_similarity", "risk_score", "risk_level")


QUERIES = {
    "q_h1_prompts": build_prompts,
    "q_h2_parse": parse_verdicts,
    "q_h3_conform": conform_verdicts,
    "q_i1_blend": blend_scores,
    "q_i2_risk_levels": risk_levels,
    "q_i3_decision": verdict_decision,
    "q_i4_invalid_input": invalid_input,
    "q_i5_reports": build_reports,
    "q_i6_score_messages": score_messages,
    "q_i6_score_by_map": score_by_map,
    "q_i6_score_from_texts": score_from_texts,
    "q_i7_records": detection_records,
    "q_j4_cv_sweep": cv_sweep,
    "q_j7_threshold_report": threshold_report,
    "q_j7_threshold_auc": threshold_auc,
    "q_j8_failure_policy": failure_policy,
}

_ANSWERS_CTE = r"""raw_answers as (""" + VERDICTS_SQL + r"""),
 unfenced as (select msg_id, regexp_replace(regexp_replace(raw, '^\s*```(?:json)?\s*', ''), '\s*```\s*$', '') as p
              from raw_answers),
 parsed as (select msg_id, case when json_valid(p) then p
                 when json_valid(replace(p, chr(92), chr(92) || chr(92))) then replace(p, chr(92), chr(92) || chr(92))
                 end as verdict_json from unfenced),
 read as (
  select msg_id, verdict_json as j,
   case when json_exists(verdict_json, '$.risk_score')
        then try_cast(json_extract_string(verdict_json, '$.risk_score') as double) else 0.0 end as s,
   [trim(x) for x in json_extract_string(verdict_json, '$.indicators[*]') if x is not null and x <> ''] as i,
   [trim(x) for x in json_extract_string(verdict_json, '$.recommendations[*]') if x is not null and x <> ''] as r,
   coalesce(json_extract_string(verdict_json, '$.confidence'), 'Low') as c from parsed),
 answers as (
  select msg_id, case when j is null then 'LLM analysis unavailable' when s is null then 'LLM analysis failed' end as error,
   coalesce(s, 0.0) * (j is not null)::int as risk_score,
   case when j is null or s is null then [] else i end as indicators,
   case when j is null or s is null then ['Please rely on pattern matching results'] else r end as recommendations,
   case when j is null or s is null then 'Low' else c end as confidence from read)"""

_LEVEL = """case when {x} >= 0.7 then 'Critical Risk' when {x} >= 0.5 then 'High Risk'
  when {x} >= 0.3 then 'Medium Risk' else 'Low Risk' end"""

_JOB_CTE = f"""near as ({nearest(SPAM_VECTORS)}),
 cases as (select query_id, max(similarity) as best, list(text order by rank) as texts,
                  list(similarity order by rank) as sims
           from near join messages on messages.msg_id = neighbour_id group by query_id),
 base as (
  select m.*, coalesce(length({sql.strip('m.text')}) >= 3, false) as usable, s.score_financial as f, s.score_urgency as u,
    s.score_suspicious as p, s.total_score as total, s.patterns, c.best, coalesce(c.texts, []) as texts,
    coalesce(c.sims, []) as sims, a.msg_id is not null as answered, a.error as e, a.risk_score as r,
    a.indicators, a.recommendations, a.confidence as conf
  from messages m join scores s using (msg_id) left join cases c on c.query_id = m.msg_id
  left join answers a using (msg_id)),
 job as (
  select msg_id, type, text, usable, if(usable, f, 0) as score_financial, if(usable, u, 0) as score_urgency,
    if(usable, p, 0) as score_suspicious, if(usable, total, 0) as total_score,
    if(usable, coalesce(best, 0), 0) as max_similarity, if(usable, len(texts), 0) as n_cases,
    case when not usable then 'Text too short' when not answered then 'LLM analysis unavailable' else e end as verdict_error,
    case when usable and answered and e is null then r else 0 end as verdict_score,
    patterns, texts, sims, indicators, recommendations, conf from base),
 blended as (
  select *, {sql.round4('total_score * 0.4::double + max_similarity * 0.3::double + verdict_score * 0.3::double')} as risk_score
  from job),
 levelled as (select *, case when not usable then 'Invalid Input' else {_LEVEL.format(x='risk_score')} end as risk_level
  from blended),
 reported as (
  select *, case when not usable then 'Text too short' else concat_ws(chr(10) || chr(10),
    '**Risk Level**: ' || case when total_score > 0.7 then 'High Risk' when total_score > 0.4 then 'Medium Risk' else 'Low Risk' end,
    case when score_financial > 0 or score_urgency > 0 or score_suspicious > 0 then '**Suspicious Patterns**  ' || chr(10) || '- ' ||
      concat_ws('  ' || chr(10) || '- ',
       case when score_financial > 0 then 'Mentions of banks, amounts, accounts, etc.' end,
       case when score_urgency > 0 then 'Urges immediate action or response within a limited time' end,
       case when score_suspicious > 0 then 'Contains suspicious words like ''click'', ''secure'', etc.' end) end,
    case when len([x for x in sims[1:2] if round(x * 100, 1) > 30]) > 0 then '**Similar Cases**  ' || chr(10) || '- ' ||
      concat_ws('  ' || chr(10) || '- ',
       case when round(sims[1] * 100, 1) > 30 then 'Similarity ' || round(sims[1] * 100, 1)::varchar || '%: ' || texts[1][1:50] || '...' end,
       case when round(sims[2] * 100, 1) > 30 then 'Similarity ' || round(sims[2] * 100, 1)::varchar || '%: ' || texts[2][1:50] || '...' end) end,
    case when verdict_error is null and len([x for x in indicators if trim(x) <> '']) > 0 then '**Risk Indicators**  ' || chr(10) || '- ' ||
      array_to_string([x for x in indicators if trim(x) <> ''], '  ' || chr(10) || '- ') end,
    case when verdict_error is null and len([x for x in recommendations if trim(x) <> '']) > 0 then '**Recommended Actions**  ' || chr(10) || '- ' ||
      array_to_string([x for x in recommendations if trim(x) <> ''], '  ' || chr(10) || '- ') end) end as report
  from levelled)"""


def _job(body: str, *more: str) -> str:
    return sql.with_messages(body, *ALL_CTES, _ANSWERS_CTE, _JOB_CTE, *more)


_PROMPT = """'Analyze the potential fraud risk of the following text:' || chr(10) || chr(10) || 'Text: ' || text
  || chr(10) || chr(10) || 'Detected patterns:' || chr(10)
  || case when summary <> '' then summary else 'No suspicious patterns detected' end || chr(10) || chr(10)
  || 'Please provide the analysis in the following JSON format:' || chr(10) || '{' || chr(10)
  || '    "risk_score": (risk score between 0 and 1),' || chr(10)
  || '    "indicators": [list of main risk indicators],' || chr(10)
  || '    "recommendations": [recommended actions],' || chr(10)
  || '    "confidence": "Low/Medium/High"' || chr(10) || '}'"""

_UUID = "md5(msg_id || ':' || {t})"
_CV_NEAR = "(" + " union all ".join(
    f"""select f.msg_id, max((ip + 1) / 2 * 0.5) as best from (
      select q.vec_id, {COSINE} as ip
      from embeddings q join folds a on a.msg_id = q.vec_id and a.fold = {fold}
      cross join embeddings c join folds b on b.msg_id = c.vec_id and b.fold <> {fold} and b.type = 'spam') p
    join folds f on f.msg_id = p.vec_id group by f.msg_id"""
    for fold in (1, 2)
) + ")"
_CV_CTE = f"""cv as (
  select f.msg_id, f.fold, (f.type = 'spam')::bigint as y_true,
    {sql.round4("""s.total_score * 0.4::double + coalesce(round(n.best, 4), 0) * 0.3::double
          + case when a.error is null then coalesce(a.risk_score, 0) else 0 end * 0.3::double""")} as score
  from folds f join scores s using (msg_id) left join {_CV_NEAR} n using (msg_id) left join answers a using (msg_id)),
 thresholds(threshold) as (values {", ".join(f"({t}::double)" for t in CV_THRESHOLDS)})"""

_RESULTS_CTE = """results as (
  select msg_id, (lower(type) = 'spam')::bigint as y_true,
    case when verdict_error is distinct from 'LLM analysis failed' then risk_score end as score
  from levelled where lower(type) in ('spam', 'ham'))"""
_SAMPLE_CTE = """picked as (select * from results order by md5('42:' || msg_id), msg_id limit 200)"""
_FINE_CTE = "thresholds(threshold) as (values " + ", ".join(f"({t}::double)" for t in ev.FINE_THRESHOLDS) + ")"

ORACLES = {
    "q_h1_prompts": sql.with_messages(
        f"""select msg_id, length(x) as chars, md5(x) as prompt_md5 from (
          select msg_id, {_PROMPT} as x from messages join scores using (msg_id) where text is not null)""",
        *ALL_CTES,
    ),
    "q_h2_parse": f"with {_ANSWERS_CTE} select msg_id, verdict_json from parsed",
    "q_h3_conform": f"""with {_ANSWERS_CTE} select msg_id, error, risk_score,
      array_to_string(indicators, ' | ') as indicators, array_to_string(recommendations, ' | ') as recommendations,
      confidence from answers""",
    "q_i1_blend": _job("select msg_id, total_score, max_similarity, risk_score from blended"),
    "q_i2_risk_levels": _job(
        """select lower(type) as type, risk_level, count(*) as n, round(avg(risk_score), 6) as mean_score
        from levelled group by 1, 2"""
    ),
    "q_i3_decision": f"""with {_ANSWERS_CTE} select msg_id, risk_score > 0.5 as risk_detected,
      round(risk_score, 4) as confidence, {_LEVEL.format(x='risk_score')} as decision_level from answers""",
    "q_i4_invalid_input": _job(
        """select msg_id, text, risk_score, total_score::double as total_score, report, verdict_error as error
        from reported where risk_level = 'Invalid Input'"""
    ),
    "q_i5_reports": _job("select msg_id, md5(report) as report_md5 from reported"),
    "q_i6_score_messages": _job(
        """select msg_id, score_financial, score_urgency, score_suspicious, total_score, max_similarity, n_cases,
        verdict_error, risk_score, risk_level from levelled"""
    ),
    "q_i6_score_by_map": _job(
        "select msg_id, total_score, max_similarity, n_cases, risk_score, risk_level, md5(report) as report_md5 from reported"
    ),
    # Equal texts have equal vectors, so each pair of distinct texts is compared once.
    "q_i6_score_from_texts": sql.with_messages(
        f"""select m.msg_id, if(usable, round((coalesce(best, 0) + 1) / 2 * 0.5, 4), 0) as max_similarity, risk_score,
          case when not usable then 'Invalid Input' else {_LEVEL.format(x='risk_score')} end as risk_level
        from (select *, {sql.round4("total * 0.4::double + if(usable, round((coalesce(best, 0) + 1) / 2 * 0.5, 4), 0) * 0.3::double")} as risk_score
              from (select m.msg_id, best, coalesce(length({sql.strip('m.text')}) >= 3, false) as usable,
                      if(coalesce(length({sql.strip('m.text')}) >= 3, false), s.total_score, 0) as total
                    from messages m join scores s using (msg_id) left join nearest_text t on t.text = m.text)) m""",
        *ALL_CTES,
        f"""texts as (select distinct text from messages where text is not null),
        terms as ({hashed_terms('texts', 'text', 'text', TEXT_DIMS)}),
        known as (select t.* from terms t where t.text in (select text from messages where type = 'spam')),
        nearest_text as (select text, max(ip) as best from (
          select a.text, sum(a.x * b.x) as ip from terms a join known b using (axis) group by a.text, b.text)
          group by text)""",
    ),
    "q_i7_records": _job(
        f"""select msg_id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) as analysis_id,
          timestamp '2024-01-31 00:00:00' as timestamp, t as input_text, verdict_score > 0.5 as risk_detected,
          round(verdict_score, 4) as confidence, round(verdict_score, 4) as risk_score,
          {_LEVEL.format(x='verdict_score')} as risk_level,
          md5(replace(report, chr(92), chr(92) || chr(92))) as report_md5,
          if(usable, patterns, '') as patterns, if(usable, patterns, '') as analysed_patterns, total_score, n_cases,
          if(usable, array_to_string([z[1] || ' @' || round(z[2] * 10000)::bigint for z in list_zip(texts, sims)], ' | '), '')
            as similar_texts,
          case when not usable then '' when recommendations is null then 'Please rely on pattern matching results'
            else array_to_string(recommendations, ' | ') end as recommendations,
          verdict_score as risk_assessment,
          case when usable and verdict_error is null then array_to_string(indicators, ' | ') else '' end as indicators,
          case when usable and verdict_error is null then conf else 'Low' end as verdict_confidence
        from (select *, {sql.strip('text')} as t, {_UUID.format(t=sql.strip('text'))} as h from reported)
        where t <> ''"""
    ),
    "q_j4_cv_sweep": sql.with_messages(
        f"""select fold, threshold, {METRICS_SELECT} from by_fold
        union all select null, threshold, {METRICS_SELECT} from pooled""",
        LABELLED_CTE, FOLDS_CTE, *ALL_CTES, _ANSWERS_CTE, _CV_CTE,
        cells_cte("cv", "by_fold", "fold,"), cells_cte("cv", "pooled"),
    ),
    "q_j7_threshold_report": _job(
        f"select threshold, {METRICS_SELECT} from cells",
        _RESULTS_CTE, _SAMPLE_CTE, _FINE_CTE, cells_cte("(select * from picked where score is not null)"),
    ),
    "q_j7_threshold_auc": _job(
        """select any_value(p) as positives, any_value(n) as negatives,
          round(sum(neg * (tp - pos / 2)) / (any_value(p) * any_value(n)), 6) as auc from (
          select pos, neg, sum(pos) over (order by score desc) as tp, (sum(pos) over ())::bigint as p,
                 (sum(neg) over ())::bigint as n from (
            select coalesce(score, 0) as score, sum(y_true) as pos, sum(1 - y_true) as neg from picked group by 1))""",
        _RESULTS_CTE, _SAMPLE_CTE,
    ),
    "q_j8_failure_policy": _job(
        """select 'skip' as policy, count(*) as n, round(avg(score), 6) as mean_score from results where score is not null
        union all select 'zero', count(*), round(avg(coalesce(score, 0)), 6) from results""",
        _RESULTS_CTE,
    ),
}
