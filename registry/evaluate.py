"""Checked queries: metrics over pattern scores of all labelled messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import sql
from registry.corpus import FOLDS_CTE, LABELLED_CTE
from registry.rules import ALL_CTES
from registry.vectors import COSINE
from registry.views import messages, table
from riskloom.operators import evaluate as ev, rules, text as tx, vectors as vx

THRESHOLDS = (0.1, 0.2, 0.3, 0.6)


def scored(spark, sf):
    """``(msg_id, y_true, score)`` with the pattern total as the score."""
    rows = tx.to_binary(tx.keep_labels(messages(spark, sf).select("msg_id", "type", "text")))
    return rules.pattern_score(rows).select("msg_id", "y_true", F.col("total_score").alias("score"))


def predict(spark, sf):
    out = ev.predict(scored(spark, sf), THRESHOLDS)
    return out.select("msg_id", "threshold", F.col("y_pred").cast("bigint").alias("y_pred"))


def confusion(spark, sf):
    return ev.confusion(scored(spark, sf), THRESHOLDS)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def metrics(spark, sf):
    return _rounded(ev.metrics(ev.confusion(scored(spark, sf), THRESHOLDS)))


def roc(spark, sf):
    return _rounded(ev.roc(scored(spark, sf), digits=4))


def auc(spark, sf):
    return _rounded(ev.auc(scored(spark, sf), digits=4))


def _near_scored(spark, sf):
    """Cosine to the nearest other vector as score of the vector's message: as many scores as rows."""
    labelled = tx.to_binary(messages(spark, sf).select("msg_id", "type"))
    every = table(spark, sf, "embeddings").select("vec_id", "embedding")
    near = vx.knn(every, every).where("rank > 1").groupBy("query_id").agg(F.max("value").alias("score"))
    return labelled.join(near, F.col("msg_id") == F.col("query_id")).select(
        "msg_id", "y_true", F.round("score", 9).alias("score")
    )


def roc_ranges(spark, sf):
    out = ev.roc(_near_scored(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("tpr", "fpr")})


def auc_ranges(spark, sf):
    return _rounded(ev.auc(_near_scored(spark, sf)))


QUERIES = {
    "q_j1_predict": predict,
    "q_j2_confusion": confusion,
    "q_j3_metrics": metrics,
    "q_j5_roc": roc,
    "q_j5_roc_ranges": roc_ranges,
    "q_j6_auc": auc,
    "q_j6_auc_ranges": auc_ranges,
}

SCORED_CTE = """scored as (
  select msg_id, (l.type = 'spam')::bigint as y_true, total_score as score from labelled l join scores using (msg_id))"""
T_CTE = "thresholds(threshold) as (values " + ", ".join(f"({t}::double)" for t in THRESHOLDS) + ")"


def cells_cte(source: str = "scored", name: str = "cells", by: str = "") -> str:
    return f"""{name} as (
  select {by} threshold, count(*) filter (y_true = 1 and score >= threshold) as tp,
         count(*) filter (y_true = 0 and score >= threshold) as fp,
         count(*) filter (y_true = 1 and score < threshold) as fn,
         count(*) filter (y_true = 0 and score < threshold) as tn
  from {source} cross join thresholds group by {by} threshold)"""


METRICS_SELECT = """round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) as accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, tp + fn as support"""

CURVE_CTE = """curve as (
  select score as threshold, pos, neg,
         (sum(pos) over (order by score desc))::bigint as tp, (sum(neg) over (order by score desc))::bigint as fp,
         (sum(pos) over ())::bigint as p, (sum(neg) over ())::bigint as n
  from (select score, sum(y_true) as pos, sum(1 - y_true) as neg from scored group by score))"""
_ROC = """select threshold, tp, fp, round(tp / p, 6) as tpr, round(fp / n, 6) as fpr from curve
  union all select null, 0, 0, 0, 0"""
_AUC = """select any_value(p) as positives, any_value(n) as negatives,
  round(sum(neg * (tp - pos / 2)) / (any_value(p) * any_value(n)), 6) as auc from curve"""
_BASE = (LABELLED_CTE, *ALL_CTES, SCORED_CTE)
_FINE_CTE = f"""scored as (
  select msg_id, (type = 'spam')::bigint as y_true, round(value, 9) as score
  from messages join (select query_id, max(ip) as value from (
     select *, row_number() over (partition by query_id order by round(ip, 9) desc, neighbour_id) as rank from (
       select q.vec_id as query_id, c.vec_id as neighbour_id,
              {COSINE} as ip
       from embeddings q cross join embeddings c)) where rank between 2 and 3 group by query_id)
  on query_id = msg_id)"""

ORACLES = {
    "q_j1_predict": sql.with_messages(
        "select msg_id, threshold, (score >= threshold)::bigint as y_pred from scored cross join thresholds",
        *_BASE, T_CTE,
    ),
    "q_j2_confusion": sql.with_messages("select * from cells", *_BASE, T_CTE, cells_cte()),
    "q_j3_metrics": sql.with_messages(f"select threshold, {METRICS_SELECT} from cells", *_BASE, T_CTE, cells_cte()),
    "q_j5_roc": sql.with_messages(_ROC, *_BASE, CURVE_CTE),
    "q_j5_roc_ranges": sql.with_messages(_ROC, _FINE_CTE, CURVE_CTE),
    "q_j6_auc": sql.with_messages(_AUC, *_BASE, CURVE_CTE),
    "q_j6_auc_ranges": sql.with_messages(_AUC, _FINE_CTE, CURVE_CTE),
}
