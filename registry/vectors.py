"""Checked queries: vectors and neighbours. Every embedding is asked, and every embedding is corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.views import messages, table
from riskloom.operators import graph, vectors as ops


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def l2_normalise(spark, sf):
    unit = ops.l2_normalise(_vectors(spark, sf))
    return unit.select("vec_id", F.posexplode("embedding").alias("axis", "x")).select(
        "vec_id", F.col("axis").cast("bigint").alias("axis"), F.round("x", 6).alias("x")
    )


def hash_vectors(spark, sf):
    """Every coordinate that is not zero."""
    out = ops.hash_vectors(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.posexplode("embedding").alias("axis", "x")).where("x <> 0").select(
        "doc_id", F.col("axis").cast("bigint").alias("axis"), F.round("x", 6).alias("x"))


def knn(spark, sf):
    return ops.similar(ops.knn(_vectors(spark, sf), _vectors(spark, sf)))


def scaled_similarity(spark, sf):
    """Range of the scaled similarity at each rank."""
    return ops.similar(ops.knn(_vectors(spark, sf), _vectors(spark, sf))).groupBy("rank").agg(
        F.min("similarity").alias("lowest"), F.max("similarity").alias("highest"), F.count(F.lit(1)).alias("n")
    )


def knn_blocked(spark, sf):
    """The same through cells and blocks, as for a corpus too large to broadcast."""
    found = ops.knn(_vectors(spark, sf), _vectors(spark, sf), broadcast_bytes=0, block_rows=128, pivots=16)
    return ops.similar(found)


def knn_approx(spark, sf):
    """Neighbours among the vectors that share a bucket in some table of random projections."""
    every = _vectors(spark, sf)
    return ops.similar(ops.knn_approx(every, every, tables=APPROX_TABLES, bits=APPROX_BITS))


def similar_cases(spark, sf):
    near = ops.similar(ops.knn(_vectors(spark, sf), _vectors(spark, sf)))
    cases = ops.similar_cases(near, table(spark, sf, "documents"))
    return cases.select("query_id", F.posexplode("similar_cases").alias("place", "case")).select(
        "query_id", F.col("place").cast("bigint").alias("place"), F.md5("case.text").alias("text_md5"),
        F.col("case.similarity").alias("similarity"),
    )


def max_similarity(spark, sf):
    """Best similarity of every message; messages without a vector have 0."""
    near = ops.similar(ops.knn(_vectors(spark, sf), _spam_vectors(spark, sf)))
    return ops.max_similarity(messages(spark, sf).select("msg_id"), near, "msg_id")


def _spam_vectors(spark, sf):
    spam = messages(spark, sf).where("type = 'spam'").select(F.col("msg_id").alias("vec_id"))
    return _vectors(spark, sf).join(spam, "vec_id")


def l2_risk(spark, sf):
    out = ops.l2_risk(_vectors(spark, sf), _spam_vectors(spark, sf))
    return out.select(
        "query_id", F.round("mean_distance", 6).alias("mean_distance"), F.round("risk_score", 6).alias("risk_score")
    )


APPROX_TABLES, APPROX_BITS = 40, 6


def hashed_terms(source: str, key: str, text: str, dims: int = 256) -> str:
    """(key, axis, x) of hashed term vectors, without zeros."""
    return f"""select {key}, axis, n / sqrt(sum(n * n) over (partition by {key})) as x from (
      select {key}, ('0x' || substr(md5(term), 1, 8))::bigint % {dims} as axis, count(*)::double as n
      from (select {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) as term from {source})
      group by 1, 2)"""


COSINE = """list_inner_product(q.embedding::double[], c.embedding::double[])
  / sqrt(list_inner_product(q.embedding::double[], q.embedding::double[]))
  / sqrt(list_inner_product(c.embedding::double[], c.embedding::double[]))"""
SPAM_VECTORS = "(select e.* from embeddings e join events v on v.event_id = e.vec_id where v.event_id % 12 < 6)"


def nearest(corpus: str = "embeddings", k: int = 3) -> str:
    return f"""select query_id, rank, neighbour_id, round((ip + 1) / 2 * 0.5, 4) as similarity from (
      select *, row_number() over (partition by query_id order by round(ip, 9) desc, neighbour_id) as rank
      from (select q.vec_id as query_id, c.vec_id as neighbour_id, {COSINE} as ip
            from embeddings q cross join {corpus} c)) where rank <= {k}"""


def graph_neighbours(spark, sf):
    """What the neighbour graph finds against the exact search: recall, and values that differ."""
    vectors = _vectors(spark, sf)
    found = graph.graph_neighbours(graph.build_graph(vectors), vectors, 3)
    exact = ops.knn(vectors, vectors, 3).select("query_id", "neighbour_id", F.col("value").alias("true_value"))
    both = found.join(exact, ["query_id", "neighbour_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"),
        (F.count("true_value") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
        F.count_if(F.abs(F.col("value") - F.col("true_value")) > 1e-9).alias("wrong_values"))


QUERIES = {
    "q_g1_l2_normalise": l2_normalise,
    "q_g2_hash_vectors": hash_vectors,
    "q_g3_knn": knn,
    "q_g3_knn_blocked": knn_blocked,
    "q_g4_scaled_similarity": scaled_similarity,
    "q_g5_similar_cases": similar_cases,
    "q_g6_knn_approx": knn_approx,
    "q_g6_graph_neighbours": graph_neighbours,
    "q_g7_max_similarity": max_similarity,
    "q_g8_l2_risk": l2_risk,
}

ORACLES = {
    "q_g1_l2_normalise": """select vec_id, axis - 1 as axis, round(e / n, 6) as x from (
      select vec_id, unnest(embedding)::double as e, generate_subscripts(embedding, 1) as axis,
             sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings)""",
    "q_g2_hash_vectors": f"select doc_id, axis, round(x, 6) as x from ({hashed_terms('documents', 'doc_id', 'text')})",
    "q_g3_knn": nearest(),
    "q_g3_knn_blocked": nearest(),
    "q_g4_scaled_similarity": f"""select rank, min(similarity) as lowest, max(similarity) as highest, count(*) as n
      from ({nearest()}) group by rank""",
    "q_g5_similar_cases": f"""select query_id, row_number() over (partition by query_id order by rank) - 1 as place,
      md5(text) as text_md5, similarity from ({nearest()}) n join documents d on d.doc_id = n.neighbour_id""",
    "q_g6_knn_approx": f"""with planes as (
        select t, b, list(case when substr(md5(t || ':' || b || ':' || i), 1, 1) < '8' then 1.0::double else -1.0 end
                          order by i) as plane
        from range({APPROX_TABLES}) a(t), range({APPROX_BITS}) c(b), range(64) d(i) group by t, b),
      keys as (select vec_id, t, sum(case when list_inner_product(embedding::double[], plane) > 0 then 1 << b else 0 end) as k
               from embeddings, planes group by vec_id, t),
      pairs as (select distinct a.vec_id as q, b.vec_id as c from keys a join keys b on a.t = b.t and a.k = b.k)
      select query_id, rank, neighbour_id, round((ip + 1) / 2 * 0.5, 4) as similarity from (
        select *, row_number() over (partition by query_id order by round(ip, 9) desc, neighbour_id) as rank from (
          select q.vec_id as query_id, c.vec_id as neighbour_id, {COSINE} as ip
          from pairs p join embeddings q on q.vec_id = p.q join embeddings c on c.vec_id = p.c)) where rank <= 3""",
    "q_g6_graph_neighbours": f"""select count(distinct query_id) as queries, count(*) as neighbours,
      true as recall_reached, 0::bigint as wrong_values from ({nearest()})""",
    "q_g7_max_similarity": f"""select event_id as msg_id, coalesce(best, 0) as max_similarity
      from events left join (select query_id, max(similarity) as best from ({nearest(SPAM_VECTORS)}) group by 1) b
      on b.query_id = event_id""",
    "q_g8_l2_risk": f"""select query_id, round(avg(d), 6) as mean_distance, round(1 - exp(-5 * avg(d)), 6) as risk_score
      from (select query_id, d, row_number() over (partition by query_id order by round(d, 9), neighbour_id) as r
            from (select q.vec_id as query_id, c.vec_id as neighbour_id,
                         list_distance(q.embedding::double[], c.embedding::double[]) ** 2 as d
                  from embeddings q cross join {SPAM_VECTORS} c)) where r <= 3 group by query_id""",
}
