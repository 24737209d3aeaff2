"""Queries that audit or combine results of several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import cleaning as cl
from pairloom.operators import contracts as ct
from pairloom.operators import vectors as vc
from pairloom.plans.base import PAIRS_SQL, pairs, query, squash_sql, table
from pairloom.plans.vectors import _DOT, _SCORED_SQL, _search
from pairloom.sources import markup


@query("""WITH m AS (SELECT DISTINCT s_suppkey AS model FROM supplier), a AS (SELECT l_suppkey AS model, avg(l_discount) AS value FROM lineitem WHERE l_quantity > 49.5 GROUP BY 1),
b AS (SELECT l_suppkey AS model, CASE WHEN count(*) > 5 THEN avg(l_tax) END AS value FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R' GROUP BY 1)
SELECT m.model, CASE WHEN a.model IS NULL THEN 'missing_clean' WHEN a.value IS NULL THEN 'not_finite_clean' WHEN b.model IS NULL THEN 'missing_robust' WHEN b.value IS NULL THEN 'not_finite_robust' END AS reason
FROM m LEFT JOIN a USING (model) LEFT JOIN b USING (model)""")
def model_rejections(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model"), "l_quantity", "l_discount", "l_tax", "l_returnflag")
    a = li.where("l_quantity > 49.5").groupBy("model").agg(F.avg("l_discount").alias("value"))
    b = li.where("l_quantity > 49 and l_returnflag = 'R'").groupBy("model").agg(F.when(F.count(F.lit(1)) > 5, F.avg("l_tax")).alias("value"))
    return ct.rejections(table(spark, d, "supplier").select(F.col("s_suppkey").alias("model")), ["model"], {"clean": a, "robust": b})


@query(f"""WITH o AS (SELECT row_id, source_candidate_id, {squash_sql('positive')} AS t, row_number() OVER (PARTITION BY source_candidate_id, {squash_sql('positive')} ORDER BY row_id) AS n
  FROM grounded_synthetic_query_factory WHERE source_candidate_id IS NOT NULL) SELECT row_id, source_candidate_id FROM o WHERE n > 1""")
def duplicate_generated_per_source(spark, d):
    from pairloom.functions.text import squash

    g = table(spark, d, "grounded_synthetic_query_factory").where("source_candidate_id is not null").select("row_id", "source_candidate_id", squash(F.col("positive")).alias("t"))
    first = cl.first_seen(g, ["source_candidate_id", "t"], ["row_id"]).select("row_id")
    return g.join(first, "row_id", "left_anti").select("row_id", "source_candidate_id")


@query(_SCORED_SQL + """, dense AS (SELECT query_id, doc_id, score FROM ranked WHERE rank <= 10), own AS (SELECT query_id, doc_id, score FROM scored WHERE doc_id BETWEEN query_id + 1 AND query_id + 7),
u AS (SELECT *, 1 AS d, 0 AS s FROM dense UNION ALL SELECT *, 0, 1 FROM own)
SELECT query_id, doc_id, round(max(score), 6) AS score, CASE WHEN max(d) = 1 AND max(s) = 1 THEN 'dense+source' WHEN max(d) = 1 THEN 'dense' ELSE 'source' END AS origin FROM u GROUP BY 1, 2""")
def source_negatives_compete(spark, d):
    """A row brings the seven vectors after it as negatives of its source."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("doc_id"))
    own = q.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv")), "doc_id").select("query_id", "doc_id", F.round(vc.dot(F.col("qv"), F.col("dv")), 12).alias("score"))
    made = vc.with_source_candidates(_search(spark, d, 10), own, "query_id", "doc_id", "score")
    return made.withColumn("score", F.round("score", 6))


@query(_SCORED_SQL + " SELECT query_id, list(doc_id ORDER BY rank) AS candidates, round(max(score), 6) AS best FROM ranked WHERE rank <= 24 GROUP BY 1")
def teacher_request_rows(spark, d):
    r = vc.teacher_requests(_search(spark, d, 24), "query_id", "doc_id", "score")
    return r.select("query_id", F.transform("candidates", lambda c: c["candidate_id"]).alias("candidates"), F.round(F.get("candidates", F.lit(0))["retriever_score"], 6).alias("best"))


@query(_SCORED_SQL + " SELECT query_id, round(max(score), 6) AS best, round(min(score), 6) AS worst, round(avg(score), 6) AS mean, count(*) AS n FROM ranked WHERE rank <= 24 GROUP BY 1")
def mining_audit_rows(spark, d):
    g = _search(spark, d, 24).groupBy("query_id")
    return g.agg(F.round(F.max("score"), 6).alias("best"), F.round(F.min("score"), 6).alias("worst"), F.round(F.avg("score"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PAIRS_SQL}, h AS (SELECT * FROM pairs WHERE split = 'test'), t AS (SELECT * FROM pairs WHERE split = 'train')
SELECT 'document_in_training' AS rule, count(*) AS n FROM h WHERE document IN (SELECT document FROM t WHERE document IS NOT NULL) UNION ALL SELECT 'query_in_training', count(*) FROM h WHERE query IN (SELECT query FROM t WHERE query IS NOT NULL)
UNION ALL SELECT 'positive_in_training', count(*) FROM h WHERE positive IN (SELECT positive FROM t WHERE positive IS NOT NULL) UNION ALL SELECT 'repeated_query', count(*) - count(DISTINCT query) FROM h WHERE query IS NOT NULL""")
def holdout_verifier(spark, d):
    p = pairs(spark, d)
    h, t = p.where("split = 'test'"), p.where("split = 'train'")
    parts = None
    for rule, c in (("document_in_training", "document"), ("query_in_training", "query"), ("positive_in_training", "positive")):
        one = h.join(t.select(c), c, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        parts = one if parts is None else parts.unionByName(one)
    again = cl.duplicates_beyond_first(h, ["query"]).select(F.lit("repeated_query").alias("rule"), F.col("duplicates").alias("n"))
    return parts.unionByName(again)


@query(f"""WITH {PAIRS_SQL} SELECT min(row_id) AS row_id, query, positive FROM pairs WHERE query IS NOT NULL AND positive IS NOT NULL GROUP BY 2, 3""")
def unique_pairs(spark, d):
    p = pairs(spark, d).where("query is not null and positive is not null").select("row_id", "query", "positive")
    return ct.unique_pairs(p, "row_id", ["query", "positive"])


@query()
def articles_of_documents(spark, d):
    """Articles of law-like texts, one row per document and article number."""
    return markup.articles(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "article", "title", F.length("body").alias("chars"))


@query(f"""WITH l AS (SELECT label, min(vec_id) AS first, list_sort(list(vec_id))[2] AS second FROM embeddings WHERE label IS NOT NULL GROUP BY 1),
t AS (SELECT e.vec_id AS query_id, CASE WHEN l.first = e.vec_id THEN l.second ELSE l.first END AS positive_id, (SELECT min(o.first) FROM l o WHERE o.label <> e.label) AS negative_id FROM embeddings e JOIN l USING (label))
SELECT query_id, positive_id, negative_id, len(q.embedding) = len(p.embedding) AND len(q.embedding) = len(n.embedding) AS same_dimension, {_DOT.format('q.embedding', 'p.embedding')} > {_DOT.format('q.embedding', 'n.embedding')} AS in_order
FROM t JOIN embeddings q ON q.vec_id = query_id JOIN embeddings p ON p.vec_id = positive_id JOIN embeddings n ON n.vec_id = negative_id""")
def relevance_order(spark, d):
    """Every vector with the first other one of its label and the first of another label: dimensions agree, the former scores higher."""
    e = table(spark, d, "embeddings").where("label is not null")
    first = e.groupBy("label").agg(F.min("vec_id").alias("first"))
    second = e.join(first, "label").where("vec_id <> first").groupBy("label").agg(F.min("vec_id").alias("second"))
    edge = first.agg(F.min("first").alias("a"), F.expr("min_by(label, first)").alias("la"))  # the first label's first vector, and the next label's
    after = first.join(F.broadcast(edge)).where("label <> la").agg(F.min("first").alias("b"))
    t = e.join(first, "label").join(second, "label", "left").join(F.broadcast(edge)).join(F.broadcast(after))
    t = t.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.when(F.col("first") == F.col("vec_id"), F.col("second")).otherwise(F.col("first")).alias("positive_id"),
        F.when(F.col("label") == F.col("la"), F.col("b")).otherwise(F.col("a")).alias("negative_id"),
    )
    vec = lambda name, out: e.select(F.col("vec_id").alias(name), F.col("embedding").alias(out))
    j = t.join(vec("positive_id", "p"), "positive_id").join(vec("negative_id", "n"), "negative_id")
    same = (F.size("q") == F.size("p")) & (F.size("q") == F.size("n"))
    return j.select("query_id", "positive_id", "negative_id", same.alias("same_dimension"), (vc.dot(F.col("q"), F.col("p")) > vc.dot(F.col("q"), F.col("n"))).alias("in_order"))
