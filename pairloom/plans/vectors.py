"""Queries over vectors and negatives. Search queries are the vectors whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.operators import negatives as ng
from pairloom.operators import vectors as vc
from pairloom.plans.base import query, table

_DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_SCORED_SQL = f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT q.query_id, q.ql, e.vec_id AS doc_id, e.label, round({_DOT.format('q.qv', 'e.embedding')}, 12) AS score FROM q JOIN embeddings e ON e.vec_id <> q.query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


def _emb(spark, d):
    return table(spark, d, "embeddings")


def _search(spark, d, k):
    e = _emb(spark, d)
    return vc.top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", k, "label")


@query(f"SELECT vec_id, round(sqrt({_DOT.format('embedding', 'embedding')}), 6) AS norm, CASE WHEN abs(sqrt({_DOT.format('embedding', 'embedding')}) - 1) > 0.005 THEN 'not_unit' END AS problem FROM embeddings")
def vector_norm_check(spark, d):
    return _emb(spark, d).select("vec_id", F.round(vc.norm(F.col("embedding")), 6).alias("norm"), vc.vector_problem(F.col("embedding"), 64).alias("problem"))


@query("""WITH n AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 3)) AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
c AS (SELECT list_dot_product(x, y) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(y, y)) AS c, abs(sqrt(list_dot_product(x, x)) - sqrt(list_dot_product(y, y))) AS drift FROM n)
SELECT count(*) AS rows, round(min(c), 6) AS least_cosine, round(avg(c), 6) AS mean_cosine, round(max(drift), 6) AS largest_drift, min(c) >= 0.999 AS passes FROM c""")
def embedding_parity(spark, d):
    e = _emb(spark, d)
    after = e.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("embedding"))
    p = vc.parity(e, after, "vec_id", "embedding")
    return p.select("rows", *[F.round(c, 6).alias(c) for c in ("least_cosine", "mean_cosine", "largest_drift")], "passes")


@query(_SCORED_SQL + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 24")
def dense_topk(spark, d):
    return _search(spark, d, 24).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_POOL_SQL = _SCORED_SQL + """, pos AS (SELECT query_id, max(score) AS p FROM scored WHERE label = ql GROUP BY 1),
kept AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM scored s JOIN pos USING (query_id) WHERE label <> ql AND score < p * 0.95),
pool AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM kept WHERE rk <= 24)"""


def _pool(spark, d):
    """The 24 best-scored negatives below 0.95 of the positive score of each query, and what was left out."""
    e = _emb(spark, d)
    return vc.mine(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", "label", 0.95, 24)


_OUT = ["query_id", "doc_id"]


@query(_POOL_SQL + " SELECT query_id, doc_id, round(score, 6) AS score, rk AS rank FROM pool WHERE rk <= 7")
def hard_negatives_positive_relative(spark, d):
    return vc.pool_choice(_pool(spark, d)[0], "query_id", "top_k", 7).select(*_OUT, F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_POOL_SQL + " SELECT query_id, doc_id, rk AS rank FROM pool WHERE n <= 7 OR list_contains(list_transform(range(7), lambda i: (i * (n - 1) + 3) // 6), rk - 1)")
def hard_negatives_rank_quantiles(spark, d):
    return vc.pool_choice(_pool(spark, d)[0], "query_id", "score_rank_quantiles", 7).select(*_OUT, F.col("rank").cast("bigint").alias("rank"))


@query(_POOL_SQL + """, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha256('7' || chr(0) || query_id || chr(0) || doc_id)) AS hr FROM pool)
SELECT query_id, doc_id, rk AS rank FROM h WHERE hr <= 7""")
def hard_negatives_hash_sample(spark, d):
    return vc.pool_choice(_pool(spark, d)[0], "query_id", "hash_sample_from_top_pool", 7).select(*_OUT, F.col("rank").cast("bigint").alias("rank"))


@query(_SCORED_SQL + """, pos AS (SELECT query_id, max(score) AS p FROM scored WHERE label = ql GROUP BY 1)
SELECT CASE WHEN label = ql THEN 'query_match' WHEN NOT (score < p * 0.95) THEN 'too_close' ELSE 'kept' END AS why, count(*) AS n FROM scored JOIN pos USING (query_id) GROUP BY 1""")
def mining_exclusions(spark, d):
    return _pool(spark, d)[1].groupBy("why").agg(F.sum("n").alias("n"))


@query()
def ivf_candidates(spark, d):
    e = _emb(spark, d)
    return vc.cell_search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)


@query("""WITH l AS (SELECT label, i - 1 AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL)
SELECT label, list(round(m, 6) ORDER BY pos) AS mean FROM l GROUP BY label""")
def vector_average(spark, d):
    return vc.mean_vector(_emb(spark, d), ["label"], "embedding").select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


_CACHE = "cache_qwen3_reranker_scores"


_T = f"""WITH s AS (SELECT * FROM {_CACHE} WHERE reranker_score IS NOT NULL AND NOT isnan(reranker_score)),
p AS (SELECT generated_id, max(reranker_score) AS p, list(DISTINCT text_sha256) AS own FROM s WHERE role = 'positive' GROUP BY 1 HAVING max(reranker_score) >= 0.5),
j AS (SELECT s.*, p, own, reranker_score <= least(p * 0.95, p - 0.05) AND reranker_score >= 0.05 AS allowed FROM s JOIN p USING (generated_id) WHERE role <> 'positive'),"""
_T_END = """t AS (SELECT *, row_number() OVER (PARTITION BY generated_id ORDER BY reranker_score DESC, score_row_id) AS pool_rank FROM u),
z AS (SELECT *, count(*) OVER (PARTITION BY generated_id) AS n FROM t WHERE pool_rank <= 24)
SELECT generated_id, score_row_id, reranker_score AS score, pool_rank FROM z WHERE n >= 7 AND list_contains(list_transform(range(7), lambda i: {0}), pool_rank - 1)"""
_KD = _T + " u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY generated_id, text_sha256 ORDER BY score_row_id) AS dup FROM j) WHERE dup = 1 AND allowed)," + _T_END.format("(i * (n - 1)) // 6")
_FACTORY = (
    _T + " u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY generated_id, text_sha256 ORDER BY reranker_score DESC, score_row_id) AS dup FROM j WHERE allowed AND NOT coalesce(list_contains(own, text_sha256), FALSE)) WHERE dup = 1),"
    + _T_END.format("(i * (n - 1) + 3) // 6")
)


def _teacher(spark, d, rule):
    f = ng.teacher_filter(table(spark, d, _CACHE), "generated_id", "score_row_id", "text_sha256", "reranker_score", F.col("role") == "positive", 0.5, 0.95, 0.05, 24, 7, rule, 0.05)
    return f.withColumn("pool_rank", F.col("pool_rank").cast("bigint"))


@query(_KD)
def teacher_filter_kd(spark, d):
    return _teacher(spark, d, "kd")


@query(_FACTORY)
def teacher_filter_factory(spark, d):
    return _teacher(spark, d, "factory")


@query(f"""SELECT generated_id, CASE WHEN bool_and(reranker_score IS NOT NULL AND NOT isnan(reranker_score)) THEN 'reranker_score'
  WHEN bool_and(retriever_score IS NOT NULL AND NOT isnan(retriever_score)) THEN 'retriever_score' END AS field FROM {_CACHE} GROUP BY 1""")
def score_field_priority(spark, d):
    return ng.score_field(table(spark, d, _CACHE), "generated_id", ["reranker_score", "retriever_score"])


@query(f"""WITH h AS (SELECT score_row_id, sha256(coalesce(generated_id, '') || chr(0) || coalesce(candidate_id, '')) AS h FROM {_CACHE}),
l AS (SELECT score_row_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0 * 8 - 4 AS n, CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0 * 8 - 4 AS y FROM h)
SELECT score_row_id, round(n, 6) AS no_logit, round(y, 6) AS yes_logit, round(1 / (1 + exp(n - y)), 6) AS p FROM l""")
def teacher_mock_scores(spark, d):
    no, yes = ng.mock_logits(F.coalesce("generated_id", F.lit("")), F.coalesce("candidate_id", F.lit("")))
    return table(spark, d, _CACHE).select("score_row_id", F.round(no, 6).alias("no_logit"), F.round(yes, 6).alias("yes_logit"), F.round(tx.yes_probability(no, yes), 6).alias("p"))


_LOSS = f"SELECT * FROM {_CACHE} WHERE isfinite(reranker_score) AND isfinite(retriever_score)"


@query(f"""WITH s AS ({_LOSS}), m AS (SELECT generated_id, max(retriever_score / 0.05) AS m FROM s GROUP BY 1),
e AS (SELECT s.generated_id, role, exp(retriever_score / 0.05 - m) AS e FROM s JOIN m USING (generated_id))
SELECT generated_id, round(ln(sum(e)) - ln(sum(e) FILTER (WHERE role = 'positive')), 6) AS loss FROM e GROUP BY 1 HAVING sum(e) FILTER (WHERE role = 'positive') > 0""")
def infonce_loss(spark, d):
    s = table(spark, d, _CACHE).where(tx.is_finite(F.col("reranker_score")) & tx.is_finite(F.col("retriever_score")))
    return ng.infonce(s, "generated_id", "retriever_score", F.col("role") == "positive", 0.05).select("generated_id", F.round("loss", 6).alias("loss"))


# Pair i: vector 2i asks, vector 2i + 1 answers; the answers of the next three pairs are its hard negatives.
_DUAL = f"""WITH p AS (SELECT q.vec_id // 2 AS pair, q.vec_id // 32 AS batch, q.embedding AS qv, d.embedding AS dv FROM embeddings q JOIN embeddings d ON d.vec_id = q.vec_id + 1 WHERE q.vec_id % 2 = 0),
b AS (SELECT x.pair, y.pair AS other, {_DOT.format('x.qv', 'y.dv')} / 0.05 AS s FROM p x JOIN p y USING (batch)), bm AS (SELECT pair, max(s) AS m FROM b GROUP BY 1),
i AS (SELECT b.pair, ln(sum(exp(s - m))) + max(m) - max(s) FILTER (WHERE other = b.pair) AS loss FROM b JOIN bm USING (pair) GROUP BY 1),
h AS (SELECT x.pair, y.pair AS other, {_DOT.format('x.qv', 'y.dv')} / 0.05 AS s FROM p x JOIN p y ON y.pair BETWEEN x.pair AND x.pair + 3), hm AS (SELECT pair, max(s) AS m FROM h GROUP BY 1),
l AS (SELECT h.pair, ln(sum(exp(s - m))) + max(m) - max(s) FILTER (WHERE other = h.pair) AS loss FROM h JOIN hm USING (pair) GROUP BY 1)"""


def _loss_pairs(spark, d):
    e = _emb(spark, d)
    q = e.where("vec_id % 2 = 0").select(F.expr("vec_id div 2").alias("pair"), F.expr("vec_id div 32").alias("batch"), F.col("embedding").alias("qv"))
    return q.join(e.where("vec_id % 2 = 1").select(F.expr("vec_id div 2").alias("pair"), F.col("embedding").alias("dv")), "pair")


@query(_DUAL + " SELECT pair, round(i.loss, 6) AS in_batch_loss, round(l.loss, 6) AS hard_loss, round(i.loss + l.loss, 6) AS loss FROM i JOIN l USING (pair)")
def dual_loss(spark, d):
    """In-batch and explicit-hard-negative cross-entropy of every pair, and their sum."""
    p = _loss_pairs(spark, d)
    inside = ng.in_batch(p, "batch", "pair", "qv", "dv", 0.05).select("pair", F.col("loss").alias("in_batch"))
    wanted = p.select("pair", "qv", F.explode(F.sequence(F.col("pair"), F.col("pair") + 3)).alias("other"))
    scored = wanted.join(p.select(F.col("pair").alias("other"), "dv"), "other").select("pair", "other", vc.dot(F.col("qv"), F.col("dv")).alias("s"))
    hard = ng.infonce(scored, "pair", "s", F.col("other") == F.col("pair"), 0.05)
    return inside.join(hard, "pair").select("pair", F.round("in_batch", 6).alias("in_batch_loss"), F.round("loss", 6).alias("hard_loss"), F.round(F.col("in_batch") + F.col("loss"), 6).alias("loss"))


_LOGIT = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"


def _finite_scores(spark, d):
    return table(spark, d, _CACHE).where(tx.is_finite(F.col("reranker_score")) & tx.is_finite(F.col("retriever_score")))


@query(f"""WITH s AS (SELECT generated_id, role, {_LOGIT.format('reranker_score')} AS t, retriever_score AS s FROM ({_LOSS})),
p AS (SELECT generated_id, max(t) AS pt FROM s WHERE role = 'positive' GROUP BY 1), q AS (SELECT generated_id, any_value(pt) AS pt, max(s) AS ps FROM s JOIN p USING (generated_id) WHERE role = 'positive' AND t = pt GROUP BY 1)
SELECT generated_id, round(avg(((ps - s) - (pt - t)) * ((ps - s) - (pt - t))), 6) AS loss FROM s JOIN q USING (generated_id) WHERE role <> 'positive' GROUP BY 1""")
def margin_mse_loss(spark, d):
    s = _finite_scores(spark, d).select("generated_id", "role", ng.teacher_logit(F.col("reranker_score")).alias("t"), F.col("retriever_score").alias("s"))
    return ng.margin_mse(s, "generated_id", "t", "s", F.col("role") == "positive").select("generated_id", F.round("loss", 6).alias("loss"))


@query(f"""WITH s AS ({_LOSS}), p AS (SELECT generated_id, max(retriever_score) AS p FROM s WHERE role = 'positive' GROUP BY 1),
j AS (SELECT s.*, p, role <> 'positive' AND retriever_score >= p - 0.1 AS masked FROM s JOIN p USING (generated_id)),
m AS (SELECT generated_id, max(retriever_score / 0.05) AS m FROM j WHERE NOT masked GROUP BY 1), k AS (SELECT generated_id, count(*) FILTER (WHERE masked) AS masked FROM j GROUP BY 1)
SELECT generated_id, round(ln(sum(exp(retriever_score / 0.05 - m))) - ln(sum(exp(retriever_score / 0.05 - m)) FILTER (WHERE role = 'positive')), 6) AS loss, any_value(k.masked) AS masked
FROM j JOIN m USING (generated_id) JOIN k USING (generated_id) WHERE NOT j.masked GROUP BY 1""")
def masked_queue_loss(spark, d):
    s, pos = _finite_scores(spark, d), F.col("role") == "positive"
    return ng.masked_infonce(s, "generated_id", "retriever_score", pos, ~pos, 0.1, 0.05).select("generated_id", F.round("loss", 6).alias("loss"), "masked")


@query(f"""WITH g AS (SELECT generated_id, count(*) AS documents, count(*) FILTER (WHERE role = 'positive') AS p, count(*) FILTER (WHERE reranker_score IS NULL OR isnan(reranker_score) OR isinf(reranker_score)) AS bad,
  count(*) FILTER (WHERE (reranker_score < 0 OR reranker_score > 1)) AS far, max(reranker_score) FILTER (WHERE role = 'positive') AS top, max(reranker_score) FILTER (WHERE role <> 'positive') AS nxt FROM {_CACHE} GROUP BY 1)
SELECT generated_id, documents, CASE WHEN p <> 1 THEN 'positives' WHEN documents < 2 THEN 'no_negative' WHEN bad > 0 THEN 'not_finite' WHEN far > 0 THEN 'range' WHEN top <= nxt THEN 'positive_not_dominant' END AS problem FROM g""")
def teacher_group_problems(spark, d):
    return ng.teacher_groups(table(spark, d, _CACHE), "generated_id", "reranker_score", F.col("role") == "positive")


@query(f"""WITH s AS ({_LOSS}), m AS (SELECT generated_id, max(reranker_score) AS mt, max(retriever_score) AS ms FROM s GROUP BY 1),
z AS (SELECT s.generated_id, ln(sum(exp(reranker_score - mt))) + max(mt) AS zt, ln(sum(exp(retriever_score - ms))) + max(ms) AS zs FROM s JOIN m USING (generated_id) GROUP BY 1)
SELECT generated_id, round(sum(exp(reranker_score - zt) * ((reranker_score - zt) - (retriever_score - zs))), 6) AS kl FROM s JOIN z USING (generated_id) GROUP BY 1""")
def listwise_kl(spark, d):
    s = table(spark, d, _CACHE).where(tx.is_finite(F.col("reranker_score")) & tx.is_finite(F.col("retriever_score")))
    return ng.listwise_kl(s, "generated_id", "reranker_score", "retriever_score", 1.0).select("generated_id", F.round("kl", 6).alias("kl"))


# The heading asks, the words in its brackets answer, the normalized passage is the evidence.
_HEAD = "json_extract_string(provenance_json, '$.section_heading')"
_BARE_Q, _BARE_T = (f"regexp_replace({c}, '[{tx.SPACE_CLASS}]+', '', 'g')" for c in ("query", "passage"))


@query(f"""WITH g AS (SELECT row_id, {_HEAD} AS query, regexp_extract({_HEAD}, '\\(([^)]*)\\)', 1) AS answer, positive_normalized AS evidence, positive AS passage FROM grounded_synthetic_query_factory),
x AS (SELECT *, {_BARE_Q} AS bq, {_BARE_T} AS bt FROM g), y AS (SELECT *, length(bq) > 0 AND len(list_filter(range(1, length(bq) - length(bq) * 3 // 10 + 1), lambda i: contains(bt, substr(bq, i, length(bq) * 3 // 10 + 1)))) > 0 AS copied FROM x)
SELECT row_id, CASE WHEN query IS NULL OR answer IS NULL OR evidence IS NULL OR passage IS NULL THEN 'missing' WHEN NOT length(query) BETWEEN 2 AND 400 THEN 'query_length'
  WHEN NOT regexp_matches(query, '[가-힣A-Za-z]') THEN 'script' WHEN NOT contains(evidence, answer) THEN 'answer_not_in_evidence' WHEN NOT contains(passage, evidence) THEN 'evidence_not_in_passage' WHEN copied THEN 'copied' END AS reason FROM y""")
def grounded_spans(spark, d):
    g = table(spark, d, "grounded_synthetic_query_factory")
    head = F.try_variant_get(F.try_parse_json("provenance_json"), "$.section_heading", "string")
    g = g.select("row_id", head.alias("query"), F.regexp_extract(head, r"\(([^)]*)\)", 1).alias("answer"), F.col("positive_normalized").alias("evidence"), F.col("positive").alias("passage"))
    return g.select("row_id", ng.generation_reason(F.col("query"), F.col("answer"), F.col("evidence"), F.col("passage"), tx.copied_share("query", "passage"), 0.3).alias("reason"))
