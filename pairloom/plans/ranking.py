"""Queries over metrics, rank aggregation and selection. A generated query's scored documents are its pool;
suppliers are models, (return flag, line status) pairs are tasks."""

from __future__ import annotations


from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.operators import ranking as rk
from pairloom.plans.base import query, table

_CACHE = "cache_qwen3_reranker_scores"
_RANK_SQL = f"""WITH s AS (SELECT c.generated_id, candidate_id, score_row_id, role, text_sha256, coalesce(g.style, 'none') AS domain, retriever_score AS s FROM {_CACHE} c
  JOIN grounded_synthetic_query_factory g USING (generated_id) WHERE isfinite(retriever_score)),
r AS (SELECT *, row_number() OVER (PARTITION BY generated_id ORDER BY s DESC, score_row_id) AS rank FROM s)"""


def _scored(spark, d):
    c = table(spark, d, _CACHE).where(tx.is_finite(F.col("retriever_score")))
    g = table(spark, d, "grounded_synthetic_query_factory").select("generated_id", F.coalesce("style", F.lit("none")).alias("domain"))
    return c.join(g, "generated_id").select("generated_id", "candidate_id", "score_row_id", "role", "text_sha256", "domain", (F.col("retriever_score") + 0.0).alias("s"))


def _ranked(spark, d):
    return rk.ranks(_scored(spark, d), ["generated_id"], "score_row_id", "s")


@query(_RANK_SQL + " SELECT generated_id, score_row_id, rank FROM r WHERE role = 'positive'")
def retrieval_ranks(spark, d):
    return _ranked(spark, d).where("role = 'positive'").select("generated_id", "score_row_id", F.col("rank").cast("bigint").alias("rank"))


_MULTI_SQL = _RANK_SQL + """, q AS (SELECT generated_id, domain, count(*) FILTER (WHERE role = 'positive') AS relevant, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE role = 'positive' AND rank <= 10), 0) AS dcg,
  count(*) FILTER (WHERE role = 'positive' AND rank <= 10) AS h10, count(*) FILTER (WHERE role = 'positive' AND rank <= 100) AS h100, min(rank) FILTER (WHERE role = 'positive') AS best_rank FROM r GROUP BY 1, 2),
m AS (SELECT *, dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg10, h10 / relevant AS recall10, h100 / relevant AS recall100,
  CASE WHEN best_rank <= 10 THEN 1 / best_rank ELSE 0 END AS rr10 FROM q WHERE relevant > 0)"""
_M = ["ndcg10", "recall10", "recall100", "rr10", "best_rank"]


def _multi(spark, d):
    return rk.multi_positive(_ranked(spark, d), ["generated_id", "domain"], F.col("role") == "positive")


@query(_MULTI_SQL + " SELECT domain, count(*) AS queries, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _M) + " FROM m GROUP BY domain")
def retrieval_metrics_multi(spark, d):
    return rk.metric_means(_multi(spark, d), ["domain"], _M).select("domain", "queries", *[F.round(c, 6).alias(c) for c in _M])


@query(_RANK_SQL + """, b AS (SELECT generated_id, min(rank) AS r FROM r WHERE role = 'positive' GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg10, round(avg(CASE WHEN r <= 10 THEN 1 ELSE 0 END), 6) AS recall10,
  round(avg(CASE WHEN r <= 100 THEN 1 ELSE 0 END), 6) AS recall100, round(avg(CASE WHEN r <= 10 THEN 1 / r ELSE 0 END), 6) AS mrr10, round(avg(r), 6) AS mean_rank, round(quantile_cont(r, 0.5), 6) AS median_rank FROM b""")
def retrieval_metrics_single(spark, d):
    best = _ranked(spark, d).where("role = 'positive'").groupBy("generated_id").agg(F.min("rank").alias("r"))
    m = rk.single_positive(best, [], "r")
    return m.select("queries", *[F.round(c, 6).alias(c) for c in m.columns if c != "queries"])


@query(_MULTI_SQL + ", dm AS (SELECT domain, avg(ndcg10) AS x FROM m GROUP BY 1) SELECT round((SELECT avg(x) FROM dm), 6) AS domain_macro, round((SELECT avg(ndcg10) FROM m), 6) AS query_mean")
def domain_macro(spark, d):
    m = _multi(spark, d)
    by = m.groupBy("domain").agg(F.sum("ndcg10").alias("s"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.round(F.avg(F.col("s") / F.col("n")), 6).alias("domain_macro"), F.round(F.sum("s") / F.sum("n"), 6).alias("query_mean"))


_NOISE = "(role <> 'positive' AND coalesce(substr(text_sha256, 1, 1), '') IN ('0', '1'))"
_NOISE_SQL = _RANK_SQL + f""", top AS (SELECT generated_id, max(s) FILTER (WHERE role = 'positive') AS p, max(s) FILTER (WHERE {_NOISE}) AS n FROM s GROUP BY 1),
j AS (SELECT s.*, p, n FROM s JOIN top USING (generated_id) WHERE p IS NOT NULL),
nr AS (SELECT generated_id, 1 + count(*) FILTER (WHERE role <> 'positive' AND s > p) AS positive_rank,
  CASE WHEN max(n) IS NOT NULL THEN 1 + count(*) FILTER (WHERE role <> 'positive' AND NOT {_NOISE} AND s >= n) + max(CASE WHEN p >= n THEN 1 ELSE 0 END) END AS noise_rank FROM j GROUP BY 1)"""


def _noise(spark, d):
    is_noise = (F.col("role") != "positive") & F.substring("text_sha256", 1, 1).isin("0", "1")
    return rk.noise_ranks(_scored(spark, d), "generated_id", "s", F.col("role") == "positive", is_noise)


@query(_NOISE_SQL + " SELECT * FROM nr")
def noise_ranks(spark, d):
    return _noise(spark, d)


_SUM = "round(avg(CASE WHEN positive_rank <= 10 THEN 1 / log2(positive_rank + 1) ELSE 0 END), 6) AS ndcg10, round(avg(CASE WHEN positive_rank <= 10 THEN 1 ELSE 0 END), 6) AS recall10, " + ", ".join(
    f"round(avg(CASE WHEN noise_rank <= {k} THEN 1 ELSE 0 END), 6) AS intrusion{k}" for k in (1, 5, 10)
)


@query(_NOISE_SQL + f" SELECT count(*) AS queries, {_SUM}, round(quantile_cont(noise_rank, 0.5), 6) AS median_noise_rank FROM nr")
def noise_intrusion(spark, d):
    s = rk.noise_summary(_noise(spark, d), [])
    return s.select("queries", *[F.round(c, 6).alias(c) for c in s.columns if c != "queries"])


@query(_RANK_SQL + """, c AS (SELECT * FROM (VALUES (0.0, ''), (0.01, '0'), (0.05, '012')) v(ratio, digits)),
x AS (SELECT c.ratio, s.* FROM s, c WHERE role = 'positive' OR coalesce(substr(text_sha256, 1, 1), '') NOT IN ('0', '1', '2') OR contains(c.digits, coalesce(substr(text_sha256, 1, 1), '-'))),
p AS (SELECT ratio, generated_id, max(s) AS p FROM x WHERE role = 'positive' GROUP BY 1, 2),
k AS (SELECT x.ratio, x.generated_id, 1 + count(*) FILTER (WHERE role <> 'positive' AND s > p) AS pr FROM x JOIN p ON x.ratio = p.ratio AND x.generated_id = p.generated_id GROUP BY 1, 2),
m AS (SELECT ratio, avg(CASE WHEN pr <= 10 THEN 1 / log2(pr + 1) ELSE 0 END) AS nd FROM k GROUP BY 1)
SELECT CAST(ratio AS DOUBLE) AS ratio, round(nd, 6) AS ndcg10, round(nd / (SELECT nd FROM m WHERE ratio = 0), 6) AS retention FROM m""")
def noise_retention(spark, d):
    s = _scored(spark, d)
    first = F.coalesce(F.substring("text_sha256", 1, 1), F.lit(""))
    parts = None
    for ratio, digits in ((0.0, []), (0.01, ["0"]), (0.05, ["0", "1", "2"])):
        pool = s.where((F.col("role") == "positive") | ~first.isin("0", "1", "2") | first.isin(digits))
        r = rk.noise_ranks(pool, "generated_id", "s", F.col("role") == "positive", (F.col("role") != "positive") & first.isin(digits))
        one = rk.noise_summary(r, []).select(F.lit(ratio).alias("ratio"), "ndcg10")
        parts = one if parts is None else parts.unionByName(one)
    return rk.retention(parts, [], "ratio", "ndcg10").select("ratio", F.round("ndcg10", 6).alias("ndcg10"), F.round("retention", 6).alias("retention"))


_BOARD_SQL = "WITH b AS (SELECT l_suppkey AS model, l_returnflag || l_linestatus AS task, round(avg(l_discount), 3) AS score FROM lineitem GROUP BY 1, 2)"


def _board(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("model"), F.concat("l_returnflag", "l_linestatus").alias("task")).agg(F.round(F.avg("l_discount"), 3).alias("score"))


_AVG_SQL = _BOARD_SQL + ", a AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY score DESC) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS avg_rank FROM b)"


@query(_AVG_SQL + " SELECT * FROM a")
def average_ranks(spark, d):
    return rk.average_ranks(_board(spark, d), "task", "score")


_BORDA_SQL = _AVG_SQL + ", p AS (SELECT model, sum((SELECT count(DISTINCT model) FROM b) - avg_rank) AS points FROM a GROUP BY 1), f AS (SELECT *, rank() OVER (ORDER BY points DESC) AS final_rank FROM p)"


@query(_BORDA_SQL + " SELECT model, round(points, 6) AS points, final_rank FROM f")
def borda_leaderboard(spark, d):
    return rk.borda(_board(spark, d), "model", "task", "score").select("model", F.round("points", 6).alias("points"), F.col("final_rank").cast("bigint").alias("final_rank"))


@query(_BORDA_SQL + """, o AS (SELECT *, row_number() OVER (ORDER BY final_rank, model) AS place FROM f)
SELECT model, final_rank, place FROM o WHERE abs(place - (SELECT place FROM o WHERE model = 7)) <= 2""")
def leaderboard_neighbors(spark, d):
    n = rk.neighbours(rk.borda(_board(spark, d), "model", "task", "score"), "final_rank", "model", 7, 2)
    return n.select("model", F.col("final_rank").cast("bigint").alias("final_rank"), F.col("place").cast("bigint").alias("place"))


@query(_BOARD_SQL + """, t AS (SELECT task, substr(task, 1, 1) AS type, avg(score) AS s FROM b GROUP BY 1, 2), y AS (SELECT type, avg(s) AS s FROM t GROUP BY 1)
SELECT round((SELECT avg(s) FROM t), 6) AS mean_task, round((SELECT avg(s) FROM y), 6) AS mean_type""")
def mean_task_and_type(spark, d):
    t = _board(spark, d).groupBy("task", F.substring("task", 1, 1).alias("type")).agg(F.avg("score").alias("s"))
    y = t.groupBy("type").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"))
    return y.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean_task"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("mean_type"))


@query(_BOARD_SQL + """, t AS (SELECT substr(task, 1, 1) AS type, task, avg(score) AS s FROM b GROUP BY 1, 2), y AS (SELECT type, avg(s) AS s FROM t GROUP BY 1)
SELECT 'task' AS level, task AS name, round(s, 6) AS score FROM t UNION ALL SELECT 'type', type, round(s, 6) FROM y UNION ALL SELECT 'all', 'all', round(avg(s), 6) FROM y""")
def subset_rollup(spark, d):
    b = _board(spark, d).withColumn("type", F.substring("task", 1, 1))
    tasks, types, whole = rk.rollup_means(b, ["type", "task"], "score")
    row = lambda df, level, name: df.select(F.lit(level).alias("level"), name.alias("name"), F.round("score", 6).alias("score"))
    return row(tasks, "task", F.col("task")).unionByName(row(types, "type", F.col("type"))).unionByName(row(whole, "all", F.lit("all")))


@query("""WITH a AS (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1),
p AS (SELECT source, n / sum(n) OVER () AS p FROM a), q AS (SELECT source, n / sum(n) OVER () AS q FROM b)
SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) AS distance FROM p FULL JOIN q ON p.source = q.source""")
def source_tv_distance(spark, d):
    n = table(spark, d, "documents").groupBy("source", (F.col("doc_id") % 2).alias("half")).agg(F.count(F.lit(1)).alias("n"))
    return rk.total_variation(n.where("half = 0"), n.where("half = 1"), "source", "n").select(F.round("distance", 9).alias("distance"))


_MODELS_SQL = """WITH m AS (SELECT l_suppkey AS model, round(avg(l_discount), 4) AS quality, round(avg(l_tax), 4) AS intrusion, round(min(l_extendedprice), 2) AS worst, count(*) AS runs FROM lineitem GROUP BY 1)"""
_STAGES = [("quality", 0.004, True), ("intrusion", 0.003, False), ("worst", 400.0, True), ("runs", 30.0, True)]


def _models(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(
        F.round(F.avg("l_discount"), 4).alias("quality"), F.round(F.avg("l_tax"), 4).alias("intrusion"), F.round(F.min("l_extendedprice"), 2).alias("worst"), F.count(F.lit(1)).alias("runs")
    )


def _bands_sql():
    out, last = _MODELS_SQL, "m"
    for i, (c, eps, up) in enumerate(_STAGES):
        cond = f"(SELECT max({c}) FROM {last}) - {c} <= {eps}" if up else f"{c} - (SELECT min({c}) FROM {last}) <= {eps}"
        out += f", s{i} AS (SELECT * FROM {last} WHERE {cond})"
        last = f"s{i}"
    return out


@query(_bands_sql() + " SELECT model, quality, intrusion, worst, runs FROM s3")
def staged_near_tie_selection(spark, d):
    return rk.near_ties(_models(spark, d), _STAGES)


@query(_bands_sql() + ", f AS (SELECT m.*, " + ", ".join(f"model IN (SELECT model FROM s{i}) AS band{i}" for i in range(4)) + """ FROM m)
SELECT model, band0, band1, band2, band3, row_number() OVER (ORDER BY band0 DESC, band1 DESC, quality DESC, model) AS place FROM f""")
def staged_ranking_flags(spark, d):
    f = rk.band_flags(_models(spark, d), _STAGES, [F.col("quality").desc(), F.col("model")])
    return f.select("model", "band0", "band1", "band2", "band3", F.col("place").cast("bigint").alias("place"))


@query(_BOARD_SQL + """, c AS (SELECT task, score AS candidate FROM b WHERE model = 1), r AS (SELECT task, max(score) AS best FROM b WHERE model IN (2, 3, 4) GROUP BY 1)
SELECT r.task, candidate, round(best - CASE r.task WHEN 'AF' THEN 0.01 ELSE 0.002 END, 9) AS floor, coalesce(candidate, -1e308) >= best - CASE r.task WHEN 'AF' THEN 0.01 ELSE 0.002 END AS passes FROM r LEFT JOIN c USING (task)""")
def guard_gate(spark, d):
    b = _board(spark, d)
    g = rk.guard_gate(b.where("model = 1"), b.where("model in (2, 3, 4)"), "task", "score", {"AF": 0.01}, 0.002)
    return g.select("task", "candidate", F.round("floor", 9).alias("floor"), "passes")


@query(_MODELS_SQL + """ SELECT model, CASE WHEN quality > 0.0505 AND intrusion <= 0.0405 THEN 'adopt' WHEN quality > 0.0505 THEN 'teacher_only_due_to_regression'
  WHEN intrusion <= 0.0405 AND 0.0505 - quality BETWEEN 0 AND 0.001 THEN 'short_adaptation_then_retest' ELSE 'resume_and_reselect' END AS decision FROM m""")
def decision_ladder(spark, d):
    deficit = 0.0505 - F.col("quality")
    return _models(spark, d).select("model", rk.decision(F.col("quality") > 0.0505, F.col("intrusion") <= 0.0405, deficit, 0.001).alias("decision"))


@query(_BOARD_SQL + """, g AS (SELECT model, count(DISTINCT task) AS n, avg(score) AS average FROM b GROUP BY 1)
SELECT model, round(average, 6) AS average, row_number() OVER (ORDER BY round(average, 9) DESC, model) AS place FROM g WHERE n = (SELECT count(DISTINCT task) FROM b)""")
def complete_runs_leaderboard(spark, d):
    b = _board(spark, d)
    tasks = b.select("task").distinct().count()
    return rk.complete_runs(b, "model", "task", "score", tasks).select("model", F.round("average", 6).alias("average"), F.col("place").cast("bigint").alias("place"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY 1")
def latest_per_key(spark, d):
    return rk.latest(table(spark, d, "events"), "user_id", "ts", ["event_type"])


_CKPT_SQL = "WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS loss, event_id AS step, event_type || '-' || event_id AS path FROM events)"


@query(_CKPT_SQL + """, g AS (SELECT user_id, min((loss, step, path)) FILTER (WHERE loss IS NOT NULL) AS b, max((step, path)) AS l FROM e GROUP BY 1)
SELECT user_id, coalesce(b[2], l[1]) AS step, coalesce(b[3], l[2]) AS path, b IS NOT NULL AS by_loss FROM g""")
def best_checkpoint(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("loss"), F.col("event_id").alias("step"), F.concat_ws("-", "event_type", "event_id").alias("path"))
    return rk.best_checkpoint(e, "user_id", "loss", "step", "path")


@query("""WITH e AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase' AND isfinite(value)) SELECT user_id, arg_max(value, event_id) AS last_value, max(event_id) AS step FROM e GROUP BY 1""")
def last_finite_evaluation(spark, d):
    e = table(spark, d, "events").where((F.col("event_type") == "purchase") & tx.is_finite(F.col("value")))
    return e.groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"), F.max("event_id").alias("step"))


