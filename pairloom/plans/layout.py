"""Queries over adapters, holdouts, batches and curricula."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import batching as bt
from pairloom.operators import holdout as ho
from pairloom.plans.base import PAIRS_SQL, pairs, query, squash_sql, table
from pairloom.sources import adapters as ad

_FULL = "SELECT * FROM pairs WHERE query IS NOT NULL AND positive IS NOT NULL"


def _full(spark, d):
    return pairs(spark, d).where("query is not null and positive is not null")


@query(f"WITH {PAIRS_SQL} SELECT row_id, query, positive, [source_id, split] AS negatives FROM pairs")
def adapter_triplets(spark, d):
    return ad.source("triplet")(pairs(spark, d), "row_id", "query", "positive", ["source_id", "split"])


@query(f"WITH {PAIRS_SQL} SELECT row_id, query, positive, list_filter([source_id, split, repository], lambda x: x IS NOT NULL) AS negatives FROM pairs")
def adapter_wide_negatives(spark, d):
    p = pairs(spark, d).withColumnsRenamed({"source_id": "negative_2", "split": "negative_9", "repository": "negative_10"})
    return ad.source("wide_negatives")(p, "row_id", "query", "positive")


@query(f"WITH {PAIRS_SQL} SELECT row_id, query, CASE WHEN row_id % 3 = 0 THEN NULL ELSE positive END AS positive, CASE WHEN row_id % 2 = 0 THEN [source_id] ELSE [] END AS negatives FROM pairs")
def adapter_lists(spark, d):
    none = F.array().cast("array<string>")
    p = pairs(spark, d).withColumn("ps", F.when(F.col("row_id") % 3 == 0, none).otherwise(F.array("positive", "source_id"))).withColumn("ns", F.when(F.col("row_id") % 2 == 0, F.array("source_id")))
    return ad.source("lists")(p, "row_id", "query", "ps", "ns")


_NAMES = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]


@query(f"SELECT vec_id, 'vector ' || vec_id AS query, {_NAMES}[label + 1] AS positive, list_filter({_NAMES}, lambda x: x <> {_NAMES}[label + 1]) AS negatives FROM embeddings")
def adapter_classification(spark, d):
    e = table(spark, d, "embeddings").withColumn("text", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    return ad.source("classification_label")(e, "vec_id", "text", "label", _NAMES)


_STS = "cache_qwen3_reranker_scores"


@query(f"""WITH s AS (SELECT * FROM {_STS} WHERE candidate_id IS NOT NULL AND text_sha256 IS NOT NULL), pool AS (SELECT text_sha256 AS negative, row_number() OVER (ORDER BY score_row_id) - 1 AS slot FROM s WHERE reranker_score <= 0.1),
g AS (SELECT score_row_id, candidate_id AS query, text_sha256 AS positive, CAST('0x' || substr(sha256(candidate_id), 1, 15) AS BIGINT) % (SELECT count(*) FROM pool) AS slot FROM s WHERE reranker_score >= 0.9)
SELECT score_row_id, query, positive, [negative] AS negatives FROM g JOIN pool USING (slot)""")
def adapter_sts_pool(spark, d):
    s = table(spark, d, _STS).where("candidate_id is not null and text_sha256 is not null")
    return ad.source("sts_pairs")(s, "score_row_id", "candidate_id", "text_sha256", "reranker_score", 0.9, 0.1)


@query(f"""WITH {PAIRS_SQL}, r AS ({_FULL}), c AS (SELECT positive, min(row_id) AS f FROM r GROUP BY 1), pool AS (SELECT positive AS text, row_number() OVER (ORDER BY f) - 1 AS slot FROM c),
n AS (SELECT count(*) AS n FROM pool), st AS (SELECT row_id, query, positive, n, CAST('0x' || substr(sha256(query), 1, 15) AS BIGINT) % n AS start FROM r, n WHERE n > 3),
x AS (SELECT st.*, o AS off, (start + o) % n AS slot FROM st, range(4) t(o)), m AS (SELECT x.row_id, x.query, x.positive, off, text FROM x JOIN pool USING (slot) WHERE text <> positive)
SELECT row_id, any_value(query) AS query, any_value(positive) AS positive, list(text ORDER BY off)[1:3] AS negatives FROM m GROUP BY row_id""")
def adapter_qa_cyclic(spark, d):
    return ad.source("qa_context")(_full(spark, d), "row_id", "query", "positive", 3)


@query("""WITH q AS (SELECT l_orderkey AS qid, l_partkey AS cid, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
j AS (SELECT q.qid, o_orderpriority AS query, score, p_partkey AS cid, CASE WHEN length(trim(p_brand)) > 0 THEN p_brand || ' ' || p_name ELSE p_name END AS doc FROM q JOIN orders ON o_orderkey = qid JOIN part ON p_partkey = cid),
s AS (SELECT qid, query, list(doc ORDER BY cid) FILTER (WHERE score > 25) AS good, coalesce(list(doc ORDER BY cid) FILTER (WHERE score <= 25), []) AS bad FROM j GROUP BY 1, 2)
SELECT qid AS query_id, query, good[CAST(('0x' || substr(sha256(CAST(qid AS VARCHAR)), 1, 15)) AS BIGINT) % len(good) + 1] AS positive, bad AS negatives FROM s WHERE len(good) > 0""")
def adapter_beir_join(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("corpus_id")).agg(F.max("l_quantity").alias("score"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("text"))
    c = table(spark, d, "part").select(F.col("p_partkey").alias("corpus_id"), F.col("p_brand").alias("title"), F.col("p_name").alias("text"))
    return ad.source("beir_join")(q, c, li, 25)


_ELIG = f"WITH {PAIRS_SQL}, r AS ({_FULL} AND repository IS NOT NULL)"


@query(_ELIG + """, w AS (SELECT row_id, repository, row_number() OVER (PARTITION BY repository ORDER BY sha256('h1' || chr(0) || row_id), row_id) AS pick FROM r) SELECT * FROM w WHERE pick <= 3""")
def holdout_equal_quota(spark, d):
    q = ho.equal_quota(_full(spark, d).where("repository is not null"), "repository", "row_id", 3, "h1")
    return q.select("row_id", "repository", F.col("pick").cast("bigint").alias("pick"))


@query()
def holdout_round_robin(spark, d):
    p = _full(spark, d).where("repository is not null and document is not null")
    return ho.round_robin(p, "repository", "row_id", 200, "rr", ["query", "positive"], ("document", 2))


@query("""SELECT id FROM candidates WHERE provenance.source_document_sha256 IS NOT NULL GROUP BY id HAVING min(provenance.source_document_sha256) <> max(provenance.source_document_sha256)""")
def holdout_id_conflicts(spark, d):
    c = table(spark, d, "candidates").select("id", F.col("provenance.source_document_sha256").alias("doc"))
    return ho.id_conflicts(c, "id", "doc")


_FEAT = """list_distinct(list_concat(list_transform(list_filter(regexp_extract_all(lower({0}), '[0-9a-z가-힣]+'), lambda w: length(w) >= 2), lambda w: 'w:' || w),
  list_transform(CASE WHEN length(replace(lower({0}), ' ', '')) >= 2 THEN range(1, length(replace(lower({0}), ' ', ''))) ELSE [] END, lambda i: 'c2:' || substr(replace(lower({0}), ' ', ''), i, 2))))"""


@query(f"""WITH {PAIRS_SQL}, f AS (SELECT unnest({_FEAT.format('query')}) AS feature FROM pairs WHERE query IS NOT NULL)
SELECT feature, count(*) AS df, round(ln(((SELECT count(*) FROM pairs WHERE query IS NOT NULL) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM f GROUP BY 1""")
def idf_table(spark, d):
    return ho.idf(pairs(spark, d), "row_id", "query").select("feature", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {PAIRS_SQL}, p AS (SELECT * FROM ({_FULL}) r WHERE repository IS NOT NULL), f AS (SELECT row_id, repository, unnest({_FEAT.replace('{0}', 'query')}) AS feature FROM p),
w AS (SELECT feature, ln(((SELECT count(*) FROM p) + 1) / (count(*) + 1)) + 1 AS idf FROM f GROUP BY 1),
s AS (SELECT a.row_id AS query_id, b.row_id AS corpus_id, sum(idf) AS score FROM f a JOIN f b ON a.repository = b.repository AND a.feature = b.feature AND a.row_id <> b.row_id JOIN w ON w.feature = a.feature WHERE a.row_id % 100 = 0 GROUP BY 1, 2),
u AS (SELECT a.row_id AS query_id, b.row_id AS corpus_id, coalesce(score, 0) AS score FROM p a JOIN p b ON a.repository = b.repository AND a.row_id <> b.row_id LEFT JOIN s ON s.query_id = a.row_id AND s.corpus_id = b.row_id WHERE a.row_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, sha256('lex' || chr(0) || corpus_id), corpus_id) AS rank FROM u) SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM r WHERE rank <= 4""")
def lexical_hard_negatives(spark, d):
    p = _full(spark, d).where("repository is not null")
    q = p.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.col("repository").alias("grp"), F.col("row_id").alias("own"), F.col("query").alias("text"))
    c = p.select(F.col("row_id").alias("corpus_id"), F.col("repository").alias("grp"), F.col("query").alias("text"))
    out = ho.lexical_negatives(q, c, ho.idf(p, "row_id", "query"), 4, "lex")
    return out.select("query_id", "corpus_id", F.round("score", 6).alias("score"), "rank")


_CNT = f"WITH {PAIRS_SQL}, c AS (SELECT source_id, count(*) AS n FROM pairs GROUP BY 1)"
_HAM = _CNT + """, s AS (SELECT source_id, n, (n * 97) // (SELECT sum(n) FROM c) AS base, (n * 97) % (SELECT sum(n) FROM c) AS rest FROM c),
h AS (SELECT *, row_number() OVER (ORDER BY rest DESC, sha256('q' || chr(0) || source_id), source_id) AS rn FROM s),
ham AS (SELECT source_id, n, CAST(base + CASE WHEN rn <= 97 - (SELECT sum(base) FROM s) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM h)"""


@query(_HAM + " SELECT * FROM ham")
def hamilton_quotas(spark, d):
    c = pairs(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return ho.hamilton(c, "source_id", "n", 97, "q")


@query("""SELECT doc_id, CASE WHEN doc_id >= (SELECT min(doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 100)) THEN 'validation' ELSE 'train' END AS part FROM documents""")
def train_validation_tail(spark, d):
    return ho.last_rows_split(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


_LEN = f"WITH {PAIRS_SQL}, r AS (SELECT row_id, source_id, greatest(length(query), length(positive)) AS len FROM ({_FULL}))"
_BATCH = _LEN + """, o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY len, sha256('b1' || chr(0) || source_id || chr(0) || row_id), row_id) - 1 AS rn FROM r),
c AS (SELECT row_id, source_id, len, rn // 16 AS batch_number, rn % 16 AS position, count(*) OVER (PARTITION BY source_id, rn // 16) AS n FROM o),
f AS (SELECT *, min(len) OVER (PARTITION BY source_id, batch_number) AS batch_min, max(len) OVER (PARTITION BY source_id, batch_number) AS batch_max FROM c WHERE n = 16),
i AS (SELECT source_id, batch_number, row_number() OVER (ORDER BY sha256('b1' || chr(0) || 'batch' || chr(0) || source_id || chr(0) || batch_number), source_id, batch_number) - 1 AS batch_index FROM f WHERE position = 0),
b AS (SELECT f.*, batch_index, batch_index * 16 + position AS row_index FROM f JOIN i USING (source_id, batch_number))"""


def _lengths(spark, d):
    return _full(spark, d).select("row_id", "source_id", F.greatest(F.length("query"), F.length("positive")).cast("bigint").alias("len"))


def _batches(spark, d):
    return bt.homogeneous_batches(_lengths(spark, d), "source_id", "row_id", "len", 16, "b1")


@query(_BATCH + " SELECT row_id, source_id, batch_index, position, row_index FROM b")
def homogeneous_batches(spark, d):
    return _batches(spark, d).select("row_id", "source_id", *[F.col(c).cast("bigint").alias(c) for c in ("batch_index", "position", "row_index")])


@query(_BATCH + " SELECT batch_index, count(*) AS rows, min(len) AS shortest, max(len) AS longest, CAST(max(len) * count(*) - sum(len) AS BIGINT) AS padding FROM b GROUP BY 1")
def batch_length_stats(spark, d):
    return bt.batch_stats(_batches(spark, d), "len").withColumn("batch_index", F.col("batch_index").cast("bigint"))


@query(_LEN + " SELECT source_id, count(*) % 16 AS dropped FROM r GROUP BY 1")
def batch_remainders(spark, d):
    return bt.dropped_rows(_lengths(spark, d), "source_id", 16)


@query(_BATCH + ", g AS (SELECT batch_index, count(*) AS n, count(DISTINCT source_id) AS s FROM b GROUP BY 1) SELECT batch_index, 'size' AS rule FROM g WHERE n <> 16 UNION ALL SELECT batch_index, 'sources' FROM g WHERE s <> 1")
def batch_contract(spark, d):
    return bt.contract_violations(_batches(spark, d), "source_id", 16).withColumn("batch_index", F.col("batch_index").cast("bigint"))


_MIX = _BATCH + """, u AS (SELECT 'base' AS role, batch_index AS source_batch, position, row_id FROM b WHERE batch_index < 20 UNION ALL SELECT 'replay', batch_index, position, row_id FROM b WHERE batch_index < 5),
h AS (SELECT role, source_batch, row_number() OVER (ORDER BY sha256('m1' || chr(0) || role || chr(0) || source_batch), role, source_batch) - 1 AS output_batch FROM u WHERE position = 0)"""


def _mixed(spark, d):
    b = _batches(spark, d).select("row_id", "batch_index", "position")
    return bt.mix_components({"base": (b, 320), "replay": (b, 80)}, 16, "m1")


@query(_MIX + " SELECT role, source_batch, position, row_id, output_batch FROM u JOIN h USING (role, source_batch)")
def replay_mix(spark, d):
    return _mixed(spark, d).select("role", *[F.col(c).cast("bigint").alias(c) for c in ("source_batch", "position", "row_id", "output_batch")])


@query(_MIX + " SELECT role, count(*) AS rows, round(count(*) / (SELECT count(*) FROM u), 6) AS share FROM u GROUP BY role")
def multidomain_mix(spark, d):
    return bt.role_shares(_mixed(spark, d), "role").select("role", "rows", F.round("share", 6).alias("share"))


@query(_BATCH + " SELECT CAST(sum(m * 16) AS BIGINT) AS padded, CAST(sum(s) AS BIGINT) AS real FROM (SELECT batch_index, max(len) AS m, sum(len) AS s FROM b GROUP BY 1)")
def padding_waste(spark, d):
    s = bt.batch_stats(_batches(spark, d), "len")
    return s.agg(F.sum(F.col("longest") * F.col("rows")).alias("padded"), F.sum(F.col("longest") * F.col("rows") - F.col("padding")).alias("real"))


_STRATA = _LEN + ", s AS (SELECT *, ((row_number() OVER (PARTITION BY source_id ORDER BY len DESC, row_id) - 1) * 4) // count(*) OVER (PARTITION BY source_id) AS stratum FROM r)"


def _strata(spark, d):
    return bt.strata(_lengths(spark, d), ["source_id"], [-F.col("len"), F.col("row_id")], 4)


@query(_STRATA + " SELECT row_id, source_id, stratum FROM s")
def length_strata(spark, d):
    return _strata(spark, d).select("row_id", "source_id", F.col("stratum").cast("bigint").alias("stratum"))


@query(_HAM + f""", r AS (SELECT row_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY row_id) - 1 AS rk, count(*) OVER (PARTITION BY source_id) AS cnt FROM pairs)
SELECT r.row_id, r.source_id, i AS slot FROM r JOIN ham USING (source_id), range(97) t(i) WHERE i < quota AND rk = ((2 * i + 1) * cnt) // (2 * quota)""")
def midpoint_selection(spark, d):
    p = pairs(spark, d).select("row_id", "source_id")
    quotas = ho.hamilton(p.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), "source_id", "n", 97, "q").select("source_id", "quota")
    return bt.midpoint_picks(p, ["source_id"], [F.col("row_id")], quotas).select("row_id", "source_id", F.col("slot").cast("bigint").alias("slot"))


@query()
def joint_quota_plan(spark, d):
    """Whole quotas per (source, length stratum) that meet both margins; planned on the cell table."""
    from pairloom.operators.holdout import joint_quotas

    cells = [(r["source_id"], int(r["stratum"]), r["n"]) for r in _strata(spark, d).groupBy("source_id", "stratum").agg(F.count(F.lit(1)).alias("n")).collect()]
    sources: dict = {}
    for s, _, n in cells:
        sources[s] = sources.get(s, 0) + n
    quotas = {s: n // 4 for s, n in sources.items()}
    total = sum(quotas.values())
    strata = {t: total // 4 + (t < total % 4) for t in range(4)}
    plan = joint_quotas(cells, quotas, strata)
    return spark.createDataFrame([(s, t, n) for (s, t), n in sorted(plan.items())], "source_id string, stratum int, quota bigint")
