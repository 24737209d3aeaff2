"""Queries over cleaning, deduplication, caps and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.operators import cleaning as cl
from pairloom.plans.base import PAIRS_SQL, pairs, query, squash_sql, strip_sql, table

# the next two rows' positives stand for negatives
_NEG_SQL = PAIRS_SQL + """, three AS (SELECT a.*, list_distinct(list_filter([b.positive, c.positive], lambda n: n IS NOT NULL AND n <> '' AND n <> a.positive)) AS neg FROM pairs a
  LEFT JOIN pairs b ON b.row_id = a.row_id + 1 LEFT JOIN pairs c ON c.row_id = a.row_id + 2)"""
_REASON = """CASE WHEN query IS NULL OR positive IS NULL OR length(query) < 2 OR length(positive) < 10 OR len(neg) = 0 THEN 'missing_or_short'
  WHEN NOT regexp_matches(query, '[가-힣]') THEN 'non_korean_query' WHEN len(list_filter(neg, lambda n: length(n) BETWEEN 10 AND 800)) = 0 THEN 'missing_or_short_negative'
  WHEN length(positive) > 800 THEN 'document_too_long' END"""


def _reasons(spark, d):
    p = pairs(spark, d)
    other = lambda k: p.select((F.col("row_id") - k).alias("row_id"), F.col("positive").alias(f"n{k}"))
    three = p.join(other(1), "row_id", "left").join(other(2), "row_id", "left").withColumn("negatives", F.array("n1", "n2"))
    return three.withColumn("reason", cl.clean_reason(F.col("query"), F.col("positive"), F.col("negatives"), most_text=800))


@query(f"WITH {_NEG_SQL} SELECT row_id, {_REASON} AS reason FROM three")
def clean_reasons(spark, d):
    return _reasons(spark, d).select("row_id", "reason")


@query(f"WITH {_NEG_SQL} SELECT source_id, coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM three GROUP BY 1, 2")
def clean_reason_counts(spark, d):
    return _reasons(spark, d).groupBy("source_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PAIRS_SQL} SELECT a.row_id, CASE WHEN a.query IS NULL OR a.positive IS NULL OR b.positive IS NULL OR length(a.query) < 2 OR least(length(a.positive), length(b.positive)) < 10 THEN 'missing_or_short'
  WHEN NOT regexp_matches(a.query, '[가-힣]') THEN 'non_korean_query' WHEN greatest(length(a.positive), length(b.positive)) > 800 THEN 'document_too_long' WHEN a.positive = b.positive THEN 'positive_equals_negative' END AS reason
FROM pairs a JOIN pairs b ON b.row_id = a.row_id + 1""")
def triplet_reasons(spark, d):
    p = pairs(spark, d)
    nxt = p.select((F.col("row_id") - 1).alias("row_id"), F.col("positive").alias("negative"))
    return p.join(nxt, "row_id").select("row_id", cl.triplet_reason(F.col("query"), F.col("positive"), F.col("negative"), most_text=800).alias("reason"))


@query(f"""WITH {PAIRS_SQL}, b AS (SELECT source_id, query, positive, min(row_id) AS row_id FROM pairs WHERE query IS NOT NULL AND positive IS NOT NULL GROUP BY ALL)
SELECT query, positive, min(row_id) AS row_id FROM b GROUP BY 1, 2""")
def exact_dedup_first_seen(spark, d):
    p = pairs(spark, d).where("query is not null and positive is not null")
    return cl.first_seen(p, ["query", "positive"], ["row_id"]).select("query", "positive", "row_id")


@query(f"SELECT {squash_sql('text')} AS norm, min(text) AS text, count(*) AS rows FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_representative_min_text(spark, d):
    return cl.representatives(table(spark, d, "documents").where("text is not null").withColumn("norm", tx.squash(F.col("text"))), "norm", "text")


@query("""SELECT 'query' AS field, count(query) - count(DISTINCT query) AS duplicates FROM candidates UNION ALL
SELECT 'positive', count(positive) - count(DISTINCT positive) FROM candidates UNION ALL SELECT 'id', count(id) - count(DISTINCT id) FROM candidates""")
def duplicates_beyond_first(spark, d):
    return cl.duplicates_beyond_first(table(spark, d, "candidates"), ["query", "positive", "id"])


@query("""SELECT lang, count(*) AS rows, min(length(text)) AS min, round(avg(length(text)), 6) AS mean, quantile_disc(length(text), 0.5) AS p50,
  quantile_disc(length(text), 0.95) AS p95, quantile_disc(length(text), 0.99) AS p99, max(length(text)) AS max FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def length_profile_by_lang(spark, d):
    x = cl.length_profile(table(spark, d, "documents").withColumn("n", F.length("text")), ["lang"], "n")
    return x.withColumn("mean", F.round("mean", 6))


@query("""SELECT source, count(*) AS rows, round(avg(n_chars), 6) AS mean, min(n_chars) AS min, max(n_chars) AS max, round(quantile_cont(n_chars, 0.05), 6) AS p5,
  round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents WHERE n_chars IS NOT NULL GROUP BY source""")
def length_distribution_linear(spark, d):
    x = cl.linear_distribution(table(spark, d, "documents"), ["source"], "n_chars")
    return x.select("source", "rows", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "p5", "p50", "p95")])


@query("""WITH o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT source, max(n) AS rows, max(CASE WHEN r = ((n - 1) * 1 + 1) // 2 THEN n_chars END) AS q1_2, max(CASE WHEN r = ((n - 1) * 19 + 10) // 20 THEN n_chars END) AS q19_20 FROM o GROUP BY source""")
def length_nearest_rank(spark, d):
    return cl.nearest_rank(table(spark, d, "documents"), ["source"], "n_chars", [(1, 2), (19, 20)])


@query(f"""WITH {PAIRS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY row_id) AS rn FROM pairs WHERE query IS NOT NULL AND positive IS NOT NULL)
SELECT row_id, source_id FROM o WHERE rn <= CASE source_id WHEN 'nlpai_ko_triplet' THEN 200 ELSE 50 END""")
def source_caps(spark, d):
    p = pairs(spark, d).where("query is not null and positive is not null")
    return cl.capped(p, "source_id", ["row_id"], {"nlpai_ko_triplet": 200}, 50).select("row_id", "source_id")


@query(f"""WITH {_NEG_SQL}, m AS (SELECT source_id, row_id, CASE WHEN {_REASON} IS NULL THEN 1 ELSE 0 END AS ok FROM three),
c AS (SELECT *, sum(ok) OVER (PARTITION BY source_id ORDER BY row_id) - ok AS before FROM m)
SELECT source_id, count(*) AS examined, CAST(sum(ok) AS BIGINT) AS accepted, CAST(sum(1 - ok) AS BIGINT) AS rejected FROM c WHERE before < 60 GROUP BY 1""")
def source_caps_examined(spark, d):
    return cl.examined(_reasons(spark, d), "source_id", [F.col("row_id")], F.col("reason").isNull(), 60)


@query(f"""WITH {PAIRS_SQL}, f AS (SELECT repository, positive AS head FROM pairs WHERE row_id IN (SELECT min(row_id) FROM pairs WHERE repository IS NOT NULL GROUP BY repository)),
x AS (SELECT row_id, query, positive, CASE WHEN f.repository IS NULL THEN [] ELSE [f.head, query] END AS neg FROM pairs LEFT JOIN f USING (repository)),
y AS (SELECT row_id, CASE WHEN query IS NULL OR length(trim(query)) = 0 THEN 'empty_query' END AS a, CASE WHEN positive IS NULL OR length(trim(positive)) = 0 THEN 'empty_positive' END AS b, CASE WHEN len(neg) = 0 THEN 'no_negative' END AS c,
  CASE WHEN len(list_filter(neg, lambda v: v IS NULL OR length(trim(v)) = 0)) > 0 THEN 'empty_negative' END AS e, CASE WHEN list_contains(neg, positive) THEN 'positive_in_negatives' END AS f FROM x)
SELECT row_id, unnest(list_filter([a, b, c, e, f], lambda v: v IS NOT NULL)) AS rule FROM y""")
def strict_row_violations(spark, d):
    """Negatives of a row: the first positive of its repository, and its own query."""
    p = pairs(spark, d)
    first = p.where("repository is not null").groupBy("repository").agg(F.min("row_id").alias("row_id"))
    heads = p.select("row_id", F.col("positive").alias("head")).join(first, "row_id").select("repository", "head", F.lit(True).alias("there"))
    negatives = F.when(F.col("there"), F.array("head", "query")).otherwise(F.array().cast("array<string>"))
    return cl.strict_violations(p.join(heads, "repository", "left").withColumn("negatives", negatives), "row_id", "query", "positive", "negatives")


@query("""WITH x AS (SELECT generated_id, reranker_score AS p, retriever_score AS n, score_row_id FROM cache_qwen3_reranker_scores)
SELECT score_row_id, unnest(list_filter([CASE WHEN p IS NULL OR isnan(p) OR n IS NULL OR isnan(n) THEN 'score_not_finite' END,
  CASE WHEN p < 0 OR (p > 1 AND NOT isnan(p)) OR isnan(p) OR n < 0 OR n > 1 OR isnan(n) THEN 'score_range' END, CASE WHEN p IS NOT NULL AND n IS NOT NULL AND p <= n THEN 'positive_not_dominant' END], lambda v: v IS NOT NULL)) AS rule FROM x""")
def teacher_score_violations(spark, d):
    s = table(spark, d, "cache_qwen3_reranker_scores").select("score_row_id", F.lit("q").alias("q"), F.lit("p").alias("p"), F.array(F.lit("n")).alias("neg"), F.array("reranker_score", "retriever_score").alias("s"))
    v = cl.strict_violations(s, "score_row_id", "q", "p", "neg", "s")
    return v.where("rule <> 'score_count'")


@query("""SELECT id, count(*) AS rows, count(DISTINCT coalesce(query, chr(2)) || chr(1) || coalesce(positive, chr(2))) > 1 AS differ FROM candidates GROUP BY id HAVING count(*) > 1""")
def repeated_candidate_ids(spark, d):
    return cl.repeated_ids(table(spark, d, "candidates"), "id", ["query", "positive"])


@query(f"""WITH {PAIRS_SQL}, x AS (SELECT row_id, query, positive, sha256(concat_ws(chr(0), coalesce(source_id,''), coalesce(query,''), coalesce(positive,''))) AS h FROM pairs)
SELECT a.row_id, a.h AS row_sha256, (row_number() OVER (ORDER BY a.row_id) - 1) = a.row_id - 1 AS index_ok FROM x a""")
def provenance_row_hash_audit(spark, d):
    from pairloom.sources.adapters import dense_order

    p = pairs(spark, d)
    h = tx.stable_hash(*[F.coalesce(c, F.lit("")) for c in ("source_id", "query", "positive")])
    return dense_order(p.select("row_id", h.alias("row_sha256")), "row_id").select("row_id", "row_sha256", (F.col("slot") == F.col("row_id") - 1).alias("index_ok"))


@query("""WITH a AS (SELECT DISTINCT generated_id AS id FROM grounded_synthetic_query_factory), b AS (SELECT DISTINCT generated_id AS id FROM cache_qwen3_reranker_scores)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL""")
def misaligned_ids(spark, d):
    from pairloom.sources.readers import misaligned

    ids = lambda name: table(spark, d, name).select(F.col("generated_id").alias("id")).distinct()
    return misaligned(ids("grounded_synthetic_query_factory"), ids("cache_qwen3_reranker_scores"), "id")


@query(f"""WITH x AS (SELECT doc_id, 'title' AS field, title AS v FROM documents UNION ALL SELECT doc_id, 'text', text FROM documents) SELECT doc_id, field, CASE
  WHEN {" OR ".join(f"regexp_matches(v, '{p}')" for p in cl.SECRET_PATTERNS)} THEN 'secret' WHEN regexp_matches(v, '^(/|~/|[A-Za-z]:\\\\)[^ ]*$') THEN 'path'
  WHEN regexp_matches(v, '[\\x00-\\x08\\x0E-\\x1F]') THEN 'control' WHEN length(v) > 512 THEN 'long' WHEN v <> trim(v, ' ') THEN 'untrimmed' END AS reason FROM x""")
def secret_like_values(spark, d):
    t = table(spark, d, "documents")
    values = t.select("doc_id", F.lit("title").alias("field"), F.col("title").alias("v")).unionByName(t.select("doc_id", F.lit("text").alias("field"), F.col("text").alias("v")))
    return values.select("doc_id", "field", cl.secret_like(F.col("v")).alias("reason"))


@query(f"""WITH {PAIRS_SQL} SELECT source_id, count(*) AS rows, count(*) FILTER (WHERE length(query) < 10) AS short_queries, count(*) FILTER (WHERE length(positive) < 50) AS short_positives FROM pairs GROUP BY 1""")
def too_short_by_source(spark, d):
    return pairs(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.length("query") < 10).alias("short_queries"), F.count_if(F.length("positive") < 50).alias("short_positives"))


@query(f"""SELECT source, count(*) AS n FROM documents WHERE NOT (coalesce(source, '') LIKE 'crawl_0%' OR coalesce(source, '') = 'web_mirror_ko') GROUP BY 1""")
def policy_source_block(spark, d):
    blocked = F.coalesce("source", F.lit("")).like("crawl_0%") | (F.coalesce("source", F.lit("")) == "web_mirror_ko")
    return table(spark, d, "documents").where(~blocked).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT * FROM pairs WHERE source_id IN ('webfaq_ko_pairs', 'finance_qa_ko'))
SELECT row_id AS parent_index, row_number() OVER (ORDER BY row_id) - 1 AS row_index, source_id FROM s""")
def source_subset(spark, d):
    from pairloom.sources.adapters import dense_order

    s = pairs(spark, d).where(F.col("source_id").isin("webfaq_ko_pairs", "finance_qa_ko")).select("row_id", "source_id")
    return dense_order(s, "row_id").select(F.col("row_id").alias("parent_index"), F.col("slot").alias("row_index"), "source_id")


@query("""SELECT doc_id FROM documents WHERE CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 4 = 1""")
def shard_members(spark, d):
    from pairloom.sources.readers import in_shard

    return table(spark, d, "documents").where(in_shard(F.col("doc_id").cast("string"), 4, 1)).select("doc_id")


@query(f"""WITH r AS (SELECT DISTINCT provenance.repository AS repository FROM candidates WHERE provenance.repository LIKE 'openlaw%')
SELECT c.row_id, CASE WHEN nullif({strip_sql('c.provenance.repository')}, '') IS NULL THEN 'no_repository' WHEN r.repository IS NULL THEN 'no_rights' WHEN c.provenance.revision IS NULL THEN 'no_revision' ELSE 'allowed' END AS verdict
FROM candidates c LEFT JOIN r ON c.provenance.repository = r.repository""")
def rights_allow_list(spark, d):
    c = table(spark, d, "candidates").select("row_id", F.col("provenance.repository").alias("repository"), F.col("provenance.revision").alias("revision"))
    rights = c.where("repository like 'openlaw%'").select("repository").distinct().withColumn("allowed", F.lit(True))
    verdict = F.when(tx.first_present(F.col("repository")).isNull(), "no_repository").when(F.col("allowed").isNull(), "no_rights").when(F.col("revision").isNull(), "no_revision").otherwise("allowed")
    return c.join(rights, "repository", "left").select("row_id", verdict.alias("verdict"))
