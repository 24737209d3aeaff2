"""Queries over contracts, nested values and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.operators import contracts as ct
from pairloom.plans.base import PAIRS_SQL, pairs, query, strip_sql, table

_CACHE = "cache_qwen3_reranker_scores"



_SRC = ["nlpai_ko_triplet", "webfaq_ko_pairs", "community_qa_ko", "statute_sections", "instruct_ko_mix", "news_topic_ko", "finance_qa_ko", "health_faq_ko", "sts_ko_pairs", "strategy_qa_ko", "longdoc_ko_train", "tidy_ko_train", "banking_intent_ko", "replay_multi"]
_EACH = " UNION ALL ".join(f"SELECT audit_id, rows, '{s}' AS s, source_counts.{s} AS c FROM training_data_audit WHERE source_counts.{s} IS NOT NULL" for s in _SRC)


@query(f"""WITH {PAIRS_SQL}, e AS ({_EACH}), o AS (SELECT source_id, count(*) AS h FROM pairs GROUP BY 1)
SELECT audit_id, 'sum_differs' AS rule, NULL AS source FROM e GROUP BY audit_id, rows HAVING sum(c) <> rows
UNION ALL SELECT audit_id, CASE WHEN c < 0 THEN 'negative' WHEN coalesce(h, 0) = 0 THEN 'unknown_source' ELSE 'above_observed' END, s FROM e LEFT JOIN o ON s = source_id WHERE c < 0 OR coalesce(h, 0) = 0 OR c > h""")
def plan_validation(spark, d):
    seen = pairs(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("h"))
    return ct.plan_problems(table(spark, d, "training_data_audit"), "audit_id", "rows", "source_counts", seen, "source_id", "h")


@query(f"""WITH g AS (SELECT generated_id, count(*) FILTER (WHERE role = 'positive') AS p, count(*) AS n, count(DISTINCT candidate_id) AS dc, count(*) FILTER (WHERE retriever_score IS NULL OR isnan(retriever_score)) AS bad FROM {_CACHE} GROUP BY 1)
SELECT generated_id, 'positives' AS rule FROM g WHERE p <> 1 UNION ALL SELECT generated_id, 'repeated_item' FROM g WHERE dc <> n UNION ALL SELECT generated_id, 'bad_score' FROM g WHERE bad > 0""")
def reranker_contract(spark, d):
    return ct.pool_problems(table(spark, d, _CACHE), "generated_id", "candidate_id", F.col("role") == "positive", "retriever_score")


@query("""SELECT 'unknown_query' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'unknown_document', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0)
UNION ALL SELECT 'unjudged_query', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'repeated_judgement', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)""")
def beir_integrity(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"))
    c = table(spark, d, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("corpus_id"))
    return ct.judgement_problems(q, c, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("corpus_id")))


@query("SELECT row_id, json_extract_string(provenance_json, '$.path') AS path FROM grounded_synthetic_query_factory WHERE row_id % 4 <> 3")
def response_objects(spark, d):
    """A quarter of the objects each bare, fenced, in an envelope, and followed by other text (rejected)."""
    g = table(spark, d, "grounded_synthetic_query_factory")
    p = F.col("provenance_json")
    wrapped = (
        F.when(F.col("row_id") % 4 == 0, p).when(F.col("row_id") % 4 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(F.col("row_id") % 4 == 2, F.to_json(F.struct(p.alias("response")))).otherwise(F.concat(p, F.lit(" trailing")))
    )
    o = g.select("row_id", ct.response_object(wrapped).alias("o")).where("o is not null")
    return o.select("row_id", F.try_variant_get("o", "$.path", "string").alias("path"))


@query(f"""WITH x AS (SELECT row_id, list_filter([nullif({strip_sql('provenance.section_heading')}, ''), nullif({strip_sql('provenance.path')}, ''), nullif({strip_sql('provenance.section_heading')}, '')], lambda v: v IS NOT NULL) AS l, id FROM candidates)
SELECT row_id, CASE WHEN len(l) = 0 THEN [id] WHEN len(l) > 1 AND l[1] <> l[2] THEN [l[1], l[2]] ELSE [l[1]] END AS locators FROM x""")
def allowed_locators(spark, d):
    h, p = F.col("provenance.section_heading"), F.col("provenance.path")
    return table(spark, d, "candidates").select("row_id", ct.locators(h, p, h, fallback=F.col("id")).alias("locators"))


@query("SELECT row_id, 'Instruct: judge relevance' || chr(10) || 'Query: ' || query || chr(10) || 'Document: ' || positive AS prompt FROM candidates WHERE query IS NOT NULL AND positive IS NOT NULL")
def scorer_prompts(spark, d):
    c = table(spark, d, "candidates").where("query is not null and positive is not null")
    return c.select("row_id", F.concat(F.lit("Instruct: judge relevance\nQuery: "), "query", F.lit("\nDocument: "), "positive").alias("prompt"))


@query("""SELECT row_id, list_distinct(regexp_extract_all(lower(to_json(provenance)), '[0-9a-f]{64}')) AS digests FROM candidates WHERE len(regexp_extract_all(lower(to_json(provenance)), '[0-9a-f]{64}')) > 0""")
def document_digests(spark, d):
    c = table(spark, d, "candidates").select("row_id", ct.digests_in(F.to_json("provenance")).alias("digests"))
    return c.where(F.size("digests") > 0)


@query("""SELECT g.row_id, replace(j.fullkey, '"', '') AS path, CASE WHEN contains(lower(string_split(replace(j.fullkey, '"', ''), '.')[-1]), 'revision') THEN 'sensitive_key' ELSE 'path' END AS rule
FROM grounded_synthetic_query_factory g, json_tree(g.provenance_json) j WHERE j.type = 'VARCHAR' AND contains(lower(string_split(replace(j.fullkey, '"', ''), '.')[-1]), 'revision')""")
def config_violations(spark, d):
    return ct.config_problems(table(spark, d, "grounded_synthetic_query_factory"), "row_id", "provenance_json", ["revision"])


@query("""WITH RECURSIVE t AS (SELECT doc_id, CASE WHEN doc_id > 1 THEN doc_id // 3 + 1 END AS parent FROM documents), u AS (SELECT doc_id, CASE WHEN parent = doc_id THEN NULL ELSE parent END AS parent FROM t),
r AS (SELECT doc_id, doc_id AS root, 0 AS depth FROM u WHERE parent IS NULL UNION ALL SELECT u.doc_id, r.root, r.depth + 1 FROM u JOIN r ON u.parent = r.doc_id)
SELECT doc_id, root, CAST(depth AS BIGINT) AS depth FROM r""")
def lineage(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") > 1, F.expr("doc_id div 3 + 1")).alias("parent"))
    t = t.withColumn("parent", F.when(F.col("parent") == F.col("doc_id"), None).otherwise(F.col("parent")))
    return ct.ancestry(t, "doc_id", "parent")


@query(f"WITH {PAIRS_SQL}, o AS (SELECT row_id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY sha256('s3' || chr(0) || row_id), row_id) AS n FROM pairs) SELECT row_id, source_id FROM o WHERE n <= 25")
def seeded_sample(spark, d):
    return ct.sample_per_group(pairs(spark, d), "source_id", "row_id", 25, "s3").select("row_id", "source_id")


@query("SELECT row_id, [pair_type, id, label_origin][CAST(('0x' || substr(sha256(id), 1, 15)) AS BIGINT) % 3 + 1] AS chosen FROM candidates WHERE id IS NOT NULL")
def hashed_choice(spark, d):
    from pairloom.sources.adapters import chosen

    c = table(spark, d, "candidates").where("id is not null")
    return c.select("row_id", chosen(F.array("pair_type", "id", "label_origin"), F.col("id")).alias("chosen"))


@query("""SELECT pair_type, label_origin, count(*) AS n FROM candidates GROUP BY 1, 2""")
def grouped_counts(spark, d):
    return table(spark, d, "candidates").groupBy("pair_type", "label_origin").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT unnest(string_split(pair_type, '_')) AS task FROM candidates) SELECT task, count(*) AS exposures FROM t GROUP BY 1""")
def exposure_counts(spark, d):
    return table(spark, d, "candidates").select(F.explode(F.split("pair_type", "_")).alias("task")).groupBy("task").agg(F.count(F.lit(1)).alias("exposures"))


@query(f"""SELECT provenance.repository AS repository, list(DISTINCT provenance.revision ORDER BY provenance.revision)[1] AS first_revision, count(DISTINCT provenance.revision) AS revisions, min(nullif({strip_sql("provenance.metadata['시행일자']")}, '')) AS first_date,
  max(nullif({strip_sql("provenance.metadata['시행일자']")}, '')) AS last_date FROM candidates GROUP BY 1""")
def source_revisions_and_dates(spark, d):
    c = table(spark, d, "candidates").select(F.col("provenance.repository").alias("repository"), F.col("provenance.revision").alias("revision"), tx.first_present(F.col("provenance.metadata").getItem("시행일자")).alias("date"))
    return c.groupBy("repository").agg(F.min("revision").alias("first_revision"), F.count_distinct("revision").alias("revisions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"""SELECT g.generated_id, CASE WHEN s.generated_id IS NULL THEN 'no_scores' ELSE 'scored' END AS state, coalesce(s.n, 0) AS n FROM grounded_synthetic_query_factory g
LEFT JOIN (SELECT generated_id, count(*) AS n FROM {_CACHE} GROUP BY 1) s USING (generated_id)""")
def generated_with_scores(spark, d):
    s = table(spark, d, _CACHE).groupBy("generated_id").agg(F.count(F.lit(1)).alias("n"))
    g = table(spark, d, "grounded_synthetic_query_factory").select("generated_id")
    return g.join(s, "generated_id", "left").select("generated_id", F.when(F.col("n").isNull(), "no_scores").otherwise("scored").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""SELECT s.score_row_id, g.row_id AS generated_row, c.row_id AS candidate_row FROM {_CACHE} s JOIN grounded_synthetic_query_factory g USING (generated_id)
JOIN (SELECT id, min(row_id) AS row_id FROM candidates GROUP BY 1) c ON c.id = s.candidate_id""")
def projected_provenance(spark, d):
    c = table(spark, d, "candidates").groupBy(F.col("id").alias("candidate_id")).agg(F.min("row_id").alias("candidate_row"))
    g = table(spark, d, "grounded_synthetic_query_factory").select("generated_id", F.col("row_id").alias("generated_row"))
    s = table(spark, d, _CACHE).select("score_row_id", "generated_id", "candidate_id")
    return s.join(g, "generated_id").join(c, "candidate_id").select("score_row_id", "generated_row", "candidate_row")


@query("""WITH a AS (SELECT source_candidate_id AS id FROM grounded_synthetic_query_factory WHERE source_candidate_id IS NOT NULL)
(SELECT id, 'only_generated' AS side FROM a EXCEPT SELECT id, 'only_generated' FROM candidates) UNION ALL (SELECT id, 'only_candidates' FROM candidates EXCEPT SELECT id, 'only_candidates' FROM a)""")
def membership_drift(spark, d):
    a = table(spark, d, "grounded_synthetic_query_factory").where("source_candidate_id is not null").select(F.col("source_candidate_id").alias("id"))
    b = table(spark, d, "candidates").select("id")
    return a.subtract(b).withColumn("side", F.lit("only_generated")).unionByName(b.subtract(a).withColumn("side", F.lit("only_candidates")))


@query(f"""WITH {PAIRS_SQL} SELECT split AS role, source_id, count(*) AS n FROM pairs WHERE split IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'generated', c.source_id, count(*) FROM grounded_synthetic_query_factory g JOIN (SELECT c.id, min(p.source_id) AS source_id FROM candidates c JOIN pairs p USING (row_id) GROUP BY 1) c ON c.id = g.source_candidate_id GROUP BY 1, 2""")
def union_by_role(spark, d):
    """Rows of the splits and generated rows, united under their roles."""
    p = pairs(spark, d).where("split is not null").select(F.col("split").alias("role"), "source_id")
    ids = table(spark, d, "candidates").select("row_id", "id").join(pairs(spark, d).select("row_id", "source_id"), "row_id").groupBy("id").agg(F.min("source_id").alias("source_id"))
    g = table(spark, d, "grounded_synthetic_query_factory").join(ids, F.col("source_candidate_id") == F.col("id")).select(F.lit("generated").alias("role"), "source_id")
    return p.unionByName(g).groupBy("role", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS domain, sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def content_addressed_corpus(spark, d):
    x = table(spark, d, "documents").where("text is not null")
    return x.groupBy(F.col("source").alias("domain"), F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"""WITH a AS (SELECT generated_id, count(*) AS requests FROM grounded_synthetic_query_factory WHERE generated_id IS NOT NULL GROUP BY 1), b AS (SELECT generated_id, count(*) AS responses FROM {_CACHE} WHERE role = 'positive' AND generated_id IS NOT NULL GROUP BY 1),
j AS (SELECT coalesce(a.generated_id, b.generated_id) AS generated_id, coalesce(requests, 0) AS requests, coalesce(responses, 0) AS responses FROM a FULL JOIN b ON a.generated_id = b.generated_id)
SELECT *, CASE WHEN requests > 1 THEN 'repeated_request' WHEN requests = 0 THEN 'unexpected_response' WHEN responses = 0 THEN 'missing_response' WHEN responses > 1 THEN 'repeated_response' ELSE 'matched' END AS state FROM j""")
def matched_responses(spark, d):
    """Generated rows as requests, scored positives as their responses."""
    scored = table(spark, d, _CACHE).where("role = 'positive'")
    return ct.matched_responses(table(spark, d, "grounded_synthetic_query_factory").select("generated_id"), scored.select("generated_id"), "generated_id")
