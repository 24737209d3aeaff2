"""Queries over decontamination. Validation and test pairs are the benchmark, train pairs the training set."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.operators import decontam as dc
from pairloom.plans.base import PAIRS_SQL, pairs, query, squash_sql, table

_ITEMS_SQL = f"""WITH {PAIRS_SQL}, items AS (
  SELECT CASE split WHEN 'test' THEN 'query_text' ELSE 'evaluation_text' END AS kind, source_id AS task, query AS text FROM pairs WHERE split IN ('validation', 'test')
  UNION ALL SELECT 'corpus_text', source_id, positive FROM pairs WHERE split IN ('validation', 'test')),
blocked AS (SELECT DISTINCT kind, task, sha256(text) AS sha FROM items WHERE length(text) > 0),
train AS (SELECT row_id, source_id, CASE WHEN row_id % 2 = 0 THEN [source_id] ELSE [] END AS declared, query, full_query, positive FROM pairs WHERE split = 'train'),
roles AS (SELECT row_id, source_id, declared, 0 AS position, 'query_full' AS role, sha256(full_query) AS sha FROM train WHERE length(full_query) > 0
  UNION ALL SELECT row_id, source_id, declared, 1, 'query_body', sha256(query) FROM train WHERE length(query) > 0
  UNION ALL SELECT row_id, source_id, declared, 2, 'positive', sha256(positive) FROM train WHERE length(positive) > 0),
one AS (SELECT sha, list(DISTINCT kind) AS kinds, coalesce(list(DISTINCT task) FILTER (WHERE kind = 'evaluation_text'), []) AS ev FROM blocked GROUP BY sha),
matched AS (SELECT * FROM roles JOIN one USING (sha))"""


def _items(spark, d):
    p = pairs(spark, d).where(F.col("split").isin("validation", "test"))
    q = p.select(F.when(F.col("split") == "test", "query_text").otherwise("evaluation_text").alias("kind"), F.col("source_id").alias("task"), F.col("query").alias("text"))
    return q.unionByName(p.select(F.lit("corpus_text").alias("kind"), F.col("source_id").alias("task"), F.col("positive").alias("text")))


def _train(spark, d):
    t = pairs(spark, d).where("split = 'train'")
    return t.withColumn("declared", F.when(F.col("row_id") % 2 == 0, F.array("source_id")).otherwise(F.array().cast("array<string>")))


def _matched(spark, d):
    from pairloom.session import materialize

    # read twice by the audit: written once
    r = dc.roles(_train(spark, d), "row_id", {"query_full": F.col("full_query"), "query_body": F.col("query"), "positive": F.col("positive")}, ["source_id", "declared"])
    return materialize(dc.matches(r, dc.blocklist(_items(spark, d))), "matched")


@query(_ITEMS_SQL + " SELECT kind, task, sha AS sha256 FROM blocked")
def blocklist_build(spark, d):
    return dc.blocklist(_items(spark, d))


@query(_ITEMS_SQL + " SELECT kind, count(*) AS occurrences, count(DISTINCT text) AS unique_texts FROM items WHERE length(text) > 0 GROUP BY kind")
def blocklist_counts(spark, d):
    return dc.blocklist_counts(_items(spark, d))


_AUDIT_SQL = _ITEMS_SQL + """, per AS (SELECT source_id, list_distinct(flatten(list(declared))) AS decl FROM matched GROUP BY 1),
j AS (SELECT m.*, decl, list_contains(kinds, 'query_text') OR len(list_filter(ev, lambda t: NOT list_contains(decl, t))) > 0 AS crit FROM matched m JOIN per USING (source_id)),
dg AS (SELECT source_id, sha, bool_or(crit) AS c, bool_or(len(list_filter(ev, lambda t: list_contains(decl, t))) > 0) AS e, bool_or(list_contains(kinds, 'corpus_text')) AS k FROM j GROUP BY 1, 2),
audit AS (SELECT source_id, count(*) FILTER (WHERE c) AS critical, count(*) FILTER (WHERE e) AS expected, count(*) FILTER (WHERE k) AS corpus, count(*) AS digests FROM dg GROUP BY 1)"""


@query(_AUDIT_SQL + " SELECT * FROM audit")
def overlap_audit_by_source(spark, d):
    return dc.overlap_audit(_matched(spark, d), "source_id", "declared")


@query(_AUDIT_SQL + """ SELECT source_id, CASE WHEN critical > 0 THEN 'critical_query_or_evaluation_text_overlap' WHEN corpus > 0 THEN 'pass_with_retrieval_corpus_exposure'
  WHEN expected > 0 THEN 'pass_with_declared_train_family_exposure' ELSE 'pass_no_exact_text_overlap' END AS status FROM audit""")
def overlap_status(spark, d):
    a = dc.overlap_audit(_matched(spark, d), "source_id", "declared")
    return a.select("source_id", dc.overlap_status(F.col("critical"), F.col("expected"), F.col("corpus")).alias("status"))


_DROP_SQL = _ITEMS_SQL + """, bad AS (SELECT row_id, arg_min(role, position) AS role FROM matched
  WHERE list_contains(kinds, 'query_text') OR len(list_filter(ev, lambda t: NOT list_contains(declared, t))) > 0 GROUP BY 1)"""


@query(_DROP_SQL + " SELECT row_id FROM train WHERE row_id NOT IN (SELECT row_id FROM bad)")
def decontaminated_rows(spark, d):
    return dc.without(_train(spark, d), dc.critical_rows(_matched(spark, d), "row_id", "declared"), "row_id").select("row_id")


@query(_DROP_SQL + " SELECT role, count(*) AS n FROM bad GROUP BY role")
def decontam_dropped_by_role(spark, d):
    return dc.critical_rows(_matched(spark, d), "row_id", "declared").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(_ITEMS_SQL + " SELECT row_id FROM train WHERE row_id NOT IN (SELECT row_id FROM matched)")
def any_text_dropped(spark, d):
    return dc.without(_train(spark, d), _matched(spark, d).select("row_id").distinct(), "row_id").select("row_id")


@query(_DROP_SQL + """ SELECT m.row_id, m.source_id, len(list_filter(ev, lambda t: NOT list_contains(declared, t))) = 0 AS exempt FROM matched m WHERE len(ev) > 0""")
def declared_task_exemption(spark, d):
    m = _matched(spark, d).where(F.size("evaluation_tasks") > 0)
    return m.select("row_id", "source_id", (F.size(F.array_except("evaluation_tasks", "declared")) == 0).alias("exempt"))


@query(f"""WITH {PAIRS_SQL}, w AS (SELECT row_id, split, string_split(lower(positive), ' ') AS w FROM pairs WHERE positive IS NOT NULL),
g AS (SELECT DISTINCT row_id, split, array_to_string(w[i:i + 12], ' ') AS gram FROM w, range(1, len(w) - 11) r(i) WHERE len(w) >= 13)
SELECT a.row_id AS train_row, b.row_id AS held_row, count(*) AS grams FROM g a JOIN g b ON a.gram = b.gram WHERE a.split = 'train' AND b.split IN ('validation', 'test') GROUP BY 1, 2""")
def benchmark_13gram_overlap(spark, d):
    p = pairs(spark, d).where("positive is not null")
    a = dc.word_grams(p.where("split = 'train'"), "row_id", "positive", 13).withColumnRenamed("row_id", "train_row")
    b = dc.word_grams(p.where("split in ('validation', 'test')"), "row_id", "positive", 13).withColumnRenamed("row_id", "held_row")
    return a.join(b, "gram").groupBy("train_row", "held_row").agg(F.count(F.lit(1)).alias("grams"))


_MINS = ", ".join(f"min((h * {a}::BIGINT + {b}::BIGINT) % {dc.PRIME})" for a, b in dc.permutations(128, 42))
_SHINGLE = " + ".join(f"unicode(substr(t, i + {k}, 1))::BIGINT * {m}" for k, m in enumerate(dc.shingle_multipliers(5)))
_SIGNED = f"""WITH x AS (SELECT doc_id, {squash_sql('text')} AS t FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, ({_SHINGLE}) % {dc.PRIME} AS h FROM x, range(1, length(t) - 3) r(i) WHERE length(t) >= 20), s AS (SELECT doc_id, [{_MINS}] AS signature FROM h GROUP BY doc_id)"""


@query(_SIGNED + " SELECT doc_id, signature FROM s")
def minhash_signatures(spark, d):
    return dc.minhash(table(spark, d, "documents"), "doc_id", "text")


@query(_SIGNED + """, c AS (SELECT signature, min(doc_id) AS doc_id FROM s GROUP BY 1), k AS (SELECT doc_id, i, signature[i * 8 + 1:i * 8 + 8] AS band FROM c, range(16) r(i)),
m AS (SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.i = b.i AND a.band = b.band AND a.doc_id < b.doc_id),
e AS (SELECT m.*, len(list_filter(list_zip(a.signature, b.signature), lambda z: z[1] = z[2])) / 128.0 AS estimate FROM m JOIN c a ON a.doc_id = doc_id_a JOIN c b ON b.doc_id = doc_id_b)
SELECT doc_id_a, doc_id_b, estimate FROM e WHERE estimate >= 0.8""")
def minhash_lsh_pairs(spark, d):
    """Near pairs of distinct signatures (16 bands of 8); copies of a signature stand behind its smallest id."""
    from pairloom.session import materialize

    classes = materialize(dc.signature_classes(dc.minhash(table(spark, d, "documents"), "doc_id", "text"), "doc_id"), "signatures")
    return dc.banded_pairs(classes, "doc_id", 16, 8)


@query(f"""WITH x AS (SELECT doc_id, string_split({squash_sql('lower(text)')}, ' ') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM x WHERE len(w) >= 5),
c AS (SELECT g, min(doc_id) AS class, count(*) AS copies FROM g GROUP BY 1), l AS (SELECT class, len(g) AS n, unnest(g) AS gram FROM c),
p AS (SELECT a.class AS a, b.class AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM l a JOIN l b ON a.gram = b.gram AND a.class <> b.class GROUP BY 1, 2),
k AS (SELECT a AS class, count(*) AS links FROM p WHERE shared >= (na + nb - shared) * 0.8 - 1e-9 GROUP BY 1)
SELECT g.doc_id, c.class, c.copies, coalesce(k.links, 0) AS links FROM g JOIN c USING (g) LEFT JOIN k USING (class)""")
def near_dup_jaccard(spark, d):
    """Documents by their sets of five-word shingles: class of equal sets, copies, and sets of similarity 0.8 or more."""
    return dc.near_word_sets(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query(f"""WITH {PAIRS_SQL}, i AS (SELECT row_id, {squash_sql('lower(query)')} AS q FROM pairs WHERE split IN ('validation', 'test') AND length(query) > 0),
x AS (SELECT doc_id, ' ' || {squash_sql('lower(text)')} || ' ' AS t FROM documents WHERE text IS NOT NULL) SELECT DISTINCT doc_id, row_id FROM x JOIN i ON contains(t, ' ' || q || ' ')""")
def benchmark_containment(spark, d):
    """Documents whose words hold a held-out query whole."""
    items = pairs(spark, d).where("split in ('validation', 'test')").select("row_id", "query")
    return dc.contained_texts(table(spark, d, "documents"), "doc_id", "text", items, "row_id", "query")


@query(f"""SELECT row_id, regexp_extract(json_extract_string(provenance_json, '$.section_heading'), '\\(([^)]*)\\)', 1) AS answer,
  contains(lower(positive), lower(regexp_extract(json_extract_string(provenance_json, '$.section_heading'), '\\(([^)]*)\\)', 1))) AS bears
FROM grounded_synthetic_query_factory WHERE json_extract_string(provenance_json, '$.section_heading') IS NOT NULL""")
def answer_bearing_passages(spark, d):
    g = table(spark, d, "grounded_synthetic_query_factory")
    head = F.try_variant_get(F.try_parse_json("provenance_json"), "$.section_heading", "string")
    answer = F.regexp_extract(head, r"\(([^)]*)\)", 1)
    return g.where(head.isNotNull()).select("row_id", answer.alias("answer"), F.lower("positive").contains(F.lower(answer)).alias("bears"))


@query("""WITH t AS (SELECT DISTINCT provenance.source_document_sha256 AS doc FROM candidates WHERE lower(trim(split)) = 'train' AND provenance.source_document_sha256 IS NOT NULL),
x AS (SELECT row_id, id, provenance.source_document_sha256 AS doc FROM candidates WHERE lower(trim(split)) = 'test')
SELECT x.row_id, CASE WHEN t.doc IS NOT NULL THEN 'document_seen_in_training' ELSE 'eligible' END AS verdict FROM x LEFT JOIN t USING (doc)""")
def holdout_document_exclusion(spark, d):
    from pairloom.operators.holdout import admission

    c = table(spark, d, "candidates").select("row_id", "id", F.col("provenance.source_document_sha256").alias("doc"), F.lower(F.trim("split")).alias("split"))
    return admission(c.where("split = 'test'"), c.where("split = 'train'"), "doc").select("row_id", "verdict")
