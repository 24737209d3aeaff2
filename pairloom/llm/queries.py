"""Queries over the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import fields, formatting, groups, leaks, mixing, overlap, packing, pii, tokens, topn, unify
from pairloom.session import materialize

QUERIES: dict = {}
SQL: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    forms = unify.plain_form(table(spark, d, "candidates"), "row_id", ["query", "positive"])
    return unify.same_look_pairs(forms, "row_id")


@query
def p6_plain_forms(spark: SparkSession, d: str) -> DataFrame:
    return unify.plain_form(table(spark, d, "candidates"), "row_id", ["query", "positive"]).select("row_id", "field", "plain")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copy_pairs(table(spark, d, "grounded_synthetic_query_factory"), "row_id", "positive_normalized", "provenance_json")


@query
def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    return formatting.formatting_classes(table(spark, d, "grounded_synthetic_query_factory"), "row_id", "positive_normalized", "provenance_json")[0]


def _top_scores(spark, d):
    return topn.top_n(table(spark, d, "cache_qwen3_reranker_scores"), "generated_id", "candidate_id", "scored_at", "score_row_id", "retriever_score", 5)


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _top_scores(spark, d).select(F.col("row_key").alias("score_row_id"))


_P4 = """
WITH latest AS (
  SELECT generated_id, candidate_id, score_row_id, retriever_score + 0.0 AS s,
         row_number() OVER (PARTITION BY generated_id, candidate_id ORDER BY scored_at DESC NULLS LAST, score_row_id DESC) AS rn
  FROM cache_qwen3_reranker_scores),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY generated_id ORDER BY s DESC, candidate_id NULLS LAST, score_row_id) AS r
  FROM latest WHERE rn = 1 AND s IS NOT NULL AND NOT isnan(s) AND NOT isinf(s))
"""
SQL["p4_found"] = _P4 + "SELECT score_row_id FROM ranked WHERE r <= 5"


@query
def p4_top_scores(spark: SparkSession, d: str) -> DataFrame:
    return _top_scores(spark, d).select(F.col("grp").alias("generated_id"), F.col("item").alias("candidate_id"), F.col("row_key").alias("score_row_id"), "score", F.col("rank").cast("bigint").alias("rank"))


SQL["p4_top_scores"] = _P4 + "SELECT generated_id, candidate_id, score_row_id, s AS score, r AS rank FROM ranked WHERE r <= 5"


def _p2_links(spark, d):
    return table(spark, d, "candidates").select(
        "row_id",
        fields.repository(F.col("provenance.repository")).alias("repository"),
        fields.digest(F.col("provenance.source_document_sha256")).alias("document"),
    )


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links = _p2_links(spark, d).where("repository is not null and document is not null")
    edges = links.select(F.concat(F.lit("0:"), "repository").alias("a"), F.concat(F.lit("1:"), "document").alias("b"))
    pairs = groups.linked_pairs(groups.components(edges), "0:")
    return pairs.withColumnsRenamed({"name_a": "repository_a", "name_b": "repository_b"})


@query
def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return groups.assign_splits(_p2_links(spark, d), "row_id", ["repository", "document"], {"train": 0.8, "validation": 0.1, "test": 0.1})


def _targets(spark, d):
    return mixing.plan_targets(table(spark, d, "training_data_audit"))


def _records(spark, d):
    return mixing.usable_records(table(spark, d, "candidates"))


def _delivered(spark, d):
    """What the mixed records hold of every source of every plan."""
    return mixing.delivered(_targets(spark, d), mixing.mix(spark, _targets(spark, d), _records(spark, d)))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _delivered(spark, d).where("short").select("phase", "source_id")


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    s = mixing.shares(_delivered(spark, d))
    return s.select("audit_id", "phase", "source_id", "want", "given", F.round("target_share", 9).alias("target_share"), F.round("actual_share", 9).alias("actual_share"))


@query
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spark, _targets(spark, d), _records(spark, d))


CAPACITY = 2048


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def _packed(spark, d):
    sizes = tokens.encode(table(spark, d, "documents"), "doc_id", "text", with_ids=False)
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


@query
def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query
def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), "n_tokens", CAPACITY)


def _held_out(spark, d):
    rows = table(spark, d, "candidates").withColumn("split", fields.split_name(F.col("split")))
    ok = F.col("split").isin("validation", "test") & ~fields.is_blank(F.col("query")) & ~fields.is_blank(F.col("positive"))
    return rows.where(ok).select("row_id", "query", "positive", "split", "source_id")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), _held_out(spark, d))


def _overlap_base(spark, d):
    rows = table(spark, d, "candidates").withColumn("split", fields.split_name(F.col("split")))
    rows = rows.where(F.col("split").isNotNull() & ~fields.is_blank(F.col("query")) & ~fields.is_blank(F.col("positive")))
    rows = rows.withColumn("side", F.when(F.col("split") == "train", "a").otherwise("b"))
    return materialize(overlap.records(rows, 0.8), "records")


def _overlap_rows(spark, d):
    base = _overlap_base(spark, d)
    return overlap.row_pairs(overlap.class_pairs(base), base)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one train and one held-out row, the smaller row id first."""
    return _overlap_rows(spark, d).select(F.least("row_id_a", "row_id_b").alias("row_id_a"), F.greatest("row_id_a", "row_id_b").alias("row_id_b"))


@query
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rows with an equal or near train row, per split and source; ``mean_fraction`` averages
    the greatest overlap fraction of each such row."""
    rows = table(spark, d, "candidates").select(F.col("row_id").alias("row_id_b"), fields.split_name(F.col("split")).alias("split"), fields.source_name(F.col("source_id")).alias("source_id"))
    met = _overlap_rows(spark, d).groupBy("row_id_b").agg(F.count(F.lit(1)).alias("n"), F.max("fraction").alias("fraction"))
    held = rows.where(F.col("split").isin("validation", "test")).join(met, "row_id_b", "left")
    return held.groupBy("split", "source_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("n").alias("overlapping_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("train_links"), F.round(F.avg("fraction"), 6).alias("mean_fraction")
    )


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos")


@query
def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), "doc_id", "text")


@query
def p7_token_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 512 tokens of the usable records of each source, and the mix over them; plans in blocks."""
    c, records = table(spark, d, "candidates"), _records(spark, d)
    sizes = materialize(tokens.encode(c.select("row_id", F.concat_ws("\n", "query", "positive").alias("text")), "row_id", "text", with_ids=False), "sizes")
    blocks = materialize(mixing.token_blocks(records, sizes, 512), "blocks")
    made = mixing.mix(spark, mixing.targets_in_blocks(_targets(spark, d), records, sizes, 512), blocks.select("source_id", "row_id"))
    return made.withColumnRenamed("row_id", "block")


_NAMES = ["nlpai_ko_triplet", "webfaq_ko_pairs", "community_qa_ko", "statute_sections", "instruct_ko_mix", "news_topic_ko", "finance_qa_ko", "health_faq_ko", "sts_ko_pairs", "strategy_qa_ko", "longdoc_ko_train", "tidy_ko_train", "banking_intent_ko", "replay_multi"]
_P7 = (
    "WITH e AS (" + " UNION ALL ".join(f"SELECT audit_id, phase, max_repeats, '{s}' AS source_id, source_counts.{s} AS want FROM training_data_audit WHERE source_counts.{s} IS NOT NULL" for s in _NAMES)
    + r"""), r AS (SELECT regexp_replace(lower(trim(source_id)), '[ _-]+', '_', 'g') AS source_id, count(*) AS have FROM candidates
  WHERE lower(trim(split)) = 'train' AND regexp_matches(query, '[^\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]') AND regexp_matches(positive, '[^\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]') GROUP BY 1),
a AS (SELECT e.*, coalesce(have, 0) * max_repeats AS capacity FROM e LEFT JOIN r USING (source_id))
"""
)
SQL["p7_found"] = _P7 + "SELECT phase, source_id FROM a WHERE capacity < want"
SQL["p7_shares"] = _P7 + """, g AS (SELECT *, least(want, capacity) AS given FROM a)
SELECT audit_id, phase, source_id, want, given, round(want / nullif(sum(want) OVER (PARTITION BY audit_id), 0), 9) AS target_share,
  round(given / nullif(sum(given) OVER (PARTITION BY audit_id), 0), 9) AS actual_share FROM g"""

_P2 = r"""WITH RECURSIVE l AS (SELECT trim(provenance.repository) AS r, regexp_replace(lower(trim(provenance.source_document_sha256)), '^[a-z0-9_-]+:\s*', '') AS h FROM candidates),
k AS (SELECT DISTINCT r, h FROM l WHERE lower(r) NOT IN ('', 'unknown', 'n/a') AND h NOT IN ('', 'unknown', 'n/a', 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855', repeat('0', 64))),
e AS (SELECT DISTINCT x.r AS a, y.r AS b FROM k x JOIN k y ON x.h = y.h AND x.r <> y.r),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT a AS repository_a, b AS repository_b FROM reach WHERE a < b"""
SQL["p2_found"] = _P2

_P5 = r"""WITH c AS (SELECT row_id, regexp_replace(lower(positive_normalized), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\pP]+', '', 'g') AS t, provenance_json AS j
  FROM grounded_synthetic_query_factory WHERE positive_normalized IS NOT NULL),
f AS (SELECT c.row_id, string_agg(x.fullkey || '=' || json_extract_string(c.j, x.fullkey), chr(1) ORDER BY x.fullkey) AS j FROM c, json_tree(c.j) x WHERE x.type NOT IN ('OBJECT', 'ARRAY') GROUP BY 1),
g AS (SELECT c.row_id, min(c.row_id) OVER (PARTITION BY c.t, f.j) AS a, count(*) OVER (PARTITION BY c.t, f.j) AS n FROM c LEFT JOIN f USING (row_id))
"""
SQL["p5_found"] = _P5 + "SELECT a AS row_id_a, row_id AS row_id_b FROM g WHERE a <> row_id"
SQL["p5_copies"] = _P5 + "SELECT a AS representative, n AS copies FROM g WHERE a = row_id"
