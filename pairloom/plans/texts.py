"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.plans.base import BODY_SQL, PAIRS_SQL, S, pairs, query, squash_sql, strip_sql, table


@query(f"""SELECT doc_id, sha256({strip_sql("replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10))")}) AS sha
FROM documents""")
def normalize_nfc_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.nfc_text("text"), 256).alias("sha"))


@query()
def normalize_hash_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.benchmark_text("text"), 256).alias("sha"))


@query()
def normalize_compat_pairs(spark, d):
    return table(spark, d, "candidates").select("row_id", tx.compat_text("query").alias("query"), tx.compat_text("positive").alias("positive"))


@query(f"""SELECT doc_id, sha256({squash_sql('text')}) AS sha, length({squash_sql('text')}) AS chars FROM documents""")
def squash_hash_documents(spark, d):
    t = tx.squash(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), F.length(t).cast("bigint").alias("chars"))


@query(f"""WITH c AS (SELECT row_id, query, starts_with({strip_sql('query')}, 'Instruct:') AND contains(query, 'Query:') AS inl, strpos(query, chr(10) || 'Query:') AS pos, string_split(query, 'Query:')[-1] AS last FROM candidates)
SELECT row_id, {BODY_SQL} AS body, CASE WHEN pos > 0 THEN {strip_sql('substr(query, 1, pos - 1)')} WHEN inl THEN {strip_sql('substr(query, 1, length(query) - length(last) - 6)')} ELSE 'unprompted' END AS instruction,
  CASE WHEN pos > 0 THEN {strip_sql('substr(query, pos + 7)')} WHEN inl THEN {strip_sql('last')} ELSE {strip_sql('query')} END AS profile_body FROM c""")
def query_body_split(spark, d):
    head, body = tx.profile_split(F.col("query"))
    return table(spark, d, "candidates").select("row_id", tx.semantic_body(F.col("query")).alias("body"), head.alias("instruction"), body.alias("profile_body"))


@query(f"""SELECT row_id, CASE WHEN starts_with({strip_sql('query')}, 'Instruct:') THEN query
  ELSE 'Instruct: Find the passage that answers the question' || chr(10) || 'Query: ' || query END AS query FROM candidates""")
def instructed_queries(spark, d):
    return table(spark, d, "candidates").select("row_id", tx.instructed(F.col("query"), "Find the passage that answers the question").alias("query"))


@query(f"""SELECT row_id, {BODY_SQL} AS body FROM candidates
WHERE starts_with({strip_sql('query')}, 'Instruct:') AND contains(query, 'Query:') AND length({BODY_SQL}) > 0""")
def stored_instruction_bodies(spark, d):
    c = table(spark, d, "candidates")
    ok = tx.strip(F.col("query")).startswith("Instruct:") & F.col("query").contains("Query:") & (F.length(tx.semantic_body(F.col("query"))) > 0)
    return c.where(ok).select("row_id", tx.stored_instruction_stripped(F.col("query")).alias("body"))


_STYLE = "CASE WHEN length(query) - length(replace(query, ',', '')) >= 2 OR length(query) - length(replace(query, '，', '')) >= 2 THEN 'comma_keyword_list' WHEN " + " OR ".join(
    f"contains(query, '{w}')" for w in tx.QUESTION_MARKS
) + " THEN 'natural_question' WHEN length(query) <= 40 THEN 'short_search_or_title' ELSE 'long_statement_or_search' END"


@query(f"WITH {PAIRS_SQL} SELECT source_id, {_STYLE} AS style, count(*) AS n FROM pairs WHERE query IS NOT NULL GROUP BY 1, 2")
def query_style_counts(spark, d):
    return pairs(spark, d).where("query is not null").groupBy("source_id", tx.query_style(F.col("query")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, sha256('seed-7' || chr(0) || source || chr(0) || doc_id) AS key,
  'doc-' || substr(sha256(source || chr(0) || doc_id), 1, 24) AS stable_id,
  CAST(('0x' || substr(sha256('seed-7' || chr(0) || source || chr(0) || doc_id), 1, 15))::UBIGINT AS BIGINT) AS number
FROM documents WHERE source IS NOT NULL""")
def stable_hash_keys(spark, d):
    key = tx.stable_hash(F.lit("seed-7"), F.col("source"), F.col("doc_id"))
    return table(spark, d, "documents").where("source is not null").select(
        "doc_id", key.alias("key"), tx.stable_id("doc", F.col("source"), F.col("doc_id")).alias("stable_id"), tx.hash_number(key, 15).cast("bigint").alias("number")
    )


@query("""SELECT row_id, sha256(concat_ws(chr(1), coalesce(id, ''), coalesce(query, ''), coalesce(positive, ''), coalesce(pair_type, ''))) AS row_sha256,
  sha256(query) AS query_sha256, sha256(positive) AS positive_sha256 FROM candidates""")
def row_digests(spark, d):
    parts = [F.coalesce(c, F.lit("")) for c in ("id", "query", "positive", "pair_type")]
    return table(spark, d, "candidates").select(
        "row_id", F.sha2(F.concat_ws("\x01", *parts), 256).alias("row_sha256"), F.sha2("query", 256).alias("query_sha256"), F.sha2("positive", 256).alias("positive_sha256")
    )


@query(f"""SELECT doc_id, CASE WHEN length(text) > 400 THEN regexp_replace(substr(text, 1, 400), '[{S}]+$', '') ELSE text END AS text, length(text) > 400 AS was_cut
FROM documents WHERE text IS NOT NULL""")
def capped_source_text(spark, d):
    t, cut = tx.capped_text(F.col("text"), 400)
    return table(spark, d, "documents").where("text is not null").select("doc_id", t.alias("text"), cut.alias("was_cut"))


@query(f"""SELECT doc_id, coalesce(nullif({strip_sql('title')}, ''), nullif({strip_sql("regexp_extract(text, '(?m)^# +(.+)$', 1)")}, ''), nullif({strip_sql('substr(text, 1, 160)')}, '')) AS title,
  coalesce(nullif({strip_sql('lang')}, ''), 'unknown') AS lang FROM documents""")
def source_titles(spark, d):
    head = F.regexp_extract("text", r"(?m)^# +(.+)$", 1)
    return table(spark, d, "documents").select(
        "doc_id", tx.first_present(F.col("title"), head, F.substring("text", 1, 160)).alias("title"), F.coalesce(tx.first_present(F.col("lang")), F.lit("unknown")).alias("lang")
    )


_DATE_KEYS = ["시행일자", "공포일자", "date", "effective_date"]


@query(
    "SELECT row_id, coalesce("
    + ", ".join(f"nullif({strip_sql(f'provenance.metadata[{chr(39)}{k}{chr(39)}]')}, '')" for k in _DATE_KEYS)
    + ") AS source_date FROM candidates"
)
def source_dates(spark, d):
    return table(spark, d, "candidates").select("row_id", tx.first_present(*[F.col("provenance.metadata").getItem(k) for k in _DATE_KEYS]).alias("source_date"))


@query(f"""WITH {PAIRS_SQL}, p AS (SELECT * FROM pairs WHERE query IS NOT NULL AND positive IS NOT NULL)
SELECT row_id, greatest(length(query), length(positive)) AS length_proxy FROM p""")
def row_length_proxy(spark, d):
    return pairs(spark, d).where("query is not null and positive is not null").select(
        "row_id", tx.length_proxy(F.col("query"), F.col("positive"), F.array().cast("array<string>")).cast("bigint").alias("length_proxy")
    )


@query(f"""WITH x AS (SELECT row_id, lower({squash_sql('query')}) AS t FROM candidates WHERE query IS NOT NULL),
y AS (SELECT row_id, list_filter(regexp_extract_all(t, '[0-9a-z가-힣]+'), lambda w: length(w) >= 2) AS w, replace(t, ' ', '') AS s FROM x)
SELECT row_id, CAST(len(list_distinct(w)) AS BIGINT) AS words,
  CAST(len(list_distinct(CASE WHEN length(s) >= 2 THEN list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) ELSE [] END)) AS BIGINT) AS pairs FROM y""")
def lexical_feature_counts(spark, d):
    f = tx.lexical_features(tx.squash(F.col("query")))
    x = table(spark, d, "candidates").where("query is not null").select("row_id", f.alias("f"))
    n = lambda p: F.size(F.filter("f", lambda v: v.startswith(p))).cast("bigint")
    return x.select("row_id", n("w:").alias("words"), n("c2:").alias("pairs"))


@query(f"""WITH x AS (SELECT row_id, {squash_sql('positive')} AS t FROM candidates WHERE positive IS NOT NULL)
SELECT row_id, CAST(CASE WHEN length(t) >= 5 THEN len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))) ELSE 0 END AS BIGINT) AS shingles FROM x""")
def shingle_counts(spark, d):
    x = table(spark, d, "candidates").where("positive is not null").select("row_id", F.size(tx.shingles(tx.squash(F.col("positive")), 5)).cast("bigint").alias("shingles"))
    return x


@query(f"""WITH {PAIRS_SQL}, x AS (SELECT row_id, replace(query, ' ', '') AS q, replace(positive, ' ', '') AS t FROM pairs),
n AS (SELECT row_id, max(n) AS n FROM x, range(1, 2000) a(n) WHERE n <= length(q) AND len(list_filter(range(1, length(q) - n + 2), lambda i: contains(t, substr(q, i, n)))) > 0 GROUP BY 1)
SELECT row_id, CASE WHEN q IS NULL OR t IS NULL THEN NULL WHEN length(q) = 0 THEN 0.0 ELSE round(coalesce(n.n, 0) / length(q), 6) END AS coverage FROM x LEFT JOIN n USING (row_id)""")
def copy_coverage(spark, d):
    return pairs(spark, d).select("row_id", F.round(tx.copied_share("query", "positive"), 6).alias("coverage"))


@query("""SELECT row_id, json_extract_string(provenance_json, '$.metadata.component') AS component, json_extract_string(provenance_json, '$.path') AS path,
  coalesce(json_extract_string(provenance_json, '$.section_heading'), json_extract_string(provenance_json, '$.path')) AS locator FROM grounded_synthetic_query_factory""")
def nested_values(spark, d):
    g = table(spark, d, "grounded_synthetic_query_factory").select("row_id", F.try_parse_json("provenance_json").alias("v"))
    at = lambda p: F.try_variant_get("v", p, "string")
    return g.select("row_id", at("$.metadata.component").alias("component"), at("$.path").alias("path"), F.coalesce(at("$.section_heading"), at("$.path")).alias("locator"))


@query("""SELECT g.row_id, replace(j.fullkey, '"', '') AS path, json_extract_string(g.provenance_json, j.fullkey) AS value
FROM grounded_synthetic_query_factory g, json_tree(g.provenance_json) j WHERE j.type = 'VARCHAR'""")
def scalar_text_values(spark, d):
    """Every string anywhere in a JSON document, with its path (objects and arrays, any depth)."""
    from pairloom.sources.nested import scalar_strings

    return scalar_strings(table(spark, d, "grounded_synthetic_query_factory"), "row_id", "provenance_json")


@query("""WITH y AS (SELECT score_row_id, raw_yes_logit - raw_no_logit AS d FROM cache_qwen3_reranker_scores
  WHERE raw_no_logit IS NOT NULL AND raw_yes_logit IS NOT NULL AND isfinite(raw_no_logit) AND isfinite(raw_yes_logit))
SELECT score_row_id, round(CASE WHEN d >= 0 THEN 1 / (1 + exp(-d)) ELSE exp(d) / (1 + exp(d)) END, 6) AS p FROM y""")
def yes_probabilities(spark, d):
    s = table(spark, d, "cache_qwen3_reranker_scores").where(tx.is_finite(F.col("raw_no_logit")) & tx.is_finite(F.col("raw_yes_logit")))
    return s.select("score_row_id", F.round(tx.yes_probability(F.col("raw_no_logit"), F.col("raw_yes_logit")), 6).alias("p"))


@query(f"""WITH {PAIRS_SQL} SELECT row_id, 'user' AS role, query AS query_content, positive AS positive_content, 1 AS positives FROM pairs
WHERE query IS NOT NULL AND positive IS NOT NULL""")
def strict_rows(spark, d):
    p = pairs(spark, d).where("query is not null and positive is not null")
    r = p.select("row_id", tx.chat_row(F.col("query"), F.col("positive"), F.array().cast("array<string>")).alias("r"))
    return r.select(
        "row_id", F.col("r.messages")[0]["role"].alias("role"), F.col("r.messages")[0]["content"].alias("query_content"),
        F.col("r.positive_messages")[0][0]["content"].alias("positive_content"), F.size("r.positive_messages").alias("positives"),
    )


@query("""WITH n AS (SELECT CAST(ceil(count(*) * 0.05) AS BIGINT) AS n FROM documents)
SELECT i AS noise_id, CASE i % 4 WHEN 0 THEN 'Thanks, noted. ' WHEN 1 THEN 'Please hold on. ' WHEN 2 THEN 'System notice: ' ELSE 'As discussed, ' END
  || substr(sha256('noise-v1:' || i), 1, 16) AS text FROM n, range(n) r(i)""")
def noise_documents(spark, d):
    from pairloom.sources.adapters import noise_documents as make

    return make(spark, table(spark, d, "documents").count(), 0.05, "noise-v1")


@query("""SELECT DISTINCT source, regexp_replace(regexp_replace(source || ' v1/2', '[^0-9A-Za-z._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS component FROM documents WHERE source IS NOT NULL""")
def safe_components(spark, d):
    return table(spark, d, "documents").where("source is not null").select("source", tx.safe_component(F.concat("source", F.lit(" v1/2"))).alias("component")).distinct()


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line,
    generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}} +[^ ]') AS is_head FROM l),
n AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
SELECT doc_id, CAST(section AS BIGINT) AS section, max(CASE WHEN is_head THEN {strip_sql("regexp_replace(line, '^#+ +| *#*$', '', 'g')")} END) AS heading,
  CAST(coalesce(sum(CASE WHEN NOT is_head THEN length(line) END), 0) AS BIGINT) AS body_chars FROM n GROUP BY 1, 2""")
def sections_from_markup(spark, d):
    from pairloom.sources.markup import heading_sections

    s = heading_sections(table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", F.col("section").cast("bigint").alias("section"), "heading", F.col("body_chars").cast("bigint").alias("body_chars"))
