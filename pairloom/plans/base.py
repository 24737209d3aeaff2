"""Registry of queries and shared views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text as tx

QUERIES: dict = {}
SQL: dict = {}

S = tx.SPACE_CLASS
#: SQL spellings of the text functions.
SQL_SQUASH = "regexp_replace(regexp_replace({0}, '[" + S + "]+', ' ', 'g'), '^ | $', '', 'g')"
SQL_STRIP = "regexp_replace({0}, '^[" + S + "]+|[" + S + "]+$', '', 'g')"


def squash_sql(x: str) -> str:
    return SQL_SQUASH.replace("{0}", x)


def strip_sql(x: str) -> str:
    return SQL_STRIP.replace("{0}", x)


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if it has one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SOURCE_SQL = f"regexp_replace(lower({strip_sql('source_id')}), '[{S}_-]+', '_', 'g')"
SPLIT_SQL = (
    f"CASE lower({strip_sql('split')}) WHEN 'train' THEN 'train' WHEN 'validation' THEN 'validation' WHEN 'dev' THEN 'validation' "
    "WHEN 'valid' THEN 'validation' WHEN 'test' THEN 'test' END"
)
BODY_SQL = (
    f"CASE WHEN starts_with({strip_sql('query')}, 'Instruct:') AND contains(query, 'Query:') "
    f"THEN {strip_sql('string_split(query, ' + chr(39) + 'Query:' + chr(39) + ')[-1]')} ELSE {strip_sql('query')} END"
)
#: SQL of the pair view: one row per candidate, texts squashed, one spelling of source and split.
PAIRS_SQL = f"""pairs AS (SELECT row_id, {SOURCE_SQL} AS source_id, {SPLIT_SQL} AS split, {squash_sql(BODY_SQL)} AS query, {squash_sql('query')} AS full_query,
  {squash_sql('positive')} AS positive, provenance.repository AS repository, provenance.source_document_sha256 AS document FROM candidates)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """The canonical pair table made from ``candidates``."""
    c = table(spark, d, "candidates")
    split = F.lower(tx.strip(F.col("split")))
    return c.select(
        "row_id",
        F.regexp_replace(F.lower(tx.strip(F.col("source_id"))), f"[{S}_-]+", "_").alias("source_id"),
        F.when(split == "train", "train").when(split.isin("validation", "dev", "valid"), "validation").when(split == "test", "test").alias("split"),
        tx.squash(tx.semantic_body(F.col("query"))).alias("query"),
        tx.squash(F.col("query")).alias("full_query"),
        tx.squash(F.col("positive")).alias("positive"),
        F.col("provenance.repository").alias("repository"),
        F.col("provenance.source_document_sha256").alias("document"),
    )


def rounded(c, n: int = 6):
    return F.round(c, n)
