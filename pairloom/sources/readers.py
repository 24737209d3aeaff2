"""Scans: strict and loose JSON lines, aligned files, digest lists, BEIR triples, run summaries, vectors."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STRICT_ROW = (
    "messages array<struct<role:string,content:string>>, positive_messages array<array<struct<role:string,content:string>>>, "
    "negative_messages array<array<struct<role:string,content:string>>>, teacher_scores array<double>"
)
DIGEST = "^[0-9a-f]{64}$"


def strict_json_lines(spark: SparkSession, path: str, schema: str | StructType = STRICT_ROW) -> DataFrame:
    """Rows of a JSON-lines file; a blank line, a broken line or an unknown key fails the read."""
    known = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    lines = spark.read.text(path)
    keys = F.json_object_keys("value")
    good = (F.trim("value") != "") & keys.isNotNull() & F.forall(keys, lambda k: k.isin(known))
    checked = lines.select(F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.substring("value", 1, 80)))).alias("value"))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value variant)`` of JSON-lines files; a broken line has a null value."""
    raw = numbered_lines(spark, path)
    return raw.select("file", "line", F.try_parse_json("value").alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)`` with lines counted from 1 in each file.

    Partitions of one file are read in order: line numbers come from the sizes of the
    partitions before, without moving the lines.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return raw.join(starts.select("file", "block", "first", "skip"), ["file", "block"]).select("file", (F.col("skip") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def aligned(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Rows of two tables with the same ``index``; a row without partner is an error."""
    a = left.withColumn("__a", F.lit(True))
    b = right.withColumn("__b", F.lit(True))
    joined = a.join(b, index, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return joined.where(F.when(both, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("row without partner: "), F.col(index).cast("string"))))).drop("__a", "__b")


def misaligned(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """``(index, side)`` of rows that only one table has."""
    a, b = left.select(index).withColumn("__a", F.lit(1)), right.select(index).withColumn("__b", F.lit(1))
    return a.join(b, index, "full").where("__a is null or __b is null").select(index, F.when(F.col("__b").isNull(), "left").otherwise("right").alias("side"))


def digest_lines(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """``(file, sha256)`` of (gzipped) digest files; a line that is no digest, or out of order, is an error."""
    rows = numbered_lines(spark, path)
    ok = F.col("value").rlike(DIGEST)
    if ordered:
        previous = F.lag("value").over(Window.partitionBy("file").orderBy("line"))
        rows = rows.withColumn("previous", previous)
        ok = ok & (F.col("previous").isNull() | (F.col("previous") < F.col("value")))
    return rows.select("file", F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad digest line: "), F.col("value")))).alias("sha256"))


def blocklist_folder(spark: SparkSession, root: str) -> DataFrame:
    """``(protocol, task, kind, sha256)`` of ``<protocol>/<task>/…/<kind>.sha256.gz`` below ``root``."""
    rows = digest_lines(spark, f"{root}/*/*/*")
    tail = F.regexp_extract("file", r"([^/]+)/([^/]+)/([^/]+)\.sha256(?:\.gz)?$", 0)
    part = lambda i: F.regexp_extract(tail, r"([^/]+)/([^/]+)/([^/]+)\.sha256(?:\.gz)?$", i)
    return rows.select(part(1).alias("protocol"), part(2).alias("task"), part(3).alias("kind"), "sha256")


def markdown_corpus(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """``(path, text)`` of all files below ``root`` that match, one row per file."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def in_shard(key: Column, count: int, index: int) -> Column:
    """Deterministic sharding: the first 8 hex digits of the key's SHA-256 modulo ``count``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % count) == index


def beir(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, corpus and relevance judgements of a BEIR folder, with snake-case names."""
    queries = spark.read.json(f"{root}/queries.jsonl").withColumnRenamed("_id", "query_id")
    corpus = spark.read.json(f"{root}/corpus.jsonl").withColumnRenamed("_id", "corpus_id")
    qrels = spark.read.option("sep", "\t").option("header", True).csv(f"{root}/qrels/*.tsv")
    return queries, corpus, qrels.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"), F.col("score").cast("int").alias("score"))


def latest_summaries(spark: SparkSession, root: str) -> DataFrame:
    """The newest ``summary.json`` below ``root`` of each model (largest creation time)."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").option("multiLine", True).json(root)
    return rows.groupBy("model").agg(F.max_by(F.struct(*rows.columns), "created_at_utc").alias("s")).select("s.*")


def json_object(path: str) -> dict:
    """A small configuration object; a repeated key is an error."""

    def unique(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("repeated key")
        return out

    with open(path, encoding="utf-8") as f:
        found = json.load(f, object_pairs_hook=unique)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def vectors(spark: SparkSession, path: str, key: str, vector: str, fingerprint: str | None = None) -> DataFrame:
    """``(key, vector array<float>)``; with a fingerprint, only a cache written under it is read."""
    return spark.read.parquet(f"{path}/{fingerprint}" if fingerprint else path).select(key, F.col(vector).cast("array<float>").alias(vector))


def fingerprint(**parts: object) -> str:
    """Order-free digest of what a cache depends on."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def staged(df: DataFrame, repository: str, rank: str) -> DataFrame:
    """Rows of one repository in stable rank order (the scan of a staged candidate table)."""
    return df.where(F.col("repository") == repository).orderBy(rank)


def wide_columns(columns: list[str], prefix: str) -> list[str]:
    """``prefix_<n>`` columns in numeric order."""
    found = [(int(m.group(1)), c) for c in columns if (m := re.fullmatch(re.escape(prefix) + r"_(\d+)", c))]
    return [c for _, c in sorted(found)]
