"""Adapters: heterogeneous rows to ``(key, query, positive, negatives)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import hash_number, stable_hash
from pairloom.operators.numbering import number_in_order
from pairloom.sources.readers import wide_columns


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def triplets(df: DataFrame, key: str, query: str, positive: str, negatives: list[str]) -> DataFrame:
    """Three or more text columns."""
    return df.select(key, F.col(query).alias("query"), F.col(positive).alias("positive"), F.array(*negatives).alias("negatives"))


def wide_negatives(df: DataFrame, key: str, query: str, positive: str, prefix: str = "negative") -> DataFrame:
    """``negative_1 … negative_n`` columns, gathered in numeric order; nulls left out."""
    found = F.array(*wide_columns(df.columns, prefix))
    return df.select(key, F.col(query).alias("query"), F.col(positive).alias("positive"), F.filter(found, lambda x: x.isNotNull()).alias("negatives"))


def listed(df: DataFrame, key: str, query: str, positives: str, negatives: str) -> DataFrame:
    """Lists of texts: the first positive counts, an empty list gives a null positive."""
    return df.select(key, F.col(query).alias("query"), F.try_element_at(positives, F.lit(1)).alias("positive"), F.coalesce(F.col(negatives), _no_strings()).alias("negatives"))


def labelled(df: DataFrame, key: str, text: str, label: str, names: list[str]) -> DataFrame:
    """Classification rows: the label's name is the positive, all other names are negatives."""
    all_names = F.array(*[F.lit(n) for n in names])
    positive = F.try_element_at(all_names, (F.col(label) + 1).cast("int"))
    return df.select(key, F.col(text).alias("query"), positive.alias("positive"), F.array_except(all_names, F.array(positive)).alias("negatives"))


def scored_pairs(df: DataFrame, key: str, first: str, second: str, score: str, at_least: float, at_most: float) -> DataFrame:
    """Similarity pairs: rows at or above ``at_least`` are positives; their negative is taken
    from the pool of second texts at or below ``at_most``, by the hash of the query."""
    pool = dense_order(df.where(F.col(score) <= at_most).select(F.col(key).alias("__key"), F.col(second).alias("negative")).withColumn("__one", F.lit(1)), "__key").select("slot", "negative")
    size = pool.agg(F.count(F.lit(1)).alias("n"))
    good = df.where(F.col(score) >= at_least).select(key, F.col(first).alias("query"), F.col(second).alias("positive"))
    aimed = good.join(F.broadcast(size)).where("n > 0").withColumn("slot", F.expr("cast(pmod(conv(substr(sha2(query, 256), 1, 15), 16, 10), n) as bigint)"))
    return aimed.join(pool, "slot").select(key, "query", "positive", F.array("negative").alias("negatives"))


def cyclic_negatives(df: DataFrame, key: str, query: str, context: str, k: int) -> DataFrame:
    """Question/context rows: ``k`` other contexts as negatives, in turn from a hashed start.

    Contexts are distinct texts in order of first appearance (smallest key). A pool of ``k``
    contexts or fewer gives no rows.
    """
    rows = df.where(F.col(query).isNotNull() & F.col(context).isNotNull()).select(F.col(key).alias("__k"), F.col(query).alias("query"), F.col(context).alias("positive"))
    contexts = rows.groupBy("positive").agg(F.min("__k").alias("first")).withColumn("__one", F.lit(1))
    pool = dense_order(contexts, "first").select("slot", F.col("positive").alias("text"))
    size = pool.agg(F.count(F.lit(1)).alias("n"))
    start = rows.join(F.broadcast(size)).where(F.col("n") > k).withColumn("start", F.expr("cast(pmod(conv(substr(sha2(query, 256), 1, 15), 16, 10), n) as bigint)"))
    reach = start.select("__k", "query", "positive", "n", F.posexplode(F.sequence(F.col("start"), F.col("start") + k)).alias("offset", "at"))
    met = reach.withColumn("slot", F.col("at") % F.col("n")).join(pool, "slot").where(F.col("text") != F.col("positive"))
    found = met.groupBy("__k").agg(F.first("query").alias("query"), F.first("positive").alias("positive"), F.sort_array(F.collect_list(F.struct("offset", "text"))).alias("t"))
    return found.select(F.col("__k").alias(key), "query", "positive", F.transform(F.slice("t", 1, k), lambda x: x["text"]).alias("negatives"))


def dense_order(df: DataFrame, key: str) -> DataFrame:
    """Add ``slot`` 0,1,2,… in order of ``key``."""
    return number_in_order(df, [], [F.col(key)], "slot")


def beir_pairs(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, above: float = 0) -> DataFrame:
    """``(query_id, query, positive, negatives)`` from judgements: scores above ``above`` are
    positives (one, chosen by hash), the others negatives. Title and body are joined by a blank."""
    text = F.when(F.length(F.trim("title")) > 0, F.concat_ws(" ", "title", "text")).otherwise(F.col("text"))
    docs = corpus.select("corpus_id", text.alias("doc"))
    judged = qrels.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(docs, "corpus_id")
    sides = judged.groupBy("query_id", "query").agg(
        F.sort_array(F.collect_list(F.when(F.col("score") > above, F.struct("corpus_id", "doc")))).alias("good"),
        F.sort_array(F.collect_list(F.when(F.col("score") <= above, F.struct("corpus_id", "doc")))).alias("bad"),
    )
    pick = F.expr("cast(pmod(conv(substr(sha2(cast(query_id as string), 256), 1, 15), 16, 10), size(good)) as int)")
    return sides.where(F.size("good") > 0).select("query_id", "query", F.get("good", pick)["doc"].alias("positive"), F.transform("bad", lambda x: x["doc"]).alias("negatives"))


def noise_documents(spark: SparkSession, documents: int, most: float, protocol: str) -> DataFrame:
    """``(noise_id, text)``: ``ceil(documents x most)`` distinct conversational texts."""
    # Openings of the noise documents.
    openings = ["Thanks, noted. ", "Please hold on. ", "System notice: ", "As discussed, "]
    n = -int(-documents * most // 1)
    heads = F.array(*[F.lit(o) for o in openings])
    return spark.range(n).select(
        F.col("id").alias("noise_id"),
        F.concat(F.get(heads, (F.col("id") % 4).cast("int")), F.substring(F.sha2(F.concat(F.lit(protocol + ":"), F.col("id").cast("string")), 256), 1, 16)).alias("text"),
    )


REGISTRY: dict[str, Callable] = {
    "triplet": triplets, "wide_negatives": wide_negatives, "lists": listed, "classification_label": labelled,
    "sts_pairs": scored_pairs, "qa_context": cyclic_negatives, "beir_join": beir_pairs,
}


def source(name: str) -> Callable:
    """The adapter of that name; an unknown name is an error."""
    if name not in REGISTRY:
        raise KeyError(f"unknown adapter {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]


def shuffled(df: DataFrame, seed: str, key: str) -> DataFrame:
    """A repeatable order: by the hash of seed and key."""
    return df.orderBy(stable_hash(F.lit(seed), F.col(key)), key)


def chosen(values: Column, by: Column) -> Column:
    """One element of an array, by the hash of ``by``."""
    at = (hash_number(F.sha2(by, 256), 15) % F.size(values)).cast("int")
    return F.get(values, at)
