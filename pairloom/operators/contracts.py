"""Contracts over tables: plans, score files, judgements, envelopes, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import first_present
from pairloom.operators.cleaning import secret_like
from pairloom.session import materialize
from pairloom.sources.nested import scalar_strings


def plan_problems(plans: DataFrame, key: str, rows: str, counts: str, observed: DataFrame, source: str, have: str) -> DataFrame:
    """``(key, rule, source)``: caps that do not add up, negative caps, caps above what is there."""
    each = plans.select(key, rows, F.explode(F.from_json(F.to_json(counts), "map<string,bigint>")).alias("__s", "__c"))
    total = each.groupBy(key, rows).agg(F.sum("__c").alias("__t")).where(F.col("__t") != F.col(rows)).select(key, F.lit("sum_differs").alias("rule"), F.lit(None).cast("string").alias("source"))
    seen = observed.select(F.col(source).alias("__s"), F.col(have).alias("__h"))
    j = each.join(seen, "__s", "left")
    rule = F.when(F.col("__c") < 0, "negative").when(F.coalesce("__h", F.lit(0)) == 0, "unknown_source").when(F.col("__c") > F.col("__h"), "above_observed")
    return total.unionByName(j.select(key, rule.alias("rule"), F.col("__s").alias("source")).where("rule is not null"))


def pool_problems(df: DataFrame, group: str, item: str, is_positive: Column, score: str) -> DataFrame:
    """``(group, rule)``: not exactly one positive, repeated items, scores that are missing or no numbers."""
    g = df.groupBy(group).agg(
        F.count_if(is_positive).alias("p"), F.count(F.lit(1)).alias("n"), F.count_distinct(item).alias("d"), F.count_if(F.col(score).isNull() | F.isnan(F.col(score))).alias("bad")
    )
    rules = F.array(F.when(F.col("p") != 1, "positives"), F.when(F.col("d") != F.col("n"), "repeated_item"), F.when(F.col("bad") > 0, "bad_score"))
    return g.select(group, F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def judgement_problems(queries: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row per rule with how often it is broken: unknown ids, unjudged queries, repeated judgements."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    repeated = qrels.groupBy("query_id", "corpus_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return (
        one("unknown_query", qrels.join(queries, "query_id", "left_anti")).unionByName(one("unknown_document", qrels.join(corpus, "corpus_id", "left_anti")))
        .unionByName(one("unjudged_query", queries.join(qrels, "query_id", "left_anti"))).unionByName(one("repeated_judgement", repeated))
    )


def whole_json(c: Column) -> Column:
    """The text as one JSON value; null if anything follows it (the parser itself stops at the first value)."""
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    at = lambda i: F.try_variant_get(v, f"$[{i}]", "variant")
    return F.when(at(1).isNull(), at(0))


def response_object(c: Column) -> Column:
    """The JSON object of a model response: bare, in a code fence, or as text in an envelope field; null otherwise."""
    fenced = F.regexp_extract(c, r"(?s)^\s*```(?:json)?\s*(\{.*\})\s*```\s*$", 1)
    outer = whole_json(c)
    inner = F.coalesce(*[F.try_variant_get(outer, p, "string") for p in ("$.response", "$.output_text", "$.choices[0].message.content")])
    inner_fenced = F.regexp_extract(inner, r"(?s)^\s*```(?:json)?\s*(\{.*\})\s*```\s*$", 1)
    found = F.coalesce(whole_json(F.nullif(inner_fenced, F.lit(""))), whole_json(inner), whole_json(F.nullif(fenced, F.lit(""))), outer)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def locators(*candidates: Column, fallback: Column) -> Column:
    """Distinct candidates that are not blank, in order; the fallback if there are none."""
    found = F.array_distinct(F.filter(F.array(*[first_present(c) for c in candidates]), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback))


def digests_in(c: Column) -> Column:
    """All distinct 64-digit hex digests anywhere in a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("(?<![0-9a-f])[0-9a-f]{64}(?![0-9a-f])"), 0))


def config_problems(df: DataFrame, key: str, column: str, sensitive: list[str]) -> DataFrame:
    """``(key, path, rule)`` of nested values that must not be published: sensitive field names and secret-like values."""
    named = F.lit(False)
    for s in sensitive:
        named = named | F.lower(F.substring_index("path", ".", -1)).contains(s)
    x = scalar_strings(df, key, column)
    return x.select(key, "path", F.coalesce(F.when(named, "sensitive_key"), secret_like(F.col("value"))).alias("rule")).where("rule is not null")


def ancestry(df: DataFrame, node: str, parent: str) -> DataFrame:
    """``(node, root, depth)`` by pointer doubling; nodes on or below a cycle have a null root.

    Each round joins the table with itself on the pointer and doubles the distance, so
    ``log2(depth)`` rounds do. A chain has nodes at every depth, so some reach their root in every
    round; once none does, only cycles are left.
    """
    at = df.select(F.col(node).alias("n"), F.col(parent).alias("p"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("bigint").alias("d"))
    roots = at.where("p is null").select(F.col("n").alias("root"))
    size = None
    while True:
        at = materialize(at, "lineage")
        up = at.select(F.col("n").alias("__n"), F.col("p").alias("__p"), F.col("d").alias("__d"))
        at = at.join(up, F.col("p") == F.col("__n"), "left").select("n", F.when(F.col("__p").isNull(), F.col("p")).otherwise(F.col("__p")).alias("p"), (F.col("d") + F.when(F.col("__p").isNull(), 0).otherwise(F.col("__d"))).alias("d"))
        moving = at.join(roots, F.col("p") == F.col("root"), "left_anti").where("p is not null").count()
        if moving in (0, size):
            break
        size = moving
    top = at.join(roots, F.coalesce("p", "n") == F.col("root"), "left")
    return top.select(F.col("n").alias(node), "root", F.when(F.col("root").isNotNull(), F.col("d")).alias("depth"))


def selected_tasks(tasks: DataFrame, wanted: list[str], columns: list[str]) -> DataFrame:
    """Tasks matched by any of the columns; a wanted name that matches nothing is an error."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).isin(wanted)
    found = tasks.where(hit)
    names = {r[c] for r in found.select(*columns).collect() for c in columns}
    if missing := [w for w in wanted if w not in names]:
        raise ValueError(f"no such task: {missing}")
    return found


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows per group without replacement, the first in the hash order of seed and key."""
    from pairloom.functions.text import stable_hash

    w = Window.partitionBy(group).orderBy(stable_hash(F.lit(seed), F.col(key)), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def rejections(base: DataFrame, keys: list[str], needed: dict[str, DataFrame]) -> DataFrame:
    """Every row of ``base`` with the first reason it cannot compete: a missing part, or a part without a number.

    ``needed`` maps a part's name to its table ``(keys…, value)``; rows with all parts get
    a null reason.
    """
    out, reason = base.select(*keys), F.lit(None).cast("string")
    for name, part in reversed(needed.items()):
        cols = [F.col(k).alias(f"__{name}{i}") for i, k in enumerate(keys)]
        p = part.select(*cols, F.col("value").alias(f"__{name}"), F.lit(True).alias(f"__{name}_there"))
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"__{name}{i}"))
        out = out.join(p, cond, "left")
        v = F.col(f"__{name}")
        reason = F.when(F.col(f"__{name}_there").isNull(), f"missing_{name}").when(v.isNull() | F.isnan(v), f"not_finite_{name}").otherwise(reason)
    return out.select(*keys, reason.alias("reason"))


def unique_pairs(df: DataFrame, key: str, pair: list[str]) -> DataFrame:
    """Rows with a pair not seen before (by key); an id that stands for two pairs is an error."""
    whole = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in pair]), 256)
    w = Window.partitionBy(key)
    same = df.withColumn("__p", whole).withColumn("__lo", F.min("__p").over(w)).withColumn("__hi", F.max("__p").over(w))
    ok = F.when(F.col("__lo") == F.col("__hi"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("id with two pairs: "), F.col(key).cast("string"))))
    first = Window.partitionBy("__p").orderBy(key)
    return same.where(ok).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__p", "__lo", "__hi", "__n")


def matched_responses(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """``(key, requests, responses, state)`` of every id on either side of an offline run.

    ``matched``, ``missing_response``, ``unexpected_response``, and ``repeated_request`` or
    ``repeated_response`` for an id that one side has more than once. Null ids are left out.
    """
    count = lambda t, n: t.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n))
    j = count(requests, "requests").join(count(responses, "responses"), key, "full").fillna(0, ["requests", "responses"])
    state = (
        F.when(F.col("requests") > 1, "repeated_request").when(F.col("requests") == 0, "unexpected_response").when(F.col("responses") == 0, "missing_response")
        .when(F.col("responses") > 1, "repeated_response").otherwise("matched")
    )
    return j.withColumn("state", state)
