"""Cleaning with reason codes, exact deduplication, source caps and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import stable_hash
from pairloom.operators.numbering import number_in_order

HANGUL = "[가-힣]"


def clean_reason(
    query: Column, positive: Column, negatives: Column, least_query: int = 2, least_text: int = 10, most_text: int = 4000, script: str | None = HANGUL
) -> Column:
    """The first reason to drop a row, in fixed order; null for a row that stays.

    missing_or_short (also without any negative that differs from the positive),
    non_korean_query (no character of ``script``), missing_or_short_negative (none of
    allowed length), document_too_long. ``query`` is the body without instruction.
    """
    some = distinct_negatives(positive, negatives)
    short = query.isNull() | positive.isNull() | (F.length(query) < least_query) | (F.length(positive) < least_text) | (F.size(some) == 0)
    reason = F.when(F.coalesce(short, F.lit(True)), "missing_or_short")
    if script:
        reason = reason.when(~query.rlike(script), "non_korean_query")
    fits = usable_negatives(positive, negatives, least_text, most_text)
    return reason.when(F.size(fits) == 0, "missing_or_short_negative").when(F.length(positive) > most_text, "document_too_long")


def distinct_negatives(positive: Column, negatives: Column) -> Column:
    """Negatives that are not empty and differ from the positive, each once, in order."""
    return F.filter(F.array_distinct(F.coalesce(negatives, F.array().cast("array<string>"))), lambda n: n.isNotNull() & (n != positive) & (n != ""))


def usable_negatives(positive: Column, negatives: Column, least_text: int, most_text: int) -> Column:
    return F.filter(distinct_negatives(positive, negatives), lambda n: F.length(n).between(least_text, most_text))


def sampled_negatives(key: Column, negatives: Column, k: int, seed: str) -> Column:
    """``k`` negatives without replacement, in an order fixed by seed and key."""
    ranked = F.array_sort(F.transform(negatives, lambda n: F.struct(stable_hash(F.lit(seed), key, n).alias("h"), n.alias("n"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["n"])


def triplet_reason(query: Column, positive: Column, negative: Column, least_query: int = 2, least_text: int = 10, most_text: int = 4000) -> Column:
    """Reasons of the plain triplet filter, first that holds; duplicates are left to ``first_seen``."""
    short = query.isNull() | positive.isNull() | negative.isNull() | (F.length(query) < least_query) | (F.least(F.length(positive), F.length(negative)) < least_text)
    return (
        F.when(F.coalesce(short, F.lit(True)), "missing_or_short").when(~query.rlike(HANGUL), "non_korean_query")
        .when(F.greatest(F.length(positive), F.length(negative)) > most_text, "document_too_long").when(positive == negative, "positive_equals_negative")
    )


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; nulls are values. Ranks are cut per partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def representatives(df: DataFrame, norm: str, raw: str) -> DataFrame:
    """One row per normalized text with its smallest raw text and the number of rows."""
    return df.groupBy(norm).agg(F.min(raw).alias(raw), F.count(F.lit(1)).alias("rows"))


def duplicates_beyond_first(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each column beyond the first of their value (nulls not counted), one row per column.

    Values are counted once per distinct digest, so no text is held twice.
    """
    parts = None
    for c in columns:
        one = df.where(F.col(c).isNotNull()).groupBy(F.sha2(F.col(c).cast("string"), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
        one = one.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")).select(F.lit(c).alias("field"), "duplicates")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def capped(df: DataFrame, source: str, order: list[str], caps: dict[str, int], default: int) -> DataFrame:
    """At most cap accepted rows per source, the first in order."""
    w = Window.partitionBy(source).orderBy(*order)
    limit = F.lit(default)
    for name, n in caps.items():
        limit = F.when(F.col(source) == name, n).otherwise(limit)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= F.greatest(*[F.lit(x) for x in (default, *caps.values(), 0)])).where(F.col("__rn") <= limit).drop("__rn")


def examined(df: DataFrame, source: str, order: list[Column], accepted: Column, cap: int) -> DataFrame:
    """Per source: accepted rows up to the cap, rows looked at until the cap was reached, rejects among them."""
    marked = number_in_order(df.withColumn("__ok", accepted.cast("int")), [source], order, "__n", {"__before": F.col("__ok")})
    # a row is looked at while fewer than `cap` rows before it were accepted
    seen = marked.where(F.col("__before") < cap)
    return seen.groupBy(source).agg(F.count(F.lit(1)).alias("examined"), F.sum("__ok").alias("accepted"), F.sum(1 - F.col("__ok")).alias("rejected"))


def length_profile(df: DataFrame, group: list[str], length: str) -> DataFrame:
    """count, min, mean, max and nearest-rank quantiles (the value at ceil(q n)) per group."""
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {length})")
    return df.where(F.col(length).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.min(length).cast("bigint").alias("min"), F.avg(length).alias("mean"),
        *[q(p).cast("bigint").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], F.max(length).cast("bigint").alias("max"),
    )


def linear_distribution(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean and linearly interpolated percentiles per group."""
    return df.where(F.col(value).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        *[F.percentile(value, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.05, 0.5, 0.95)],
    )


def nearest_rank(df: DataFrame, group: list[str], value: str, parts: list[tuple[int, int]]) -> DataFrame:
    """Quantiles at rank ``((n - 1) num + den // 2) // den`` (from 0), from a histogram of values.

    The histogram of a group is summed by window; its size is the number of distinct values.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(w))
    at = lambda num, den: F.floor(((F.col("total") - 1) * num + den // 2) / den)
    return cum.groupBy(*group).agg(
        F.sum("n").alias("rows"),
        *[F.min(F.when(F.col("upto") > at(num, den), F.col(value))).cast("bigint").alias(f"q{num}_{den}") for num, den in parts],
    )


def strict_violations(df: DataFrame, key: str, query: str, positive: str, negatives: str, scores: str | None = None) -> DataFrame:
    """``(key, rule)``: one row for every rule a row breaks.

    Rules: empty_query, empty_positive, no_negative, empty_negative, positive_in_negatives,
    and with scores score_count, score_range, positive_not_dominant, score_not_finite.
    """
    blank = lambda c: c.isNull() | (F.length(F.trim(c)) == 0)
    neg = F.coalesce(F.col(negatives), F.array().cast("array<string>"))
    rules = [
        ("empty_query", blank(F.col(query))), ("empty_positive", blank(F.col(positive))), ("no_negative", F.size(neg) == 0),
        ("empty_negative", F.exists(neg, blank)), ("positive_in_negatives", F.coalesce(F.array_contains(neg, F.col(positive)), F.lit(False))),
    ]
    if scores:
        s = F.col(scores)
        rules += [
            ("score_count", s.isNotNull() & (F.size(s) != F.size(neg) + 1)),
            ("score_range", s.isNotNull() & F.exists(s, lambda x: (x < 0) | (x > 1))),
            ("score_not_finite", s.isNotNull() & F.exists(s, lambda x: x.isNull() | F.isnan(x))),
            ("positive_not_dominant", s.isNotNull() & (F.size(s) > 1) & (F.get(s, F.lit(0)) <= F.array_max(F.slice(s, 2, 1 << 20)))),
        ]
    broken = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda r: r.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def repeated_ids(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys with more than one row, and whether those rows differ."""
    whole = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns]), 256)
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    return g.where("rows > 1").select(key, "rows", (F.col("lo") != F.col("hi")).alias("differ"))


SECRET_PATTERNS = [
    r"(?i)\b(api[_-]?key|secret|token|password)\b\s*[:=]\s*[^ ]{6,}", r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[0-9A-Za-z]{20,}\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\bBearer [0-9A-Za-z._-]{16,}",
]


def secret_like(c: Column, most: int = 512) -> Column:
    """Why a value must not be published: secret, path, control, long or untrimmed; null if it may."""
    hit = F.lit(False)
    for p in SECRET_PATTERNS:
        hit = hit | c.rlike(p)
    return (
        F.when(hit, "secret").when(c.rlike(r"^(/|~/|[A-Za-z]:\\)[^ ]*$"), "path").when(c.rlike("[\\x00-\\x08\\x0E-\\x1F]"), "control")
        .when(F.length(c) > most, "long").when(c != F.trim(c), "untrimmed")
    )
