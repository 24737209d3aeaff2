"""Teacher-score filters for negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.vectors import pool_choice, rank_anchor, rank_anchor_floor


def score_field(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """``(group, field)``: the first field that all documents of a group have as a number."""
    has = [F.bool_and(F.col(f).isNotNull() & ~F.isnan(F.col(f))).alias(f"__{i}") for i, f in enumerate(fields)]
    pick = F.coalesce(*[F.when(F.col(f"__{i}"), F.lit(f)) for i, f in enumerate(fields)])
    return df.groupBy(group).agg(*has).select(group, pick.alias("field"))


def teacher_limit(positive: Column, ratio: float, margin: float) -> Column:
    """Highest score a negative may have; it may equal the limit."""
    return F.least(positive * ratio, positive - margin)


def teacher_filter(
    df: DataFrame, group: str, item: str, text: str, score: str, is_positive: Column, least_positive: float, ratio: float, margin: float, pool: int, k: int,
    rule: str = "kd", least_negative: float = 0.0, strategy: str = "score_rank_quantiles",
) -> DataFrame:
    """``(group, item, score, pool_rank)``: k negatives per group from its top pool, by a teacher's scores.

    A group needs a positive of at least ``least_positive`` and k eligible negatives, else it
    gives nothing. A negative may score up to the limit (inclusive) and not below
    ``least_negative``. Rule "kd": the first item (by ``item``) of each text counts, whatever
    its score, before the limit is applied; ranks are spaced by the floor formula. Rule
    "factory": texts of the positive are excluded, the best-scored item of each text
    counts, ranks are spaced by the rounded formula or chosen by ``strategy``.
    """
    s = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score)))
    p = s.where(is_positive).groupBy(group).agg(F.max(score).alias("__p"), F.collect_set(text).alias("__own")).where(F.col("__p") >= least_positive)
    n = s.where(~is_positive).join(p, group)
    allowed = (F.col(score) <= teacher_limit(F.col("__p"), ratio, margin)) & (F.col(score) >= least_negative)
    if rule == "kd":
        n = n.withColumn("__n", F.row_number().over(Window.partitionBy(group, text).orderBy(item))).where("__n = 1").where(allowed)
    else:
        n = n.where(allowed & ~F.coalesce(F.array_contains("__own", F.col(text)), F.lit(False)))
        n = n.withColumn("__n", F.row_number().over(Window.partitionBy(group, text).orderBy(F.col(score).desc(), item))).where("__n = 1")
    best = Window.partitionBy(group).orderBy(F.col(score).desc(), item)
    top = n.withColumn("pool_rank", F.row_number().over(best)).where(F.col("pool_rank") <= pool)
    sized = top.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group))).where(F.col("__n") >= k)
    if rule != "kd" and strategy != "score_rank_quantiles":
        chosen = pool_choice(sized.withColumnsRenamed({"pool_rank": "rank", item: "doc_id"}), group, strategy, k).withColumnsRenamed({"rank": "pool_rank", "doc_id": item})
    else:
        anchor = rank_anchor_floor if rule == "kd" else rank_anchor
        at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: anchor(i, F.col("__n"), k))
        chosen = sized.where(F.array_contains(at, (F.col("pool_rank") - 1).cast("bigint")))
    return chosen.select(group, item, F.col(score).alias("score"), "pool_rank")


def mock_logits(*parts: Column) -> tuple[Column, Column]:
    """Deterministic (no, yes) logits in [-4, 4) from the hash of the parts: a scorer without a model."""
    h = F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)
    num = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint") / F.lit(4294967296.0) * 8 - 4
    return num(1), num(9)


def generation_reason(query: Column, answer: Column, evidence: Column, passage: Column, coverage: Column, most: float = 0.8) -> Column:
    """First reason to reject a generated row: length, script, ungrounded answer or evidence, copied query."""
    return (
        F.when(query.isNull() | answer.isNull() | evidence.isNull() | passage.isNull(), "missing")
        .when(~F.length(query).between(2, 400), "query_length").when(~query.rlike("[가-힣A-Za-z]"), "script")
        .when(~evidence.contains(answer), "answer_not_in_evidence").when(~passage.contains(evidence), "evidence_not_in_passage").when(coverage > most, "copied")
    )


def infonce(scores: DataFrame, group: str, score: str, is_positive: Column, temperature: float) -> DataFrame:
    """``(group, loss)``: minus the log-softmax share of the positives, by one stable aggregate."""
    s = F.col(score) / temperature
    top = scores.groupBy(group).agg(F.max(s).alias("__m"))
    j = scores.join(top, group).withColumn("__e", F.exp(s - F.col("__m")))
    return j.groupBy(group).agg((F.log(F.sum("__e")) - F.log(F.sum(F.when(is_positive, F.col("__e"))))).alias("loss")).where("loss is not null")


def listwise_kl(scores: DataFrame, group: str, teacher: str, student: str, temperature: float) -> DataFrame:
    """``(group, kl)``: Kullback-Leibler divergence of the student's softmax from the teacher's."""
    t, s = F.col(teacher) / temperature, F.col(student) / temperature
    top = scores.groupBy(group).agg(F.max(t).alias("__mt"), F.max(s).alias("__ms"))
    j = scores.join(top, group)
    z = j.groupBy(group).agg((F.log(F.sum(F.exp(t - F.col("__mt")))) + F.max("__mt")).alias("__zt"), (F.log(F.sum(F.exp(s - F.col("__ms")))) + F.max("__ms")).alias("__zs"))
    lp, lq = t - F.col("__zt"), s - F.col("__zs")
    return scores.join(z, group).groupBy(group).agg(F.sum(F.exp(lp) * (lp - lq)).alias("kl"))


def in_batch(df: DataFrame, batch: str, key: str, query: str, document: str, temperature: float) -> DataFrame:
    """``(batch, key, loss)``: cross-entropy of a row's own document against all documents of its batch.

    A batch has a fixed number of rows, so the join inside it is bounded.
    """
    from pairloom.operators.vectors import dot

    docs = df.select(F.col(batch), F.col(key).alias("__other"), F.col(document).alias("__doc"))
    logits = df.select(batch, key, F.col(query).alias("__query")).join(docs, batch)
    logits = logits.select(batch, key, "__other", (dot(F.col("__query"), F.col("__doc")) / temperature).alias("__s"))
    return infonce(logits.withColumn("__group", F.struct(batch, key)), "__group", "__s", F.col("__other") == F.col(key), 1.0).select(f"__group.{batch}", f"__group.{key}", "loss")


def teacher_logit(score: Column, temperature: float = 1.0, epsilon: float = 1e-6) -> Column:
    """Log odds of a teacher's probability, kept away from 0 and 1."""
    p = F.least(F.greatest(score, F.lit(epsilon)), F.lit(1 - epsilon))
    return F.log(p / (1 - p)) / temperature


def teacher_groups(df: DataFrame, group: str, score: str, is_positive: Column) -> DataFrame:
    """``(group, documents, problem)``: whether a teacher's scores can be learned from.

    A group needs one positive and a negative, all scores finite and in 0..1, and the positive
    above every negative; ``problem`` names the first rule it breaks, null if none.
    """
    s, bad = F.col(score), F.col(score).isNull() | F.isnan(F.col(score)) | (F.abs(F.col(score)) == float("inf"))
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(is_positive).alias("__p"), F.count_if(bad).alias("__bad"), F.count_if((s < 0) | (s > 1)).alias("__out"),
        F.max(F.when(is_positive, s)).alias("__top"), F.max(F.when(~is_positive, s)).alias("__next"),
    )
    problem = (
        F.when(F.col("__p") != 1, "positives").when(F.col("documents") < 2, "no_negative").when(F.col("__bad") > 0, "not_finite")
        .when(F.col("__out") > 0, "range").when(F.col("__top") <= F.col("__next"), "positive_not_dominant")
    )
    return g.select(group, "documents", problem.alias("problem"))


def margin_mse(scores: DataFrame, group: str, teacher: str, student: str, is_positive: Column) -> DataFrame:
    """``(group, loss)``: mean squared difference of the student's and the teacher's margins between
    the positive (the best by the teacher) and each negative."""
    t, s = F.col(teacher), F.col(student)
    top = scores.where(is_positive).groupBy(group).agg(F.max(F.struct(t.alias("t"), s.alias("s"))).alias("__p"))
    gap = (F.col("__p.s") - s) - (F.col("__p.t") - t)
    return scores.where(~is_positive).join(top, group).groupBy(group).agg(F.avg(gap * gap).alias("loss"))


def masked_infonce(scores: DataFrame, group: str, score: str, is_positive: Column, is_queued: Column, margin: float, temperature: float) -> DataFrame:
    """``(group, loss, masked)``: ``infonce`` in which queued negatives within ``margin`` of the best positive, or
    above it, may be false negatives and do not count."""
    top = scores.where(is_positive).groupBy(group).agg(F.max(score).alias("__p"))
    j = scores.join(top, group).withColumn("__masked", is_queued & ~is_positive & (F.col(score) >= F.col("__p") - margin))
    masked = j.groupBy(group).agg(F.count_if("__masked").alias("masked"))
    return infonce(j.where("not __masked"), group, score, is_positive, temperature).join(masked, group)
