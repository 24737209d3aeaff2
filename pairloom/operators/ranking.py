"""Retrieval metrics, rank aggregation and staged selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(df: DataFrame, group: list[str], item: str, score: str) -> DataFrame:
    """Add ``rank`` from 1 by falling score, ties to the smaller item."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), item)
    return df.withColumn("rank", F.row_number().over(w))


def multi_positive(ranked: DataFrame, group: list[str], relevant: Column) -> DataFrame:
    """Per query: relevant, ndcg10, recall10, recall100, rr10 and best rank, over all relevant ranks."""
    gain = F.when(relevant & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    q = ranked.groupBy(*group).agg(
        F.count_if(relevant).alias("relevant"), F.sum(gain).alias("dcg"), F.count_if(relevant & (F.col("rank") <= 10)).alias("h10"),
        F.count_if(relevant & (F.col("rank") <= 100)).alias("h100"), F.min(F.when(relevant, F.col("rank"))).alias("best_rank"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return q.where("relevant > 0").select(
        *group, "relevant", "best_rank", (F.col("dcg") / ideal).alias("ndcg10"), (F.col("h10") / F.col("relevant")).alias("recall10"),
        (F.col("h100") / F.col("relevant")).alias("recall100"), F.when(F.col("best_rank") <= 10, 1 / F.col("best_rank")).otherwise(0.0).alias("rr10"),
    )


def metric_means(per_query: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    return per_query.groupBy(*group).agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in columns])


def single_positive(best: DataFrame, group: list[str], rank: str) -> DataFrame:
    """Metrics of one positive rank per query: ndcg10, recall10, recall100, mrr10, mean and median rank."""
    r = F.col(rank)
    return best.groupBy(*group).agg(
        F.count(F.lit(1)).alias("queries"), F.avg(F.when(r <= 10, 1 / F.log2(r + 1)).otherwise(0.0)).alias("ndcg10"), F.avg((r <= 10).cast("int")).alias("recall10"),
        F.avg((r <= 100).cast("int")).alias("recall100"), F.avg(F.when(r <= 10, 1 / r).otherwise(0.0)).alias("mrr10"), F.avg(r).alias("mean_rank"), F.percentile(r, F.lit(0.5)).alias("median_rank"),
    )


def noise_ranks(df: DataFrame, group: str, score: str, is_positive: Column, is_noise: Column) -> DataFrame:
    """Rank of the positive and of the best noise document when noise is appended to the clean pool.

    Clean rows stand before noise rows of equal score: a tie with noise never costs the
    positive a rank, and the best noise stands behind all clean rows that are not worse.
    """
    is_noise, is_positive = F.coalesce(is_noise, F.lit(False)), F.coalesce(is_positive, F.lit(False))
    top = df.groupBy(group).agg(F.max(F.when(is_positive, F.col(score))).alias("p"), F.max(F.when(is_noise, F.col(score))).alias("n"))
    j = df.join(top.where("p is not null"), group)
    s, clean = F.col(score), ~is_noise & ~is_positive
    return j.groupBy(group).agg(
        (1 + F.count_if(clean & (s > F.col("p"))) + F.count_if(is_noise & (s > F.col("p")))).alias("positive_rank"),
        F.when(F.max("n").isNotNull(), 1 + F.count_if(clean & (s >= F.col("n"))) + F.max((F.col("p") >= F.col("n")).cast("int"))).alias("noise_rank"),
    )


def noise_summary(r: DataFrame, group: list[str]) -> DataFrame:
    """recall10 of the positive, noise intrusion at 1, 5 and 10, median noise rank."""
    n = F.col("noise_rank")
    hit = lambda k: F.avg(F.coalesce((n <= k).cast("int"), F.lit(0))).alias(f"intrusion{k}")
    return r.groupBy(*group).agg(
        F.count(F.lit(1)).alias("queries"), F.avg(F.when(F.col("positive_rank") <= 10, 1 / F.log2(F.col("positive_rank") + 1)).otherwise(0.0)).alias("ndcg10"),
        F.avg((F.col("positive_rank") <= 10).cast("int")).alias("recall10"), hit(1), hit(5), hit(10), F.percentile(n, F.lit(0.5)).alias("median_noise_rank"),
    )


def retention(summary: DataFrame, group: list[str], ratio: str, metric: str) -> DataFrame:
    """Add ``retention``: the metric over its value at ratio 0; null where that is 0 or missing."""
    clean = summary.where(F.col(ratio) == 0).select(*[F.col(g).alias(f"__{g}") for g in group], F.col(metric).alias("__clean"))
    cond = F.lit(True)
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__{g}"))
    j = summary.join(clean if group else F.broadcast(clean), cond, "left")  # without groups: one row
    return j.withColumn("retention", F.col(metric) / F.nullif(F.col("__clean"), F.lit(0.0))).drop("__clean", *[f"__{g}" for g in group])


def average_ranks(scores: DataFrame, task: str, score: str) -> DataFrame:
    """Add ``avg_rank``: position by falling score, peers share the mean of their positions."""
    w = Window.partitionBy(task).orderBy(F.col(score).desc())
    peers = Window.partitionBy(task, score)
    return scores.where(F.col(score).isNotNull()).withColumn("avg_rank", F.rank().over(w) + (F.count(F.lit(1)).over(peers) - 1) / 2.0)


def borda(scores: DataFrame, model: str, task: str, score: str) -> DataFrame:
    """``(model, points, final_rank)``: each task gives ``models - avg_rank`` points, a missing task none."""
    models = scores.select(model).distinct().agg(F.count(F.lit(1)).alias("n"))
    p = average_ranks(scores, task, score).join(F.broadcast(models))
    total = p.groupBy(model).agg(F.sum(F.col("n") - F.col("avg_rank")).alias("points"))
    return total.withColumn("final_rank", F.rank().over(Window.orderBy(F.round("points", 9).desc())))  # one row per model


def neighbours(board: DataFrame, order: str, model: str, own: str, k: int) -> DataFrame:
    """Rows at most ``k`` places from ``own`` in the final order."""
    placed = board.withColumn("place", F.row_number().over(Window.orderBy(order, model)))  # one row per model
    mine = placed.where(F.col(model) == own).agg(F.min("place").alias("__own"))
    return placed.join(F.broadcast(mine)).where(F.abs(F.col("place") - F.col("__own")) <= k).drop("__own")


def rollup_means(df: DataFrame, levels: list[str], value: str) -> list[DataFrame]:
    """Unweighted averages, level by level: subsets to tasks, tasks to types, types to one number."""
    out, at = [], df
    for i in range(len(levels), 0, -1):
        at = at.groupBy(*levels[:i]).agg(F.avg(value).alias(value))
        out.append(at)
    out.append(at.agg(F.avg(value).alias(value)))
    return out


def total_variation(a: DataFrame, b: DataFrame, key: str, count: str) -> DataFrame:
    """One row: half the sum of absolute differences of the two shares over the union of keys."""
    share = lambda d, out: d.select(F.col(key).alias("__k"), (F.col(count) / F.sum(count).over(Window.partitionBy(F.lit(1)))).alias(out))
    j = share(a, "p").join(share(b, "q"), "__k", "full")
    return j.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"))


def near_ties(df: DataFrame, stages: list[tuple[str, float, bool]]) -> DataFrame:
    """Successive bands: of each stage ``(column, eps, larger is better)`` keep rows within eps of the best left."""
    for column, eps, up in stages:
        best = df.agg((F.max(column) if up else F.min(column)).alias("__best"))
        gap = (F.col("__best") - F.col(column)) if up else (F.col(column) - F.col("__best"))
        df = df.join(F.broadcast(best)).where(gap <= eps).drop("__best")
    return df


def band_flags(df: DataFrame, stages: list[tuple[str, float, bool]], order: list[Column]) -> DataFrame:
    """All rows with, per stage, whether they were still in the band, and their place: the first two bands, then ``order``."""
    left = df
    flagged = df
    for i, (column, eps, up) in enumerate(stages):
        best = left.agg((F.max(column) if up else F.min(column)).alias("__best"))
        gap = (F.col("__best") - F.col(column)) if up else (F.col(column) - F.col("__best"))
        before = F.col(f"band{i - 1}") if i else F.lit(True)
        flagged = flagged.join(F.broadcast(best)).withColumn(f"band{i}", before & (gap <= eps)).drop("__best")
        left = flagged.where(F.col(f"band{i}"))
    keys = [F.col(f"band{i}").desc() for i in range(min(2, len(stages)))]
    return flagged.withColumn("place", F.row_number().over(Window.orderBy(*keys, *order)))  # one row per model


def guard_gate(candidate: DataFrame, references: DataFrame, metric: str, value: str, guards: dict[str, float], default: float) -> DataFrame:
    """``(metric, candidate, floor, passes)``: at least the best reference minus the metric's guard."""
    guard = F.lit(default)
    for name, g in guards.items():
        guard = F.when(F.col(metric) == name, g).otherwise(guard)
    best = references.groupBy(metric).agg(F.max(value).alias("best"))
    j = best.join(candidate.select(metric, F.col(value).alias("candidate")), metric, "left").withColumn("floor", F.col("best") - guard)
    return j.select(metric, "candidate", "floor", (F.coalesce(F.col("candidate"), F.lit(float("-inf"))) >= F.col("floor")).alias("passes"))


def decision(passes_target: Column, passes_guards: Column, deficit: Column, most_deficit: float) -> Column:
    """The four-way ladder: adopt, teacher only, adapt and retest (a small deficit), or resume."""
    return (
        F.when(passes_target & passes_guards, "adopt").when(passes_target, "teacher_only_due_to_regression")
        .when(passes_guards & deficit.between(0, most_deficit), "short_adaptation_then_retest").otherwise("resume_and_reselect")
    )


def complete_runs(df: DataFrame, model: str, task: str, score: str, tasks: int) -> DataFrame:
    """``(model, average, place)`` of models with all tasks, best average first, then by name."""
    g = df.where(F.col(score).isNotNull()).groupBy(model).agg(F.count_distinct(task).alias("n"), F.avg(score).alias("average")).where(F.col("n") == tasks)
    return g.select(model, "average", F.row_number().over(Window.orderBy(F.round("average", 9).desc(), model)).alias("place"))


def latest(df: DataFrame, key: str, at: str, carry: list[str]) -> DataFrame:
    """The row with the largest ``at`` of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(at, *carry), F.struct(at, *carry)).alias("x")).select(key, "x.*")


def best_checkpoint(df: DataFrame, key: str, loss: str, step: str, path: str) -> DataFrame:
    """Per key the least finite loss, then the smallest step, then path; without a finite loss the latest step."""
    ok = F.col(loss).isNotNull() & ~F.isnan(F.col(loss)) & (F.abs(F.col(loss)) < float("inf"))
    g = df.groupBy(key).agg(F.min(F.when(ok, F.struct(loss, step, path))).alias("b"), F.max(F.struct(F.col(step), F.col(path), F.col(loss))).alias("l"))
    return g.select(key, F.coalesce("b." + step, "l." + step).alias(step), F.coalesce("b." + path, "l." + path).alias(path), F.col("b").isNotNull().alias("by_loss"))
