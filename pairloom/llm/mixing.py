"""Problem 7: mixing sources to target weights.

Method: the output is cut in shards; multinomial draws (conditioned on the exact totals
of the plan) say how many slots of a shard each source fills; slot ``k`` of a source is
mapped to a record by a pseudorandom permutation of ``0..n-1`` per source and repeat, and
records are joined by their dense index. A plan that counts records takes a record for a
block; ``token_blocks`` packs the token streams of sources to blocks of a fixed length and
``targets_in_blocks`` brings a plan to that unit. The driver draws for ``TOP_SHARDS`` shards
at most; larger mixes cut these in shards of the wanted size in tasks, by the same draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.fields import is_blank, source_name, split_name
from pairloom.operators.numbering import number_in_order, number_within

#: Shards drawn by the driver; each is cut further where it is too large.
TOP_SHARDS = 4096


def plan_targets(plans: DataFrame) -> DataFrame:
    """``(audit_id, phase, source_id, want, max_repeats)``; a null count is no part of a plan."""
    wanted = F.from_json(F.to_json("source_counts"), "map<string,bigint>")
    return plans.select("audit_id", "phase", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.explode(wanted).alias("source_id", "want"))


def usable_records(candidates: DataFrame) -> DataFrame:
    """``(source_id, row_id)`` of train rows with both texts, sources in one spelling."""
    ok = (split_name(F.col("split")) == "train") & ~is_blank(F.col("query")) & ~is_blank(F.col("positive"))
    return candidates.where(ok).select(source_name(F.col("source_id")).alias("source_id"), "row_id")


def targets_in_blocks(targets: DataFrame, records: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """``plan_targets`` with ``want`` in blocks: the wanted records at the mean tokens of their source."""
    mean = records.join(sizes, "row_id").groupBy("source_id").agg(F.avg("n_tokens").alias("__mean"))
    return targets.join(mean, "source_id", "left").withColumn("want", F.ceil(F.col("want") * F.coalesce("__mean", F.lit(0.0)) / block).cast("bigint")).drop("__mean")


def allotment(targets: DataFrame, records: DataFrame) -> DataFrame:
    """What each source can and will give: ``have``, ``capacity``, ``given``, ``short``.

    A source that is short gives all its records ``max_repeats`` times; the rest of the
    plan is not stretched to fill the gap, so shares stay as near to target as they can.
    """
    have = records.groupBy("source_id").agg(F.count(F.lit(1)).alias("have"))
    t = targets.join(have, "source_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    t = t.withColumn("capacity", F.col("have") * F.col("max_repeats"))
    return t.withColumn("given", F.greatest(F.lit(0), F.least("want", "capacity"))).withColumn("short", F.col("capacity") < F.col("want"))


def shares(allotted: DataFrame) -> DataFrame:
    """Wanted and actual share of every source of every plan."""
    plan = Window.partitionBy("audit_id")
    return allotted.select(
        "audit_id", "phase", "source_id", "want", "given", "max_repeats", "short",
        (F.col("want") / F.nullif(F.sum("want").over(plan), F.lit(0))).alias("target_share"),
        (F.col("given") / F.nullif(F.sum("given").over(plan), F.lit(0))).alias("actual_share"),
    )


def _shard_counts(given: list[int], shards: int, seed: int):
    """Slots of each source in each shard: rows are shards of equal size, column sums are ``given``."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    left, out = np.array(given, dtype="int64"), []
    for i in range(shards):
        size = int(left.sum()) // (shards - i)
        if left.sum() < 900_000_000:
            draw = rng.multivariate_hypergeometric(left, size, method="marginals")
        else:  # beyond numpy's range: multinomial, then moved inside what is left
            draw = np.minimum(rng.multinomial(size, left / left.sum()), left)
            while (need := size - int(draw.sum())) > 0:
                room = left - draw
                draw = draw + np.minimum(room, -(-need * room // max(1, int(room.sum()))))
                over = int(draw.sum()) - size
                for j in range(len(draw)):
                    cut = min(over, int(draw[j])) if over > 0 else 0
                    draw[j] -= cut
                    over -= cut
        left = left - draw
        out.append(draw)
    return out


def _permute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """slot k -> repeat and record index, by a 4-round Feistel network walked into 0..n-1."""
    import numpy as np

    with np.errstate(over="ignore"):
        for b in batches:
            n = b["have"].to_numpy("uint64")
            k = b["k"].to_numpy("uint64")
            turn, x = k // n, k % n
            half = np.ceil(np.log2(np.maximum(n, 2).astype("float64") + 1) / 2).astype("uint64")
            mask = (np.uint64(1) << half) - np.uint64(1)
            key = b["seed"].to_numpy("int64").view("uint64") + turn * np.uint64(0x9E3779B97F4A7C15)
            todo = np.ones(len(b), dtype=bool)
            while todo.any():
                lo, hi = x[todo] & mask[todo], x[todo] >> half[todo]
                for r in range(4):
                    f = (lo + key[todo] + np.uint64(r)) * np.uint64(0xBF58476D1CE4E5B9)
                    f ^= f >> np.uint64(29)
                    f *= np.uint64(0x94D049BB133111EB)
                    lo, hi = hi ^ ((f >> np.uint64(32)) & mask[todo]), lo
                x[todo] = (hi << half[todo]) | lo
                todo[todo] = x[todo] >= n[todo]
            b["nth"], b["repeat"] = x.astype("int64"), turn.astype("int32")
            yield b[["audit_id", "phase", "source_id", "shard", "k", "repeat", "nth"]]


_CELL = "audit_id string, phase string, source_id string, shard bigint, k0 bigint, n bigint, have bigint, seed bigint"


def _cut_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per drawn shard, with lists over its sources, to the cells of the shards it is cut in."""
    for b in batches:
        for r in b.itertuples(index=False):
            start, out = list(r.k0), []
            for i, draw in enumerate(_shard_counts(list(r.n), r.parts, r.seed0 + r.shard)):
                for j, n in enumerate(draw):
                    if n:
                        out.append((r.audit_id, r.phase, r.source_id[j], r.shard * r.parts + i, start[j], int(n), int(r.have[j]), int(r.seeds[j])))
                        start[j] += int(n)
            yield pd.DataFrame(out, columns=["audit_id", "phase", "source_id", "shard", "k0", "n", "have", "seed"])


def mix(spark: SparkSession, targets: DataFrame, records: DataFrame, shard_rows: int = 10_000, seed: int = 7) -> DataFrame:
    """The mixed records of every plan: ``(audit_id, phase, shard, at, source_id, row_id, repeat)``.

    ``targets`` as of ``plan_targets``; ``at`` orders a shard. Empty sources give nothing; a plan
    without sources gives no row.
    """
    allotted = allotment(targets, records).where("given > 0")
    by_plan: dict = {}
    for r in allotted.orderBy("audit_id", "source_id").collect():  # plans x sources rows
        by_plan.setdefault((r["audit_id"], r["phase"]), []).append(r)
    drawn = []
    for i, ((audit, phase), rs) in enumerate(sorted(by_plan.items())):
        total = sum(r["given"] for r in rs)
        shards = max(1, min(TOP_SHARDS, -(-total // shard_rows)))
        parts = max(1, -(-total // (shards * shard_rows)))
        start = [0] * len(rs)
        names, have, seeds = [r["source_id"] for r in rs], [int(r["have"]) for r in rs], [seed * 1_000_003 + i * 1009 + j for j in range(len(rs))]
        for shard, draw in enumerate(_shard_counts([r["given"] for r in rs], shards, seed + i)):
            drawn.append((audit, phase, shard, parts, seed, names, list(start), [int(x) for x in draw], have, seeds))
            start = [x + int(y) for x, y in zip(start, draw)]
    tops = spark.createDataFrame(drawn, "audit_id string, phase string, shard bigint, parts bigint, seed0 bigint, source_id array<string>, k0 array<bigint>, n array<bigint>, have array<bigint>, seeds array<bigint>")
    # a few rows make many: tasks are counted by what comes out, and the planner is not left to
    # judge by what went in whether to broadcast it
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r["given"] for r in sum(by_plan.values(), [])) // 1_000_000)
    cells = tops.repartition(min(tasks, max(1, len(drawn))), "audit_id", "shard").mapInPandas(_cut_shards, _CELL)
    slots = cells.select("audit_id", "phase", "source_id", "shard", "have", "seed", F.explode(F.sequence("k0", F.col("k0") + F.col("n") - 1)).alias("k"))
    mapped = slots.mapInPandas(_permute, "audit_id string, phase string, source_id string, shard bigint, k bigint, repeat int, nth bigint")
    indexed = number_within(records, ["source_id"], ["row_id"], "nth")
    return mapped.join(indexed.hint("merge"), ["source_id", "nth"]).select(
        "audit_id", "phase", "shard", F.xxhash64("audit_id", "source_id", "k").alias("at"), "source_id", "row_id", "repeat"
    )


def delivered(targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """``targets`` with ``given``: what the mix holds of each source, and ``short``: less than wanted."""
    made = mixed.groupBy("audit_id", "source_id").agg(F.count(F.lit(1)).alias("given"))
    t = targets.join(made, ["audit_id", "source_id"], "left").withColumn("given", F.coalesce("given", F.lit(0)))
    return t.withColumn("short", F.col("given") < F.col("want"))


def token_blocks(records: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """``(source_id, row_id, n_tokens, pieces)``: the token stream of each source cut in blocks of ``block`` tokens.

    ``records(source_id, row_id)``, ``sizes(row_id, n_tokens)``. ``row_id`` of the result
    numbers the blocks of a source from 0; ``pieces`` lists (record, first token, tokens) in
    order. The last block of a source holds what is left, so no token is lost; records
    without tokens are in no block.
    """
    sized = records.join(sizes, "row_id").where("n_tokens > 0").select("source_id", "row_id", "n_tokens")
    placed = number_in_order(sized, ["source_id"], [F.col("row_id")], "nth", {"begin": F.col("n_tokens")})
    last = F.expr(f"(begin + n_tokens - 1) div {block}")
    cut = placed.withColumn("no", F.explode(F.sequence(F.expr(f"begin div {block}"), last)))
    start = F.greatest(F.col("begin"), F.col("no") * block)
    end = F.least(F.col("begin") + F.col("n_tokens"), (F.col("no") + 1) * block)
    piece = F.struct("begin", F.col("row_id").alias("record"), (start - F.col("begin")).alias("first"), (end - start).alias("tokens"))
    made = cut.groupBy("source_id", "no").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum(end - start).alias("n_tokens"))
    return made.select("source_id", F.col("no").alias("row_id"), "n_tokens", F.transform("pieces", lambda p: p.dropFields("begin")).alias("pieces"))
