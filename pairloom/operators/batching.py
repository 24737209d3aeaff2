"""Source-homogeneous batches, curricula and length strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import stable_hash
from pairloom.operators.numbering import number_in_order


def homogeneous_batches(df: DataFrame, source: str, key: str, length: str, size: int, seed: str, by_length: bool = True) -> DataFrame:
    """Add ``batch_source_index``, ``position``, ``batch_min`` and ``batch_max``; incomplete batches are dropped.

    Rows of a source are ordered by hash (or by length, then hash), cut in batches of
    ``size``; ``batch_index`` orders all batches by the hash of seed, source and number.
    """
    h = stable_hash(F.lit(seed), F.col(source), F.col(key))
    order = [F.col(length), h, F.col(key)] if by_length else [h, F.col(key)]
    cut = number_in_order(df, [source], order, "__rn").withColumn("batch_number", F.expr(f"__rn div {size}")).withColumn("position", F.col("__rn") % size)
    whole = Window.partitionBy(source, "batch_number")
    full = cut.withColumn("__n", F.count(F.lit(1)).over(whole)).where(F.col("__n") == size)
    sized = full.withColumn("batch_min", F.min(length).over(whole)).withColumn("batch_max", F.max(length).over(whole))
    # one row per batch is numbered, then joined back
    heads = sized.where("position = 0").select(source, "batch_number")
    index = number_in_order(heads, [], [stable_hash(F.lit(seed), F.lit("batch"), F.col(source), F.col("batch_number")), F.col(source), F.col("batch_number")], "batch_index")
    joined = sized.join(index, [source, "batch_number"])
    return joined.withColumn("row_index", F.col("batch_index") * size + F.col("position")).drop("__rn", "__n")


def batch_stats(batched: DataFrame, length: str) -> DataFrame:
    """Per batch: rows, sources, shortest, longest and wasted padding."""
    return batched.groupBy("batch_index").agg(
        F.count(F.lit(1)).alias("rows"), F.min(length).alias("shortest"), F.max(length).alias("longest"), (F.max(length) * F.count(F.lit(1)) - F.sum(length)).alias("padding")
    )


def dropped_rows(df: DataFrame, source: str, size: int) -> DataFrame:
    """Rows of each source that fill no batch."""
    return df.groupBy(source).agg((F.count(F.lit(1)) % size).alias("dropped"))


def padding_waste(df: DataFrame, order: list[Column], length: str, size: int, groups: int = 64) -> DataFrame:
    """One row: padded and real characters when rows are cut in batches of ``size`` in ``order`` within hash groups."""
    cut = df.withColumn("__g", F.pmod(F.xxhash64(*df.columns[:1]), F.lit(groups)))
    rn = F.row_number().over(Window.partitionBy("__g").orderBy(*order)) - 1
    b = cut.withColumn("__b", F.floor(rn / size)).groupBy("__g", "__b").agg(F.max(length).alias("m"), F.count(F.lit(1)).alias("n"), F.sum(length).alias("s"))
    return b.agg(F.sum(F.col("m") * F.col("n")).alias("padded"), F.sum("s").alias("real"))


def contract_violations(batched: DataFrame, source: str, size: int) -> DataFrame:
    """``(batch_index, rule)``: wrong size, several sources, several minima or a gap in the row index."""
    prev = F.lag("row_index").over(Window.partitionBy("batch_index").orderBy("row_index"))
    g = batched.withColumn("__gap", F.coalesce(F.col("row_index") - prev, F.lit(1)) != 1).groupBy("batch_index").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(source).alias("s"), F.count_distinct("batch_min").alias("m"), F.bool_or("__gap").alias("gap")
    )
    rules = F.array(
        F.when(F.col("n") != size, "size"), F.when(F.col("s") != 1, "sources"), F.when(F.col("m") != 1, "metadata"), F.when(F.col("gap"), "gap")
    )
    return g.select("batch_index", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def mix_components(components: dict[str, tuple[DataFrame, int]], size: int, seed: str) -> DataFrame:
    """Complete batches of several components in one hashed order: ``(role, source_batch, position, …, output_batch)``.

    Each component gives its first ``rows // size`` batches and keeps their inner order.
    """
    if len(components) < 2:
        raise ValueError("a mix takes two components or more")
    parts = None
    for role, (batched, rows) in components.items():
        if rows % size:
            raise ValueError(f"the rows of {role!r} fill no whole number of batches")
        one = batched.where(F.col("batch_index") < rows // size).withColumn("role", F.lit(role)).withColumnRenamed("batch_index", "source_batch")
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    heads = parts.where("position = 0").select("role", "source_batch")
    order = [stable_hash(F.lit(seed), F.col("role"), F.col("source_batch")), F.col("role"), F.col("source_batch")]
    return parts.join(number_in_order(heads, [], order, "output_batch"), ["role", "source_batch"])


def role_shares(df: DataFrame, role: str) -> DataFrame:
    g = df.groupBy(role).agg(F.count(F.lit(1)).alias("rows"))
    total = g.agg(F.sum("rows").alias("total"))
    return g.join(F.broadcast(total)).select(role, "rows", (F.col("rows") / F.col("total")).alias("share"))


def _sized(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rank from 0 and size of the group, for groups of any size."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    return number_in_order(df, group, order, "__r").join(n, group)


def strata(df: DataFrame, group: list[str], order: list[Column], count: int) -> DataFrame:
    """Add ``stratum``: ``rank x count // n`` with ranks from 0 (sizes differ from ntile's)."""
    return _sized(df, group, order).withColumn("stratum", F.expr(f"(__r * {count}) div __n")).drop("__r", "__n")


def midpoint_picks(df: DataFrame, group: list[str], order: list[Column], quotas: DataFrame) -> DataFrame:
    """Of each group its quota of evenly spaced rows, at positions ``(2 i + 1) n // (2 c)``; add ``slot``."""
    ranked = _sized(df, group, order).join(quotas, group).where("quota > 0")
    # the only slot whose position can be this rank is the one just below it
    near = F.expr("((2 * __r + 2) * quota - __n) div (2 * __n)")
    slots = F.filter(F.array(near - 1, near, near + 1), lambda i: (i >= 0) & (i < F.col("quota")) & (F.floor((i * 2 + 1) * F.col("__n") / (F.col("quota") * 2)) == F.col("__r")))
    return ranked.withColumn("slot", F.explode(slots)).drop("__r", "__n")
