"""Dense row numbers inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, group: list[str], key: list[str], out: str, chunks: int | None = None) -> DataFrame:
    """Add ``out``: 0,1,2,… within each ``group``, in an order fixed by ``key``.

    A plain ``row_number`` over a group sorts the whole group in one task, which fails
    when one group holds a third of the rows. Here each group is cut in ``chunks``
    pieces (by default as many as shuffle partitions, 64 at least) by a hash of ``key``;
    pieces are numbered apart and shifted by the sizes of the pieces before them. The
    piece sizes are ``groups x chunks`` rows at most.
    Nulls in ``group`` form one group. ``key`` must be unique for a repeatable order.
    """
    if chunks is None:
        chunks = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    piece = F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int")
    cut = df.withColumn("__piece", piece)
    sizes = cut.groupBy(*group, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__piece").alias("__p"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy(*group, "__piece").orderBy(*key)
    numbered = cut.withColumn("__rn", F.row_number().over(inside) - 1)
    match: Column = F.col("__piece") == F.col("__p")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = numbered.join(starts, match, "inner")
    return joined.withColumn(out, (F.col("__start") + F.col("__rn")).cast("bigint")).select(*df.columns, out)


def number_in_order(df: DataFrame, group: list[str], order: list[Column], out: str, running: dict[str, Column] | None = None) -> DataFrame:
    """Add ``out``: 0,1,2,… within each ``group`` in the given ``order``, at any group size.

    Rows are range-partitioned by group and order, so a group that holds a third of all
    rows is spread over many tasks; each task numbers its part and is shifted by the sizes
    of the parts before it. ``running`` adds sums over the rows before a row, per name.
    ``order`` (ascending expressions; negate a number to fall) must be unique within a group
    for a repeatable result. Nulls form one group.
    """
    from pairloom.session import materialize

    running = running or {}
    sums = {f"__v{i}": c for i, c in enumerate(running.values())}
    keyed = df.withColumns({f"__o{i}": c for i, c in enumerate(order)} | sums)
    by = [F.col(g).asc_nulls_first() for g in group] + [F.col(f"__o{i}") for i in range(len(order))]
    cut = keyed.repartitionByRange(*by).withColumn("__part", F.spark_partition_id())
    cut = materialize(cut, "ordered")
    sizes = cut.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(f"{v}s") for v in sums])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), *[F.coalesce(F.sum(f"{v}s").over(before), F.lit(0)).alias(f"{v}b") for v in sums],
    )
    inside = Window.partitionBy(*group, "__part").orderBy(*[F.col(f"__o{i}") for i in range(len(order))])
    match: Column = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumns({"__rn": F.row_number().over(inside) - 1} | {f"{v}r": F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in sums})
    joined = numbered.join(starts, match).withColumn(out, (F.col("__start") + F.col("__rn")).cast("bigint"))
    return joined.select(*df.columns, out, *[(F.col(f"{v}b") + F.col(f"{v}r")).alias(name) for v, name in zip(sums, running)])
