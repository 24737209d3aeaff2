"""As-of and interval joins without inequality joins over all rows; joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.numbering import number_within
from pairloom.session import materialize


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, carry: list[str]) -> DataFrame:
    """Each left row with the last right row of its keys at or before it; nulls where there is none.

    Both sides are stacked and the last right value is carried forward by one window, so
    the work is one sort per key instead of a join of all pairs. Of right rows at one
    moment the largest counts.
    """
    r = right.select(*keys, F.col(at), F.struct(*carry).alias("__r"), F.lit(0).alias("__side"))
    body = F.struct(*[c for c in left.columns if c not in (*keys, at)])
    stacked = left.select(*keys, F.col(at), body.alias("__l"), F.lit(1).alias("__side")).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__side", F.col("__r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = stacked.withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return seen.select(*keys, at, "__l.*", *[F.col(f"__last.{c}").alias(c) for c in carry])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, at: str, seconds: int) -> DataFrame:
    """Pairs with ``start <= at <= start + seconds``, by an equi-join on time buckets of that width.

    A left row meets the bucket of its start and the next one, so only rows near in time
    are compared.
    """
    bucket = lambda c: F.expr(f"unix_micros(cast({c} as timestamp)) div {seconds * 1_000_000}")
    a = left.withColumn("__b", F.explode(F.array(bucket(start), bucket(start) + 1)))
    b = right.withColumn("__b", bucket(at))
    near = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(start) + F.make_dt_interval(secs=F.lit(seconds)))
    return a.join(b, [*keys, "__b"]).where(near).drop("__b")


def join_members(left: DataFrame, key: str, members: DataFrame, row: str, piece: int = 256) -> DataFrame:
    """Inner join of ``left`` with ``members(key, row)`` on ``key``, for keys with any number of members.

    Members of a key are numbered and cut in pieces; a left row meets one piece at a time,
    so the rows a hot key produces come from many tasks instead of one.
    """
    named = members.select(F.col(key).alias("__k"), F.col(row))
    cut = materialize(number_within(named, ["__k"], [row], "__nth").select("__k", F.expr(f"__nth div {piece}").alias("__piece"), row), "members")
    pieces = cut.groupBy(F.col("__k").alias("__kp")).agg(F.max("__piece").alias("__last"))
    met = left.join(pieces, F.col(key) == F.col("__kp")).withColumn("__at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last"))))
    return met.join(cut, (F.col(key) == F.col("__k")) & (F.col("__at") == F.col("__piece"))).drop("__k", "__kp", "__last", "__at", "__piece")


def hot_keys(df: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """``(__k, __last)`` of keys with more than ``most`` rows, or more than a ten-thousandth of all,
    and the number of pieces less one to cut them in. There are 10,000 such keys at most."""
    counts = materialize(df.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")), "counts")
    bound = max(most, (counts.agg(F.sum("__n")).first()[0] or 0) // 10_000)
    return counts.where(F.col("__n") > bound).select("__k", F.expr(f"cast(__n div {bound} as int)").alias("__last"))


def with_pieces(df: DataFrame, key: str, hot: DataFrame, by: list[str]) -> DataFrame:
    """Add ``__salt``: the piece of a hot key a row falls in by a hash of ``by``; 0 for other keys."""
    salt = F.when(F.col("__last").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("__last") + 1).cast("int"))
    return df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__k")), "left").withColumn("__salt", salt).drop("__k", "__last")


def join_unique(left: DataFrame, key: str, right: DataFrame, most: int = 100_000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per ``key`` at most.

    The rows of a hot key are spread by their hash over as many copies of its right row, so no
    task holds all of them. The table of hot keys has 10,000 rows at most and is broadcast.
    """
    hot = hot_keys(left, key, most)
    copies = right.join(F.broadcast(hot), F.col(key) == F.col("__k"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__last", F.lit(0))))).drop("__k", "__last")
    return with_pieces(left, key, hot, left.columns).join(copies, [key, "__salt"]).drop("__salt")
