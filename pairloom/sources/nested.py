"""Strings inside nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import materialize


def scalar_strings(df: DataFrame, key: str, column: str, depth: int = 8) -> DataFrame:
    """``(key, path, value)`` of every string in a JSON column; other scalars are left out.

    Text that is no JSON gives nothing. One explode per level, without a shuffle; after every
    ``depth`` levels what is found is written, and the search ends when nothing nested is left.
    """
    spark = df.sparkSession
    level = df.select(F.col(key).alias("__key"), F.lit("$").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null")
    out = None
    while True:
        found = None
        for _ in range(depth):
            kind = F.schema_of_variant("v")
            leaf = level.where(kind == "STRING").select("__key", "path", F.expr("cast(v as string)").alias("value"), F.expr("cast(null as variant)").alias("v"))
            found = leaf if found is None else found.unionByName(leaf)
            nested = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
            level = spark.sql(
                "SELECT n.__key, concat(n.path, coalesce(concat('.', e.key), concat('[', e.pos, ']'))) AS path, e.value AS v "
                "FROM {nested} n, LATERAL variant_explode(n.v) AS e(pos, key, value)",
                nested=nested,
            )
        found = materialize(found.unionByName(level.select("__key", "path", F.expr("cast(null as string)").alias("value"), "v")), "strings")
        strings = found.where("value is not null").select("__key", "path", "value")
        out = strings if out is None else out.unionByName(strings)
        level = found.where("v is not null").select("__key", "path", "v")
        if level.isEmpty():
            return out.withColumnRenamed("__key", key)
