"""Problem 5: duplicates hidden by formatting.

Method: byte-identical raw rows collapse first, with counts; only distinct survivors
are made canonical; a second grouping on the full canonical text sums the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import materialize


def canonical_text(c: Column) -> Column:
    """Lower case, without white space and punctuation (Unicode category P)."""
    return F.regexp_replace(F.lower(c), "(?U)[\\s\\x1c-\\x1f\\p{P}]+", "")


def canonical_json(c: Column) -> Column:
    """One spelling of a JSON value: sorted fields, no blanks, no escapes.

    Text that is no JSON, or more than one value, stands for itself; a leading mark keeps
    it apart from JSON.
    """
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    at = lambda i: F.try_variant_get(v, f"$[{i}]", "variant")
    one = at(0).isNotNull() & at(1).isNull()
    return F.coalesce(F.when(one, F.to_json(v)), F.concat(F.lit("\u0001"), c))


def _raw_key(text: str, record: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.coalesce(F.sha2(F.col(text), 256), F.lit("-")), F.coalesce(F.sha2(F.col(record), 256), F.lit("-"))), 256)


def formatting_classes(df: DataFrame, key: str, text: str, record: str) -> tuple[DataFrame, DataFrame]:
    """``(classes, variants)`` of rows that differ only in formatting.

    classes: ``representative`` (smallest key), ``copies``. variants: ``raw_key`` of each
    distinct raw row -> ``representative``. A null ``text`` is a copy of nothing and is
    in neither; a null ``record`` agrees with a null ``record`` only.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), F.col(record).cast("string").alias("__record"))
    raw = rows.groupBy("__text", "__record").agg(F.count(F.lit(1)).alias("n"), F.min("__key").alias("first"))
    canon = raw.select(
        _raw_key("__text", "__record").alias("raw_key"), "n", "first",
        canonical_text(F.col("__text")).alias("canon_text"), canonical_json(F.col("__record")).alias("canon_record"),
    )
    canon = materialize(canon, "canon")  # read for the classes and for the variants
    by_form = canon.groupBy("canon_text", "canon_record").agg(F.min("first").alias("representative"), F.sum("n").alias("copies"))
    classes = by_form.select("representative", "copies")
    several = by_form.where(F.col("copies") > 1).withColumnsRenamed({"canon_text": "ct", "canon_record": "cr"})
    variants = canon.join(several, (F.col("canon_text") == F.col("ct")) & F.col("canon_record").eqNullSafe(F.col("cr"))).select("raw_key", "representative")
    return classes, variants


def copy_pairs(df: DataFrame, key: str, text: str, record: str) -> DataFrame:
    """``(row_id_a, row_id_b)``: the smallest key of a class and each other key of it."""
    _, variants = formatting_classes(df, key, text, record)
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("row_id_b"), _raw_key(text, record).alias("raw_key"))
    return rows.join(variants, "raw_key").where(F.col("row_id_b") != F.col("representative")).select(F.col("representative").alias("row_id_a"), "row_id_b")
