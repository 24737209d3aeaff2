"""Problem 6: bring visually identical text to one form.

Method: texts are cut in runs; a run of characters that may change (plus the one
character before it, which a following accent may compose with) is exploded to
positioned code points, broadcast-joined with the decomposition and look-alike table
(about 4,000 rows, bounded by Unicode), combining marks are put in order of their
class, pairs are recomposed and the strings rebuilt. Runs of characters that have no
entry in any table are copied, because every step is the identity on them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.glyphs import java_common, tables
from pairloom.operators.joins import join_members
from pairloom.session import materialize

_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00


def _mapping_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    t = tables()
    spell = [(chr(cp), [chr(x) for x in to]) for cp, to in t["split"].items()]
    second = {b for _, b in t["pairs"]}
    marks = [(chr(cp), t["marks"].get(cp, 0), cp in second) for cp in set(t["marks"]) | second]
    return (
        spark.createDataFrame(spell, "src string, spelling array<string>"),
        spark.createDataFrame(marks, "mark string, ccc int, composes boolean"),
    )


def _char(cp):
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def _recompose(points):
    """Fold ordered (ccc, composes, ch) structs to a composed string."""
    pairs = F.from_json(
        F.lit(json.dumps({chr(a) + chr(b): chr(c) for (a, b), c in tables()["pairs"].items()})), "map<string,string>"
    )
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    def step(s, x):
        b, c = F.ascii(s["base"]), F.ascii(x["ch"])
        is_lv = b.between(_L, _L + 18) & c.between(_V, _V + 20)
        is_lvt = b.between(_S, 0xD7A3) & ((b - _S) % 28 == 0) & c.between(_T + 1, _T + 27)
        open_ = (s["marks"] == "") | ((s["last"] < x["ccc"]) & (x["ccc"] > 0))
        made = (
            F.when(~open_ | (s["base"] == ""), F.lit(None))
            .when(is_lv, _char(F.lit(_S) + ((b - _L) * 21 + (c - _V)) * 28))
            .when(is_lvt, _char(b + c - _T))
            .when(x["composes"], F.element_at(pairs, F.concat(s["base"], x["ch"])))
        )
        joined = F.struct(s["done"].alias("done"), made.alias("base"), s["marks"].alias("marks"), s["last"].alias("last"))
        starts = F.struct(
            F.concat(s["done"], s["base"], s["marks"]).alias("done"),
            x["ch"].alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"),
        )
        hangs = F.struct(
            s["done"].alias("done"), s["base"].alias("base"),
            F.concat(s["marks"], x["ch"]).alias("marks"), x["ccc"].alias("last"),
        )
        return F.when(made.isNotNull(), joined).when(x["ccc"] == 0, starts).otherwise(hangs)

    return F.aggregate(points, zero, step, lambda s: F.concat(s["done"], s["base"], s["marks"]))


def plain_clusters(clusters: DataFrame) -> DataFrame:
    """``clusters(token)`` distinct short strings -> ``(token, plain_token)``."""
    spark = clusters.sparkSession
    spell, marks = _mapping_tables(spark)
    points = clusters.select("token", F.posexplode(F.regexp_extract_all("token", F.lit("(?s)."), 0)).alias("pos", "ch0"))
    spelled = points.join(F.broadcast(spell), F.col("ch0") == F.col("src"), "left").select(
        "token", "pos", F.posexplode(F.coalesce("spelling", F.array("ch0"))).alias("sub", "ch")
    )
    classed = spelled.join(F.broadcast(marks), F.col("ch") == F.col("mark"), "left").select(
        "token", "pos", "sub", "ch", F.coalesce("ccc", F.lit(0)).alias("ccc"), F.coalesce("composes", F.lit(False)).alias("composes")
    )
    run = Window.partitionBy("token").orderBy("pos", "sub")
    blocks = classed.withColumn("block", F.sum((F.col("ccc") == 0).cast("int")).over(run))
    ordered = blocks.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("block", "ccc", "pos", "sub", "ch", "composes"))).alias("points"))
    return ordered.select("token", _recompose(F.col("points")).alias("plain_token"))


def plain_form(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Long table ``(key, field, stored, plain)`` with one row per row and non-null text.

    Null texts give no row; empty and blank texts give their own plain form; repeated keys
    keep their rows. Other columns of ``df`` are not carried, so their names cannot clash.
    Copies of an unusual text are worked on once.
    """
    long = df.select(
        F.col(key).alias("__key"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("stored")) for c in columns])).alias("t"),
    ).select("__key", "t.field", "t.stored").where(F.col("stored").isNotNull())
    common = java_common()
    odd = F.col("stored").rlike(f"[^{common}]")
    # a run to copy ends before the character that an unusual one may compose with
    pattern = f"(?s)[{common}]?[^{common}]+|[{common}]+?(?=[{common}][^{common}]|\\z)"
    texts = long.where(odd).select(F.sha2("stored", 256).alias("id"), "stored").dropDuplicates(["id"])
    tokens = texts.select("id", F.posexplode(F.regexp_extract_all("stored", F.lit(pattern), 0)).alias("at", "token"))
    tokens = materialize(tokens.withColumn("unusual", F.col("token").rlike(f"[^{common}]")), "tokens")
    plain = plain_clusters(tokens.where("unusual").select("token").distinct())
    rebuilt = (
        tokens.join(plain.withColumnRenamed("token", "__t"), F.col("unusual") & (F.col("token") == F.col("__t")), "left")
        .withColumn("piece", F.when(F.col("unusual"), F.coalesce("plain_token", F.lit(""))).otherwise(F.col("token")))
        .groupBy("id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("plain"))
    )
    odd_rows = long.where(odd).withColumn("id", F.sha2("stored", 256)).join(rebuilt, "id").select("__key", "field", "stored", "plain")
    same = long.where(~odd).select("__key", "field", "stored", F.col("stored").alias("plain"))
    return same.unionByName(odd_rows).withColumnRenamed("__key", key)


def same_look_pairs(forms: DataFrame, key: str) -> DataFrame:
    """``(field, row_id_a, row_id_b)``: rows whose text is equal in plain form but not as stored.

    Input is ``plain_form``'s table. Forms are known by two 64-bit hashes. Forms with one
    spelling drop out before anything is paired, so exact copies alone make no pairs; the
    spellings of a form are paired, then expanded to their rows, in pieces where a spelling
    has many. Each pair of rows comes out once, smaller key first. Blank texts (in plain
    form) are no cases.
    """
    used = forms.where(F.col("plain").rlike("(?U)[^\\s]"))
    twice = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(1), c))
    (p1, p2), (v1, v2) = twice("plain"), twice("stored")
    ids = materialize(used.select(F.col(key).alias("row_id"), "field", p1.alias("p1"), p2.alias("p2"), v1.alias("v1"), v2.alias("v2")), "forms")
    look = ["field", "p1", "p2"]
    spelt = ids.groupBy(*look).agg(*[f(v).alias(f"{n}{v}") for v in ("v1", "v2") for n, f in (("lo", F.min), ("hi", F.max))])
    mixed = spelt.where("lov1 <> hiv1 or lov2 <> hiv2").select(*look)
    rows = materialize(ids.join(mixed, look, "left_semi").withColumn("v", F.xxhash64("field", "p1", "p2", "v1", "v2")), "spelt")
    kinds = rows.groupBy(*look, "v").agg(F.count(F.lit(1)).alias("n"))
    a, b = kinds.select(*look, F.col("v").alias("va")), kinds.select(*look, F.col("v").alias("vb"))
    pairs = a.join(b, look).where("va < vb").select("field", "va", "vb")  # spellings of one form, each pair once
    left = join_members(pairs, "va", rows.select(F.col("v").alias("va"), F.col("row_id").alias("ra")), "ra")
    both = join_members(left, "vb", rows.select(F.col("v").alias("vb"), F.col("row_id").alias("rb")), "rb")
    return both.select("field", F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b")).where("row_id_a <> row_id_b")
