"""Sections of Markdown-like text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import strip


def lines_of(c: Column) -> Column:
    return F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1)


def heading_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, section, heading, body, body_chars)``: section 0 is the text before the first heading."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(lines_of(F.col(text))).alias("at", "line"))
    head = F.col("line").rlike("^#{1,6} +[^ ]")
    upto = Window.partitionBy(key).orderBy("at")
    numbered = lines.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(upto))
    return numbered.groupBy(key, "section").agg(
        F.max(F.when(F.col("head"), strip(F.regexp_replace("line", "^#+ +| *#*$", "")))).alias("heading"),
        F.coalesce(F.sum(F.when(~F.col("head"), F.length("line"))), F.lit(0)).alias("body_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("at", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )


def articles(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, article, title, body)`` of law-like texts: an article runs from its heading to
    the next article or heading; of equal article numbers the first counts."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(lines_of(F.col(text))).alias("at", "line"))
    start = F.col("line").rlike(r"^제\d+조") | F.col("line").rlike("^#{1,2} ")
    upto = Window.partitionBy(key).orderBy("at")
    cut = lines.withColumn("start", start).withColumn("part", F.sum(F.col("start").cast("int")).over(upto))
    whole = cut.groupBy(key, "part").agg(
        F.min("at").alias("at"), F.min_by("line", "at").alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"),
    )
    named = whole.withColumn("article", F.regexp_extract("first", r"^제(\d+)조", 1)).where("article <> ''")
    first = Window.partitionBy(key, "article").orderBy("at")
    return named.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(
        key, F.col("article").cast("bigint").alias("article"), F.regexp_extract("first", r"^제\d+조\(([^)]*)\)", 1).alias("title"), "body"
    )


def front_matter(c: Column) -> tuple[Column, Column]:
    """(metadata map, body) of a text that may start with a ``---`` block of ``key: value`` lines."""
    flat = F.regexp_replace(c, "\r\n?", "\n")
    block = F.regexp_extract(flat, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: F.locate(":", x) > 0)
    entries = F.transform(pairs, lambda x: F.struct(strip(F.substring_index(x, ":", 1)), strip(F.regexp_replace(x, "^[^:]*:", ""))))
    meta = F.map_from_entries(F.when(F.size(entries) > 0, entries).otherwise(F.array().cast("array<struct<col1:string,col2:string>>")))
    return meta, F.regexp_replace(flat, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
