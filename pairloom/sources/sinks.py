"""Sinks: versioned tables with a manifest, digest lists, BEIR folders, Markdown tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import put_bytes


def content_digest(df: DataFrame) -> str:
    """Order-free digest of a table: row digests are summed in two halves, so partial sums do."""
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)"))
    r = df.agg(part(1).alias("a"), part(13).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return f"{int(r['a'] or 0):x}-{int(r['b'] or 0):x}-{r['n']}"


def write_versioned(df: DataFrame, root: str, version: str, **about: object) -> dict:
    """Write ``root/version`` as Parquet and its manifest beside it; a finished version is never written again.

    The job's commit makes the data appear at once; the manifest is written after it, so
    a folder without manifest is unfinished and may be replaced.
    """
    spark, path = df.sparkSession, f"{root}/{version}"
    if (done := manifest(spark, root, version)) is not None:
        if content_digest(spark.read.parquet(path)) != done["digest"]:
            raise ValueError(f"{path} is not what its manifest says")
        return done
    df.write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    made = {"version": version, "rows": written.count(), "digest": content_digest(written), "columns": written.columns, **about}
    _put(spark, f"{root}/{version}.manifest.json", json.dumps(made, sort_keys=True, ensure_ascii=False))
    return made


def _put(spark, path: str, text: str) -> None:
    """Write a small file beside ``path`` and rename it over: a reader sees the old text or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".writing")
    out = p.getFileSystem(conf).create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = p.getFileSystem(conf).makeQualified(p)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(p.getFileSystem(conf).makeQualified(tmp), qualified, over)


def manifest(spark, root: str, version: str) -> dict | None:
    """The manifest of a finished version, or None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{version}.manifest.json")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return json.loads(spark.read.text(p.toString(), wholetext=True).first()[0])


def resume(todo: DataFrame, done: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows not yet done under this run's fingerprint; results of other runs do not count."""
    return todo.join(done.where(F.col("fingerprint") == fingerprint).select(key), key, "left_anti")


def refresh_decision(found: dict | None, fingerprint: str, replace: bool) -> str:
    """write, skip, replace or error, by the manifest there is and what it was made from."""
    if found is None:
        return "write"
    if found.get("fingerprint") == fingerprint:
        return "skip"
    return "replace" if replace else "error"


def write_digest_lists(blocked: DataFrame, root: str) -> None:
    """Sorted gzipped digest lines, one folder per protocol, task and kind."""
    cut = blocked.dropDuplicates(["protocol", "task", "kind", "sha256"]).repartition("protocol", "task", "kind").sortWithinPartitions("protocol", "task", "kind", "sha256")
    cut.write.mode("overwrite").partitionBy("protocol", "task", "kind").option("compression", "gzip").text(root)


def write_beir(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, root: str) -> None:
    """queries, corpus (JSON lines) and judgements (TSV) under their usual names."""
    queries.withColumnRenamed("query_id", "_id").write.mode("overwrite").json(f"{root}/queries.jsonl")
    corpus.withColumnRenamed("corpus_id", "_id").write.mode("overwrite").json(f"{root}/corpus.jsonl")
    named = qrels.select(F.col("query_id").alias("query-id"), F.col("corpus_id").alias("corpus-id"), "score")
    named.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{root}/qrels/test.tsv")


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small report table as Markdown; more than ``most`` rows are data and no report: an error."""
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    rows = [df.columns, ["---"] * len(df.columns)] + [[cell(v) for v in r] for r in found]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def between_markers(document: str, name: str, content: str) -> str:
    """``document`` with the text between ``<!-- name:begin -->`` and ``<!-- name:end -->`` replaced."""
    rx = re.compile(rf"(<!-- {re.escape(name)}:begin -->).*?(<!-- {re.escape(name)}:end -->)", re.S)
    if not rx.search(document):
        raise ValueError(f"no markers {name!r}")
    return rx.sub(lambda m: f"{m[1]}\n{content}\n{m[2]}", document)


__all__ = ["between_markers", "content_digest", "manifest", "markdown_table", "put_bytes", "refresh_decision", "resume", "write_beir", "write_digest_lists", "write_versioned"]
