"""Problem 4: the N best items of every group.

Method: the counted rows are written clustered by group: all rows of a group are in one file
(a hot group in several, by a hash), and inside a file rows come in falling bands of score, in
Parquet with small row groups. Each file is then read from its footer statistics: row groups
in order of falling maximum score, leaving out those whose maximum lies strictly below the
current N-th score of every group they contain. Which groups a row group contains is read from
its group column alone. So of a file with many groups only the upper bands are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.joins import hot_keys, with_pieces
from pairloom.session import scratch_path

#: Bands of score between the median and the maximum; what lies below is one band.
BANDS = 64
#: Rows kept before they are cut to the N best of each group again.
HELD_ROWS = 200_000


def latest_per_item(df: DataFrame, group: str, item: str, at: str, key: str, score: str) -> DataFrame:
    """The row with the latest ``at`` (then the highest ``key``) per group and item."""
    when = F.coalesce(F.col(at).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    best = F.max(F.struct(when.alias("w"), F.col(key).alias("k"), F.col(score).cast("double").alias("s")))
    return df.groupBy(F.col(group).alias("grp"), F.col(item).alias("item")).agg(best.alias("b")).select("grp", "item", F.col("b.k").alias("row_key"), F.col("b.s").alias("score"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def write_clustered(rows: DataFrame, hot: DataFrame, low: float, high: float, name: str, row_group_bytes: int = 1 << 18) -> str:
    """Write ``(grp, item, row_key, score)``, a group to a file and bands of score inside; returns the folder.

    ``hot``: table of ``hot_keys`` of the groups; such a group is spread over several files, so no task
    holds an unbounded group. ``low``, ``high``: scores between which bands lie; they decide on
    the work alone.
    """
    path = scratch_path(rows.sparkSession, name)
    rows = rows.withColumn("score", F.col("score") + F.lit(0.0))
    band = F.width_bucket("score", F.lit(low), F.lit(high), F.lit(BANDS)) if low < high else F.lit(0)
    (
        with_pieces(rows, "grp", hot, ["row_key", "item"])
        .withColumn("__band", F.coalesce(band.cast("int"), F.lit(0)))
        .repartition("grp", "__salt")
        .sortWithinPartitions(F.col("__band").desc())
        .select("grp", "item", "row_key", "score")
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.block.size.row.check.min", 100)
        .option("parquet.page.size.row.check.min", 100)
        .parquet(path)
    )
    return path


def _open(uri: str):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, path = pafs.FileSystem.from_uri(uri)
    return pq.ParquetFile(path, filesystem=fs)


def _best(t, n: int):
    """The first ``n`` rows of each group of an Arrow table, in order; and their ranks from 0."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    group = t.column("grp").combine_chunks().dictionary_encode(null_encoding="encode").indices
    order = pc.sort_indices(
        pa.table({"g": group, "s": pc.negate(t.column("score")), "item": t.column("item"), "k": t.column("row_key")}),
        [("g", "ascending"), ("s", "ascending"), ("item", "ascending"), ("k", "ascending")], null_placement="at_end",
    )
    g = group.take(order).to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.array([], "int64")
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    kept = np.flatnonzero(rank < n)
    return t.take(order.take(pa.array(kept))), rank[kept]


def skim(file, n: int, read: list | None = None):
    """Rows of a ``pyarrow.parquet.ParquetFile`` that may be among the ``n`` best of their group: an Arrow table.

    ``read``: gets the numbers of the row groups that were read.
    """
    import numpy as np
    import pyarrow as pa

    meta, si = file.metadata, file.schema_arrow.names.index("score")
    tops = []
    for i in range(meta.num_row_groups):
        s = meta.row_group(i).column(si).statistics
        tops.append((s.max if s is not None and s.has_min_max else float("inf"), i))
    number: dict = {}  # group -> its line in ``best``
    best = np.full((256, n), -np.inf)
    kept, held = [], 0
    for top, i in sorted(tops, key=lambda x: (-x[0], x[1])):
        there = file.read_row_group(i, columns=["grp"]).column("grp").combine_chunks().unique().to_pylist()
        lines = np.array([number.setdefault(x, len(number)) for x in there], dtype="int64")
        while len(best) < len(number):
            best = np.concatenate([best, np.full_like(best, -np.inf)])
        if not (best[lines, -1] <= top).any():
            continue
        if read is not None:
            read.append(i)
        found, rank = _best(file.read_row_group(i, columns=["grp", "item", "row_key", "score"]), n)
        codes = found.column("grp").combine_chunks().dictionary_encode(null_encoding="encode")
        line = np.array([number[x] for x in codes.dictionary.to_pylist()], dtype="int64")[codes.indices.to_numpy(zero_copy_only=False)]
        score = found.column("score").to_numpy()
        mine, at = np.unique(line, return_inverse=True)
        here = np.full((len(mine), n), -np.inf)
        here[at, rank] = score
        best[mine] = -np.sort(-np.concatenate([best[mine], here], axis=1), axis=1)[:, :n]
        found = found.filter(pa.array(score >= best[line, -1]))
        kept.append(found)
        held += found.num_rows
        if held > HELD_ROWS:
            kept = [_best(pa.concat_tables(kept), n)[0]]
            held = kept[0].num_rows
    return _best(pa.concat_tables(kept), n)[0] if kept else None


def _read_skipping(n: int):
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                found = skim(_open(uri), n)
                if found is not None:
                    yield from found.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def read_top_n(spark, path: str, n: int) -> DataFrame:
    """Top ``n`` per group from a folder of ``write_clustered``.

    Ties at equal score go to the smaller ``item`` in code points, a null item last; a
    null group counts as one group.
    """
    stored = spark.read.parquet(path)
    files = stored.select(F.col("_metadata.file_path").alias("uri")).distinct()
    part = files.repartition(F.col("uri")).mapInArrow(_read_skipping(n), stored.schema)
    order = Window.partitionBy("grp").orderBy(F.col("score").desc(), F.col("item").asc_nulls_last(), F.col("row_key"))
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_n(df: DataFrame, group: str, item: str, at: str, key: str, score: str, n: int = 5) -> DataFrame:
    """Latest row per item, finite scores only, N best per group: ``(grp, item, row_key, score, rank)``."""
    value = F.col(score).cast("double")
    low, high = df.where(finite(value)).agg(F.percentile_approx(value, 0.5, 200), F.max(value)).first()
    rows = latest_per_item(df, group, item, at, key, score).where(finite(F.col("score")))
    return read_top_n(df.sparkSession, write_clustered(rows, hot_keys(df, group), low or 0.0, high or 0.0, "topn"), n)
