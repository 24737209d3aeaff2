"""The same results kept incrementally with Structured Streaming.

Each function starts from a streaming DataFrame and ends in a table of the shared folder;
``available_now`` runs what is there and stops, so a rerun with the same checkpoint picks
up where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.session import scratch_path


def stream_table(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A Parquet folder or file as a stream of its files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        watched = f"{path[:-1]}[{path[-1]}]"  # the stream source takes folders and patterns
    else:
        watched = path
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(watched)


def available_now(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run to the end of the available input and read the result back.

    Append streams go to a Parquet folder with exactly-once files; update streams write
    each batch to its own folder, so a repeated batch replaces itself, and the newest
    version of each row is taken by ``latest_update``.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    out = out or scratch_path(spark, name)
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(lambda df, i: df.withColumn("__batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.schema(spark.createDataFrame([], stream.schema).withColumn("__batch", F.lit(0).cast("bigint")).schema).parquet(f"{out}/batch=*")


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of an update stream's rows the newest per key."""
    rest = [c for c in updates.columns if c not in (*keys, "__batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("x")).select(*keys, "x.*")


def first_seen(stream: DataFrame, keys: list[str], at: str | None = None, late: str | None = None) -> DataFrame:
    """The first arrival of each key; with an event time, state is kept for ``late`` only."""
    if at is None:
        return stream.dropDuplicates(keys)
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.dropDuplicatesWithinWatermark(keys)


def best_so_far(stream: DataFrame, key: str, loss: str, carry: list[str]) -> DataFrame:
    """Running least loss per key (an update stream)."""
    ok = F.col(loss).isNotNull() & ~F.isnan(F.col(loss))
    return stream.where(ok).groupBy(key).agg(F.min(F.struct(loss, *carry)).alias("b")).select(key, "b.*")


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Tumbling counts with late data up to ``late``; windows are final once the watermark passes."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def failures(stream: DataFrame, key: str, order: str, failed: str, in_a_row: int = 2) -> DataFrame:
    """``(key, at, run)``: each time a key reaches ``in_a_row`` failures in a row (state: the current run)."""
    kinds = dict(stream.dtypes)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for at, bad in zip(rows[order], rows[failed]):
            run = run + 1 if bad else 0
            if run == in_a_row:
                out.append((group[0], at, run))
        state.update((run,))
        yield pd.DataFrame(out, columns=[key, "at", "run"])

    return stream.select(key, order, failed).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, at {kinds[order]}, run int", "run int", "append", GroupStateTimeout.NoTimeout
    )


def settled(stream: DataFrame, key: str, order: str, value: str, times: int = 2) -> DataFrame:
    """``(key, value, at)``: a key's value once it was seen unchanged ``times`` times in a row, once per value."""
    kinds = dict(stream.dtypes)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for at, v in zip(rows[order], rows[value]):
            count = count + 1 if last is not None and v == last else 1
            last = v
            if count == times:
                out.append((group[0], v, at))
        state.update((last, count))
        yield pd.DataFrame(out, columns=[key, "value", "at"])

    return stream.select(key, order, value).where(F.col(value).isNotNull()).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, value {kinds[value]}, at {kinds[order]}", f"last {kinds[value]}, count int", "append", GroupStateTimeout.NoTimeout
    )


def queue(stream: DataFrame, key: str, order: str, item: str, size: int) -> DataFrame:
    """``(key, items)``: each key's last ``size`` items, oldest first (a bounded first-in first-out queue)."""
    kinds = dict(stream.dtypes)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("__order")
        held = (held + rows["__item"].tolist())[-size:]
        state.update((held,))
        yield pd.DataFrame({key: [group[0]], "items": [held]})

    return stream.select(key, F.col(order).alias("__order"), F.col(item).alias("__item")).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, items array<{kinds[item]}>", f"items array<{kinds[item]}>", "update", GroupStateTimeout.NoTimeout
    )
