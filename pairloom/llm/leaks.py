"""Problem 3: evaluation passages inside a training corpus.

Method: Wu-Manber multi-pattern search (``wumanber``). Patterns are whole bare queries,
and the aligned blocks of ``run // 2`` characters of every bare positive: any ``run``
characters in a row that a document shares with a positive cover one such block. There is
one table a length class, of bounded size for any number of patterns, and a document meets
it once. Buckets are chosen by the hash of a pattern's whole first window, of which the
suffix block is a part. Direct comparison, as equality joins on the text, confirms
occurrences; a block that many positives and documents share is compared by its ``run``
characters, not pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.wumanber import CLASSES, Table, block_slots, bucket_bits, buckets_of, codes_of, length_class, pattern_rows, prefix_sums, reach_slot, table_bytes
from pairloom.operators.joins import join_members
from pairloom.session import materialize, put_bytes

SLICE_CHARS = 4_000_000
#: A block with more pairs of places than this is compared by all its ``run`` characters.
HOT_PAIRS = 1_000_000


def _bare_items(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from pairloom.llm.glyphs import bare_bodies, bare_texts

    for b in batches:
        q, p = bare_bodies(b.column(1).to_pylist()), bare_texts(b.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(q, pa.string()), pa.array(p, pa.string())], ["row_id", "q", "p"])


def bare_items(rows: DataFrame) -> DataFrame:
    """``(row_id, q, p)``: bare query (without a stored instruction) and positive of rows ``(row_id, query, positive)``."""
    return rows.select("row_id", "query", "positive").mapInArrow(_bare_items, "row_id bigint, q string, p string")


def patterns_of(items: DataFrame, run: int) -> DataFrame:
    """Distinct ``(kind, m, text)``: whole queries ('q') and aligned blocks of positives ('p')."""
    size = run // 2
    m = F.lit(CLASSES[0][0])
    for low, _ in CLASSES[1:]:
        m = F.when(F.length("text") >= low, low).otherwise(m)
    whole = items.where(F.length("q") > 0).select(F.lit("q").alias("kind"), F.col("q").alias("text")).withColumn("m", m)
    blocks = positive_blocks(items.select("p").distinct(), run).select(F.lit("p").alias("kind"), F.col("block").alias("text"), F.lit(size).alias("m"))
    return whole.select("kind", "m", "text").unionByName(blocks.select("kind", "m", "text")).distinct()


def positive_blocks(positives: DataFrame, run: int) -> DataFrame:
    """``(p, block, before, after)``: aligned blocks of each positive of ``run`` characters or more."""
    size = run // 2
    cut = positives.where(F.length("p") >= run).select("p", F.explode(F.sequence(F.lit(0), F.expr(f"length(p) - {size}"), F.lit(size))).alias("at"))
    return cut.select(
        "p", F.substring("p", F.col("at") + 1, F.lit(size)).alias("block"),
        F.substring("p", F.greatest(F.lit(1), F.col("at") + 1 - size), F.least(F.lit(size), F.col("at"))).alias("before"),
        F.substring("p", F.col("at") + 1 + size, F.lit(size)).alias("after"),
    )


PIECE = 1 << 16  # bytes of a bucket table made at once


def _pattern_parts(bits: dict[tuple[str, int], int]):
    """Rows of the tables: ('s', slot, shift), ('r', slot, length), ('b', piece, bucket in it)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            kind, m, text = (batch.column(i).to_pylist() for i in range(3))
            groups: dict = {}
            for k, mm, t in zip(kind, m, text):
                groups.setdefault((k, mm), []).append(t)
            for (k, mm), texts in groups.items():
                h, slots, shifts = pattern_rows([t[:mm] for t in texts], mm, length_class(mm)[1])
                spans = np.array([len(t) for t in texts], dtype="int64")
                bucket = np.unique(np.concatenate(buckets_of(h, bits[k, mm])))
                for what, a, v in (("s", slots, shifts), ("r", reach_slot(h), spans), ("b", bucket // (8 * PIECE), bucket % (8 * PIECE))):
                    n = len(a)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * n), pa.array([mm] * n, pa.int32()), pa.array([what] * n), pa.array(a), pa.array(v)], ["kind", "m", "what", "a", "v"])

    return run


def _packed(key, t):
    import numpy as np
    import pyarrow as pa

    piece = np.zeros(8 * PIECE, dtype=bool)
    piece[t.column("v").to_numpy()] = True
    return pa.table({"kind": [key[0].as_py()], "m": pa.array([key[1].as_py()], pa.int32()), "a": [key[2].as_py()], "data": pa.array([np.packbits(piece, bitorder="little").tobytes()], pa.binary())})


def build_tables(patterns: DataFrame) -> list[tuple[str, str]]:
    """``(kind, file name)`` of the table of every length class; a file has a fixed size at most."""
    import numpy as np

    spark = patterns.sparkSession
    patterns = materialize(patterns, "patterns")
    sizes = {(r["kind"], r["m"]): r["n"] for r in patterns.groupBy("kind", "m").agg(F.count(F.lit(1)).alias("n")).collect()}
    bits = {k: bucket_bits(n) for k, n in sizes.items()}
    parts = patterns.mapInArrow(_pattern_parts(bits), "kind string, m int, what string, a bigint, v bigint")
    parts = materialize(parts.groupBy("kind", "m", "what", "a", F.when(F.col("what") == "b", F.col("v")).alias("bucket")).agg(F.min("v").alias("low"), F.max("v").alias("high")), "tables")
    buckets = parts.where("what = 'b'").select("kind", "m", "a", F.col("low").alias("v")).groupBy("kind", "m", "a").applyInArrow(_packed, "kind string, m int, a bigint, data binary")
    buckets = materialize(buckets, "buckets")
    files = []
    for kind, m in sorted(sizes):  # two kinds by the length classes
        mine = lambda t: t.where((F.col("kind") == kind) & (F.col("m") == m))  # noqa: B023, E731
        # at most 2**21 shifts, 2**18 lengths and 2**29 bits: numbers of a fixed count, no texts
        col = lambda t, c: t.column(c).to_numpy().astype("int64")
        s, r = (mine(parts).where(F.col("what") == x).select("a", "low", "high").toArrow() for x in "sr")
        data = bytearray(1 << bits[kind, m] - 3)
        for x in mine(buckets).toLocalIterator():
            piece = memoryview(x["data"])[: len(data)]
            data[x["a"] * PIECE : x["a"] * PIECE + len(piece)] = piece
        made = table_bytes(m, length_class(m)[1], col(s, "a"), col(s, "low").astype("uint8"), (col(r, "a"), np.minimum(col(r, "high"), 2**31 - 1)), bits[kind, m], bytes(data))
        path = put_bytes(spark, f"wm-{kind}-{m}", made)
        spark.sparkContext.addFile(path)
        files.append((kind, path.rsplit("/", 1)[1]))
    return files


def _scan(files: list[tuple[str, str]], size: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from pairloom.llm.glyphs import bare_texts

        tables = [(kind, Table(SparkFiles.get(name))) for kind, name in files]

        def search(keys: list, texts: list[str]):
            codes, start = codes_of(texts)
            sums, slots = prefix_sums(codes), {b: block_slots(codes, b) for b in {t.b for _, t in tables}}
            for kind, t in tables:
                at, reach = t.search(codes, slots[t.b], sums)
                if not len(at):
                    continue
                doc = np.searchsorted(start, at, "right") - 1
                seen, out = set(), ([], [], [], [], [])
                for d, i, n in zip(doc.tolist(), (at - start[doc]).tolist(), reach.tolist()):
                    text = texts[d]
                    if kind == "q":
                        row = (d, text[i : i + t.m], text[i : i + n], "")
                    else:
                        row = (d, text[i : i + t.m], text[max(0, i - size) : i], text[i + t.m : i + t.m + size])
                    if row in seen:
                        continue
                    seen.add(row)
                    for col, v in zip(out, (keys[d], kind, *row[1:])):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], ["doc_id", "kind", "window", "x", "y"])

        for batch in batches:
            keys, texts, chars = [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), bare_texts(batch.column(1).to_pylist())):
                if not t:
                    continue
                keys.append(k)
                texts.append(t)
                chars += len(t)
                if chars > SLICE_CHARS:
                    yield from search(keys, texts)
                    keys, texts, chars = [], [], 0
            if texts:
                yield from search(keys, texts)

    return run


def _by_query(hits: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, row_id)``: a hit's text begins with the whole query. Only the lengths that queries
    of a window have are tried, so queries with one beginning are not met one by one."""
    m = F.lit(CLASSES[0][0])
    for low, _ in CLASSES[1:]:
        m = F.when(F.length("q") >= low, low).otherwise(m)
    asked = items.where(F.length("q") > 0).select("q", F.substring("q", F.lit(1), m).alias("window"), F.length("q").alias("n"))
    lengths = asked.groupBy("window").agg(F.collect_set("n").alias("lengths"))
    tried = hits.join(lengths, "window").select("doc_id", "x", F.explode("lengths").alias("n")).where("length(x) >= n")
    tried = tried.select("doc_id", F.sha2(F.expr("left(x, n)"), 256).alias("qid")).distinct()
    return join_members(tried, "qid", items.where(F.length("q") > 0).select(F.sha2("q", 256).alias("qid"), "row_id"), "row_id").select("doc_id", "row_id")


def _by_run(hits: DataFrame, items: DataFrame, run: int, hot_pairs: int) -> DataFrame:
    """``(doc_id, row_id)``: ``run`` characters around a hit equal those around a block of a positive."""
    size = run // 2
    blocks = positive_blocks(items.select("p").distinct(), run).select(F.sha2("p", 256).alias("pid"), F.col("block").alias("window"), "before", "after")
    count = lambda t, n: t.groupBy("window").agg(F.count(F.lit(1)).alias(n))
    hot = materialize(count(hits, "nh").join(count(blocks, "nb"), "window").where(F.col("nh") * F.col("nb") > hot_pairs).select("window"), "hot")
    some = not hot.isEmpty()
    light = (lambda t: t.join(hot, "window", "left_anti")) if some else (lambda t: t)
    ways = F.expr(
        f"exists(sequence(0, {size}), k -> length(x) >= k and length(before) >= k and right(x, k) = right(before, k)"
        f" and length(y) >= {size} - k and length(after) >= {size} - k and left(y, {size} - k) = left(after, {size} - k))"
    )
    met = light(hits).join(light(blocks), "window").where(ways).select("doc_id", "pid")
    if some:

        def runs(t: DataFrame, key: str, left: str, right: str) -> DataFrame:
            """Digests of all ``run`` characters that hold the block."""
            text, at = F.concat(left, "window", right), F.sequence(F.lit(0), F.length(left) + F.length(right) - size)
            cut = t.join(hot, "window", "left_semi").where(F.length(left) + F.length(right) >= size).select(key, text.alias("t"), F.explode(at).alias("at"))
            return cut.select(key, F.sha2(F.substring("t", F.col("at") + 1, F.lit(run)), 256).alias("run")).distinct()

        met = met.unionByName(join_members(runs(hits, "doc_id", "x", "y"), "run", runs(blocks, "pid", "before", "after"), "pid").select("doc_id", "pid"))
    members = items.where(F.col("p").isNotNull()).select(F.sha2("p", 256).alias("pid"), "row_id")
    return join_members(met.distinct(), "pid", members, "row_id").select("doc_id", "row_id")


def leaks(documents: DataFrame, rows: DataFrame, run: int = 60, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Distinct ``(doc_id, row_id)``: the document contains the row's whole bare query, or
    shares at least ``run`` bare characters in a row with its positive.

    ``documents(doc_id, text)``, ``rows(row_id, query, positive)``. Rows with an empty bare query are matched by their positive only.
    ``run`` must be even. Empty tables give no rows.
    """
    items = materialize(bare_items(rows), "items")
    files = build_tables(patterns_of(items, run))
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    hits = materialize(docs.mapInArrow(_scan(files, run // 2), "doc_id bigint, kind string, window string, x string, y string"), "hits")
    return _by_query(hits.where("kind = 'q'"), items).unionByName(_by_run(hits.where("kind = 'p'"), items, run, hot_pairs)).distinct()
