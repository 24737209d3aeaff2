"""Vector operators: norms, exact and cell-pruned top-k, mining with exclusions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors sent to every task at once; more queries are searched in blocks.
BLOCK_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def normalized(a: Column) -> Column:
    """Unit vector; null for a zero or not finite vector."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")) & ~F.isnan(n), F.transform(a, lambda x: x / n))


def vector_problem(a: Column, dim: int, tolerance: float = 5e-3) -> Column:
    """missing, dimension, not_finite, zero or not_unit; null for a good vector."""
    n = norm(a)
    return (
        F.when(a.isNull(), "missing").when(F.size(a) != dim, "dimension")
        .when(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").when(n == 0, "zero").when(F.abs(n - 1) > tolerance, "not_unit")
    )


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[list, object]]:
    import numpy as np

    rows, ids = [], []
    for r in queries.select(key, vector).orderBy(key).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK_QUERIES:
            yield ids, np.asarray(rows, dtype="float64")
            rows, ids = [], []
    if ids:
        yield ids, np.asarray(rows, dtype="float64")


def top_k(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, label: str | None = None) -> DataFrame:
    """``(query_id, doc_id, score[, label], rank)``: the k best dot products of each query over all rows.

    The query set goes out in blocks of bounded size; each partition of the corpus keeps
    its own k best per query by a matrix product, and the partial lists are merged by a
    window. The query itself is left out; ties go to the smaller id.
    """
    kind = dict(corpus.dtypes)[key]
    out = None
    extra = f", label {dict(corpus.dtypes)[label]}" if label else ""
    cols = [key, vector] + ([label] if label else [])

    def searcher(ids, matrix):
        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            q_ids = np.asarray(ids)
            best: list = [None] * len(ids)
            id_type = tag_type = None
            for b in batches:
                id_type, tag_type = b.schema.field(0).type, b.schema.field(2).type if label else None
                doc = np.asarray(b.column(0).to_pylist())
                v = np.asarray(b.column(1).to_pylist(), dtype="float64")
                tags = np.asarray(b.column(2).to_pylist()) if label else None
                scores = np.round(matrix @ v.T, 12)
                for i in range(len(q_ids)):
                    s, d = scores[i], doc
                    keep = d != q_ids[i]
                    s, d, t = s[keep], d[keep], tags[keep] if label else None
                    if best[i] is not None:
                        s, d = np.r_[best[i][0], s], np.r_[best[i][1], d]
                        t = np.r_[best[i][2], t] if label else None
                    o = np.lexsort((d, -s))[:k]
                    best[i] = (s[o], d[o], t[o] if label else None)
            for i, x in enumerate(best):
                if x is not None and len(x[0]):
                    arrays = [pa.array([ids[i]] * len(x[0]), id_type), pa.array(x[1], id_type), pa.array(x[0])] + ([pa.array(x[2], tag_type)] if label else [])
                    names = ["query_id", "doc_id", "score"] + (["label"] if label else [])
                    schema = pa.schema([(n, a.type) for n, a in zip(names, arrays)])
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

        return run

    for ids, matrix in _blocks(queries, key, vector):
        part = corpus.where(F.col(vector).isNotNull()).select(*cols).mapInArrow(searcher(ids, matrix), f"query_id {kind}, doc_id {kind}, score double{extra}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return corpus.sparkSession.createDataFrame([], f"query_id {kind}, doc_id {kind}, score double{extra}, rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scores(batch, matrix, key_at: int = 0, vec_at: int = 1, label_at: int = 2):
    import numpy as np

    doc = np.asarray(batch.column(key_at).to_pylist())
    v = np.asarray(batch.column(vec_at).to_pylist(), dtype="float64")
    return doc, np.asarray(batch.column(label_at).to_pylist()), np.round(matrix @ v.T, 12)


def mine(queries: DataFrame, corpus: DataFrame, key: str, vector: str, label: str, ratio: float, pool: int) -> tuple[DataFrame, DataFrame]:
    """Hard negatives of each query: ``(query_id, doc_id, score, rank)`` and ``(query_id, why, n)``.

    Rows of the query's label are positives. The first pass finds the best positive score
    of each query, the second keeps per partition the ``pool`` best rows of other labels
    whose score lies strictly below ``ratio`` times it, and counts what was left out
    (query_match, too_close) or kept. Both passes hold a block of queries and its pools, no
    score table. A query without a positive gives nothing.
    """
    kinds = dict(corpus.dtypes)
    rows = corpus.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(key, vector, label)
    labels = queries.select(F.col(key).alias("query_id"), F.col(label).alias("ql"))
    picked = counted = None

    def best_positive(ids, tags, matrix):
        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            top, kind = np.full(len(ids), -np.inf), None
            for b in batches:
                kind = b.schema.field(0).type
                doc, tag, score = _scores(b, matrix)
                mine_ = (tag[None, :] == tags[:, None]) & (doc[None, :] != np.asarray(ids)[:, None])
                top = np.maximum(top, np.where(mine_, score, -np.inf).max(axis=1, initial=-np.inf))
            found = np.flatnonzero(top > -np.inf)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in found], kind), pa.array(top[found])], ["query_id", "p"])

        return run

    def pools(ids, tags, matrix, bound):
        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            best = [(np.array([]), np.array([], "int64"))] * len(ids)
            n, kind = np.zeros((len(ids), 3), dtype="int64"), None
            for b in batches:
                kind = b.schema.field(0).type
                doc, tag, score = _scores(b, matrix)
                for i in range(len(ids)):
                    if np.isnan(bound[i]):
                        continue
                    other = doc != ids[i]
                    same = other & (tag == tags[i])
                    keep = other & ~same & (score[i] < bound[i])
                    n[i] += (same.sum(), (other & ~same & ~keep).sum(), keep.sum())
                    s, d = np.r_[best[i][0], score[i][keep]], np.r_[best[i][1], doc[keep]] if len(best[i][1]) else doc[keep]
                    o = np.lexsort((d, -s))[:pool]
                    best[i] = (s[o], d[o])
            why = ["query_match", "too_close", "kept"]
            for i, (s, d) in enumerate(best):
                if kind is None or not n[i].any():
                    continue
                rows_ = [(ids[i], x, y, None, None) for x, y in zip(d.tolist(), s.tolist())] + [(ids[i], None, None, w, int(c)) for w, c in zip(why, n[i]) if c]
                cols = list(zip(*rows_))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], kind), pa.array(cols[1], kind), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())], ["query_id", "doc_id", "score", "why", "n"]
                )

        return run

    import numpy as np

    from pairloom.session import materialize

    tag_of = {r["query_id"]: r["ql"] for r in labels.toLocalIterator()}  # the stated query set
    for ids, matrix in _blocks(queries, key, vector):
        tags = np.asarray([tag_of[i] for i in ids])
        top = rows.mapInArrow(best_positive(ids, tags, matrix), f"query_id {kinds[key]}, p double").groupBy("query_id").agg(F.max("p").alias("p"))
        bounds = {r["query_id"]: r["p"] * ratio for r in top.collect()}  # one number a query of the block
        bound = np.asarray([bounds.get(i, np.nan) for i in ids])
        made = materialize(rows.mapInArrow(pools(ids, tags, matrix, bound), f"query_id {kinds[key]}, doc_id {kinds[key]}, score double, why string, n bigint"), "pools")
        p, c = made.where("why is null").select("query_id", "doc_id", "score"), made.where("why is not null").select("query_id", "why", "n")
        picked, counted = (p, c) if picked is None else (picked.unionByName(p), counted.unionByName(c))
    if picked is None:
        spark = corpus.sparkSession
        picked = spark.createDataFrame([], f"query_id {kinds[key]}, doc_id {kinds[key]}, score double")
        counted = spark.createDataFrame([], f"query_id {kinds[key]}, why string, n bigint")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    best = picked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)
    return best, counted.groupBy("query_id", "why").agg(F.sum("n").alias("n"))


def exclusion(score: Column, positive_score: Column, ratio: float, own: Column, same: Column) -> Column:
    """Why a candidate is no hard negative: own, query_match, not_finite, too_close; null if it is one.

    The threshold is strict: a score equal to ``ratio x positive`` is too close.
    """
    return (
        F.when(own, "own").when(same, "query_match").when(score.isNull() | F.isnan(score), "not_finite").when(~(score < positive_score * ratio), "too_close")
    )


def pool_choice(pool: DataFrame, group: str, strategy: str, k: int, seed: str = "7") -> DataFrame:
    """k of the ranked pool: ``top_k``, ``score_rank_quantiles`` (both ends, rounded spacing) or
    ``hash_sample_from_top_pool`` (by hash, then by rank again). ``rank`` counts from 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    if strategy == "top_k":
        return pool.where(F.col("rank") <= k)
    if strategy == "score_rank_quantiles":
        sized = pool.withColumn("__n", n)
        at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: rank_anchor(i, F.col("__n"), k))
        return sized.where((F.col("__n") <= k) | F.array_contains(at, (F.col("rank") - 1).cast("bigint"))).drop("__n")
    if strategy == "hash_sample_from_top_pool":
        from pairloom.functions.text import stable_hash

        w = Window.partitionBy(group).orderBy(stable_hash(F.lit(seed), F.col(group), F.col("doc_id")))
        return pool.withColumn("__h", F.row_number().over(w)).where(F.col("__h") <= k).drop("__h")
    raise ValueError(f"unknown strategy {strategy!r}")


def rank_anchor(i: Column, n: Column, k: int) -> Column:
    """Rounded even spacing from 0 to n - 1: ``(i (n - 1) + (k - 1) // 2) // (k - 1)``."""
    return F.floor((i * (n - 1) + (k - 1) // 2) / (k - 1)).cast("bigint") if k > 1 else F.lit(0).cast("bigint")


def rank_anchor_floor(i: Column, n: Column, k: int) -> Column:
    """The floor variant: ``i (n - 1) // (k - 1)``."""
    return F.floor(i * (n - 1) / (k - 1)).cast("bigint") if k > 1 else F.lit(0).cast("bigint")


def cells(corpus: DataFrame, key: str, vector: str, cells_wanted: int, sample_rows: int = 50_000, seed: int = 7):
    """Centres of at most ``N // 39`` cells, trained on at most ``sample_rows`` rows in hash order.

    Every row is indexed; the sample only places the centres.
    """
    import numpy as np

    corpus = corpus.where(F.col(vector).isNotNull())
    total = corpus.count()
    n = max(1, min(cells_wanted, total // 39))
    share = min(1.0, 2 * sample_rows / max(1, total))
    picked = corpus.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64(F.lit(seed), F.col(key))).limit(sample_rows)
    x = np.asarray([r[0] for r in picked.select(vector).collect()], dtype="float64")
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:n]]
    for _ in range(15):
        nearest = np.argmax(x @ centre.T, axis=1)
        for c in range(len(centre)):
            if (mine := x[nearest == c]).size:
                m = mine.mean(axis=0)
                centre[c] = m / max(np.linalg.norm(m), 1e-12)
    return centre


def with_cells(df: DataFrame, key: str, vector: str, centre, probes: int) -> DataFrame:
    """``(key, vector, cell)``: one row per nearest cell, ``probes`` of them."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            v = np.asarray(b.column(1).to_pylist(), dtype="float64")
            if not len(v):
                continue
            near = np.argsort(-(v @ centre.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(v)), near.shape[1]))), b.column(1).take(pa.array(np.repeat(np.arange(len(v)), near.shape[1]))), pa.array(near.ravel().astype("int32"))], ["key", "vec", "cell"])

    return df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<float>")).mapInArrow(run, f"key {kind}, vec array<float>, cell int")


def cell_search(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, cells_wanted: int = 64, probes: int = 34) -> DataFrame:
    """Approximate top-k: an equi-join on the cell, then exact scores of what met.

    ``probes`` sets the recall: vectors without clusters need most of the cells (0.93 of the
    true neighbours with 32 of 51 cells on random unit vectors), clustered ones few.
    """
    centre = cells(corpus, key, vector, cells_wanted)
    index = with_cells(corpus, key, vector, centre, 1).select(F.col("key").alias("doc_id"), F.col("vec").alias("dv"), "cell")
    asked = with_cells(queries, key, vector, centre, probes).select(F.col("key").alias("query_id"), F.col("vec").alias("qv"), "cell")
    met = asked.join(index, "cell").where("query_id <> doc_id").select("query_id", "doc_id", dot(F.col("qv"), F.col("dv")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_vector(df: DataFrame, group: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean per group: ``(group…, mean array<double>, rows)``.

    Elements are averaged by position with partial sums; a group with vectors of several
    lengths is an error.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = df.where(F.col(vector).isNotNull()).select(*group, w.alias("w"), F.size(vector).alias("n"), F.posexplode(vector).alias("at", "x"))
    one = long.groupBy(*group, "at").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"), F.count(F.lit(1)).alias("rows"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    whole = one.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("ms"), F.max("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    same = F.when(F.col("lo") == F.col("hi"), F.transform("ms", lambda x: x["m"])).otherwise(F.raise_error(F.lit("vectors of several lengths")))
    return whole.select(*group, same.alias("mean"), "rows")


def parity(before: DataFrame, after: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: rows, least and mean cosine of rows with equal keys, largest norm drift; and whether least >= 0.999."""
    b = before.select(key, F.col(vector).alias("x"))
    a = after.select(key, F.col(vector).alias("y"))
    j = b.join(a, key).select((dot(F.col("x"), F.col("y")) / (norm(F.col("x")) * norm(F.col("y")))).alias("c"), F.abs(norm(F.col("x")) - norm(F.col("y"))).alias("drift"))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("least_cosine"), F.avg("c").alias("mean_cosine"), F.max("drift").alias("largest_drift"), (F.min("c") >= 0.999).alias("passes"))




def with_source_candidates(dense: DataFrame, own: DataFrame, query: str, doc: str, score: str) -> DataFrame:
    """Mined candidates and those a source brought along, each once with its ``origin``.

    ``dense`` and ``own`` hold ``(query, doc, score)``; a candidate of both has the origin
    "dense+source". Scores of one pair agree, the larger counts.
    """
    both = dense.select(query, doc, score, F.lit(1).alias("d"), F.lit(0).alias("s")).unionByName(own.select(query, doc, score, F.lit(0).alias("d"), F.lit(1).alias("s")))
    one = both.groupBy(query, doc).agg(F.max(score).alias(score), F.max("d").alias("d"), F.max("s").alias("s"))
    origin = F.when((F.col("d") == 1) & (F.col("s") == 1), "dense+source").when(F.col("d") == 1, "dense").otherwise("source")
    return one.select(query, doc, score, origin.alias("origin"))


def teacher_requests(pool: DataFrame, query: str, doc: str, score: str) -> DataFrame:
    """One nested row per query: its candidates in rank order, for a teacher to score."""
    c = F.struct((-F.col(score)).alias("order"), F.col(doc).alias("candidate_id"), F.col(score).alias("retriever_score"))
    g = pool.groupBy(query).agg(F.sort_array(F.collect_list(c)).alias("cs"))
    return g.select(query, F.transform("cs", lambda x: x.dropFields("order")).alias("candidates"))
