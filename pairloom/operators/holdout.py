"""Leakage-free holdouts, quotas and lexical negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import lexical_features, stable_hash


def admission(candidates: DataFrame, training: DataFrame, document: str) -> DataFrame:
    """Add ``verdict``: a candidate whose document training holds is excluded as a whole."""
    seen = training.where(F.col(document).isNotNull()).select(F.col(document).alias("__doc")).distinct().withColumn("__seen", F.lit(True))
    joined = candidates.join(seen, F.col(document) == F.col("__doc"), "left")
    return joined.withColumn("verdict", F.when(F.col("__seen"), "document_seen_in_training").otherwise("eligible")).drop("__doc", "__seen")


def id_conflicts(df: DataFrame, key: str, document: str) -> DataFrame:
    """Ids seen with more than one document: these are errors, not duplicates."""
    g = df.where(F.col(document).isNotNull()).groupBy(key).agg(F.min(document).alias("lo"), F.max(document).alias("hi"))
    return g.where("lo <> hi").select(key)


def equal_quota(df: DataFrame, group: str, key: str, quota: int, seed: str) -> DataFrame:
    """``quota`` rows per group in stable hash order; groups with fewer give what they have."""
    w = Window.partitionBy(group).orderBy(stable_hash(F.lit(seed), F.col(key)), key)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= quota)


def round_robin(df: DataFrame, source: str, key: str, target: int, seed: str, distinct: list[str], per_document: tuple[str, int] | None = None) -> DataFrame:
    """Source-balanced greedy selection of ``target`` rows: ``(source, key, pick)``.

    Sources in order of their names give, turn by turn, their next admissible row in stable
    hash order: one whose ``distinct`` columns repeat no chosen value and whose document is
    below its cap. What is admissible depends on all earlier picks, so the choice itself is
    sequential; it needs the first rows of each source only. A source that runs out of
    them before the end is read further, so the result is that of the whole tables.
    """
    columns = [*distinct, *([per_document[0]] if per_document else [])]
    w = Window.partitionBy(source).orderBy(stable_hash(F.lit(seed), F.col(key)), key)
    digests = [F.sha2(F.col(c).cast("string"), 256).alias(c) for c in columns]
    ranked = df.where(F.col(source).isNotNull()).select(source, key, *digests, F.row_number().over(w).alias("__rn"))
    reach = max(64, 2 * target // max(1, df.select(source).distinct().count()))
    while True:
        rows: dict = {}
        for r in ranked.where(F.col("__rn") <= reach + 1).orderBy(source, "__rn").toLocalIterator():
            rows.setdefault(r[source], []).append(r)
        chosen, short = _turns(rows, target, reach, distinct, per_document)
        if not short:
            break
        reach *= 4
    kinds = dict(df.dtypes)
    made = [(r[source], r[key], i) for i, r in enumerate(chosen)]
    return df.sparkSession.createDataFrame(made, f"{source} {kinds[source]}, {key} {kinds[key]}, pick bigint")


def _turns(rows: dict, target: int, reach: int, distinct: list[str], per_document) -> tuple[list, bool]:
    """The greedy choice, and whether a source ended because only ``reach`` of its rows were read."""
    seen: list[set] = [set() for _ in distinct]
    held: dict = {}
    at = dict.fromkeys(rows, 0)
    chosen: list = []
    open_sources = sorted(rows)
    while open_sources and len(chosen) < target:
        for s in list(open_sources):
            if len(chosen) >= target:
                break
            while True:
                if at[s] >= min(len(rows[s]), reach):
                    if len(rows[s]) > reach:
                        return chosen, True
                    open_sources.remove(s)
                    break
                r = rows[s][at[s]]
                at[s] += 1
                if any(r[c] in have for c, have in zip(distinct, seen)) or (per_document and held.get(r[per_document[0]], 0) >= per_document[1]):
                    continue
                for c, have in zip(distinct, seen):
                    have.add(r[c])
                if per_document:
                    held[r[per_document[0]]] = held.get(r[per_document[0]], 0) + 1
                chosen.append(r)
                break
    return chosen, False


def idf(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(feature, df, idf)``: ln((N + 1) / (df + 1)) + 1 over distinct lexical features of each row."""
    rows = df.where(F.col(text).isNotNull())
    n = rows.agg(F.count(F.lit(1)).alias("total"))
    counts = rows.select(F.explode(lexical_features(F.col(text))).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    return counts.join(F.broadcast(n)).select("feature", "df", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def lexical_negatives(queries: DataFrame, corpus: DataFrame, weights: DataFrame, k: int, seed: str) -> DataFrame:
    """``(query_id, corpus_id, score, rank)``: the k lexically nearest other passages of the same group.

    ``queries(query_id, grp, own, text)``, ``corpus(corpus_id, grp, text)``. Candidates without
    a common feature rank last by hash, so groups with few overlaps still give k rows: such
    rows are filled from the group's first k + 1 passages in hash order.
    """
    qf = queries.select("query_id", "grp", "own", F.explode(lexical_features(F.col("text"))).alias("feature"))
    cf = corpus.select("corpus_id", "grp", F.explode(lexical_features(F.col("text"))).alias("feature"))
    met = qf.join(cf, ["grp", "feature"]).where("corpus_id <> own").join(weights.select("feature", "idf"), "feature")
    scored = met.groupBy("query_id", "corpus_id").agg(F.sum("idf").alias("score"))
    order = Window.partitionBy("grp").orderBy(stable_hash(F.lit(seed), F.col("corpus_id")), "corpus_id")
    spare = corpus.select("corpus_id", "grp").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    filled = queries.select("query_id", "grp", "own").join(spare, "grp").where("corpus_id <> own").select("query_id", "corpus_id", F.lit(0.0).alias("score"))
    best = scored.unionByName(filled).groupBy("query_id", "corpus_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), stable_hash(F.lit(seed), F.col("corpus_id")), "corpus_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hamilton(counts: DataFrame, key: str, count: str, slots: int, seed: str) -> DataFrame:
    """Largest-remainder apportionment of ``slots``: ``(key, count, quota)``; ties by hash."""
    total = counts.agg(F.sum(count).alias("total"))
    share = counts.join(F.broadcast(total)).withColumn("__x", F.col(count) * F.lit(slots)).withColumn("base", F.expr("__x div total")).withColumn("rest", F.expr("__x % total"))
    given = share.agg(F.sum("base").alias("given"))
    order = Window.orderBy(F.col("rest").desc(), stable_hash(F.lit(seed), F.col(key)), key)  # one row per source
    ranked = share.join(F.broadcast(given)).withColumn("rn", F.row_number().over(order))
    return ranked.select(key, count, (F.col("base") + (F.col("rn") <= F.lit(slots) - F.col("given")).cast("int")).alias("quota"))


def last_rows_split(df: DataFrame, order: str, validation: int) -> DataFrame:
    """Add ``part``: the last ``validation`` rows in order are validation, the rest train.

    The boundary value comes from a top-n, so no full sort is needed.
    """
    edge = df.select(order).orderBy(F.col(order).desc()).limit(validation).agg(F.min(order).alias("__edge"))
    return df.join(F.broadcast(edge)).withColumn("part", F.when(F.col(order) >= F.col("__edge"), "validation").otherwise("train")).drop("__edge")


def joint_quotas(cells: list[tuple[str, int, int]], sources: dict[str, int], strata: dict[int, int]) -> dict[tuple[str, int], int]:
    """Whole numbers per (source, stratum) that meet both margins, each at most the cell's count.

    Maximum flow on the two-layer network: shortest augmenting paths, each pushed by its
    whole capacity, so the number of steps depends on the cells (sources x strata) and not on
    the quotas.
    """
    room = {(s, t): n for s, t, n in cells}
    flow = dict.fromkeys(room, 0)
    need, open_ = dict(sources), dict(strata)
    while any(need.values()):
        # breadth first over sources and strata; ``came`` holds where a node was reached from
        came: dict = {("s", s): None for s in sorted(need) if need[s] > 0}
        queue, end = list(came), None
        for kind, x in queue:
            if kind == "t" and open_.get(x, 0) > 0:
                end = ("t", x)
                break
            for s, t in sorted(room):
                to = ("t", t) if kind == "s" and s == x and flow[s, t] < room[s, t] else ("s", s) if kind == "t" and t == x and flow[s, t] > 0 else None
                if to and to not in came:
                    came[to] = (kind, x)
                    queue.append(to)
        if end is None:
            raise ValueError(f"the quotas of {sorted(s for s in need if need[s] > 0)} and the strata cannot both be met")
        path, at = [], end
        while came[at]:
            path.append((came[at], at))
            at = came[at]
        cell = lambda e: (e[0][1], e[1][1]) if e[0][0] == "s" else (e[1][1], e[0][1])
        most = min([need[at[1]], open_[end[1]]] + [room[cell(e)] - flow[cell(e)] if e[0][0] == "s" else flow[cell(e)] for e in path])
        for e in path:
            flow[cell(e)] += most if e[0][0] == "s" else -most
        need[at[1]] -= most
        open_[end[1]] -= most
    return {k: v for k, v in flow.items() if v}


def midpoints(size: Column, take: Column, index: Column) -> Column:
    """Position ``(2 i + 1) n // (2 c)`` of the i-th of c evenly spaced picks among n."""
    return F.floor((index * 2 + 1) * size / (take * 2)).cast("bigint")
