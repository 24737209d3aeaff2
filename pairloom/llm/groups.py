"""Problem 2: splits that keep related records together.

Method: distributed union-find. Every task builds local forests of at most
``single_task_edges`` of its edges at a time and passes on one edge per non-root; edges
between roots that share a node form the next, smaller graph, merged in fewer and fewer
tasks, but never fewer than hold ``single_task_edges`` each. The last graph is solved in one
task once it fits; a graph that local forests no longer shrink is contracted by star rounds
(each node of one half joins a neighbour of the other half), so no task ever holds an
unbounded component. Groups are then dealt largest first to the split furthest below its
target.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.joins import join_members, join_unique
from pairloom.operators.numbering import number_within
from pairloom.session import materialize

EDGE = "a string, b string"
STAR = "node string, root string"


def _local_forests(most: int):
    """Edges in, (node, root) out: union by smaller name, path halving, a new forest after ``most`` edges."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parent: dict[str, str] = {}

        def find(x: str) -> str:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        def trees():
            nodes = list(parent)
            for at in range(0, len(nodes), 50_000):
                some = nodes[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([find(x) for x in some], pa.string())], ["node", "root"])
            parent.clear()

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if held and held + part.num_rows > most:
                    yield from trees()
                    held = 0
                for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    a, b = find(a), find(b)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                held += part.num_rows
        yield from trees()

    return run


def _root_graph(forest: DataFrame) -> DataFrame:
    """Edges between local roots that share a node."""
    low = forest.groupBy("node").agg(F.min("root").alias("a"), F.max("root").alias("top")).where(F.col("a") != F.col("top"))
    return forest.join(low.select("node", "a"), "node").where(F.col("root") != F.col("a")).select("a", F.col("root").alias("b")).distinct()


def _star_round(edges: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """Each node of the 'tail' half that has a 'head' neighbour joins the smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    head = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(salt)), F.lit(2)) == 1
    moves = both.where(~head("a") & head("b")).groupBy("a").agg(F.min("b").alias("to"))
    moves = materialize(moves.select(F.col("a").alias("node"), F.col("to").alias("root")), "star")
    left = moves.withColumnsRenamed({"node": "na", "root": "ra"})
    right = moves.withColumnsRenamed({"node": "nb", "root": "rb"})
    moved = (
        edges.join(left, F.col("a") == F.col("na"), "left").join(right, F.col("b") == F.col("nb"), "left")
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where(F.col("a") != F.col("b"))
    )
    return materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), moves


def components(edges: DataFrame, fan_in: int = 8, single_task_edges: int = 2_000_000) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``; the component is its smallest node.

    Null ends are dropped; a self-loop gives a component of one.
    """
    edges = edges.select(F.col("a").cast("string"), F.col("b").cast("string")).where("a is not null and b is not null")
    parts, single = edges.sparkSession.sparkContext.defaultParallelism, max(1, single_task_edges)
    forests = lambda graph: materialize(graph.mapInArrow(_local_forests(single), STAR), "forest")
    first = forests(edges)
    maps = [first.groupBy("node").agg(F.min("root").alias("root"))]
    graph = materialize(_root_graph(first), "edges")
    size, salt, starred = graph.count(), 0, False
    while size:
        if size <= single:
            maps.append(forests(graph.coalesce(1)))
            break
        parts = max(2, parts // fan_in, -(-size // single))
        forest = forests(graph.repartition(parts, "a"))
        maps.append(forest.groupBy("node").agg(F.min("root").alias("root")))
        smaller = materialize(_root_graph(forest), "edges")
        left = smaller.count()
        if left > size // 2:  # local forests no longer shrink it
            smaller, moves = _star_round(smaller, salt)
            maps.append(moves)
            left, salt, starred = smaller.count(), salt + 1, True
        graph, size = smaller, left
    labels = maps[0]
    for m in maps[1:]:
        up = m.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        labels = labels.join(up, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root"))
    labels = materialize(labels, "labels")
    if not starred:  # forests keep the smallest name as root
        return labels.withColumnRenamed("root", "component")
    names = labels.groupBy("root").agg(F.min("node").alias("component"))
    return materialize(join_unique(labels, "root", names).select("node", "component"), "labels")


def deal(sizes: list[tuple[int, int]], shares: dict[str, float]) -> list[tuple[int, int, str]]:
    """Largest-first greedy over ``(group size, how many groups)``.

    Returns ``(size, groups, split)`` runs in dealing order. Each group goes to the
    split furthest below its target (in rows), ties to the one named first. Groups of
    one size are dealt in laps over the splits that are level.
    """
    total = sum(s * n for s, n in sizes)
    names = list(shares)
    gap = {k: total * v / sum(shares.values()) for k, v in shares.items()}
    runs: list[tuple[int, int, str]] = []
    for size, n in sorted(sizes, reverse=True):
        while n:
            top = max(gap.values())
            level = [k for k in names if gap[k] > top - size]  # dealt in turn, so they sink together
            lower = [gap[k] for k in names if k not in level]
            laps = int(min((top - max(lower)) // size if lower else n, n // len(level)))
            for k in level if laps else [max(level, key=lambda k: gap[k])]:
                take = laps or 1
                runs.append((size, take, k))
                gap[k] -= take * size
                n -= take
    return runs


def assign_splits(df: DataFrame, key: str, links: list[str], shares: dict[str, float]) -> DataFrame:
    """``(key, component, split)`` for every row; rows sharing a value of any link column stay together.

    A row with no link at all is a group of its own. Values in different link columns
    never meet. Repeated keys get one result row each.
    """
    names = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(c).cast("string"))) for i, c in enumerate(links)]
    rows = df.select(F.col(key).alias("__key"), F.filter(F.array(*names), lambda x: x.isNotNull()).alias("ends"))
    anchor = F.element_at("ends", 1)
    edges = rows.where(F.size("ends") > 0).select(anchor.alias("a"), F.explode("ends").alias("b")).distinct()
    labels = components(edges).withColumnRenamed("node", "__a")
    linked = rows.where(F.size("ends") > 0).select("__key", anchor.alias("__a"))
    labelled = join_unique(linked, "__a", labels).select("__key", "component")
    alone = rows.where(F.size("ends") == 0).select("__key", F.concat(F.lit("row:"), F.col("__key").cast("string")).alias("component"))
    labelled = materialize(labelled.unionByName(alone), "labelled")
    groups = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ranked = materialize(number_within(groups, ["size"], ["component"], "nth"), "ranked")
    # the number of different sizes is below sqrt(2 x rows): this list is bounded
    sizes = [(r["size"], r["n"]) for r in ranked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()]
    dealt: dict[tuple[int, str], int] = {}
    for size, n, split in deal(sizes, shares):
        dealt[size, split] = dealt.get((size, split), 0) + n
    runs, at = [], {}
    for (size, split), n in dealt.items():  # which group of a size goes where is free: one run a split
        at[size] = at.get(size, 0) + n
        runs.append((size, at[size], split))
    spark = df.sparkSession
    table = spark.createDataFrame(runs, "s bigint, hi bigint, split string").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("hi", "split"))).alias("runs"))
    chosen = ranked.join(table, F.col("size") == F.col("s")).select(
        "component", F.element_at(F.filter("runs", lambda r: r["hi"] > F.col("nth")), 1)["split"].alias("split")
    )
    return join_unique(labelled, "component", chosen).select(F.col("__key").alias(key), "component", "split")


def linked_pairs(labels: DataFrame, prefix: str) -> DataFrame:
    """Pairs of different names with ``prefix`` in one component, smaller name first."""
    named = labels.where(F.col("node").startswith(prefix)).select("component", F.substring("node", len(prefix) + 1, 1 << 30).alias("name"))
    several = named.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    named = named.join(several, "component", "left_semi")
    both = join_members(named.withColumnRenamed("name", "name_a"), "component", named.withColumnRenamed("name", "name_b"), "name_b")
    return both.where("name_a < name_b").select("name_a", "name_b")
