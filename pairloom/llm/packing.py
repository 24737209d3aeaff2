"""Problem 9: fill containers of fixed capacity.

Method: minimum bin slack over the histogram of lengths. A bitset subset-sum over the
remaining lengths finds the fill closest to capacity, backtracking gives how often each
length is used, and the same fill is repeated while the counts last. The plan therefore
depends on the number of different lengths (at most the capacity), not on the number of
items; items meet their containers by their dense rank among items of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.numbering import number_within
from pairloom.session import materialize


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (within ``counts``) whose sum is as near below ``room`` as can be."""
    full = (1 << (room + 1)) - 1
    reach = 1
    stages: list[tuple[int, int, int]] = []  # (length, times, what was reachable before)
    for length in sorted(counts, reverse=True):
        left, k = counts[length], 1
        while left and length * k <= room:
            k = min(k, left)
            stages.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(stages):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def plan_fills(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(how many containers, {length: items in each})`` placing every item of the histogram."""
    left = {k: n for k, n in histogram.items() if 0 < k <= capacity and n > 0}
    plan = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = best_fill({k: n for k, n in rest.items() if n}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        plan.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _runs(plan: list[tuple[int, dict[int, int]]]):
    """Arrays over (length, first rank): container of the first, items per container."""
    import numpy as np

    rows, at, base = [], {}, 0
    for times, used in plan:
        for length, n in sorted(used.items()):
            rows.append((length, at.get(length, 0), base, n))
            at[length] = at.get(length, 0) + n * times
        base += times
    return np.array(sorted(rows), dtype="int64").reshape(-1, 4), base


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``(container, key, piece, start, size)`` for every item of ``sizes(key, size)``.

    An item above the capacity is cut in pieces of the capacity and a rest. An item of
    size 0 or null takes no room and goes to container 0. ``key`` must be unique.
    """
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    items = materialize(sizes.select(F.col(key).alias("__key"), n.alias("n")), "sizes")  # read twice below
    pieces = items.select(
        "__key", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("n") / capacity) - 1))).alias("piece")
    ).select("__key", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece") * capacity).alias("len"))
    ranked = materialize(number_within(pieces, ["len"], ["__key", "piece"], "nth"), "pieces")
    # one row per different length, at most `capacity` of them
    histogram = {r["len"]: r["n"] for r in ranked.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = _runs(plan_fills(histogram, capacity))
    kind = dict(sizes.dtypes)[key]

    def place(batches: Iterator) -> Iterator:
        import numpy as np

        code = runs[:, 0]
        edges = {int(x): (np.searchsorted(code, x), np.searchsorted(code, x, "right")) for x in np.unique(code)}
        for b in batches:
            length, nth = b["len"].to_numpy("int64"), b["nth"].to_numpy("int64")
            container = np.zeros(len(b), dtype="int64")
            for x in np.unique(length[length > 0]):
                lo, hi = edges[int(x)]
                mine = length == x
                i = lo + np.searchsorted(runs[lo:hi, 1], nth[mine], "right") - 1
                container[mine] = runs[i, 2] + (nth[mine] - runs[i, 1]) // runs[i, 3]
            b["container"] = container
            yield b[["container", "__key", "piece", "start", "len"]]

    placed = ranked.mapInPandas(place, f"container bigint, __key {kind}, piece bigint, start bigint, len bigint")
    return placed.select("container", F.col("__key").alias(key), "piece", "start", F.col("len").alias(size))


def fill_report(packed: DataFrame, size: str, capacity: int) -> DataFrame:
    """One row: containers, tokens, the fewest containers possible, and the share filled."""
    per = packed.where(F.col(size) > 0).groupBy("container").agg(F.sum(size).alias("filled"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest"),
        F.ceil(F.sum("filled") / capacity).alias("fewest_possible"),
        F.round(F.sum("filled") / (F.count(F.lit(1)) * capacity), 6).alias("filled_share"),
    )
