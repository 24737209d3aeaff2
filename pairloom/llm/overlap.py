"""Problem 1: the same or nearly the same record in several splits.

Method: content-defined chunks. The bare query of a side 'a' record is cut in chunks at
places its content decides: of all ways to take enough disjoint chunks, the one whose
rolling-hash digests the other side holds least. Side 'b' is hashed at every offset, digests
are joined across splits, and shared chunk lengths are summed to the overlap fraction of
the pair. Cutting both sides at hash minima cannot give the whole result: at a similarity
of 0.8 scattered edits touch every such chunk. Here ``k`` edits leave at least ``chunks - k``
chunks whole, so a pair below that is no case and no similar pair is lost, at any length.
An edit distance on both texts confirms.

Exact copies meet first: everything works on distinct queries, then on distinct (query,
positive) classes. A chunk meets only where its place in both texts and the two multisets of
characters allow the edit similarity, which loses no pair. A digest that many side 'b' texts
hold is salted. How frequent a digest is comes from a table of one byte a slot, sized by the
data; it decides on the work alone. Queries shared by many records are not paired record by
record: their positives meet in chunks the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.wumanber import prefix_sums, span_hashes
from pairloom.operators.joins import join_members
from pairloom.session import materialize, put_bytes

#: Lengths of chunks in texts of at least ``LONG`` characters, and in shorter ones. A text
#: shorter than twice the least is one chunk.
LENGTHS, SHORTER = (3, 4), (2, 3, 4)
LONG = 9
#: Least edit similarity at which enough chunks of these lengths fit into every text.
LEAST_SIMILAR = 0.8
#: Chunks of a longer text are chosen in even blocks of up to this many characters.
BLOCK = 128
#: Characters keyed at once, which bounds a worker's memory.
SLICE_CHARS = 500_000
#: Least and most slots of the frequency table.
SLOTS = 1 << 20, 1 << 26
#: Side 'b' texts that share a digest and a salt, about.
SALTED = 2048
#: A pair of queries with more pairs of records than this is compared by its positives' chunks.
HEAVY = 100_000


def segments_needed(n: int, similar: float) -> int:
    """One more than edits between a text of ``n`` characters and a similar one can touch."""
    return int(n / similar * (1 - similar) + 1e-9) + 1


def once(*columns):
    """Rows of equal (text, digest) as one: least and greatest place, number of rows, characters."""
    import numpy as np

    t, h, at, n = columns
    o = np.lexsort((at, h, t))
    t, h, at, n = t[o], h[o], at[o], n[o]
    new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(t) else np.array([], "int64")
    last = np.r_[new[1:], len(t)] - 1 if len(new) else new
    return t[new], h[new], at[new], at[last], last - new + 1, n[new] * (last - new + 1)


class Flat:
    """Texts side by side, with hashes of their spans."""

    def __init__(self, texts: list[str]):
        import numpy as np

        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.size = np.fromiter(map(len, texts), "int64", len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.sums = prefix_sums(self.codes)

    def digests(self, at, length: int):
        return span_hashes(self.sums, at, at + length).view("int64")

    def bags(self):
        """Two words a text: 128 bits of its multiset of characters. An edit clears one bit at most."""
        import numpy as np

        text = np.repeat(np.arange(len(self.size)), self.size)
        o = np.lexsort((self.codes, text))
        t, c = text[o], self.codes[o].astype("uint64")
        new = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])] if len(t) else np.array([], bool)
        first = np.flatnonzero(new)
        nth = (np.arange(len(t)) - first[np.cumsum(new) - 1]).astype("uint64") if len(t) else c
        with np.errstate(over="ignore"):
            # small letters lie far enough apart for their usual counts
            place = np.where(c < 128, c * np.uint64(5), c * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57))
            bit = (place + nth) & np.uint64(127)
        bits = np.zeros((len(self.size), 128), dtype=bool)
        bits[t, bit.astype("int64")] = True
        words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
        return words[:, 0], words[:, 1]

    def all_segments(self, similar: float):
        """``(text, digest, place, length)`` of every substring that may be a chunk of a similar text."""
        import numpy as np

        whole = self.size < 2 * SHORTER[0]
        small = np.ceil(self.size * similar - 1e-9) < LONG
        text = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(text))
        left = (self.start + self.size)[text] - at
        found = []
        for n in range(1, LENGTHS[-1] + 1):
            usual = n in LENGTHS or small[text] if n in SHORTER else False
            here = np.flatnonzero(np.where(whole[text], (left == n) & (self.size[text] == n), (left >= n) & usual))
            found.append((text[here], self.digests(at[here], n), at[here] - self.start[text[here]], np.full(len(here), n)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def chosen_segments(self, similar: float, cost):
        """``(text, digest, place, length)`` of ``segments_needed`` disjoint chunks of each text, of least total cost."""
        import numpy as np

        none = np.array([], "int64")
        found = [(none, none, none, none)]
        for n in range(1, 2 * SHORTER[0]):
            t = np.flatnonzero(self.size == n)
            found.append((t, self.digests(self.start[t], n), t * 0, t * 0 + n))
        t = np.flatnonzero(self.size >= 2 * SHORTER[0])
        parts = -(-self.size[t] // BLOCK)
        t, parts = np.repeat(t, parts), np.repeat(parts, parts)
        part = np.arange(len(t)) - np.searchsorted(t, t)
        low, high = self.size[t] * part // parts, self.size[t] * (part + 1) // parts
        # the needs of the blocks of a text sum to its own need at least
        for m in np.unique(high - low).tolist():
            mine = np.flatnonzero(high - low == m)
            found += self._blocks(t[mine], self.start[t[mine]] + low[mine], m, segments_needed(m, similar), cost)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _blocks(self, text, start, m: int, need: int, cost):
        import numpy as np

        lengths = LENGTHS if m >= LONG else SHORTER
        digest = {n: self.digests((start + np.arange(m - n + 1)[:, None]).ravel(), n).reshape(m - n + 1, -1) for n in lengths}
        price = {n: cost(h) for n, h in digest.items()}
        best = np.full((m + 1, need + 1, len(text)), np.inf, dtype="float32")
        took = np.zeros((m + 1, need + 1, len(text)), dtype="int8")
        best[:, 0] = 0
        for at in range(1, m + 1):
            best[at, 1:] = best[at - 1, 1:]
            for n in lengths:
                if n <= at:
                    with_it = best[at - n, :-1] + price[n][at - n]
                    less = with_it < best[at, 1:]
                    best[at, 1:][less] = with_it[less]
                    took[at, 1:][less] = n
        row, at, j = np.arange(len(text)), np.full(len(text), m), np.full(len(text), need)
        found = []
        while len(row):
            n = took[at, j, row].astype("int64")
            for k in lengths:
                x = np.flatnonzero(n == k)
                place = at[x] - k
                found.append((text[row[x]], digest[k][place, row[x]], start[row[x]] - self.start[text[row[x]]] + place, np.full(len(x), k)))
            at, j = at - np.maximum(n, 1), j - (n > 0)
            row, at, j = row[j > 0], at[j > 0], j[j > 0]
        return found


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def _records(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from pairloom.llm.glyphs import bare_bodies, bare_texts

    for b in batches:
        q, p = bare_bodies(b.column(2).to_pylist()), bare_texts(b.column(3).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(q, pa.string()), pa.array(p, pa.string())], ["row_id", "side", "q", "p"])


def records(rows: DataFrame, similar: float) -> DataFrame:
    """``(row_id, side, cls, query_no, q, p)`` of ``(row_id, side, query, positive)``: bare texts, a
    128-bit class of both and a number of the query; a stored instruction is no part of a query;
    records with an empty bare text are left out, repeated rows stay."""
    if similar < LEAST_SIMILAR:
        raise ValueError(f"similar pairs are found from {LEAST_SIMILAR} on")
    made = rows.select("row_id", "side", "query", "positive").mapInArrow(_records, "row_id bigint, side string, q string, p string")
    cls = F.unhex(F.md5(F.concat_ws("\0", "q", "p")))
    return made.where("length(q) > 0 and length(p) > 0").select("row_id", "side", cls.alias("cls"), F.xxhash64("q").alias("query_no"), "q", "p")


def _frequencies(held: DataFrame, similar: float) -> tuple[str, int]:
    """A file of one byte a slot: how many side 'b' texts hold a chunk of it (log scale), 0 if none does."""
    import numpy as np

    spark = held.sparkSession
    chars = held.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = min(max(1 << int(2 * chars).bit_length(), SLOTS[0]), SLOTS[1])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = b.column(0).to_pylist()
            for at, end in _slices(texts):
                slot, n = np.unique(Flat(texts[at:end]).all_segments(similar)[1] % slots, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype("int32")), pa.array(n.astype("int64"))], ["slot", "n"])

    piece = 1 << 16

    def packed(key, t):
        import pyarrow as pa

        level = np.zeros(piece, dtype="uint8")
        level[t.column("slot").to_numpy() % piece] = np.minimum(np.log2(t.column("n").to_numpy()) * 4 + 1, 255)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([level.tobytes()], pa.binary())})

    each = held.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    pieces = each.groupBy(F.expr(f"cast(slot div {piece} as int)").alias("piece")).applyInArrow(packed, "piece int, data binary")
    table = bytearray(slots)
    for r in pieces.toLocalIterator():  # at most SLOTS[1] bytes in all
        table[r["piece"] * piece : (r["piece"] + 1) * piece] = r["data"]
    path = put_bytes(spark, "frequencies", bytes(table))
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1], slots


_KEY = "h bigint, no bigint, size int, bag bigint, bag_2 bigint, low int, high int"


def _keys(name: str, slots: int, similar: float, first: bool):
    """Keys of texts ``(no, text)``: the chosen chunks of side 'a' (``first``), all possible ones of side 'b'."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        level = np.memmap(SparkFiles.get(name), dtype="uint8", mode="r")
        price = np.r_[np.float32(0), np.exp2(np.arange(255, dtype="float32") / 4)]
        cost = lambda h: price[level[h % slots]]
        salts = lambda h: 1 + (cost(h) / SALTED).astype("int64")
        i32 = lambda x: pa.array(x.astype("int32"))

        for b in batches:
            numbers, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for start, end in _slices(texts):
                flat, no = Flat(texts[start:end]), numbers[start:end]
                bag = flat.bags()
                found = flat.chosen_segments(similar, cost) if first else flat.all_segments(similar)
                chunks = np.bincount(found[0], minlength=len(no))
                chars = np.bincount(found[0], found[3], len(no))
                t, h, low, high, n, length = once(*found)
                s = salts(h)
                if first:
                    keep = np.flatnonzero(level[h % slots] > 0)
                    keep = np.repeat(keep, s[keep])
                    salt = np.arange(len(keep)) - np.searchsorted(keep, keep)
                    t, h, low, high, n, length = (x[keep] for x in (t, h, low, high, n, length))
                else:
                    salt = no[t] % s
                with np.errstate(over="ignore"):
                    h = h ^ (salt * np.int64(0x61C8864680B583EB))
                out = [pa.array(h), pa.array(no[t]), i32(flat.size[t]), pa.array(bag[0][t]), pa.array(bag[1][t]), i32(low), i32(high)]
                names = ["h", "no", "size", "bag", "bag_2", "low", "high"]
                if first:
                    out += [i32(n), i32(length), i32(chunks[t]), i32(chars[t])]
                    names += ["n", "length", "chunks", "chars"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def near_texts(texts: DataFrame, similar: float) -> DataFrame:
    """``(no_a, no_b, fraction)`` of texts ``(no, a, text)`` of the two sides that are similar, equal ones
    included. ``fraction``: characters in chunks of side 'a' that side 'b' holds too, by characters in chunks."""
    name, slots = _frequencies(texts.where("not a"), similar)
    keyed = lambda first, more="": texts.where(F.col("a") if first else ~F.col("a")).select("no", "text").mapInArrow(_keys(name, slots, similar, first), _KEY + more)
    a, b = keyed(True, ", n int, length int, chunks int, chars int"), keyed(False)
    a = a.withColumnsRenamed({c: f"{c}_a" for c in ("no", "size", "bag", "bag_2", "low", "high")})
    b = b.withColumnsRenamed({c: f"{c}_b" for c in ("no", "size", "bag", "bag_2", "low", "high")})
    edits = F.floor(F.greatest("size_a", "size_b") * (1 - similar) + 1e-9).cast("int")
    # an edit takes one character of a side away at most
    lacking = lambda x, y: sum(F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(f"{c}_{y}"))) for c in ("bag", "bag_2"))
    # characters before a chunk and after it are shifted by edits; of several places the best counts
    longer = F.col("size_a") - F.col("size_b")
    off = F.greatest(F.lit(0), F.col("low_a") - F.col("high_b") - F.greatest(longer, F.lit(0)), F.least(longer, F.lit(0)) - (F.col("high_a") - F.col("low_b")))
    fits = (F.abs(longer) + 2 * off <= edits) & (lacking("a", "b") <= edits) & (lacking("b", "a") <= edits)
    met = a.join(b, "h").where(fits).groupBy("no_a", "no_b").agg(
        F.sum("n").alias("whole"), F.sum("length").alias("shared"), F.first("chunks").alias("chunks"), F.first("chars").alias("chars"), F.first(edits).alias("edits")
    )
    met = met.where(F.col("whole") >= F.col("chunks") - F.col("edits")).select("no_a", "no_b", (F.col("shared") / F.col("chars")).alias("fraction"))
    text = lambda s, is_a: texts.where(F.col("a") if is_a else ~F.col("a")).select(F.col("no").alias(f"no_{s}"), F.col("text").alias(f"text_{s}"))
    compared = met.join(text("a", True), "no_a").join(text("b", False), "no_b").where(within("text_a", "text_b", similar))
    return compared.select("no_a", "no_b", "fraction")


def within(a: str, b: str, similar: float):
    """Edit similarity of at least ``similar``; the distance stops counting beyond the bound."""
    most = f"cast(floor(greatest(length({a}), length({b})) * {1 - similar:.6f} + 1e-9) as int)"
    return F.expr(f"abs(length({a}) - length({b})) <= {most} and levenshtein({a}, {b}, {most}) >= 0")


def class_pairs(base: DataFrame, similar: float = 0.8, heavy: int = HEAVY) -> DataFrame:
    """``(cls_a, cls_b, fraction)`` of near classes across sides, copies across sides included."""
    is_a = F.col("side") == "a"
    queries = materialize(base.groupBy(F.col("query_no").alias("no"), is_a.alias("a"), F.col("q").alias("text")).agg(F.count(F.lit(1)).alias("rows")), "queries")
    rows = lambda s, first: queries.where(F.col("a") if first else ~F.col("a")).groupBy(F.col("no").alias(f"no_{s}")).agg(F.sum("rows").alias(f"rows_{s}"))
    pairs = near_texts(queries, similar).join(rows("a", True), "no_a").join(rows("b", False), "no_b")
    pairs = materialize(pairs.select("no_a", "no_b", "fraction", (F.col("rows_a") * F.col("rows_b") > heavy).alias("heavy")), "overlaps")
    classes = lambda s, some: (
        base.where(F.col("side") == s).select(F.col("query_no").alias(f"no_{s}"), F.col("cls").alias(f"cls_{s}"), F.col("q").alias(f"q{s}"), F.col("p").alias(f"p{s}"))
        .join(some.select(f"no_{s}").distinct(), f"no_{s}", "left_semi").dropDuplicates([f"cls_{s}"])
    )
    light = pairs.where("not heavy")
    near = light.join(classes("a", light), "no_a").join(classes("b", light), "no_b")
    many = pairs.where("heavy")
    if not many.isEmpty():
        a, b = (materialize(classes(s, many).withColumn(f"p_no_{s}", F.xxhash64(f"p{s}")), "heavy") for s in ("a", "b"))
        side = lambda t, s, first: t.select(F.col(f"p_no_{s}").alias("no"), F.lit(first).alias("a"), F.col(f"p{s}").alias("text"))
        positives = materialize(side(a, "a", True).unionByName(side(b, "b", False)).distinct(), "positives")
        by_text = near_texts(positives, similar).select(F.col("no_a").alias("p_no_a"), F.col("no_b").alias("p_no_b")).distinct()
        met = by_text.join(a, "p_no_a").join(b, "p_no_b").join(many, ["no_a", "no_b"])
        near = near.unionByName(met.select(*near.columns))
    near = near.where(F.col("cls_a") != F.col("cls_b")).where(within("qa", "qb", similar)).where(within("pa", "pb", similar))
    same = base.groupBy("cls").agg(F.count_if(is_a).alias("na"), F.count_if(~is_a).alias("nb")).where("na > 0 and nb > 0")
    near = near.groupBy("cls_a", "cls_b").agg(F.max("fraction").alias("fraction"))
    return near.unionByName(same.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(1.0).alias("fraction")))


def row_pairs(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """``(row_id_a, row_id_b, fraction)`` of class pairs: all rows of the classes, copies included."""
    pairs = materialize(pairs, "pairs")
    rows = lambda s: (
        base.where(F.col("side") == s).select(F.col("cls").alias(f"cls_{s}"), F.col("row_id").alias(f"row_id_{s}"))
        .join(pairs.select(f"cls_{s}").distinct(), f"cls_{s}", "left_semi")
    )
    left = join_members(pairs, "cls_a", rows("a"), "row_id_a")
    return join_members(left, "cls_b", rows("b"), "row_id_b").select("row_id_a", "row_id_b", "fraction")
