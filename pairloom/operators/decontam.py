"""Benchmark decontamination: build, audit and apply blocklists of text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import squash
from pairloom.session import materialize

CRITICAL = ["query_text", "evaluation_text"]


def blocklist(items: DataFrame, norm=squash) -> DataFrame:
    """Distinct ``(kind, task, sha256)`` of benchmark texts ``(kind, task, text)``; blank texts are left out."""
    t = norm(F.col("text"))
    return items.where(F.length(t) > 0).select("kind", "task", F.sha2(t, 256).alias("sha256")).dropDuplicates(["kind", "task", "sha256"])


def blocklist_counts(items: DataFrame, norm=squash) -> DataFrame:
    """Occurrences and distinct digests per kind."""
    t = norm(F.col("text"))
    one = items.where(F.length(t) > 0).groupBy("kind", F.sha2(t, 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("kind").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("unique_texts"))


def roles(pairs: DataFrame, key: str, texts: dict[str, Column], carry: list[str], norm=squash) -> DataFrame:
    """One row per text of a training row: ``(key, carry…, position, role, sha256)``."""
    parts = [F.struct(F.lit(i).alias("position"), F.lit(r).alias("role"), norm(c).alias("t")) for i, (r, c) in enumerate(texts.items())]
    long = pairs.select(key, *carry, F.explode(F.array(*parts)).alias("x")).where(F.length("x.t") > 0)
    return long.select(key, *carry, "x.position", "x.role", F.sha2("x.t", 256).alias("sha256"))


def matches(role_rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """Role rows with the kinds and tasks their digest is blocked for.

    Two steps: the blocklist is grouped to one row per digest, so a digest that many tasks
    hold does not multiply rows; the join's small side is chosen by its size at run time.
    """
    one = blocked.groupBy("sha256").agg(
        F.collect_set("kind").alias("kinds"), F.collect_set(F.when(F.col("kind").isin(CRITICAL), F.col("task"))).alias("critical_tasks"),
        F.collect_set(F.when(F.col("kind") == "evaluation_text", F.col("task"))).alias("evaluation_tasks"),
    )
    return role_rows.join(one, "sha256")


def is_critical(declared: Column) -> Column:
    """A hit on query text in any role, or an evaluation text of a task that is not declared."""
    return F.array_contains("kinds", "query_text") | (F.size(F.array_except("evaluation_tasks", declared)) > 0)


def overlap_audit(matched: DataFrame, source: str, tasks: str) -> DataFrame:
    """Per source: distinct digests that are critical, expected (a declared task's text) or corpus exposure.

    Declared tasks are united per source before they are compared. A digest may be critical
    and expected at once.
    """
    per_source = matched.groupBy(source).agg(F.array_distinct(F.flatten(F.collect_set(tasks))).alias("__declared"))
    m = matched.join(per_source, source)
    critical = is_critical(F.col("__declared"))
    expected = F.size(F.array_intersect("evaluation_tasks", F.col("__declared"))) > 0
    digest = m.groupBy(source, "sha256").agg(
        F.bool_or(critical).alias("critical"), F.bool_or(expected).alias("expected"), F.bool_or(F.array_contains("kinds", "corpus_text")).alias("corpus")
    )
    return digest.groupBy(source).agg(
        F.count_if("critical").alias("critical"), F.count_if("expected").alias("expected"), F.count_if("corpus").alias("corpus"),
        F.count(F.lit(1)).alias("digests"),
    )


def overlap_status(critical: Column, expected: Column, corpus: Column) -> Column:
    """The ladder from worst to best."""
    return (
        F.when(critical > 0, "critical_query_or_evaluation_text_overlap").when(corpus > 0, "pass_with_retrieval_corpus_exposure")
        .when(expected > 0, "pass_with_declared_train_family_exposure").otherwise("pass_no_exact_text_overlap")
    )


def critical_rows(matched: DataFrame, key: str, tasks: str) -> DataFrame:
    """``(key, role)`` of rows to drop, with the first role that is critical; declared tasks are the row's own."""
    bad = matched.where(is_critical(F.col(tasks)))
    return bad.groupBy(key).agg(F.min_by("role", "position").alias("role"))


def without(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    return df.join(dropped.select(key), key, "left_anti")


def grams_of(words: Column, n: int) -> Column:
    """All runs of ``n`` words, each word taken by its place (a slice would copy the whole array)."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))


def word_grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Distinct ``(key, gram)``: digests of ``n`` words in a row."""
    words = F.split(squash(F.lower(F.col(text))), " ")
    return df.select(key, words.alias("w")).where(F.size("w") >= n).select(key, F.explode(grams_of(F.col("w"), n)).alias("gram")).select(key, F.xxhash64("gram").alias("gram")).distinct()


def _signatures(width: int, perms: int, seed: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        mult, (a, b) = np.array(shingle_multipliers(width), dtype="uint64"), (np.array(x, dtype="uint64") for x in zip(*permutations(perms, seed)))
        for batch in batches:
            out, texts = np.empty((batch.num_rows, perms), dtype="int64"), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):  # bounds the arrays of one step
                some = texts[at : at + 256]
                codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("uint64")
                size = np.fromiter(map(len, some), "int64", len(some))
                start = np.cumsum(size) - size
                h = sum(codes[k : len(codes) - width + 1 + k] * mult[k] for k in range(width)) % np.uint64(PRIME)
                inside = np.concatenate([np.arange(x, x + n - width + 1) for x, n in zip(start, size)])
                h, first = h[inside], np.cumsum(size - width + 1) - (size - width + 1)
                for i in range(perms):
                    out[at : at + len(some), i] = np.minimum.reduceat((h * a[i] + b[i]) % np.uint64(PRIME), first)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, perms, dtype="int32")), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sig], ["key", "signature"])

    return run


def minhash(df: DataFrame, key: str, text: str, perms: int = 128, width: int = 5, least: int = 20, seed: int = 42) -> DataFrame:
    """``(key, signature)``: minima of ``perms`` affine hashes over the character shingles.

    A shingle's hash is a sum of its code points by fixed multipliers, so a text is one pass
    over arrays and nothing is shuffled. Texts below ``least`` (at least ``width``) characters
    have no signature.
    """
    t = squash(F.col(text))
    rows = df.where(F.length(t) >= max(least, width)).select(F.col(key).alias("key"), t.alias("t"))
    return rows.mapInArrow(_signatures(width, perms, seed), f"key {dict(df.dtypes)[key]}, signature array<bigint>").withColumnRenamed("key", key)


def shingle_multipliers(width: int) -> list[int]:
    """Odd numbers below 2**38, by the congruence of ``permutations``."""
    return [(a << 8) + 1 for a, _ in permutations(width, 7)]


def signature_classes(signatures: DataFrame, key: str) -> DataFrame:
    """``(key, signature, copies)`` of the smallest key of each distinct signature."""
    return signatures.groupBy("signature").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")).select(key, "signature", "copies")


def banded_pairs(classes: DataFrame, key: str, bands: int, rows: int, least: float = 0.8) -> DataFrame:
    """``(key_a, key_b, estimate)`` of distinct signatures that agree in a whole band of ``rows`` minima and
    in a share of ``least`` of all; smaller key first. Copies are met once, as their class."""
    n = bands * rows
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    keyed = classes.select(key, F.explode(band).alias("__band"))
    a, b = keyed.withColumnRenamed(key, f"{key}_a"), keyed.withColumnRenamed(key, f"{key}_b")
    met = a.join(b, "__band").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b").distinct()
    sig = lambda s: classes.select(F.col(key).alias(f"{key}_{s}"), F.col("signature").alias(f"__{s}"))
    same = F.size(F.filter(F.zip_with("__a", "__b", lambda x, y: x == y), lambda x: x))
    both = met.join(sig("a"), f"{key}_a").join(sig("b"), f"{key}_b").withColumn("estimate", same / F.lit(float(n)))
    return both.where(F.col("estimate") >= least).select(f"{key}_a", f"{key}_b", "estimate")


def near_word_sets(df: DataFrame, key: str, text: str, words: int = 5, least: float = 0.8) -> DataFrame:
    """``(key, class, copies, links)``: each text of ``words`` words or more, the smallest key with the same set
    of word shingles, how many rows have that set, and how many other sets are similar to it by Jaccard.

    Exact: two sets of similarity ``least`` share a shingle among the rarest ``n - ceil(least * n) + 1``
    of either, so sets meet by these alone, and only sets of fitting size; both sets are compared then.
    """
    shingled = materialize(word_grams(df, key, text, words).groupBy(key).agg(F.sort_array(F.collect_list("gram")).alias("grams")), "grams")
    sets = materialize(shingled.groupBy("grams").agg(F.min(key).alias("class"), F.count(F.lit(1)).alias("copies")), "sets")
    counts = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    long = sets.select("class", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(counts.where("n > 1"), "gram")
    rarest = F.sort_array(F.collect_list(F.struct("n", "gram")))
    # shingles of one set only cannot meet: they come first in its order and use up its prefix
    held = long.groupBy("class", "size").agg(rarest.alias("g"))
    prefix = F.expr(f"size - cast(ceil(size * {least} - 1e-9) as int) + 1 - (size - size(g))")
    keyed = held.where(prefix > 0).select("class", "size", F.explode(F.transform(F.slice("g", 1, prefix), lambda x: x["gram"])).alias("gram"))
    a, b = keyed.withColumnsRenamed({"class": "a", "size": "na"}), keyed.withColumnsRenamed({"class": "b", "size": "nb"})
    met = a.join(b, "gram").where(F.col("a") < F.col("b")).where(F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9).select("a", "b").distinct()
    grams = lambda s: sets.select(F.col("class").alias(s), F.col("grams").alias(f"g{s}"))
    shared = F.size(F.array_intersect("ga", "gb"))
    pairs = met.join(grams("a"), "a").join(grams("b"), "b").where(shared >= (F.size("ga") + F.size("gb") - shared) * least - 1e-9).select("a", "b")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    known = sets.join(ends, "class", "left").select("grams", "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return shingled.join(known, "grams").select(key, "class", "copies", "links")


def contained_texts(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, phrase: str, anchor: int = 3) -> DataFrame:
    """Distinct ``(key, item)``: the document's words contain the item's words in a row.

    Words are those between white space, in lower case. Items are looked up by their first
    ``anchor`` words (or all, if fewer), of which one document gives each once; the whole phrase is compared
    then. Items without words are contained in nothing.
    """
    words = lambda c: F.split(squash(F.lower(F.col(c))), " ")
    asked = items.where(F.length(squash(F.col(phrase))) > 0).select(item, words(phrase).alias("w")).select(item, "w", F.least(F.size("w"), F.lit(anchor)).alias("n"))
    phrases = materialize(asked.select(item, F.array_join("w", " ").alias("phrase"), F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("anchor")), "phrases")
    # written, so that the words of a text are not made again for each of its runs
    docs = materialize(documents.where(F.length(squash(F.col(text))) > 0).select(key, words(text).alias("w")), "words")

    def runs_of(n: int):
        return F.when(F.size("w") >= n, grams_of(F.col("w"), n)).otherwise(F.array().cast("array<string>"))

    runs = F.flatten(F.array(*map(runs_of, range(1, anchor + 1))))
    anchors = docs.select(key, F.explode(F.array_distinct(runs)).alias("anchor")).join(phrases.select("anchor").distinct(), "anchor", "left_semi")
    met = anchors.join(phrases, "anchor").join(docs.select(key, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("all")), key)
    return met.where(F.col("all").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))).select(key, item).distinct()


PRIME = 4294967291


def permutations(n: int, seed: int) -> list[tuple[int, int]]:
    """Multipliers below 2**30 and offsets, by a linear congruence from the seed."""
    out, x = [], seed
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        a = (x >> 34) | 1
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((a, x >> 33))
    return out
