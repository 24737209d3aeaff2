"""Problem 8: encode a corpus with a public byte-level tokenizer.

Method: one pass counts the words of all texts; the most frequent ones (a bound given
as parameter) are compiled with their token ids into a minimal acyclic transducer, which
is written to the shared folder, shipped to the executors and memory-mapped. The second
pass looks the distinct words of each batch up in it, many at a time, and merges unseen
words exactly. The result does not depend on what the lexicon holds.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bytebpe import ROUGH_PATTERN, WORD_PATTERN, Transducer, build_transducer, merge_word, read_ranks
from pairloom.session import put_bytes

#: Where the vocabulary files are; a parameter of every call, read from no environment.
VOCABULARIES = "/opt/tokenizers"
SLICE_CHARS = 4_000_000
FLUSH_WORDS = 200_000


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> str:
    return f"{folder}/{name}.tiktoken"


def _count_words(batches: Iterator) -> Iterator:
    import re

    import pyarrow as pa

    find = re.compile(ROUGH_PATTERN).findall
    seen: Counter = Counter()

    def flush():
        words, n = list(seen), list(seen.values())
        seen.clear()
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.string()), pa.array(n[at : at + 50_000], pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(find(text))
            if len(seen) > FLUSH_WORDS:
                yield from flush()
    yield from flush()


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``(word, n)`` over all texts, counted inside partitions first. Words are cut by
    ``ROUGH_PATTERN``: a word the exact pattern cuts otherwise only misses the lexicon."""
    texts = df.select(F.col(text).alias("t")).where(F.length("t") > 0)
    return texts.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_file(df: DataFrame, text: str, vocabulary: str, size: int) -> str:
    """Build the transducer of the ``size`` most frequent words; returns its file name on every executor."""
    spark = df.sparkSession
    ranks = read_ranks(vocabulary)
    top = word_counts(df, text).where("n > 1 and length(word) <= 64").orderBy(F.col("n").desc(), "word").limit(size)
    words = sorted(r["word"].encode() for r in top.select("word").collect())  # `size` bounds this list
    path = put_bytes(spark, "lexicon", build_transducer(words, [merge_word(w, ranks) for w in words]))
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


class Encoder:
    """Encodes lists of texts to flat ids and lengths; unseen words go through a bounded cache."""

    def __init__(self, lexicon: str, vocabulary: str, cache: int = 100_000) -> None:
        import regex

        self.find = regex.compile(WORD_PATTERN).findall
        self.fst, self.ranks = Transducer(lexicon), read_ranks(vocabulary)
        self.cache: OrderedDict[str, list[int]] = OrderedDict()
        self.most = cache

    def unseen(self, word: str) -> list[int]:
        ids = self.cache.get(word)
        if ids is None:
            ids = merge_word(word.encode(), self.ranks)
            if len(word) <= 64:
                self.cache[word] = ids
                if len(self.cache) > self.most:
                    self.cache.popitem(last=False)
        return ids

    def encode(self, texts: list[str | None], with_ids: bool = True):
        """``(ids or None, tokens per text)`` as numpy arrays."""
        import numpy as np

        number: dict[str, int] = {}
        codes: list[int] = []
        per_text = np.zeros(len(texts) + 1, dtype="int64")
        for i, text in enumerate(texts):
            if text:
                found = self.find(text)
                codes.extend([number.setdefault(w, len(number)) for w in found])
            per_text[i + 1] = len(codes)
        words = list(number)
        lex = self.fst.numbers([w.encode() for w in words])
        size = np.zeros(len(words), dtype="int64")
        seen = lex >= 0
        starts = np.asarray(self.fst.starts, dtype="int64")
        size[seen] = starts[lex[seen] + 1] - starts[lex[seen]]
        extra, begin = [], np.zeros(len(words), dtype="int64")
        begin[seen] = starts[lex[seen]]
        at = len(self.fst.ids)
        for k in np.flatnonzero(~seen):
            ids = self.unseen(words[k])
            begin[k], size[k] = at, len(ids)
            at += len(ids)
            extra.extend(ids)
        code = np.array(codes, dtype="int64")
        length = size[code] if len(code) else np.array([], "int64")
        total = np.r_[0, np.cumsum(length)]
        tokens = np.diff(total[per_text])
        if not with_ids:
            return None, tokens
        pool = np.concatenate([np.asarray(self.fst.ids), np.array(extra, dtype="int32")]).astype("int32")
        first = begin[code] - total[:-1] if len(code) else np.array([], "int64")
        where = np.repeat(first, length) + np.arange(int(total[-1]))
        return pool[where], tokens


def _encode_batches(lexicon: str, vocabulary: str, with_ids: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc = Encoder(SparkFiles.get(lexicon), vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= SLICE_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                ids, n = enc.encode(texts[at:end], with_ids)
                if with_ids:
                    out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype("int32")), pa.array(ids, pa.int32()))
                else:
                    out = pa.array(n.astype("int64"))
                yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), out], ["key", "out"])
                at = end

    return run


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None, lexicon_words: int = 1 << 16, with_ids: bool = True) -> DataFrame:
    """``(key, ids)`` of every row, or ``(key, n_tokens)`` without ids.

    Null and empty texts give an empty list (0 tokens); white space is text. Repeated
    keys keep their rows; other columns are not carried.
    """
    vocabulary = vocabulary or vocabulary_path()
    lexicon = lexicon_file(df, text, vocabulary, lexicon_words)
    kind = dict(df.dtypes)[key]
    made = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).mapInArrow(
        _encode_batches(lexicon, vocabulary, with_ids), f"key {kind}, out {'array<int>' if with_ids else 'bigint'}"
    )
    return made.select(F.col("key").alias(key), F.col("out").alias("ids" if with_ids else "n_tokens"))
