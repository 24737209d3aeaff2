"""Text functions as column expressions; Arrow UDFs only for Unicode normalization and LCS."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Fixed value: the characters str.split() takes for white space, as a character class
# that Java and RE2 read alike.
SPACE_CLASS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Characters without width that benchmark normalization drops.
ZERO_WIDTH = "​‌‍⁠﻿"
# Substrings that mark a query as a natural question.
QUESTION_MARKS = ["?", "까", "나요", "인가요", "어떻게", "무엇", "뭐", "왜", "언제", "어디", "누가", "몇"]


def squash(c: Column) -> Column:
    """White space runs to one blank, outer white space off."""
    return F.regexp_replace(F.regexp_replace(c, f"[{SPACE_CLASS}]+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


@F.pandas_udf(StringType())
def nfc_text(s: pd.Series) -> pd.Series:
    """Canonical composition, line ends to LF, outer white space off; inner white space kept."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n").strip())


@F.pandas_udf(StringType())
def compat_text(s: pd.Series) -> pd.Series:
    """Compatibility composition, white space runs to one blank, stripped; null gives ''."""
    return s.map(lambda t: "" if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


_DROP = {ord(c): None for c in ZERO_WIDTH}


@F.pandas_udf(StringType())
def benchmark_text(s: pd.Series) -> pd.Series:
    """Compatibility form without zero-width characters, white space runs to one blank."""
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(_DROP).split()))


def semantic_body(q: Column) -> Column:
    """Text after the last ``Query:`` of an instructed query, else the stripped query."""
    stored = strip(q).startswith("Instruct:") & q.contains("Query:")
    return F.when(stored, strip(F.substring_index(q, "Query:", -1))).otherwise(strip(q))


def profile_split(q: Column) -> tuple[Column, Column]:
    """(instruction, body): cut at the first line break before ``Query:``; a one-line
    instructed query is cut at its last ``Query:``; other queries are unprompted."""
    at = F.locate("\nQuery:", q)
    inline = strip(q).startswith("Instruct:") & q.contains("Query:")
    last = F.substring_index(q, "Query:", -1)
    head = F.when(at > 0, F.substring(q, F.lit(1), at - 1)).when(inline, F.substring(q, F.lit(1), F.length(q) - F.length(last) - 6)).otherwise("unprompted")
    body = F.when(at > 0, F.substring(q, at + 7, F.lit(1 << 30))).when(inline, last).otherwise(q)
    return strip(head), strip(body)


def stored_instruction_stripped(q: Column) -> Column:
    """Body of a query that must carry an instruction; an error where it carries none."""
    body = semantic_body(q)
    ok = strip(q).startswith("Instruct:") & q.contains("Query:") & (F.length(body) > 0)
    return F.when(ok, body).otherwise(F.raise_error(F.lit("no stored instruction")))


def instructed(q: Column, instruction: str) -> Column:
    """``Instruct: …`` line before the query, unless there is one."""
    return F.when(strip(q).startswith("Instruct:"), q).otherwise(F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), q))


def occurrences(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def query_style(q: Column) -> Column:
    """Keyword list (two commas of one kind), natural question, short (at most 40 code
    points) or long: the first that holds for the stripped query."""
    q = strip(q)
    commas = (occurrences(q, ",") >= 2) | (occurrences(q, "，") >= 2)
    asks = F.lit(False)
    for w in QUESTION_MARKS:
        asks = asks | q.contains(w)
    return (
        F.when(commas, "comma_keyword_list").when(asks, "natural_question").when(F.length(q) <= 40, "short_search_or_title").otherwise("long_statement_or_search")
    )


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def hash_number(hexed: Column, digits: int = 16) -> Column:
    """The first ``digits`` hex digits as an unsigned number."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("decimal(20,0)")


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(stable_hash(*parts), 1, 24))


def capped_text(c: Column, most: int) -> tuple[Column, Column]:
    """(text cut to ``most`` code points with trailing white space off, was it cut?); 0 means no limit."""
    if most == 0:
        return c, F.lit(False)
    cut = F.length(c) > most
    return F.when(cut, F.regexp_replace(F.substring(c, 1, most), f"[{SPACE_CLASS}]+$", "")).otherwise(c), cut


def shingles(c: Column, n: int) -> Column:
    """Distinct character n-grams; [] for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), 1))


def lexical_features(c: Column) -> Column:
    """Words of two or more letters or digits ('w:') and character pairs ('c2:') as one set."""
    low = F.lower(c)
    words = F.filter(F.regexp_extract_all(low, F.lit("[0-9a-z가-힣]+"), 0), lambda w: F.length(w) >= 2)
    solid = F.regexp_replace(low, f"[{SPACE_CLASS}]+", "")
    pairs = F.regexp_extract_all(solid, F.lit("(?s)(?=(..))."), 1)
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), F.transform(pairs, lambda p: F.concat(F.lit("c2:"), p))))


def first_present(*cs: Column) -> Column:
    """The first value that is neither null nor blank, stripped."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cs])


def yes_probability(no: Column, yes: Column) -> Column:
    """Two-way softmax, stable for large logits."""
    d = yes.cast("double") - no.cast("double")
    e = F.exp(-F.abs(d))
    return F.when(d >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def chat_row(query: Column, positive: Column, negatives: Column) -> Column:
    """The strict nested training row: messages, positive_messages, negative_messages."""
    said = lambda role, t: F.array(F.struct(F.lit(role).alias("role"), t.alias("content")))
    return F.struct(
        said("user", query).alias("messages"), F.array(said("user", positive)).alias("positive_messages"),
        F.transform(negatives, lambda n: said("user", n)).alias("negative_messages"),
    )


def length_proxy(query: Column, positive: Column, negatives: Column) -> Column:
    """Longest sequence of a row, in code points."""
    return F.array_max(F.concat(F.array(F.length(query), F.length(positive)), F.transform(negatives, lambda n: F.length(n))))


@F.pandas_udf(DoubleType())
def copied_share(query: pd.Series, text: pd.Series) -> pd.Series:
    """Longest common substring of the blank-free texts over the length of the query."""

    def share(q, t):
        if q is None or t is None:
            return None
        q, t = "".join(q.split()), "".join(t.split())
        if not q:
            return 0.0
        # binary search on the length: a common substring of n characters implies one of n - 1
        lo, hi = 0, min(len(q), len(t))
        while lo < hi:
            n = (lo + hi + 1) // 2
            seen = {q[i : i + n] for i in range(len(q) - n + 1)}
            if any(t[i : i + n] in seen for i in range(len(t) - n + 1)):
                lo = n
            else:
                hi = n - 1
        return lo / len(q)

    return pd.Series([share(q, t) for q, t in zip(query, text)], dtype="float64")


def safe_component(c: Column) -> Column:
    """A text as one path component."""
    return F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z._-]+", "_"), "^[._]+|[._]+$", "")
