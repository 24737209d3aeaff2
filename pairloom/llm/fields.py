"""Spellings in the candidate table brought to one value, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands in the data for "no value", in lower case.
STAND_INS = ["", "unknown", "n/a"]
# SHA-256 of the empty string, and all zeros.
EMPTY_DIGESTS = ["e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "0" * 64]
# Names of the splits.
SPLITS = {"train": "train", "validation": "validation", "dev": "validation", "valid": "validation", "val": "validation", "test": "test"}

_EDGE = "(?U)^[\\s\\p{Cf}]+|[\\s\\p{Cf}]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def is_blank(c: Column) -> Column:
    """True for null and for white space only."""
    return c.isNull() | ~c.rlike("(?U)[^\\s]")


def digest(c: Column) -> Column:
    """Lower-case hex without prefix or blanks; null for missing and stand-in values."""
    bare = F.regexp_replace(F.lower(trimmed(c)), "^[a-z0-9_-]+:\\s*", "")
    return F.when(bare.isin(STAND_INS + EMPTY_DIGESTS), None).otherwise(bare)


def repository(c: Column) -> Column:
    """The stored name without outer blanks; null for missing and stand-in values."""
    bare = trimmed(c)
    return F.when(F.lower(bare).isin(STAND_INS + EMPTY_DIGESTS), None).otherwise(bare)


def split_name(c: Column) -> Column:
    low = F.lower(trimmed(c))
    out = F.lit(None).cast("string")
    for spelt, name in SPLITS.items():
        out = F.when(low == spelt, F.lit(name)).otherwise(out)
    return out


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(c)), "(?U)[\\s_-]+", "_")
