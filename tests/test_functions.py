"""Text functions and their edge cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as tx


def one(spark, value, *cols):
    df = spark.createDataFrame([(value,)], "q string")
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


Q = F.col("q")


@pytest.mark.parametrize(
    ("q", "body", "instruction", "profile"),
    [
        ("Instruct: a\nQuery: b Query: c", "c", "Instruct: a", "b Query: c"), ("  plain ", "plain", "unprompted", "plain"), ("do\nQuery: x", "do\nQuery: x", "do", "x"),
        ("Instruct: a Query: b", "b", "Instruct: a", "b"), ("Instruct: a", "Instruct: a", "unprompted", "Instruct: a"), (None, None, "unprompted", None),
    ],
)
def test_bodies(spark, q, body, instruction, profile):
    head, rest = tx.profile_split(Q)
    assert one(spark, q, tx.semantic_body(Q), head, rest) == (body, instruction, profile)


def test_stored_instruction_is_required(spark):
    assert one(spark, "Instruct: x\nQuery: y", tx.stored_instruction_stripped(Q)) == ("y",)
    with pytest.raises(Exception, match="no stored instruction"):
        one(spark, "plain", tx.stored_instruction_stripped(Q))


def test_instructed_once(spark):
    made = one(spark, "q", tx.instructed(Q, "find"))[0]
    assert made == "Instruct: find\nQuery: q" and one(spark, made, tx.instructed(Q, "find")) == (made,)


@pytest.mark.parametrize(("q", "style"), [("a, b, c", "comma_keyword_list"), ("a，b，c", "comma_keyword_list"), ("이건 뭐지", "natural_question"), (" " + "x" * 40, "short_search_or_title"), ("x" * 41, "long_statement_or_search")])
def test_style(spark, q, style):
    assert one(spark, q, tx.query_style(Q)) == (style,)


def test_normalizers(spark):
    t = "한  ａ​b\r\nc "
    assert one(spark, t, tx.nfc_text("q"), tx.compat_text("q"), tx.benchmark_text("q"), tx.squash(Q)) == ("한  ａ​b\nc", "한 a​b c", "한 ab c", "한 ａ​b c")
    assert one(spark, None, tx.nfc_text("q"), tx.compat_text("q"), tx.benchmark_text("q")) == (None, "", None)


def test_squash_takes_the_white_space_of_python(spark):
    for cp in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        assert one(spark, f"a{chr(cp)}b{chr(cp)}", tx.squash(Q)) == ("a b",), hex(cp)


def test_hashes(spark):
    import hashlib

    h = hashlib.sha256(b"s\0q").hexdigest()
    assert one(spark, "q", tx.stable_hash(F.lit("s"), Q), tx.hash_number(tx.stable_hash(F.lit("s"), Q)), tx.stable_id("doc", F.lit("s"), Q)) == (h, int(h[:16], 16), "doc-" + h[:24])


def test_caps_shingles_features(spark):
    assert one(spark, "abc  def", *tx.capped_text(Q, 5)) == ("abc", True) and one(spark, "abc", *tx.capped_text(Q, 0)) == ("abc", False)
    assert one(spark, "ababab🙂x", tx.shingles(Q, 5))[0] == ["ababa", "babab", "abab🙂", "bab🙂x"] and one(spark, "abcd", tx.shingles(Q, 5))[0] == []
    assert set(one(spark, "Ab 한글 1", tx.lexical_features(Q))[0]) == {"w:ab", "w:한글", "c2:ab", "c2:b한", "c2:한글", "c2:글1"}


def test_scores_and_rows(spark):
    import math

    df = spark.createDataFrame([(800.0, -800.0), (1.0, 2.0)], "n double, y double")
    p = [r[0] for r in df.select(tx.yes_probability(F.col("n"), F.col("y"))).collect()]
    assert p[0] == 0.0 and abs(p[1] - 1 / (1 + math.exp(-1))) < 1e-12
    row = one(spark, "q", tx.chat_row(Q, F.lit("p"), F.array(F.lit("n"))))[0].asDict(True)
    assert row == {"messages": [{"role": "user", "content": "q"}], "positive_messages": [[{"role": "user", "content": "p"}]], "negative_messages": [[{"role": "user", "content": "n"}]]}
    assert one(spark, "q", tx.length_proxy(Q, F.lit("pp"), F.array(F.lit("nnn")))) == (3,)


def test_copied_share(spark):
    df = spark.createDataFrame([("ab cd", "xxabcdyy"), ("abc", "xbcx"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(tx.copied_share("a", "b")).collect()] == [1.0, 2 / 3, 0.0, None]


def test_safe_component(spark):
    assert one(spark, "../a b/c.", tx.safe_component(Q)) == ("a_b_c",)
