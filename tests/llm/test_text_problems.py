"""Plain forms, tokenizing, packing and search against brute force, with the edge cases of each operator."""

from __future__ import annotations

import base64
import itertools
import os
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import bytebpe, glyphs, leaks, packing, tokens, unify, wumanber

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.vocabulary_path()), reason="no vocabulary files")
ODD = ["ｈｅｌｌｏ", "é", "é", "한", "한", "각", "а​x", "a b", "", "  ", "Ё", "ﬁ", "ﾡ", "歷", "̣́a", "ạ́", "plain text", "\U0001d400bc"]


def test_plain_is_stable_and_equal_looks_meet():
    for cp in range(0x3000):
        once = glyphs.plain_text(chr(cp))
        assert glyphs.plain_text(once) == once
    assert glyphs.plain_text("ｈеllо​") == "hello"
    assert glyphs.bare_text("Ａ-b　Ｃ_1!") == "abc1"
    assert glyphs.plain_text("É") == "É" != glyphs.plain_text("E")
    assert glyphs.plain_text(None) is None


def test_unify_equals_python(spark):
    rows = [(i, t, None if i % 3 else (t or "") + "é") for i, t in enumerate(ODD + [None, "x" * 30000 + "е" + "각" * 5000])]
    df = spark.createDataFrame(rows + rows[:2], "row_id bigint, query string, positive string").selectExpr("*", "1 as token", "2 as plain", "3 as id")
    got = unify.plain_form(df, "row_id", ["query", "positive"]).collect()
    assert len(got) == sum(t is not None for r in rows + rows[:2] for t in r[1:])
    for r in got:
        assert r["plain"] == glyphs.plain_text(r["stored"]), ascii(r["stored"][:50])
    empty = unify.plain_form(df.limit(0), "row_id", ["query"])
    assert empty.count() == 0 and unify.same_look_pairs(empty, "row_id").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aeх̣́​　한가ｅé ", max_size=12), min_size=1, max_size=8))
def test_python_plain_form_is_idempotent(texts):
    for t in texts:
        p = glyphs.plain_text(t)
        assert glyphs.plain_text(p) == p == unicodedata.normalize("NFC", p)


def test_same_look_pairs(spark):
    rows = [(1, "café"), (2, "café"), (3, "café"), (4, "cafe"), (5, " "), (6, "　"), (7, None)]
    forms = unify.plain_form(spark.createDataFrame(rows, "row_id bigint, query string"), "row_id", ["query"])
    got = {(r[1], r[2]) for r in unify.same_look_pairs(forms, "row_id").collect()}
    assert got == {(1, 2), (1, 3)}  # copies alone make no pair, blanks are no case


@needs_vocabulary
def test_encoding_equals_the_library(spark):
    import tiktoken

    ranks = bytebpe.read_ranks(tokens.vocabulary_path())
    enc = tiktoken.Encoding("own", pat_str=bytebpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "hello world", "안녕하세요 여러분!\r\n\r\n", "x" * 5000, "日本語" * 400, "it's 2024　년   a\u0085b", "<|endoftext|>", "🙂🙃 emoji\ttab", "hello world"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, "hello world")], "doc_id bigint, text string").selectExpr("*", "'x' as ids", "0 as key")
    for words in (1, 1000):
        got = tokens.encode(df, "doc_id", "text", lexicon_words=words).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            assert list(r["ids"]) == (enc.encode_ordinary(texts[r["doc_id"]]) if texts[r["doc_id"]] else [])
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.encode(df, "doc_id", "text", with_ids=False).collect()}
    assert n[0] == n[1] == 0 and n[3] == 2
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_merge_word_is_exact(text):
    import tiktoken

    ranks = bytebpe.read_ranks(tokens.vocabulary_path()) if not hasattr(test_merge_word_is_exact, "r") else test_merge_word_is_exact.r
    test_merge_word_is_exact.r = ranks
    enc = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    if text:
        assert bytebpe.merge_word(text.encode(), ranks) == enc.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_transducer(tmp_path_factory, words, others):
    words = sorted(words)
    path = str(tmp_path_factory.mktemp("t") / "a.bin")
    with open(path, "wb") as f:
        f.write(bytebpe.build_transducer(words, [[i, i + 1] for i in range(len(words))]))
    t = bytebpe.Transducer(path)
    probe = words + others
    want = [words.index(w) if w in words else -1 for w in probe]
    assert t.numbers(probe).tolist() == want
    for i, w in enumerate(words):
        n = int(t.numbers([w])[0])
        assert t.ids[t.starts[n] : t.starts[n + 1]].tolist() == [i, i + 1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 25))
def test_best_fill_is_optimal(counts, room):
    used = packing.best_fill(counts, room)
    assert all(used[k] <= counts[k] for k in used)
    total = sum(k * n for k, n in used.items())
    best = max(sum(k * n for k, n in zip(counts, c)) for c in itertools.product(*[range(n + 1) for n in counts.values()]) if sum(k * n for k, n in zip(counts, c)) <= room)
    assert total == best


def test_packing(spark):
    rows = [(1, 10), (2, 7), (3, 3), (4, 25), (5, 0), (6, None), (7, 5), (8, 5), (9, 10), (10, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").selectExpr("*", "9 as container", "9 as len", "9 as piece")
    got = packing.pack(df, "doc_id", "n_tokens", 10).collect()
    filled, sizes = {}, {}
    for r in got:
        filled[r["container"]] = filled.get(r["container"], 0) + r["n_tokens"]
        sizes.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n_tokens"]))
    assert all(v <= 10 for v in filled.values()) and sum(filled.values()) == 66
    assert sorted(sizes[4]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert sizes[5] == sizes[6] == [(0, 0, 0)]
    assert len([k for k, v in filled.items() if v]) == 7  # the fewest possible
    assert packing.pack(df.limit(0), "doc_id", "n_tokens", 10).count() == 0
    many = spark.range(3000).selectExpr("id as doc_id", "10 as n_tokens")  # one hot length
    assert packing.pack(many, "doc_id", "n_tokens", 10).select("container").distinct().count() == 3000


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab가", min_size=1, max_size=9), min_size=1, max_size=6), st.lists(st.text(alphabet="ab가", max_size=40), min_size=1, max_size=4))
def test_wu_manber_finds_every_window(tmp_path_factory, patterns, texts):
    m, b = wumanber.length_class(min(map(len, patterns)))
    h, slots, shifts = wumanber.pattern_rows([p[:m] for p in patterns], m, b)
    bits = wumanber.bucket_bits(len(patterns))
    buckets, reach = np.zeros(1 << bits, dtype=bool), {}
    buckets[np.concatenate(wumanber.buckets_of(h, bits))] = True
    for slot, p in zip(wumanber.reach_slot(h).tolist(), patterns):
        reach[slot] = max(reach.get(slot, 0), len(p))
    path = str(tmp_path_factory.mktemp("w") / "t.bin")
    with open(path, "wb") as f:
        f.write(wumanber.table_bytes(m, b, slots, shifts.astype("uint8"), (np.array(list(reach)), np.array(list(reach.values()))), bits, np.packbits(buckets, bitorder="little").tobytes()))
    t = wumanber.Table(path)
    codes, start = wumanber.codes_of(texts)
    at, far = t.search(codes, wumanber.block_slots(codes, b), wumanber.prefix_sums(codes))
    want = {int(s) + i for s, x in zip(start, texts) for i in range(len(x) - m + 1) if any(x[i : i + m] == p[:m] for p in patterns)}
    assert want <= set(at.tolist()) and len(set(at.tolist()) - want) <= len(want) + 3
    joined = "\0".join([*texts, ""])
    for i, n in zip(at.tolist(), far.tolist()):
        assert all(n >= len(p) for p in patterns if joined[i:].startswith(p))


def test_a_table_has_a_bounded_size():
    assert wumanber.bucket_bits(1) == 16 and wumanber.bucket_bits(10**12) == 29


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("가나다라마바사아자차카타파하"), n))
    shared = word(200)
    rows = [(1, "짧은", word(20)), (2, word(12), shared), (3, "Ｑ" + word(9), word(70)), (4, "!!!", word(90)), (5, word(40), shared), (6, None, word(80)), (7, "가", word(10))]
    docs = [(1, f"앞 {shared[50:110]} 뒤"), (2, f"앞 {shared[50:109]} 뒤"), (3, rows[2][1].replace("Ｑ", " q-")), (4, None), (5, ""), (6, "." * 5000), (7, rows[3][2] * 3), (8, f"{rows[4][1]} 짧 은 {word(20000)}"), (1, f"{shared}")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as window", "'k' as kind", "1 as q")
    r = spark.createDataFrame(rows, "row_id bigint, query string, positive string").selectExpr("*", "1 as p", "2 as block")
    want = set()
    for did, text in docs:
        x = glyphs.bare_text(text) or ""
        for rid, q, p in rows:
            q, p = glyphs.bare_text(q) or "", glyphs.bare_text(p) or ""
            if (q and q in x) or any(p[i : i + 60] in x for i in range(len(p) - 59)):
                want.add((did, rid))
    got = {(x[0], x[1]) for x in leaks.leaks(d, r).collect()}
    assert got == want and (1, 2) in want and (2, 2) not in want
    assert {(x[0], x[1]) for x in leaks.leaks(d, r, hot_pairs=0).collect()} == want  # every block is hot
    assert leaks.leaks(d.limit(0), r).count() == 0 and leaks.leaks(d, r.limit(0)).count() == 0


def test_leaks_of_rows_with_one_beginning(spark):
    """A block that all positives and documents share, and queries with one beginning, give the pairs they should."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("가나다라마바사아자차카타파하"), n))
    block, begin = word(30), word(40)
    rows = [(i, begin + word(5), block + word(45)) for i in range(40)]
    docs = [(i, word(30) + block + word(30)) for i in range(40)] + [(100 + i, word(9) + rows[i][2][: 60 - i % 2] + "힣" + word(9)) for i in range(10)] + [(200 + i, word(3) + rows[i][1] + word(3)) for i in range(10)]
    d, r = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(rows, "row_id bigint, query string, positive string")
    want = {(100 + i, i) for i in range(0, 10, 2)} | {(200 + i, i) for i in range(10)}
    for hot_pairs in (0, 10**9):
        assert {tuple(x) for x in leaks.leaks(d, r, hot_pairs=hot_pairs).collect()} == want


def test_vocabulary_line_format(tmp_path):
    p = tmp_path / "v.tiktoken"
    p.write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"b") + b" 1\n" + base64.b64encode(b"ab") + b" 2\n")
    ranks = bytebpe.read_ranks(str(p))
    assert bytebpe.merge_word(b"abab", ranks) == [2, 2] and bytebpe.merge_word(b"ba", ranks) == [1, 0]
