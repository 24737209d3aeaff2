"""Similar pairs of problem 1 whose shared parts are common, whatever else the tables hold."""

from __future__ import annotations

import random

import numpy as np

from pairloom.llm import overlap, queries

ALPHABET = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호"


def found(spark, rows):
    base = overlap.records(spark.createDataFrame(rows, "row_id bigint, side string, query string, positive string"), 0.8).persist()
    got = {(x["row_id_a"], x["row_id_b"]) for x in overlap.row_pairs(overlap.class_pairs(base), base).collect()}
    base.unpersist()
    return got


def scattered(r, t, share):
    at = set(r.sample(range(len(t)), int(len(t) * share + 1e-9)))
    return "".join("힣" if i in at else c for i, c in enumerate(t))


def test_pairs_that_share_only_common_parts(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice(ALPHABET) for _ in range(n))
    query, common = word(40), word(200)
    rows, want = [], set()
    for i in range(60):  # one phrase in all positives and queries, edits everywhere else
        q, p = query[:24] + word(8), common[:150] + word(50)
        rows += [(2 * i, "a", q, p), (2 * i + 1, "b", q[:24] + scattered(r, q[24:], 0.75), p[:150] + scattered(r, p[150:], 0.8))]
        want.add((2 * i, 2 * i + 1))
    for i in range(60, 120):  # edits spread as thin as the similarity allows
        q, p = word(r.choice([5, 12, 33, 100, 300])), word(r.choice([10, 60, 200]))
        rows += [(2 * i, "a", q, p), (2 * i + 1, "b", "".join("힣" if k % 5 == 4 else c for k, c in enumerate(q)), "".join("힣" if k % 5 == 4 else c for k, c in enumerate(p)))]
        want.add((2 * i, 2 * i + 1))
    assert want <= found(spark, rows)


def test_very_long_query(spark):
    r = random.Random(9)
    long = "".join(r.choice(ALPHABET) for _ in range(40_000))
    rows = [(0, "a", long, "가나다라마바사"), (1, "b", long[:-3] + "힣", "가나다라마바사"), (2, "b", long[:20_000], "가나다라마바사")]
    assert found(spark, rows) == {(0, 1)}


def test_chosen_chunks_are_disjoint_and_enough():
    r = random.Random(7)
    texts = ["".join(r.choice(ALPHABET) for _ in range(n)) for n in [*range(1, 60), 127, 128, 129, 500, 4001]]
    noise = np.random.default_rng(1)
    for cost in (lambda h: np.zeros(h.shape, "float32"), lambda h: noise.random(h.shape, "float32")):
        flat = overlap.Flat(texts)
        t, h, at, n = flat.chosen_segments(0.8, cost)
        every = set(zip(*(x.tolist() for x in flat.all_segments(0.8))))
        assert set(zip(t.tolist(), h.tolist(), at.tolist(), n.tolist())) <= every
        taken = np.bincount(t, minlength=len(texts))
        assert all(k >= overlap.segments_needed(len(x), 0.8) for k, x in zip(taken.tolist(), texts))
        covered = np.zeros(len(flat.codes), int)
        for k, x, y in zip(t.tolist(), at.tolist(), n.tolist()):
            covered[flat.start[k] + x : flat.start[k] + x + y] += 1
        assert covered.max() == 1


def test_no_count_of_chunks_loses_a_pair():
    r = random.Random(11)
    full = lambda h: np.ones(h.shape, "float32")
    misleading = lambda h: (h % 97).astype("float32")
    left = ["".join(r.choice(ALPHABET) for _ in range(r.choice([*range(4, 60), 150, 400]))) for _ in range(400)]
    right = [scattered(r, x, 0.2) for x in left]
    held = {x[:2] for x in zip(*(x.tolist() for x in overlap.Flat(right).all_segments(0.8)))}
    for cost in (full, misleading):
        t, h, _, _ = overlap.Flat(left).chosen_segments(0.8, cost)
        whole = np.zeros(400, int)
        for x in zip(t.tolist(), h.tolist()):
            whole[x[0]] += x in held
        edits = np.array([int(len(x) * 0.2 + 1e-9) for x in left])
        assert (whole >= np.maximum(1, np.bincount(t, minlength=400) - edits)).all()


def test_a_bag_loses_one_bit_an_edit():
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (1, 7, 30, 200)] + [""]
    cut = [t[:-1] for t in texts]
    words = [np.stack(overlap.Flat(x).bags(), 1).tolist() for x in (texts, cut)]
    for a, b in zip(*words):
        assert sum((x & ~y).bit_count() for x, y in zip(a, b)) <= 1
    assert words[0][4] == [0, 0]


def test_one_digest_in_every_record(spark, monkeypatch):
    """A phrase that all records share is salted; the pairs stay the same."""
    r = random.Random(13)
    word = lambda n: "".join(r.choice(ALPHABET) for _ in range(n))
    rows, want = [], set()
    for i in range(300):
        q, p = "같은말" + word(3), word(12)
        rows += [(2 * i, "a" if i % 2 else "b", q, p), (2 * i + 1, "b" if i % 2 else "a", q, p[:-1] + "힣")]
        want.add((2 * i, 2 * i + 1) if i % 2 else (2 * i + 1, 2 * i))
    monkeypatch.setattr(overlap, "SALTED", 4)
    salted = found(spark, rows)
    monkeypatch.undo()
    assert want <= salted and salted == found(spark, rows)


def test_query_that_many_records_share(spark):
    """Records of one query meet by their positives and are not paired with each other."""
    r = random.Random(17)
    word = lambda n: "".join(r.choice(ALPHABET) for _ in range(n))
    rows = []
    for i in range(120):
        p = word(r.choice([5, 40, 90]))
        rows += [(2 * i, "a", "무엇을 물었는가 하는 같은 질문", p), (2 * i + 1, "b", "무엇을 물었는가 하는 같은 질문을", p[:-1] + "힣")]
    base = overlap.records(spark.createDataFrame(rows, "row_id bigint, side string, query string, positive string"), 0.8).persist()
    results = []
    for heavy in (1, 10**9):
        got = overlap.row_pairs(overlap.class_pairs(base, heavy=heavy), base).collect()
        assert all(0 < x["fraction"] <= 1 for x in got)
        results.append(sorted(map(tuple, got)))
    assert results[0] == results[1] and {(2 * i, 2 * i + 1) for i in range(120)} <= {x[:2] for x in results[0]}
    base.unpersist()


def test_the_smaller_row_id_comes_first(spark, tmp_path):
    text = "무엇을 물었는가 하는 같은 질문"
    rows = [(5, text, "열 글자는 넘는 대답이다", "train", "s"), (3, text, "열 글자는 넘는 대답이다", "test", "s"), (9, text, "열 글자는 넘는 대답이다!", "dev", "s"), (11, None, " ", "test", "s")]
    spark.createDataFrame(rows, "row_id bigint, query string, positive string, split string, source_id string").write.parquet(f"{tmp_path}/candidates.parquet")
    assert sorted(map(tuple, queries.p1_found(spark, str(tmp_path)).collect())) == [(3, 5), (5, 9)]
    report = {r["split"]: r for r in queries.p1_report(spark, str(tmp_path)).collect()}
    assert report["test"]["rows"] == 2 and report["test"]["overlapping_rows"] == 1 and report["test"]["mean_fraction"] == 1.0
