"""Operators against small worked cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pairloom.operators import batching as bt
from pairloom.operators import cleaning as cl
from pairloom.operators import contracts as ct
from pairloom.operators import decontam as dc
from pairloom.operators import holdout as ho
from pairloom.operators import joins
from pairloom.operators import negatives as ng
from pairloom.operators import ranking as rk
from pairloom.operators import vectors as vc
from pairloom.operators.numbering import number_in_order, number_within


def audit(spark, blocked, declared):
    items = spark.createDataFrame(blocked, "kind string, task string, text string")
    train = spark.createDataFrame([(1, "src", declared, "body", "positive text")], "row_id bigint, source_id string, tasks array<string>, query string, positive string")
    r = dc.roles(train, "row_id", {"query": F.col("query"), "positive": F.col("positive")}, ["source_id", "tasks"])
    m = dc.matches(r, dc.blocklist(items))
    rows = dc.overlap_audit(m, "source_id", "tasks").withColumn("status", dc.overlap_status(F.col("critical"), F.col("expected"), F.col("corpus"))).collect()
    return rows[0].asDict() if rows else None, dc.critical_rows(m, "row_id", "tasks").count()


def test_overlap_cases(spark):
    critical, dropped = audit(spark, [("query_text", "t", " body "), ("corpus_text", "t", "positive  text")], [])
    assert (critical["critical"], critical["corpus"], critical["status"], dropped) == (1, 1, "critical_query_or_evaluation_text_overlap", 1)
    corpus, dropped = audit(spark, [("corpus_text", "t", "positive text")], [])
    assert (corpus["critical"], corpus["status"], dropped) == (0, "pass_with_retrieval_corpus_exposure", 0)
    declared, dropped = audit(spark, [("evaluation_text", "t", "positive text")], ["t"])
    assert (declared["critical"], declared["expected"], dropped) == (0, 1, 0)
    assert audit(spark, [("query_text", "t", "positive text")], [])[0]["critical"] == 1  # in any role
    both, _ = audit(spark, [("evaluation_text", "t", "positive text"), ("evaluation_text", "u", "positive text")], ["t"])
    assert (both["critical"], both["expected"]) == (1, 1)


def test_mining_exclusions(spark):
    s = spark.createDataFrame([(0, 1.0), (1, 0.99), (2, 0.9), (3, 0.8), (4, 0.7), (5, 0.95)], "doc_id int, score double")
    why = vc.exclusion(F.col("score"), F.lit(1.0), 0.95, F.col("doc_id") == 0, F.col("doc_id") == 1)
    got = {r[0]: r[1] for r in s.select("doc_id", why).collect()}
    assert got == {0: "own", 1: "query_match", 2: None, 3: None, 4: None, 5: "too_close"}  # the bound is strict


def test_mine(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.99, 0.1], 0), (2, [0.98, 0.2], 1), (3, [0.8, 0.6], 1), (4, [0.6, 0.8], 2), (5, [0.0, 1.0], 2), (6, None, 1), (7, [0.8, 0.6], None), (100, [0.0, 1.0], 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<float>, label int").repartition(3)
    best, why = vc.mine(df.where("vec_id % 100 = 0"), df, "vec_id", "v", "label", 0.95, 2)
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in best.orderBy("rank").collect()] == [(0, 3, 1), (0, 4, 2)]
    assert {(r["query_id"], r["why"]): r["n"] for r in why.collect()} == {(0, "query_match"): 1, (0, "too_close"): 1, (0, "kept"): 4}
    assert vc.mine(df.limit(0), df, "vec_id", "v", "label", 0.95, 2)[0].count() == 0


def test_rank_anchors(spark):
    i = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda x: vc.rank_anchor(x, F.lit(24), 7))
    j = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda x: vc.rank_anchor_floor(x, F.lit(24), 7))
    a, b = spark.range(1).select(i, j).first()
    assert a == [(k * 23 + 3) // 6 for k in range(7)] and b == [k * 23 // 6 for k in range(7)] and a[0] == 0 and a[-1] == 23 and len(set(a)) == 7


def test_top_k_and_cells(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)] + [(999, None, 0)], "vec_id bigint, embedding array<float>, label int")
    q = df.where("vec_id % 100 = 0 and embedding is not null")
    got = {(r["query_id"], r["doc_id"]) for r in vc.top_k(q, df, "vec_id", "embedding", 5).collect()}
    s = x.astype("float32").astype("float64")
    want = {(i, int(j)) for i in range(0, 400, 100) for j in np.lexsort((np.arange(400), -np.where(np.arange(400) == i, -9, np.round(s @ s[i], 12))))[:5]}
    assert got == want
    assert vc.top_k(q.limit(0), df, "vec_id", "embedding", 5).count() == 0
    near = {(r["query_id"], r["doc_id"]) for r in vc.cell_search(q, df, "vec_id", "embedding", 5, cells_wanted=8, probes=6).collect()}
    assert len(near & want) / len(want) >= 0.9


def test_cell_recall_on_the_embeddings(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.where("vec_id % 100 = 0")
    pairs = lambda df: {(r["query_id"], r["doc_id"]) for r in df.collect()}
    exact, near = pairs(vc.top_k(q, e, "vec_id", "embedding", 10)), pairs(vc.cell_search(q, e, "vec_id", "embedding", 10))
    assert len(exact & near) / len(exact) >= 0.9


def test_metrics(spark):
    ranked = spark.createDataFrame([("a", 1, True), ("a", 3, True), ("a", 2, False), ("b", 11, True)], "q string, rank int, rel boolean")
    m = rk.metric_means(rk.multi_positive(ranked, ["q"], F.col("rel")), [], ["ndcg10", "recall10", "rr10"]).first()
    assert math.isclose(m["ndcg10"], 0.5 * 1.5 / 1.6309297536, rel_tol=1e-9) and m["recall10"] == 0.5 and m["rr10"] == 0.5
    noise = spark.createDataFrame([(1, 2), (2, 7), (11, 12), (101, 200)], "positive_rank int, noise_rank int")
    s = rk.noise_summary(noise, []).first()
    assert (s["recall10"], s["intrusion1"], s["intrusion5"], s["intrusion10"], s["median_noise_rank"]) == (0.5, 0.0, 0.25, 0.5, 9.5)


def test_noise_ties(spark):
    rows = [(0, s, i == 0, False) for i, s in enumerate([0.9, 0.8, 0.7])] + [(0, s, False, True) for s in (0.95, 0.9)]
    rows += [(1, s, i == 1, False) for i, s in enumerate([0.1, 0.5, 0.2])] + [(1, s, False, True) for s in (0.5, 0.4)]
    df = spark.createDataFrame(rows, "q int, s double, pos boolean, noise boolean")
    got = {r["q"]: (r["positive_rank"], r["noise_rank"]) for r in rk.noise_ranks(df, "q", "s", F.col("pos"), F.col("noise")).collect()}
    assert got == {0: (2, 1), 1: (1, 2)}


def test_borda_and_average_ranks(spark):
    s = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 1.0), ("c", "t", 0.5), ("a", "u", 2.0)], "m string, t string, s double")
    assert {(r["m"], r["t"]): r["avg_rank"] for r in rk.average_ranks(s, "t", "s").collect()} == {("a", "t"): 1.5, ("b", "t"): 1.5, ("c", "t"): 3.0, ("a", "u"): 1.0}
    assert {r["m"]: (r["points"], r["final_rank"]) for r in rk.borda(s, "m", "t", "s").collect()} == {"a": (3.5, 1), "b": (1.5, 2), "c": (0.0, 3)}


def test_near_ties_and_gate(spark):
    df = spark.createDataFrame([("a", 0.80, 3.0), ("b", 0.799, 1.0), ("c", 0.70, 0.0)], "m string, q double, r double")
    assert [r["m"] for r in rk.near_ties(df, [("q", 0.002, True), ("r", 0.5, False)]).collect()] == ["b"]
    g = rk.guard_gate(df.selectExpr("m as metric", "q as v").where("metric <> 'c'"), df.selectExpr("m as metric", "q + 0.01 as v"), "metric", "v", {"a": 0.02}, 0.0)
    assert {r["metric"]: r["passes"] for r in g.collect()} == {"a": True, "b": False, "c": False}


def test_hamilton_and_joint_quotas(spark):
    c = spark.createDataFrame([("a", 6), ("b", 4), ("c", 2)], "s string, n bigint")
    quota = {r["s"]: r["quota"] for r in ho.hamilton(c, "s", "n", 4, "x").collect()}
    assert sum(quota.values()) == 4 and quota["a"] == 2
    plan = ho.joint_quotas([("a", 0, 1), ("a", 1, 5), ("b", 0, 5), ("b", 1, 1)], {"a": 3, "b": 3}, {0: 3, 1: 3})
    assert sum(v for (s, _), v in plan.items() if s == "a") == 3 and sum(v for (_, t), v in plan.items() if t == 0) == 3 and plan.get(("a", 0), 0) <= 1
    with pytest.raises(ValueError, match="cannot both be met"):
        ho.joint_quotas([("a", 0, 1)], {"a": 2}, {0: 2})


def test_homogeneous_batches(spark):
    rows = [(i, "a" if i < 6 else "b", i * 10) for i in range(11)]
    b = bt.homogeneous_batches(spark.createDataFrame(rows, "row_id bigint, source_id string, len bigint"), "source_id", "row_id", "len", 2, "s")
    got = b.collect()
    assert len(got) == 10 and len({r["batch_index"] for r in got}) == 5 and sorted(r["row_index"] for r in got) == list(range(10))
    assert bt.contract_violations(b, "source_id", 2).count() == 0
    assert {r["source_id"]: r["dropped"] for r in bt.dropped_rows(b.sparkSession.createDataFrame(rows, "row_id bigint, source_id string, len bigint"), "source_id", 2).collect()} == {"a": 0, "b": 1}
    with pytest.raises(ValueError, match="two components"):
        bt.mix_components({"x": (b, 2)}, 2, "s")


def test_strata_differ_from_ntile(spark):
    df = spark.range(6).withColumn("g", F.lit(1))
    sizes = {r["stratum"]: r["n"] for r in bt.strata(df, ["g"], [F.col("id")], 4).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 2, 1: 1, 2: 2, 3: 1}


def test_numbering_of_hot_groups(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 7).cast("string")).alias("g"), "id")
    for made in (number_within(df, ["g"], ["id"], "n"), number_in_order(df, ["g"], [-F.col("id")], "n", {"before": F.lit(2)})):
        per = made.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_distinct("n").alias("k")).collect()
        assert all(r["lo"] == 0 and r["hi"] == r["c"] - 1 and r["k"] == r["c"] for r in per) and len(per) == 8
    top = number_in_order(df, ["g"], [-F.col("id")], "n", {"before": F.lit(2)}).where("n = 3").first()
    assert top["before"] == 6


def test_clean_reasons(spark):
    long = "긴 본문이 여기에 있습니다"
    rows = [("질문입니다", long, ["다른 본문이 여기에 있습니다"]), ("q only latin", long, ["xxxxxxxxxxxx"]), (None, long, ["x" * 12]), ("질문", "짧다", ["x" * 12]), ("질문", long, [long, None, ""]), ("질문", long, ["짧다"]), ("질문", "가" * 60, ["가" * 30])]
    df = spark.createDataFrame(rows, "q string, p string, n array<string>")
    got = [r[0] for r in df.select(cl.clean_reason(F.col("q"), F.col("p"), F.col("n"), most_text=50)).collect()]
    assert got == [None, "non_korean_query", "missing_or_short", "missing_or_short", "missing_or_short", "missing_or_short_negative", "document_too_long"]
    sample = df.select(cl.sampled_negatives(F.col("q"), F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2, "s")).first()[0]
    assert len(set(sample)) == 2


def test_round_robin_is_the_sequential_greedy(spark):
    import hashlib
    import random

    r = random.Random(2)
    rows = [(i, "abc"[r.randrange(3)], f"q{r.randrange(60)}", f"p{r.randrange(80)}", f"d{r.randrange(20)}") for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, s string, q string, p string, d string")
    order = lambda x: (hashlib.sha256(f"z\0{x[0]}".encode()).hexdigest(), x[0])
    left = {s: sorted([x for x in rows if x[1] == s], key=order) for s in "abc"}
    want, qs, ps, docs = [], set(), set(), {}
    while any(left.values()) and len(want) < 40:
        for s in "abc":
            while left[s] and len(want) < 40:
                k, _, q, p, d = left[s].pop(0)
                if q in qs or p in ps or docs.get(d, 0) >= 2:
                    continue
                qs.add(q), ps.add(p), docs.update({d: docs.get(d, 0) + 1}), want.append(k)
                break
    got = ho.round_robin(df, "s", "k", 40, "z", ["q", "p"], ("d", 2)).orderBy("pick").collect()
    assert [x["k"] for x in got] == want
    assert ho.round_robin(df.limit(0), "s", "k", 5, "z", ["q"]).count() == 0


def test_strict_violations(spark):
    rows = [(1, "q", "p", ["n"], [0.9, 0.1]), (2, " ", None, ["p", ""], [0.1, 0.9, 2.0]), (3, "q", "p", ["p"], None)]
    df = spark.createDataFrame(rows, "k int, q string, p string, n array<string>, s array<double>")
    got = {}
    for r in cl.strict_violations(df, "k", "q", "p", "n", "s").collect():
        got.setdefault(r["k"], set()).add(r["rule"])
    assert got == {2: {"empty_query", "empty_positive", "empty_negative", "score_range", "positive_not_dominant"}, 3: {"positive_in_negatives"}}


def test_teacher_filter(spark):
    rows = [("g", "p", "tp", 0.8, True), ("g", "a", "ta", 0.76, False), ("g", "b", "tb", 0.7601, False), ("g", "c", "tb", 0.5, False), ("g", "d", "tp", 0.1, False), ("h", "p", "x", 0.3, True), ("h", "a", "y", 0.1, False)]
    df = spark.createDataFrame(rows, "grp string, item string, txt string, s double, pos boolean")
    run = lambda rule, k: {r["item"] for r in ng.teacher_filter(df, "grp", "item", "txt", "s", F.col("pos"), 0.5, 0.95, 0.0, 10, k, rule).collect()}
    assert run("kd", 2) == {"a", "d"}  # b is over the limit and hides its copy c; the limit itself is kept
    assert run("factory", 2) == {"a", "c"}  # texts of the positive are out, copies are judged after the limit
    assert run("kd", 3) == set()  # too few negatives give none


def test_losses(spark):
    s = spark.createDataFrame([("g", 1.0, 1.0, True), ("g", 0.0, 0.0, False)], "g string, t double, s double, pos boolean")
    assert math.isclose(ng.infonce(s, "g", "s", F.col("pos"), 1.0).first()["loss"], math.log(1 + math.exp(-1)), rel_tol=1e-12)
    assert abs(ng.listwise_kl(s, "g", "t", "s", 1.0).first()["kl"]) < 1e-12


def test_as_of_and_intervals(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("u", 2, "a"), ("u", 5, "b"), ("u", 7, "c")], "k string, t int, x string")
    assert {r["id"]: r["x"] for r in joins.as_of(left, right, ["k"], "t", ["x"]).collect()} == {1: "b", 2: None, 3: None}
    a = spark.sql("select 1 as k, timestamp'2024-01-01 00:00:00' as s")
    b = spark.sql("select 1 as k, explode(sequence(timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:10:00', interval 1 minute)) as t")
    assert joins.interval_join(a, b, ["k"], "s", "t", 300).count() == 6
    m = joins.join_members(spark.range(3).withColumnRenamed("id", "k"), "k", spark.range(1000).selectExpr("id % 2 as k", "id as row"), "row", piece=10)
    assert m.count() == 1000


def test_lineage_and_cycles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5)], "n int, p int")
    got = {r["n"]: (r["root"], r["depth"]) for r in ct.ancestry(df, "n", "p").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (None, None), 6: (None, None)}


def test_tasks_must_exist(spark):
    t = spark.createDataFrame([("k1", "Task One")], "key string, name string")
    assert ct.selected_tasks(t, ["Task One"], ["key", "name"]).count() == 1
    with pytest.raises(ValueError, match="no such task"):
        ct.selected_tasks(t, ["x"], ["key", "name"])


def test_mean_vector_rejects_mixed_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0], 1.0), (1, [3.0, 5.0], 3.0)], "g int, v array<double>, w double")
    assert vc.mean_vector(df, ["g"], "v", "w").first()["mean"] == [2.5, 4.5]
    with pytest.raises(Exception, match="several lengths"):
        vc.mean_vector(df.unionByName(spark.createDataFrame([(1, [1.0], 1.0)], df.schema)), ["g"], "v").collect()


def test_operators_take_empty_tables(spark):
    none = spark.createDataFrame([], "row_id bigint, source_id string, len bigint, t string")
    assert bt.homogeneous_batches(none, "source_id", "row_id", "len", 2, "s").count() == 0
    assert bt.strata(none, ["source_id"], [F.col("len")], 4).count() == 0
    assert dc.minhash(none, "row_id", "t").count() == 0
    assert cl.duplicates_beyond_first(none, ["t"]).first()["duplicates"] == 0
    assert number_in_order(none, ["source_id"], [F.col("len")], "n").count() == 0


def test_hot_group_is_spread(spark):
    left = spark.range(5000).selectExpr("id", "case when id % 3 > 0 then 'hot' else concat('k', id) end as k")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("none", 4)], "k string, v int")
    got = joins.join_unique(left, "k", right, most=50)
    assert got.columns == ["k", "id", "v"] and got.groupBy("k").count().sort("k").collect() == [("hot", 3333), ("k0", 1), ("k3", 1)]
    assert joins.join_unique(left.limit(0), "k", right).count() == 0


def test_lineage_of_a_long_chain_beside_a_cycle(spark):
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 150)] + [(500, 501), (501, 500), (502, 500), (600, 999)]
    got = {r["n"]: (r["root"], r["depth"]) for r in ct.ancestry(spark.createDataFrame(rows, "n int, p int"), "n", "p").collect()}
    assert all(got[i] == (0, i) for i in range(150))
    assert all(got[i][0] is None for i in (500, 501, 502, 600))
