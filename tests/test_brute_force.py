"""Queries that SQL does not express, against brute force or their stated bounds on the smallest tables."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pytest

from pairloom.operators.holdout import joint_quotas
from pairloom.plans import catalogue, layout

run = lambda name, spark, sf: catalogue.QUERIES[name](spark, sf)


def stored(spark, sf, table, *columns):
    return spark.read.parquet(f"{sf}/{table}.parquet").select(*columns).collect()


def test_normalize_hash_documents(spark, sf):
    got = {r["doc_id"]: r["sha"] for r in run("normalize_hash_documents", spark, sf).collect()}
    for doc, text in stored(spark, sf, "documents", "doc_id", "text"):
        plain = None if text is None else re.sub(r"\s+", " ", re.sub("[\u200b\u200c\u200d\u2060\ufeff]", "", unicodedata.normalize("NFKC", text))).strip()
        assert got[doc] == (None if plain is None else hashlib.sha256(plain.encode()).hexdigest())


def test_normalize_compat_pairs(spark, sf):
    got = {r["row_id"]: (r["query"], r["positive"]) for r in run("normalize_compat_pairs", spark, sf).collect()}
    flat = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "")).strip()
    for row, q, p in stored(spark, sf, "candidates", "row_id", "query", "positive"):
        assert got[row] == (flat(q), flat(p))


def test_holdout_round_robin(spark, sf):
    rows = layout._full(spark, sf).where("repository is not null and document is not null").collect()
    key = lambda r: (hashlib.sha256(f"rr\0{r['row_id']}".encode()).hexdigest(), r["row_id"])
    left = {}
    for r in sorted(rows, key=key, reverse=True):
        left.setdefault(r["repository"], []).append(r)
    want, seen, held, names = [], set(), {}, sorted(left)
    while names and len(want) < 200:
        for s in list(names):
            while left[s] and len(want) < 200:
                r = left[s].pop()
                if ("q", r["query"]) in seen or ("p", r["positive"]) in seen or held.get(r["document"], 0) >= 2:
                    continue
                seen |= {("q", r["query"]), ("p", r["positive"])}
                held[r["document"]] = held.get(r["document"], 0) + 1
                want.append((s, r["row_id"]))
                break
            else:
                if not left[s]:
                    names.remove(s)
    assert [(r["repository"], r["row_id"]) for r in run("holdout_round_robin", spark, sf).orderBy("pick").collect()] == want


def test_joint_quota_plan(spark, sf):
    cells = {(r["source_id"], r["stratum"]): r["count"] for r in layout._strata(spark, sf).groupBy("source_id", "stratum").count().collect()}
    rows = run("joint_quota_plan", spark, sf).collect()
    by_source, by_stratum = {}, {}
    for r in rows:
        assert 0 < r["quota"] <= cells[r["source_id"], r["stratum"]]
        by_source[r["source_id"]] = by_source.get(r["source_id"], 0) + r["quota"]
        by_stratum[r["stratum"]] = by_stratum.get(r["stratum"], 0) + r["quota"]
    sizes = {}
    for (s, _), n in cells.items():
        sizes[s] = sizes.get(s, 0) + n
    assert by_source == {s: n // 4 for s, n in sizes.items() if n // 4}
    assert max(by_stratum.values()) - min(by_stratum.values()) <= 1


def test_joint_quotas_of_any_size():
    big = 10**12
    plan = joint_quotas([("a", 0, big), ("a", 1, big), ("b", 0, big)], {"a": big, "b": big}, {0: big, 1: big})
    assert plan == {("a", 1): big, ("b", 0): big}
    with pytest.raises(ValueError):
        joint_quotas([("a", 0, 1)], {"a": 2}, {0: 2})


def test_articles_of_documents(spark, sf):
    texts = dict(stored(spark, sf, "documents", "doc_id", "text"))
    rows = run("articles_of_documents", spark, sf).collect()
    assert len({(r["doc_id"], r["article"]) for r in rows}) == len(rows)
    for r in rows:
        assert str(r["article"]) in texts[r["doc_id"]] and 0 <= r["chars"] <= len(texts[r["doc_id"]])


def test_approx_distinct(spark, sf):
    exact, prices = {}, {}
    for flag, order, price in stored(spark, sf, "lineitem", "l_returnflag", "l_orderkey", "l_extendedprice"):
        exact.setdefault(flag, set()).add(order)
        prices.setdefault(flag, []).append(price)
    for r in run("approx_distinct", spark, sf).collect():
        f = r["l_returnflag"]
        assert abs(r["orders"] / len(exact[f]) - 1) < 0.08  # four times the stated standard error
        rank = np.searchsorted(np.sort(prices[f]), r["median_price"]) / len(prices[f])
        assert abs(rank - 0.5) < 0.01


def test_ivf_candidates(spark, sf):
    rows = stored(spark, sf, "embeddings", "vec_id", "embedding")
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype="float64")
    got = {}
    for r in run("ivf_candidates", spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    hit = want = 0
    for i in np.flatnonzero(ids % 100 == 0):
        s = vectors @ vectors[i]
        s[i] = -np.inf
        best = set(ids[np.argsort(-s, kind="stable")[:10]].tolist())
        hit, want = hit + len(best & got.get(int(ids[i]), set())), want + len(best)
    assert hit / want >= 0.9
