"""Readers, writers, adapters and streams over files."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from pairloom.operators.contracts import config_problems
from pairloom.sources import adapters as ad
from pairloom.sources import markup, readers, sinks
from pairloom.sources.nested import scalar_strings
from pairloom.streaming import incremental as inc


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


STRICT = {"messages": [{"role": "user", "content": "q"}], "positive_messages": [[{"role": "user", "content": "p"}]], "negative_messages": [[{"role": "user", "content": "n"}]]}


def test_strict_rows(spark, tmp_path):
    good = write(tmp_path / "good.jsonl", [json.dumps(STRICT), json.dumps(STRICT | {"teacher_scores": [0.9, 0.1]})])
    rows = readers.strict_json_lines(spark, good).collect()
    assert rows[0]["messages"][0]["content"] == "q" and rows[1]["teacher_scores"] == [0.9, 0.1]
    for bad in ("", '{"messages": []', json.dumps(STRICT | {"extra": 1})):
        with pytest.raises(Exception, match="(?i)bad line|malformed"):
            readers.strict_json_lines(spark, write(tmp_path / "bad.jsonl", [json.dumps(STRICT), bad, json.dumps(STRICT)])).collect()


def test_line_numbers(spark, tmp_path):
    path = write(tmp_path / "n.txt", [f"line {i}" for i in range(1, 2001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = readers.numbered_lines(spark, path)
        assert rows.rdd.getNumPartitions() > 2
        assert all(r["value"] == f"line {r['line']}" for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert readers.json_lines(spark, write(tmp_path / "j.jsonl", ['{"a":1}', "{"])).where("value is null").first()["line"] == 2


def test_digests_and_blocklists(spark, tmp_path):
    a, b = "0" * 63 + "1", "f" * 64
    folder = tmp_path / "list" / "proto" / "task"
    folder.mkdir(parents=True)
    with gzip.open(folder / "query_text.sha256.gz", "wt") as f:
        f.write(f"{a}\n{b}\n")
    assert {tuple(r) for r in readers.blocklist_folder(spark, str(tmp_path / "list")).collect()} == {("proto", "task", "query_text", a), ("proto", "task", "query_text", b)}
    for lines, ordered in (([a, "xyz"], False), ([b, a], True)):
        with pytest.raises(Exception, match="bad digest line"):
            readers.digest_lines(spark, write(tmp_path / "d.txt", lines), ordered).collect()
    blocked = spark.createDataFrame([("p", "t", "k", b), ("p", "t", "k", a), ("p", "t", "k", a)], "protocol string, task string, kind string, sha256 string")
    sinks.write_digest_lists(blocked, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [a, b]


def test_alignment(spark):
    a, b = spark.range(3), spark.range(1, 4)
    assert {(r["id"], r["side"]) for r in readers.misaligned(a, b, "id").collect()} == {(0, "left"), (3, "right")}
    assert readers.aligned(a, a.withColumn("x", F.lit(1)), "id").count() == 3
    with pytest.raises(Exception, match="row without partner"):
        readers.aligned(a, b, "id").collect()


def test_markdown(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("---\ntitle: T: x\n---\nintro\n# One\nbody\n제1조(목적) 가\n나\n제2조(정의) 다\n제1조(다시) 라\n## Two ##\n", encoding="utf-8")
    (tmp_path / "x" / "b.txt").write_text("no")
    docs = readers.markdown_corpus(spark, str(tmp_path))
    meta, body = markup.front_matter(F.col("text"))
    d = docs.select("path", meta.alias("m"), body.alias("text"))
    assert d.count() == 1 and d.first()["m"] == {"title": "T: x"} and d.first()["text"].startswith("intro")
    assert [(r["section"], r["heading"]) for r in markup.heading_sections(d, "path", "text").orderBy("section").collect()] == [(0, None), (1, "One"), (2, "Two")]
    assert [(r["article"], r["title"], r["body"]) for r in markup.articles(d, "path", "text").orderBy("article").collect()] == [(1, "목적", "제1조(목적) 가\n나"), (2, "정의", "제2조(정의) 다")]
    plain = spark.createDataFrame([("no front matter",)], "text string")
    assert tuple(plain.select(*markup.front_matter(F.col("text"))).first()) == ({}, "no front matter")


def test_versions_and_reports(spark, tmp_path):
    df = spark.range(10).withColumn("t", F.lit("x"))
    made = sinks.write_versioned(df, str(tmp_path), "v1", fingerprint="f")
    assert made["rows"] == 10 and sinks.write_versioned(df.limit(1), str(tmp_path), "v1") == sinks.manifest(spark, str(tmp_path), "v1")
    assert sinks.content_digest(df.repartition(3)) == made["digest"] != sinks.content_digest(df.limit(9))
    assert [sinks.refresh_decision(m, "f", r) for m, r in ((None, False), (made, False), ({"fingerprint": "g"}, True), ({"fingerprint": "g"}, False))] == ["write", "skip", "replace", "error"]
    done = spark.createDataFrame([(1, "f"), (2, "other")], "id bigint, fingerprint string")
    assert sinks.resume(spark.range(4), done, "id", "f").count() == 3
    assert sinks.markdown_table(spark.sql("select 'a|b' as x, 1.5d as y, null as z")) == "| x | y | z |\n| --- | --- | --- |\n| a\\|b | 1.5 |  |"
    text = "<!-- t:begin -->old<!-- t:end -->"
    assert sinks.between_markers(text, "t", "new") == "<!-- t:begin -->\nnew\n<!-- t:end -->"


def test_beir_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("q1", "text")], "query_id string, text string")
    c = spark.createDataFrame([("c1", "T", "b"), ("c2", "", "n")], "corpus_id string, title string, text string")
    j = spark.createDataFrame([("q1", "c1", 1), ("q1", "c2", 0)], "query_id string, corpus_id string, score int")
    sinks.write_beir(q, c, j, str(tmp_path))
    r = ad.source("beir_join")(*readers.beir(spark, str(tmp_path))).first()
    assert (r["query"], r["positive"], r["negatives"]) == ("text", "T b", ["n"])
    with pytest.raises(KeyError, match="unknown adapter"):
        ad.source("x")


def test_cyclic_negatives(spark):
    rows = [(i, f"q{i}", f"context {i}") for i in range(6)] + [(6, "q6", "context 0"), (7, None, "x"), (8, "x", None)]
    got = ad.cyclic_negatives(spark.createDataFrame(rows, "k int, q string, c string"), "k", "q", "c", 3).collect()
    assert len(got) == 7 and all(len(set(r["negatives"])) == 3 and r["positive"] not in r["negatives"] for r in got)
    assert ad.cyclic_negatives(spark.createDataFrame(rows[:3], "k int, q string, c string"), "k", "q", "c", 3).count() == 0


def test_scored_pairs_and_noise(spark):
    rows = [(i, f"a{i}", f"b{i}", i / 10) for i in range(11)]
    got = ad.scored_pairs(spark.createDataFrame(rows, "k int, a string, b string, s double"), "k", "a", "b", "s", 0.8, 0.2).collect()
    assert {r["k"] for r in got} == {8, 9, 10} and all(r["negatives"][0] in {"b0", "b1", "b2"} for r in got)
    noise = ad.noise_documents(spark, 10_000, 0.05, "p").collect()
    assert len(noise) == len({r["text"] for r in noise}) == 500


def test_nested_strings(spark):
    df = spark.createDataFrame([(1, '{"a": ["x", {"b": "y", "c": 3}], "d": null}'), (2, "no json"), (3, None)], "k int, j string")
    assert {(r["path"], r["value"]) for r in scalar_strings(df, "k", "j").collect()} == {("$.a[0]", "x"), ("$.a[1].b", "y")}


def test_strings_nested_deeply(spark):
    deep = lambda n: '{"a": [' * n + '{"revision": "r"}' + "]}" * n
    df = spark.createDataFrame([(n, deep(n)) for n in (1, 3, 4, 8, 12)], "k int, j string")
    want = {(n, "$" + ".a[0]" * n + ".revision") for n in (1, 3, 4, 8, 12)}
    assert {(r["k"], r["path"]) for r in scalar_strings(df, "k", "j").collect()} == want
    assert {(r["k"], r["path"]) for r in config_problems(df, "k", "j", ["revision"]).collect()} == want


def test_summaries_and_objects(spark, tmp_path):
    for i, at in enumerate(["2024-01-02", "2024-01-01"]):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "summary.json").write_text(json.dumps({"model": "m", "created_at_utc": at, "x": i}))
    assert readers.latest_summaries(spark, str(tmp_path)).first()["x"] == 0
    (tmp_path / "dup.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError, match="repeated key"):
        readers.json_object(str(tmp_path / "dup.json"))
    assert readers.fingerprint(a=1, b=2) == readers.fingerprint(b=2, a=1)
    assert readers.wide_columns(["negative_10", "negative_2", "x", "negative_x"], "negative") == ["negative_2", "negative_10"]


def test_stream_resumes_over_new_files(spark, tmp_path):
    src, check, out = (str(tmp_path / x) for x in ("src", "check", "out"))
    seen = []
    for batch in ([(1, "a"), (2, "a")], [(2, "a"), (3, "b")]):
        spark.createDataFrame(batch, "k int, v string").coalesce(1).write.mode("append").parquet(src)
        got = inc.available_now(inc.first_seen(inc.stream_table(spark, src), ["k"]), "t", checkpoint=check, out=out)
        seen.append(sorted(r["k"] for r in got.collect()))
    assert seen == [[1, 2], [1, 2, 3]]


def test_failures_run_over_batches(spark, tmp_path):
    src, check, out = (str(tmp_path / x) for x in ("src", "check", "out"))
    for batch in ([("u", 1, True)], [("u", 2, True), ("u", 3, True), ("u", 4, False)]):
        spark.createDataFrame(batch, "u string, t int, bad boolean").coalesce(1).write.mode("append").parquet(src)
        got = inc.available_now(inc.failures(inc.stream_table(spark, src), "u", "t", "bad"), "t", checkpoint=check, out=out)
    assert [(r["u"], r["at"], r["run"]) for r in got.collect()] == [("u", 2, 2)]
