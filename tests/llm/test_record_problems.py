"""Overlaps, groups, top N, formatting copies, mixing and personal information, with their edge cases."""

from __future__ import annotations

import random

import pytest

from pairloom.llm import fields, formatting, glyphs, groups, mixing, overlap, pii, spans, topn
from pairloom.llm.semicrf import SemiCRF
from pairloom.operators import joins


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a: str, b: str) -> bool:
    n = max(len(a), len(b))
    return n > 0 and 1 - distance(a, b) / n >= 0.8 - 1e-12


def test_overlap_against_brute_force(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("가나다라마바사아자차카타파하거너더러") for _ in range(n))
    rows = []
    for i in range(40):
        q, p = word(30), word(r.choice([15, 60, 150, 300]))
        rows.append((2 * i, "a", q, p))
        kind = i % 5
        edit = lambda t, n: "".join(c if k % n else "힣" for k, c in enumerate(t))
        rows.append((2 * i + 1, "b", q if kind < 3 else edit(q, 8), [p, p.upper() + "!", edit(p, 40), edit(p, 30), word(len(p))][kind]))
    rows += [(900, "a", None, "x"), (901, "b", "!!!", "..."), (902, "a", "", ""), (903, "b", rows[0][2], rows[0][3]), (904, "a", rows[0][2], rows[0][3]), (905, "a", "긴" * 20, "나" * 20000), (906, "b", "긴" * 20, "나" * 20000 + "다")]
    df = spark.createDataFrame(rows, "row_id bigint, side string, query string, positive string").selectExpr("*", "1 as cls", "2 as chunks", "3 as h", "4 as q", "5 as p", "6 as no", "7 as text")
    base = overlap.records(df, 0.8).persist()
    got = {(x["row_id_a"], x["row_id_b"]) for x in overlap.row_pairs(overlap.class_pairs(base), base).collect()}
    bare = [(i, s, glyphs.bare_text(q) or "", glyphs.bare_text(p) or "") for i, s, q, p in rows if i != 905 and i != 906]
    want = {(x[0], y[0]) for x in bare if x[1] == "a" for y in bare if y[1] == "b" if x[2] and y[2] and x[3] and y[3] if similar(x[2], y[2]) and similar(x[3], y[3])}
    assert got - {(905, 906)} == want and (905, 906) in got and (904, 903) in got
    assert overlap.class_pairs(overlap.records(df.limit(0), 0.8)).count() == 0
    base.unpersist()


def test_components_and_splits(spark):
    edges = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3"), (None, "3"), ("e", "e")] + [(f"n{i}", f"n{i + 1}") for i in range(60)]
    df = spark.createDataFrame(edges + edges[:2], "a string, b string").repartition(7)
    for single in (10_000, 0):  # solved in one task, and by star rounds alone
        comp = {r["node"]: r["component"] for r in groups.components(df, single_task_edges=single).collect()}
        assert comp["a"] == comp["b"] == comp["c"] == comp["2"] == "1"
        assert comp["d"] == comp["3"] == "3" and comp["e"] == "e"
        assert len({comp[f"n{i}"] for i in range(61)}) == 1
    assert groups.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "stars", "random"])
def test_components_of_a_graph_above_one_task(spark, shape):
    r = random.Random(4)
    pairs = {
        "path": [(i, i + 1) for i in range(400)], "star": [(0, i) for i in range(1, 400)], "stars": [(i % 7 + 1000, i) for i in range(400)],
        "random": [(r.randrange(500), r.randrange(500)) for _ in range(420)],
    }[shape]
    r.shuffle(pairs)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    named = [(f"n{a:04}", f"n{b:04}") for a, b in pairs]
    for a, b in named:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(named, "a string, b string").repartition(2)
    got = {x["node"]: x["component"] for x in groups.components(df, single_task_edges=37).collect()}
    assert got == {x: find(x) for x in parent}


def test_a_forest_holds_a_bounded_number_of_edges():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([f"a{i}" for i in range(25)]), pa.array([f"b{i}" for i in range(25)])], ["a", "b"])
    assert [b.num_rows for b in groups._local_forests(10)(iter([batch, batch.slice(0, 3)]))] == [20, 20, 16]


def test_deal_equals_dealing_one_by_one():
    r = random.Random(6)
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    for _ in range(20):
        sizes = sorted({r.randrange(1, 60) for _ in range(8)}, reverse=True)
        counts = [(s, r.randrange(1, 30)) for s in sizes]
        total = sum(s * n for s, n in counts)
        gap = {k: total * v for k, v in shares.items()}
        for s, n in counts:
            for _ in range(n):
                gap[max(gap, key=lambda k: (round(gap[k], 6), -list(gap).index(k)))] -= s
        got = {k: total * v for k, v in shares.items()}
        for s, n, k in groups.deal(counts, shares):
            got[k] -= s * n
        assert max(abs(got[k] - gap[k]) for k in shares) <= max(sizes[-3:])


def test_assign_splits_keeps_groups_and_shares(spark):
    rows = [(i, f"r{i % 37}" if i % 3 else None, f"h{i // 4}" if i % 2 else None) for i in range(900)] + [(5, "r5", None)]
    df = spark.createDataFrame(rows, "row_id bigint, repo string, doc string").selectExpr("*", "1 as component", "2 as size", "'x' as split")
    got = groups.assign_splits(df, "row_id", ["repo", "doc"], {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(got) == len(rows)
    split = {}
    for r in got:
        assert split.setdefault(r["component"], r["split"]) == r["split"]
    alone = [(i, None, None) for i in range(1000)]
    n = {}
    for r in groups.assign_splits(spark.createDataFrame(alone, "row_id bigint, repo string, doc string"), "row_id", ["repo", "doc"], {"train": 0.8, "validation": 0.1, "test": 0.1}).collect():
        n[r["split"]] = n.get(r["split"], 0) + 1
    assert n == {"train": 800, "validation": 100, "test": 100}
    assert groups.assign_splits(df.limit(0), "row_id", ["repo", "doc"], {"train": 1.0}).count() == 0


def test_deal_is_largest_first():
    runs = groups.deal([(5, 1), (1, 5)], {"train": 0.5, "test": 0.5})
    assert runs[0] == (5, 1, "train") and sum(n for s, n, k in runs if k == "test" and s == 1) == 5
    big = groups.deal([(1, 1_000_000)], {"train": 0.8, "validation": 0.1, "test": 0.1})
    total = {k: sum(n for _, n, x in big if x == k) for k in ("train", "validation", "test")}
    assert total == {"train": 800_000, "validation": 100_000, "test": 100_000}


def test_top_n(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"g{0 if i % 3 == 0 else r.randrange(40)}", f"c{r.randrange(400)}", r.choice([None, float("nan"), float("inf"), -0.0, 0.0, 0.5, r.random()]), i % 7) for i in range(4000)]
    rows += [(9001, None, "c1", 0.3, 1), (9002, "g1", None, 0.9, 1), (9003, "g1", None, 0.2, 2)]
    df = spark.createDataFrame(rows, "score_row_id bigint, generated_id string, candidate_id string, retriever_score double, t int")
    df = df.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,t) as scored_at", "1 as grp", "2 as item", "3 as rank")
    got = {x["row_key"] for x in topn.top_n(df, "generated_id", "candidate_id", "scored_at", "score_row_id", "retriever_score", 5).collect()}
    latest = {}
    for i, g, c, s, t in rows:
        if (g, c) not in latest or (t, i) > latest[g, c][:2]:
            latest[g, c] = (t, i, s)
    by = {}
    for (g, c), (_, i, s) in latest.items():
        if s is not None and s == s and abs(s) != float("inf"):
            by.setdefault(g, []).append((-s, c is None, c or "", i))
    want = {x[3] for v in by.values() for x in sorted(v)[:5]}
    assert got == want and 9001 in got and 9002 not in got and 9003 in want | {9003}
    assert topn.top_n(df.limit(0), "generated_id", "candidate_id", "scored_at", "score_row_id", "retriever_score").count() == 0


def _clustered(spark, rows, most=100_000, **options):
    import glob

    import pyarrow.parquet as pq

    low, high = rows.selectExpr("percentile_approx(score, 0.5, 200)", "max(score)").first()
    path = topn.write_clustered(rows, joins.hot_keys(rows, "grp", most), low, high, "skips", **options)
    return path, [pq.ParquetFile(p) for p in glob.glob(path.removeprefix("file://") + "/*.parquet")]


def test_top_n_reads_the_upper_row_groups_only(spark):
    """Row groups of many groups: those below the N-th score of all their groups stay unread."""
    rows = spark.range(120_000).selectExpr("concat('g', id % 200) as grp", "concat('c', id) as item", "id as row_key", "cast(xxhash64(id) as double) / 1e18 as score")
    path, files = _clustered(spark, rows, row_group_bytes=1 << 15)
    total = skipped = 0
    for f in files:
        read = []
        topn.skim(f, 5, read)
        tops = {i: f.metadata.row_group(i).column(3).statistics.max for i in range(f.metadata.num_row_groups)}
        total, skipped = total + len(tops), skipped + len(tops) - len(read)
        # what was left out lies below every N-th score of its groups
        rest = [i for i in tops if i not in read]
        best = {}
        for g, s in zip(*(f.read().column(c).to_pylist() for c in ("grp", "score"))):
            best.setdefault(g, []).append(s)
        fifth = {g: sorted(v)[-5] for g, v in best.items()}
        assert all(tops[i] < fifth[g] for i in rest for g in set(f.read_row_group(i, columns=["grp"]).column(0).to_pylist()))
    assert total > 20 and skipped > total / 2
    want = rows.selectExpr("*", "row_number() over (partition by grp order by score desc, item) as r").where("r <= 5")
    assert topn.read_top_n(spark, path, 5).select("row_key").exceptAll(want.select("row_key")).count() == 0
    assert topn.read_top_n(spark, path, 5).count() == 1000


def test_top_n_of_a_hot_group_in_several_files(spark):
    for score in ("cast(id as double)", "0.5"):
        rows = spark.range(60_000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else concat('g', id) end as grp", "concat('c', id) as item", "id as row_key", f"{score} as score")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        path, files = _clustered(spark, rows, most=2000, row_group_bytes=1 << 14)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        holding = [f for f in files if "hot" in f.read(columns=["grp"]).column(0).to_pylist()]
        assert len(holding) > 1
        top = [r for r in topn.read_top_n(spark, path, 3).collect() if r["grp"] in ("hot", None)]
        want = [59_998, 59_995, 59_992, 59_997, 59_994, 59_991] if score != "0.5" else sorted(range(60_000), key=lambda i: f"c{i}")
        if score == "0.5":
            want = [i for i in want if i % 3 == 1][:3] + [i for i in want if i % 3 == 0][:3]
        assert sorted(r["row_key"] for r in top) == sorted(want)


def test_formatting_copies(spark):
    rows = [
        (1, "Hello, World", '{"a": 1, "b": {"c": "x", "d": null}}'), (2, "hello world!", '{"b":{"d":null,"c":"\\u0078"},"a":1}'), (3, "hello world", '{"a": 2}'), (4, None, '{"a": 1}'),
        (5, None, '{"a": 1}'), (6, "", None), (7, "...", None), (8, "x", "no json"), (9, "X", "no json"), (10, "x", '{"a": 1} tail'), (11, "x", '{"a": 1}'), (12, "가" * 30000, "[]"), (13, "가 " * 30000, "[ ]"), (1, "Hello, World", '{"a": 1, "b": {"c": "x", "d": null}}'),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, t string, j string").selectExpr("*", "1 as raw_key", "2 as representative", "3 as n")
    got = {(r["row_id_a"], r["row_id_b"]) for r in formatting.copy_pairs(df, "row_id", "t", "j").collect()}
    assert got == {(1, 2), (6, 7), (8, 9), (12, 13)}
    classes = {r["representative"]: r["copies"] for r in formatting.formatting_classes(df, "row_id", "t", "j")[0].collect()}
    assert classes == {1: 3, 3: 1, 6: 2, 8: 2, 10: 1, 11: 1, 12: 2}
    assert formatting.copy_pairs(df.limit(0), "row_id", "t", "j").count() == 0


PLAN = "audit_id string, phase string, created_at timestamp, rows bigint, source_counts struct<a:bigint,b:bigint,c:bigint,d:bigint>, max_repeats int"


def test_mixing(spark):
    plans = spark.createDataFrame([("p1", "x", None, 60, (40, 20, None, None), 3), ("p2", "y", None, 50, (10, None, 35, 5), 2), ("p3", "z", None, 0, (None, None, None, None), 1)], PLAN)
    records = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1000 + i) for i in range(7)] + [("c", 2000 + i) for i in range(10)], "source_id string, row_id bigint")
    a = {(r["audit_id"], r["source_id"]): r for r in mixing.allotment(mixing.plan_targets(plans), records).collect()}
    assert not a["p1", "b"]["short"] and a["p2", "c"]["short"] and a["p2", "d"]["short"] and a["p2", "d"]["given"] == 0
    rows = mixing.mix(spark, mixing.plan_targets(plans), records, shard_rows=8).collect()
    used, per = {}, {}
    for r in rows:
        used[r["audit_id"], r["row_id"]] = used.get((r["audit_id"], r["row_id"]), 0) + 1
        per[r["audit_id"], r["source_id"]] = per.get((r["audit_id"], r["source_id"]), 0) + 1
    assert per == {("p1", "a"): 40, ("p1", "b"): 20, ("p2", "a"): 10, ("p2", "c"): 20}
    assert max(n for (k, _), n in used.items() if k == "p1") <= 3 and max(n for (k, _), n in used.items() if k == "p2") <= 2
    again = mixing.mix(spark, mixing.plan_targets(plans), records, shard_rows=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    targets = mixing.plan_targets(plans)
    assert mixing.mix(spark, targets, records.limit(0)).count() == 0 and mixing.mix(spark, targets.limit(0), records).count() == 0
    short = {(r["audit_id"], r["source_id"]) for r in mixing.delivered(targets, mixing.mix(spark, targets, records)).where("short").collect()}
    assert short == {(k, s) for (k, s), r in a.items() if r["short"]} == {("p2", "c"), ("p2", "d")}


def test_shards_are_cut_to_size(spark, monkeypatch):
    """Shards beyond those the driver draws are cut in tasks; no shard is larger than wanted."""
    monkeypatch.setattr(mixing, "TOP_SHARDS", 3)
    plans = spark.createDataFrame([("p1", "x", None, 60, (170, 20, None, None), 3)], PLAN)
    records = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1000 + i) for i in range(7)], "source_id string, row_id bigint")
    rows = mixing.mix(spark, mixing.plan_targets(plans), records, shard_rows=8).collect()
    size = {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + 1
    assert sum(size.values()) == 190 and max(size.values()) <= 8 and len(size) >= 24
    assert len({(r["row_id"], r["repeat"]) for r in rows}) == 190


def test_token_blocks(spark):
    records = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "source_id string, row_id bigint")
    sizes = spark.createDataFrame([(1, 7), (2, 0), (3, 6), (4, 3)], "row_id bigint, n_tokens bigint")
    got = {(r["source_id"], r["row_id"]): [tuple(p) for p in r["pieces"]] for r in mixing.token_blocks(records, sizes, 5).collect()}
    assert got == {("a", 0): [(1, 0, 5)], ("a", 1): [(1, 5, 2), (3, 0, 3)], ("a", 2): [(3, 3, 3)], ("b", 0): [(4, 0, 3)]}
    targets = spark.createDataFrame([("p", "x", 1, "a", 30), ("p", "x", 1, "b", 3), ("p", "x", 1, "none", 3)], "audit_id string, phase string, max_repeats int, source_id string, want bigint")
    assert {r["source_id"]: r["want"] for r in mixing.targets_in_blocks(targets, records, sizes, 5).collect()} == {"a": 26, "b": 2, "none": 0}


def test_usable_records_and_fields(spark):
    rows = [(1, "q", "p", " TRAIN ", "A-b c"), (2, "q", " ", "train", "x"), (3, None, "p", "train", "x"), (4, "q", "p", "Dev", "x"), (5, "q", "p", None, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, query string, positive string, split string, source_id string")
    assert [tuple(r) for r in mixing.usable_records(df).collect()] == [("a_b_c", 1)]
    c = spark.createDataFrame([("SHA256:" + "AB" * 32,), ("0" * 64,), (" unknown ",), ("",), (None,), ("ab" * 32 + " ",)], "h string")
    assert [r[0] for r in c.select(fields.digest(c["h"])).collect()] == ["ab" * 32, None, None, None, None, "ab" * 32]


@pytest.mark.parametrize(
    ("query", "body"),
    [("Instruct: do\nQuery: What, now", "whatnow"), ("Ｉｎｓtｒuсt： do\nＱuеry: x", "x"), ("INSTRUCT: A\r\nQUERY: B query: c", "bqueryc"), ("Instruct: a Query: b", "b"), ("plain Query: x", "plainqueryx"), ("", ""), (None, None)],
)
def test_stored_instructions_in_any_characters(query, body):
    assert glyphs.bare_body(query) == body


TEXT = (
    "담당 김새봄 / 전화 ０１０－１２３４－５６７８\r\n메일 a.b+1 (at) site (dot) test, 주민번호 900101-1234567\n소재지: 가온도 솔빛시 참샘구 별하로12번길 3-4, 5층\n"
    "접수번호 206406-1663168 건은 종결되었다. 바코드 8899420271490 상품\n고시 제205579-5730941호\n공지 계정 @desk_x 를 구독하세요.\n도로명 주소 체계를 설명한다.\n담당자 미정\n"
    "Signed by Rufina D. Ostrander\nThe appeal by Ashgrove, Brenna was heard.\nAddress: 215 Marrow Street, Apt 6, East Varley\nID: 986 11 2519 | Tel. +1-313-555-0111\n전화 공일공 공육이팔 칠칠구이 로 예약"
)


def test_personal_information(spark):
    docs = [(1, TEXT), (2, None), (3, ""), (4, "x" * 100_000), (5, "전화 010-1111-2222, 전화 010-1111-2222"), (1, "이메일 a@b.test")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'k' as kind", "1 as key", "2 as t")
    got = [(r["doc_id"], r["kind"], r["start_pos"], r["length"]) for r in pii.find(df, "doc_id", "text").collect()]
    found = {(k, TEXT[p - 1 : p - 1 + n]) for d, k, p, n in got if d == 1 and p > 5}
    assert found == {
        ("phone", "０１０－１２３４－５６７８"), ("email", "a.b+1 (at) site (dot) test"), ("id_number", "900101-1234567"), ("address", "가온도 솔빛시 참샘구 별하로12번길 3-4, 5층"),
        ("name", "Rufina D. Ostrander"), ("name", "Ashgrove, Brenna"), ("address", "215 Marrow Street, Apt 6, East Varley"), ("id_number", "986 11 2519"), ("phone", "+1-313-555-0111"), ("phone", "공일공 공육이팔 칠칠구이"),
    }
    assert (1, "name", 4, 3) in got and (1, "email", 5, 8) in got
    assert [x for x in got if x[0] == 5] == [(5, "phone", 4, 13), (5, "phone", 22, 13)]
    red = {r["doc_id"]: r["text"] for r in pii.redact(df.where("text is null or length(text) < 100000"), "doc_id", "text").collect()}
    assert red[2] is None and red[3] == "" and red[5] == "전화 [PHONE], 전화 [PHONE]"
    assert pii.find(df.limit(0), "doc_id", "text").count() == 0


def test_held_out_accuracy_of_the_model():
    model = SemiCRF(dict(pii.trained_weights()))
    hit = made = true = 0
    for text, gold in pii.training_lines(400, seed=77):
        got = {(c.start, c.end, c.kind) for c in model.decode(spans.candidates(text.translate(spans.WIDE)))}
        hit, made, true = hit + len(got & gold), made + len(got), true + len(gold)
    assert hit / true > 0.97 and hit / made > 0.97


# Sentences without a listed cue, and the names in them.
HAND = [
    ("김서연이 창문을 닫았다", ["김서연"]), ("그 책은 박민준의 것이다", ["박민준"]), ("아침에 이지우를 만났다", ["이지우"]), ("최예진과 정우성은 친구다", ["최예진", "정우성"]), ("막내 윤하준이 웃었다", ["윤하준"]), ("홍길동 부사장이 말했다", ["홍길동"]),
    ("장수진에게 편지를 썼다", ["장수진"]), ("우리는 한상현을 기억한다", ["한상현"]), ("조은경 님께", ["조은경"]), ("임재현 교수가 왔다", ["임재현"]), ("발신: 최도윤", ["최도윤"]), ("저는 이영희라고 합니다", ["이영희"]), ("강민호도 같이 갔다", ["강민호"]),
    ("신동욱 팀장의 메모", ["신동욱"]), ("서기: 오지훈", ["오지훈"]), ("송미경은 답이 없었다", ["송미경"]), ("문은주가 노래했다", ["문은주"]), ("남궁민수가 왔다", ["남궁민수"]), ("김민수가 회의에 참석했다", ["김민수"]), ("남선생님께 물었다", []),
    ("문화재가 늘었다", []), ("임시로 지정한 자료를 본다", []), ("이용자가 신용한도를 묻는다", []),
    ("My name is John Smith", ["John Smith"]), ("We met Sarah Connor yesterday.", ["Sarah Connor"]), ("Manager: Peter Parker", ["Peter Parker"]), ("Regards, Alice Walker", ["Alice Walker"]), ("I asked David Brown to come.", ["David Brown"]),
    ("Emily Johnson signed it", ["Emily Johnson"]), ("the note from Laura Palmer", ["Laura Palmer"]), ("Author: Jane Foster", ["Jane Foster"]), ("Thank you, Robert Miles", ["Robert Miles"]), ("She knows Michael B. Jordan well.", ["Michael B. Jordan"]), ("The Annual Report is out.", []),
]


def test_names_without_listed_cues():
    model, hit, true, made = SemiCRF(dict(pii.trained_weights())), 0, 0, 0
    for line, names in HAND:
        got = [line[a:b] for kind, a, b in pii.find_items(line, model) if kind == "name"]
        hit, true, made = hit + len(set(got) & set(names)), true + len(names), made + len(got)
    assert hit / true >= 0.9 and hit == made


def test_addresses_of_other_shapes():
    model = SemiCRF(dict(pii.trained_weights()))
    for line, item in [("1600 Pennsylvania Ave NW, Washington", "1600 Pennsylvania Ave NW, Washington"), ("Send to PO Box 123.", "PO Box 123"), ("Address: 471 Old Tannery Ave., East Varley, ID: 995 17 4378", "471 Old Tannery Ave., East Varley")]:
        assert item in [line[a:b] for kind, a, b in pii.find_items(line, model) if kind == "address"]


WRITTEN = [
    "전화 010–1234–5678", "전화 010\u00a01234\u30005678", "010．1234．5678", "kim at host.com", "kim at host (dot) com", "kim<at>host.com", "kim 골뱅이 host 점 com", "홍길동\u00a0과장", "가온시 별하로\u300012", "Ｍ１２３４５６７８", "+82 10 1234 5678", "공일공-일이삼사-오육칠팔",
    "one two three four five six seven", "M123A4567", "AB1234567", "12-34-567890-12", "사서함 12호", "P.O. Box 9", "Walker, Alice", "Ａlice Ｗalker", "이름： 김 새봄", "담당자는 황보든", "성명 김\u2009새봄", "독고영재 귀하",
]


def test_gates_let_every_candidate_pass():
    import pyarrow as pa

    lines = [t for t, _ in pii.training_lines(1500, seed=5)] + TEXT.splitlines() + [x for x, _ in HAND] + WRITTEN
    lines = [x.translate(spans.WIDE) for x in lines]
    for line, bits in zip(lines, spans.open_gates(pa.array(lines)).tolist()):
        assert spans.candidates(line) == spans.candidates(line, gates=bits), line
    assert sum(bool(spans.candidates(x.translate(spans.WIDE))) for x in WRITTEN) > 20


def test_decode_joins_boundaries_and_types():
    model = SemiCRF({"a": 1.0, "b": 1.5, "t=0,1": 0.25})
    s = [spans.Span(0, 4, 0, ("a",)), spans.Span(0, 9, 1, ("b",)), spans.Span(5, 9, 1, ("a",))]
    assert [(c.start, c.end) for c in model.decode(sorted(s, key=lambda c: (c.end, c.start)))] == [(0, 4), (5, 9)]
    assert model.decode([]) == []


@pytest.mark.parametrize("n", [1, 2, 7])
def test_permutation_covers_every_record(n):
    import pandas as pd

    b = pd.DataFrame({"audit_id": "p", "phase": "x", "source_id": "a", "shard": 0, "k": range(2 * n), "have": n, "seed": 3})
    out = next(mixing._permute(iter([b])))
    assert sorted(out["nth"][:n]) == sorted(out["nth"][n:]) == list(range(n))
