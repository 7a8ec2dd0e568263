"""Chunks, seats, ledgers and audits against cases worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import audit, chunking, dense, judge, profile, select
from quillon.plans import retrieve

U = chunking.Unit


def units(*sizes, major="a"):
    return [U("x" * n, 1, major, major) for n in sizes]


def test_pack_fills_and_overlaps():
    groups = chunking.pack(units(*[100] * 20))
    assert [len(g) for g in groups] == [7, 7, 7, 5] and sum(len(u.text) + 1 for u in groups[0]) <= 800
    assert [len(g) for g in chunking.pack(units(*[100] * 20), overlap=0)] == [7, 7, 6]


def test_pack_keeps_long_units_whole_and_ends():
    assert [[len(u.text) for u in g] for g in chunking.pack(units(2000, 10))] == [[2000], [10]]
    assert chunking.pack([]) == [] and len(chunking.pack(units(1))) == 1


def test_pack_breaks_at_sections_without_tails():
    rows = units(*[100] * 3) + units(*[100] * 3, major="b")
    assert [[u.major for u in g] for g in chunking.pack(rows)][:1] == [["a"] * 3]
    got = chunking.pack(rows)
    assert all(len({u.major for u in g}) == 1 for g in got) and [u for g in got for u in g if u.major == "b"] == rows[3:]
    assert len(chunking.pack(rows, tails=True)) > len(got)


def test_pack_covers_everything():
    rng = random.Random(4)
    for _ in range(50):
        rows = [U("x" * rng.randint(1, 400), k, "l", rng.choice("ab")) for k in range(rng.randint(1, 60))]
        got = chunking.pack(rows)
        seen = sorted({u.page for g in got for u in g})
        assert seen == list(range(len(rows))) and all(sum(len(u.text) + 1 for u in g) <= 800 or len(g) == 1 for g in got)


def test_chunk(spark):
    text = "第一节 概述\n" + "句子很长。" * 30 + "\n3 / 281\n第二节 财务\n合并利润表\n单位：万元\n" + "2024年 数。" * 20
    pages = spark.createDataFrame([("d", "cninfo", 1, text), ("d", "cninfo", 2, "短"), ("e", "ecfr", 1, None), ("f", "sec", 1, "y" * 39), ("g", "sec", 1, "y" * 40)], "doc_id string, source string, page int, text string")
    rows = {r.chunk_id: r for r in chunking.chunk(pages).collect()}
    assert sorted(rows) == ["d::00000", "d::00001", "g::00000"]
    assert rows["d::00000"].section.startswith("第一节") and rows["d::00001"].section.startswith("第二节") and "281" not in rows["d::00000"].text
    assert (rows["d::00001"].period, rows["d::00001"].amount_unit, rows["d::00001"].table_title) == ("2024年", "万元", "合并利润表")


def test_carry_titles(spark):
    rows = spark.createDataFrame([("d", 0, 1, 1, "t"), ("d", 1, 4, 4, ""), ("d", 2, 5, 5, "")], "doc_id string, seq int, page_start int, page_end int, table_title string")
    assert [r.table_title for r in chunking.carry_titles(rows).orderBy("seq").collect()] == ["t", "t", ""]


def greedy(rows, gap=2):
    kept = []
    for r in sorted(rows, key=lambda r: r[2]):
        if not any(k[0] == r[0] and abs(k[1] - r[1]) <= gap for k in kept):
            kept.append(r)
    return sorted(kept)


def test_drop_adjacent_is_greedy(spark):
    rng = random.Random(1)
    rows = [("d%d" % rng.randint(0, 5), s, r) for r, s in enumerate(rng.sample(range(60), 50))]
    hits = spark.createDataFrame([(1, *r) for r in rows], "q int, doc_id string, seq int, rank int")
    once = select.drop_adjacent(hits, "q")
    assert sorted((r.doc_id, r.seq, r.rank) for r in once.collect()) == greedy(rows)
    assert once.exceptAll(select.drop_adjacent(once, "q")).isEmpty()


def test_doc_cap_spares_protected(spark):
    hits = spark.createDataFrame([(1, "d", k, k == 4) for k in range(6)], "q int, doc_id string, rank int, safe boolean")
    assert sorted(r["rank"] for r in select.cap_documents(hits, "q", protected=F.col("safe")).collect()) == [0, 1, 2, 4]


def test_seats(spark):
    rows = [(1, f"{c}{k}", c, 3 * k + i, None) for k in range(4) for i, c in enumerate("ABC")] + [(1, "z", "D", 20, 0)]
    hits = spark.createDataFrame(rows, "q int, row string, company string, rank int, anchor_rank int")
    named = spark.createDataFrame([(1, c, k) for k, c in enumerate("CBA")], "q int, company string, position int")
    got = [r.row for r in select.seat(hits, named, 8, "q", "row").orderBy("seat").collect()]
    assert got == ["z", "C0", "B0", "A0", "C1", "B1", "A1", "A2"]
    none = named.where("false")
    assert [r.row for r in select.seat(hits.withColumn("anchor_rank", F.lit(None).cast("int")), none, 3, "q", "row").orderBy("seat").collect()] == ["A0", "B0", "C0"]


def test_a_silent_channel_changes_nothing(spark, data):
    from quillon.operators import fusion

    a = spark.createDataFrame([(1, k, k) for k in range(5)], "q int, row int, rank int")
    votes = fusion.votes(a, "q", "row")
    one, two = (fusion.fuse(x, "q", "row").orderBy("rank").collect() for x in ([votes], [votes, votes.where("false")]))
    assert one == two and one[0].score == round(1 / 60, 9)


def test_settings():
    assert [retrieve.Settings(k=k).clamped().k for k in (0, 8, 99)] == [1, 8, 50]


def answers(spark, *rows):
    return spark.createDataFrame(rows, "query_id int, q string, ans string, must_ans array<string>, must_fail boolean")


def hits(spark, *rows):
    return spark.createDataFrame(rows, "query_id int, seat int, text string, company string, source string")


@pytest.mark.parametrize(
    ("ans", "passage", "seats"),
    [
        ("见（89 FR 96790）", "(89 FR 96790, December 5, 2024)", {"96790": [1]}), ("营收 1,234,567 元", "1234567 元", {"1,234,567": [1]}), ("营收 1,234 元", "1234 元", {"1,234": []}),
        ("营收 999999 元", "none", {"999999": []}), ("12,345.67", "12.34%", {"12,345.67": []}), ("门槛是 3A090.c", "3A090.c", {}), ("问 55555 答", "x", {}),
    ],
)
def test_number_attribution(spark, ans, passage, seats):
    got = judge.attribute_numbers(answers(spark, (1, "问 55555", ans, None, None)), hits(spark, (1, 0, passage, "", "")))
    assert {r.number: r.seats for r in got.collect()} == seats


@pytest.mark.parametrize(
    ("ans", "present"),
    [("讲 [1][2]", True), ("美光 说", True), ("没有引用", False), ("[99] 引用", False), ("美光 最近 如何", False)],
)
def test_answer_domain(spark, ans, present):
    seats = hits(spark, (1, 0, "t", "美光 Micron", "sec"), (1, 1, "t", "美光 Micron", "sec"))
    out = judge.answer_domain(answers(spark, (1, "美光最近如何", ans, None, None)), seats).first()["domain"]
    assert ("美光" in out) == present


@pytest.mark.parametrize(("ans", "ok"), [("HBM3E 的合约价材料未覆盖，库中无一手价格。", True), ("HBM3E 合约价约 30 美元。", False), ("具体价格需查付费报告。", False), (None, False)])
def test_must_fail(spark, ans, ok):
    assert judge.judge_answers(answers(spark, (1, "q", ans, None, True)), hits(spark, (1, 0, "t", "", ""))).first()["ok_answer"] == ok


def test_judge_answers(spark):
    rows = answers(spark, (1, "q", "美光 96790", ["美光"], False), (2, "q", "96790", ["美光"], False), (3, "q", "x 88888", None, None))
    got = {r.query_id: (r.ok_answer, r.orphans, r.missing) for r in judge.judge_answers(rows, hits(spark, (1, 0, "96790", "", ""), (2, 0, "96,790", "", ""))).collect()}
    assert got == {1: (True, [], []), 2: (False, [], ["美光"]), 3: (False, ["88888"], [])}


def test_recall(spark):
    schema = "n int, must array<string>, min_companies int, need_lib map<string,int>, forbid_lib string, require_companies map<string,string>, min_from_company map<string,int>, must_fail boolean"
    specs = spark.createDataFrame(
        [(1, ["HBM"], 2, {"A": 1, "B": 1}, None, {"美光": "HBM"}, {"美光": 1}, False), (2, ["nothing"], None, None, "B", None, None, False), (3, ["x"], None, None, None, None, None, True), (4, None, None, None, "A", None, {"三星": 1}, None)], schema
    )
    rows = spark.createDataFrame([(n, t, c, s) for n in (1, 2, 4) for t, c, s in (("HBM here", "美光 Micron", "sec"), ("rule", "", "ecfr"))], "n int, text string, company string, source string")
    got = {r.n: r for r in judge.recall(specs, rows).collect()}
    assert got[1].ok_recall and not got[2].ok_must and not got[2].ok_forbid and got[3].ok_recall and not got[4].ok_from and not got[4].ok_recall


def test_cross_source_dedup(spark):
    files = [("cninfo", f"a{k}", "A" if k < 5 else "B") for k in range(8)] + [("szse", f"b{k}", "A" if k < 5 else "B") for k in range(8)] + [("sec", f"c{k}", "C") for k in range(4)]
    manifest = spark.createDataFrame([(d, s, h) for s, d, h in files], "doc_id string, source string, sha256 string")
    rows = spark.createDataFrame([(d, s) for s, d, _ in files] + [("unknown", "szse")], "doc_id string, source string")
    kept = [r.doc_id for r in audit.dedup_across_sources(rows, manifest).collect()]
    assert len(kept) == 13 and not any(d.startswith("b") for d in kept) and "unknown" in kept and sum(d.startswith("c") for d in kept) == 4


def test_completeness(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    pages = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "doc_id string, page int")
    trailers = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, pages int")
    assert {r.doc_id: r.state for r in audit.completeness(expected, pages, trailers).collect()} == {"a": "ok", "b": "mismatch", "c": "broken", "d": "missing"}


def test_dense_top_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERIES", 2)
    rng = random.Random(2)
    vectors = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(30)] + [(99, None)], "vec_id long, embedding array<double>")
    got = dense.top(vectors.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), vectors, 3)
    assert got.count() == 15 and {r.query_id for r in got.where("rank = 0 and query_id = vec_id").collect()} == set(range(5))
    assert dense.top(vectors.where("false").withColumnRenamed("vec_id", "query_id"), vectors, 3).count() == 0


def test_size_percentiles(spark):
    rows = spark.createDataFrame([(k,) for k in (5, 1, 9, 9, 2)], "size int")
    assert {r.share: r["size"] for r in profile.size_percentiles(rows, "size", (0.0, 0.5, 1.0)).collect()} == {0.0: 1, 0.5: 5, 1.0: 9}


def test_streaming(spark, tmp_path):
    """Contents over two runs, the second with a copy of less key than the first's; a batch that is run again changes nothing."""
    from quillon.streaming import ingest

    schema, path, seen = "doc_id long, text string, source string", str(tmp_path / "contents"), []
    spark.createDataFrame([(2, "a", "x"), (3, "a", "y"), (4, "b", "y"), (8, None, "y")], schema).write.parquet(str(tmp_path / "in"))

    def each(batch, no):
        seen.append(sorted(r.text or "" for r in ingest.unseen(batch, spark, path, no).collect()))
        for _ in range(2):
            ingest.record(batch, no, path)

    run = lambda: ingest.start(ingest.landed(spark, str(tmp_path / "in"), schema), each, str(tmp_path / "state")).awaitTermination()
    run()
    spark.createDataFrame([(1, "b", "z"), (5, "c", "x"), (9, "", "x")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert seen == [["", "a", "a", "b"], ["c"]]
    assert sorted((r.doc_id, r.source) for r in ingest.recorded(spark, path).collect()) == [(1, "z"), (2, "x"), (5, "x"), (8, "y")]


def test_named_companies(spark):
    asked = spark.createDataFrame([(1, "三星和 hynix 谁大"), (2, "none")], "query_id long, text string")
    names = spark.createDataFrame([("三星电子",), ("SK hynix",), ("美光 Micron",), (None,)], "company string")
    got = [(r.query_id, r.company, r.alias, r.position) for r in retrieve.named_companies(asked, names, "query_id").orderBy("position").collect()]
    assert got == [(1, "SK hynix", "hynix", 0), (1, "三星电子", "三星", 1)]


def test_anchor_channel(spark):
    chunks = spark.createDataFrame([(1, "一、营业收入 | 3\n营业收入 | 4"), (2, "营业收入 | 5"), (3, "营业收入 5"), (4, "净利 | x")], "row long, text string")
    anchors = spark.createDataFrame([(7, "营业收入"), (7, "净利")], "query_id long, anchor string")
    bm25 = spark.createDataFrame([], "query_id long, row long, rank int")
    assert [(r.row, r.anchor_hits, r["rank"]) for r in retrieve.anchor_channel(chunks, anchors, bm25, "query_id", "row").orderBy("rank").collect()] == [(1, 2, 0), (2, 1, 1)]


def test_blocks_of_questions(spark):
    asked = spark.range(10).withColumnRenamed("id", "k")
    assert sorted(r.k for r in select.in_blocks(asked, "k", lambda b: b, rows=3).collect()) == list(range(10))
