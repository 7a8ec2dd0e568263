"""Layout pages, SQL functions, answers and reports."""

from pyspark.sql import functions as F

from quillon.functions import register
from quillon.operators import lexical
from quillon.plans import answers
from quillon.sources import pages

HEAD, BODY = ["项目", "2025 年", "2024 年"], ["营业成本", "1.5", "2.5"]


def item(page, y0, text=None, rows=None, box=(0.0, 100.0, 0.0)):
    return ("d", page, 800.0, box[0], y0, box[1], y0 + 50 + box[2], text, rows)


def test_layout_pages(spark):
    rows = [
        item(1, 700.0, rows=[HEAD, BODY]), item(1, 10.0, text="above"), item(1, 720.0, text="in the table"),
        item(2, 20.0, rows=[BODY, BODY]), item(3, 500.0, rows=[BODY, BODY]), item(3, 600.0, rows=[["a", "b"]]),
    ]
    found = {r.page: r for r in pages.from_layout(spark.createDataFrame(rows, pages.LAYOUT)).collect()}
    assert found[1].text == "above\n营业成本 | 2025 年 1.5 | 2024 年 2.5" and found[2].text.startswith("营业成本 | 2025 年 1.5") and found[3].text.startswith("营业成本 | 1.5")
    assert (found[3].tables, found[3].tables_dropped, found[3].drop_reasons) == (1, 1, ["few rows"])
    assert pages.trailer(spark.createDataFrame([("d", 1, 5, 1, 0), ("d", 2, 6, 0, 1)], "doc_id string, page int, chars int, tables int, tables_dropped int")).first()["pages"] == 2


def test_sql_functions(spark):
    register.register(spark)
    row = spark.sql("select tokenize('HBM3E the') t, detect_section('PART II').level l, derive_caliber('单位：元').amount_unit u, row_label('一、甲： | 3') r, label_hits('甲 | 3', '甲') h, value_numbers('x 1,234.5 y') v, report_kind('年度报告') k, version_tag('a') g").first()
    assert tuple(row) == (["hbm3e", "hbm"], 1, "元", "甲", 1, ["1,234.5"], "年报", "原件")
    spark.createDataFrame([(1, "one. two.\nthree. four | 4"), (2, None)], "id int, text string").createOrReplaceTempView("some_texts")
    got = spark.sql("select id, c.* from some_texts, lateral chunk_text(text, 100, 0) c order by id, seq").collect()
    assert [(r.id, r.n_units, r.text) for r in got] == [(1, 3, "one.\ntwo.\nthree. four | 4")]


def test_expand(spark):
    asked = spark.createDataFrame([(1, "问题"), (2, "alone")], "query_id long, text string")
    lines = spark.createDataFrame([(1, 0, "1. 3A090.c first"), (1, 1, "问题"), (1, 2, ""), (1, 3, "x" * 400), (1, 4, "second"), (1, 5, "- third"), (1, 6, "fourth")], "query_id long, pos int, text string")
    got = [(r.query_id, r.pos, r.weight, r.text) for r in answers.expand(asked, lines).orderBy("query_id", "pos").collect()]
    assert got == [(1, 0, 1.0, "问题"), (1, 1, 0.6, "3A090.c first"), (1, 2, 0.6, "second"), (1, 3, 0.6, "third"), (2, 0, 1.0, "alone")]
    assert [r.text for r in answers.uncached(asked, spark.createDataFrame([("alone", ["x"])], "text string, rewrites array<string>")).collect()] == ["问题"]


def test_answers(spark):
    asked = spark.createDataFrame([(1, "q"), (2, "none")], "query_id long, text string")
    seats = spark.createDataFrame([(1, 1, "later"), (1, 0, "First one. Second")], "query_id long, seat int, text string")
    assert {r.query_id: r.ans for r in answers.answer(asked, seats).collect()} == {1: "First one. [1]", 2: "材料未覆盖"}


def test_small_things(spark, tmp_path, monkeypatch):
    assert [len(b) for b in answers.batches(["x" * 100] * 10, tokens=200, most=3)] == [3, 3, 3, 1] and [len(b) for b in answers.batches(["x" * 1000, "y"], tokens=10)] == [1, 1]
    assert [answers.seats_asked(v) for v in (None, "x", "0", "99", "5")] == [8, 8, 1, 50, 5]
    (tmp_path / ".env").write_text("A=1\n#B=2\nC='3'\nD=4\n")
    monkeypatch.setenv("D", "own")
    assert answers.settings(["A", "B", "C", "D"], str(tmp_path / ".env")) == {"A": "1", "C": "3", "D": "own"}
    report = spark.createDataFrame([("a|b", None)], "x string, y int")
    assert answers.markdown(report).split("\n") == ["| x | y |", "| --- | --- |", "| a\\|b | — |"]
    shown = answers.page("q<", [{"cite": "美光|sec · x", "text": "t&"}], "see [1] 材料未覆盖")
    assert '<a href="#h1">[1]</a>' in shown and "t&amp;" in shown and "q&lt;" in shown
    counted = answers.seats_by_company(spark.createDataFrame([(1, shown)], "id int, html string"), "id")
    assert [tuple(r) for r in counted.collect()] == [(1, "美光", 1)]
    assert answers.markdown_section("# a\nx\n## Q2 b\ny\nz\n# c", "Q2") == "## Q2 b\ny\nz" and answers.markdown_section("x", "Q2") == ""
    chunks = spark.createDataFrame([("d", 0, 1, 2, "甲 | 1\n乙 | 2\n甲 | 1\n甲 | 3"), ("d", 1, 3, None, "甲 | 9")], "doc_id string, seq int, page_start int, page_end int, text string")
    assert [r.text for r in answers.lines_with(chunks, "d", 2, "甲").collect()] == ["甲 | 1", "甲 | 3"] and [r.text for r in answers.lines_with(chunks, "d", 3, "甲").collect()] == ["甲 | 9"]


def test_index_is_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "beta gamma alpha")], "doc_id long, text string")
    built = lexical.build(docs, "doc_id")
    built.write(str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "beta unknown")], "query_id long, text string")
    one, two = (lexical.search(i, asked, "doc_id", "query_id").orderBy("rank").collect() for i in (built, lexical.Index.read(spark, str(tmp_path / "index"))))
    assert one == two and [r.doc_id for r in one] == [1, 3] and lexical.search(built, asked.withColumn("text", F.lit("")), "doc_id", "query_id").count() == 0
