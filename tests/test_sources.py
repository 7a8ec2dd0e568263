"""Tables, HTML, text and XML."""

import json

import pytest

from quillon.sources import html, plain, tables, tabular

HEAD = ["项目", "2025 年半年度", "2024 年半年度"]


def test_flatten_pairs_each_number_with_its_header():
    flat, header = tables.flatten([HEAD, ["二、营业总成本", "10,081,506,072.43", "8,215,067,574.55"]])
    assert flat == "二、营业总成本 | 2025 年半年度 10,081,506,072.43 | 2024 年半年度 8,215,067,574.55" and header == HEAD


def test_a_rest_row_is_no_header():
    flat, header = tables.flatten([["利息收入", "", ""], ["二、营业总成本", "10,081,506,072.43", "8,215,067,574.55"]], inherited=HEAD)
    assert "二、营业总成本 | 2025 年半年度 10,081,506,072.43" in flat and "利息收入 10,081,506,072.43" not in flat and header == HEAD
    assert tables.flatten([["2、职工福利费", "111,000.00"], ["3、其他", "5.0"]])[0].split("\n")[0] == "2、职工福利费 | 111,000.00"


def test_runs_keep_their_column():
    flat, _ = tables.flatten([["x", "期末余额", "期末余额", "期初余额"], ["商誉", "1.5", "1.5", "2.5"]])
    assert flat == "商誉 | 期末余额 1.5 | 期初余额 2.5"


def test_header_only_and_merged_header():
    assert tables.flatten([["项目", "年度"]]) == ("项目 | 年度", ["项目", "年度"])
    assert tables.flatten([["a", "b", ""], ["x", "1.0", "2.0"]])[0] == "x | b 1.0 | b 2.0"
    assert tables.flatten([]) == ("", None)


def test_defects():
    assert tables.defect([["a", "b"]]) and tables.defect([["a"], ["b"]]) and tables.defect([["a", "", "", ""], ["", "b", "c", ""]]).startswith("empty")
    assert not tables.defect([["a", "b"], ["c", "d"]])


def test_wrapped_lines():
    assert tables.unwrap("公司股\n东") == "公司股东" and tables.unwrap("high\nbandwidth") == "high bandwidth" and tables.unwrap(None) == ""


def test_inheritance():
    assert tables.may_inherit(HEAD, 3) and not tables.may_inherit(HEAD, 2) and not tables.may_inherit(HEAD, 3, apart=1) and not tables.may_inherit(None, 3)
    assert tables.may_inherit(HEAD, 3, top=100, height=800) and not tables.may_inherit(HEAD, 3, top=300, height=800)


def test_spans():
    span = tables.Span()
    span.add([("a", "2", "2"), ("b", None, "bad")])
    span.add([("c", None, None)])
    span.add([("d", None, None)])
    assert span.grid == [["a", "a", "b"], ["a", "a", "c"], ["d"]]


def test_html_blocks():
    page = """<html><head><title>no</title></head><body><p>one <b>bold</b> tail<!-- c --></p><script>x</script><div style="display: none">hid</div>
    <table><tr><td>项目</td><td>年度</td></tr><tr><td>甲<table><tr><td>inner</td></tr></table></td><td>1.5</td></tr></table>
    <table><tr><td>乙</td><td>2.5</td></tr><tr><td>丙</td><td>3.5</td></tr></table><p>between</p><table><tr><td>丁</td><td>4.5</td></tr><tr><td>戊</td><td>5.5</td></tr></table>end"""
    got = html.Blocks.of(page)
    assert got.out == [("text", "one bold tail"), ("table", "甲 inner | 年度 1.5"), ("table", "乙 | 年度 2.5\n丙 | 年度 3.5"), ("text", "between"), ("table", "丁 | 4.5\n戊 | 5.5"), ("text", "end")]
    assert html.Blocks.of(None).out == [] and html.Blocks.of("<table><tr><td>x").out == []


def test_html_links(spark):
    pages = spark.createDataFrame([(1, '<a href="//x.com/a/Half_Interim_Report.pdf">a</a><a href="http://x.com/1Q_Interim_Report.pdf?a=1&amp;b=2">'), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in html.links(pages, drop=r"(?i)[123]Q[_-]?Interim").collect()] == [(1, "https://x.com/a/Half_Interim_Report.pdf", "Half_Interim_Report.pdf")]


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a b\nc\n \n\nx\n\nlast one"), (2, "<html><head><title>t</title></head><pre>one\nline\n\n[[Page 9]] &amp; two</pre>"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in plain.paragraphs(docs).collect()) == [(1, 1, "a b c"), (1, 2, "last one"), (2, 1, "one line"), (2, 2, "[[Page 9]] & two")]


def test_xml(spark):
    assert plain.xml_blocks("<R><DIV8><HD>a</HD><SECTION>in</SECTION> tail</DIV8><SECTION>second</SECTION></R>") == ["a in tail", "second"]
    assert plain.xml_blocks("<R><P>one</P><Q><FP>two</FP></Q><P>x</P></R>") == ["one", "two"] and plain.xml_blocks("<R>") == []
    long = "w " * 15_000
    big = f"<R><DIV9>intro <FP-2>0A002 {long}</FP-2><HD1>List of items</HD1><P>same entry</P><FP-2>3A090 {long}</FP-2><HD1>Category 3</HD1></DIV9></R>"
    got = plain.xml_blocks(big)
    assert [g[:14] for g in got] == ["intro", "0A002 w w w w ", "3A090 w w w w ", "Category 3"] and got[1].endswith("List of items same entry")
    docs = spark.createDataFrame([(1, "<R><P>one</P></R>"), (2, "no xml\n\nat all")], "doc_id long, xml string")
    assert sorted(tuple(r) for r in plain.sections(docs).collect()) == [(1, 1, "one"), (2, 1, "no xml"), (2, 2, "at all")]


def test_listings(spark, tmp_path):
    lines = [json.dumps({"source": "s", "url": "u", "bytes": k, "fetched_at": f"2024-01-0{k}"}) for k in (1, 3, 2)]
    (tmp_path / "m.jsonl").write_text("\n".join([*lines, "{bad"]))
    assert [(r.url, r.bytes) for r in tabular.manifest(spark, str(tmp_path / "m.jsonl")).collect()] == [("u", 3)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    (row,) = tabular.files(spark, str(tmp_path / "f")).collect()
    assert (row.bytes, row.sha256) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    rules = spark.createDataFrame([("2024-12-05", "2024-12-02"), ("2024-12-02", "2024-12-05"), ("", "2024")], "publication_date string, effective_on string")
    assert [bool(r.note) for r in tabular.odd_dates(rules).collect()] == [True, False, False]
    zipped = tabular.zipped(spark.createDataFrame([(1, ["a", "b"], [5, 6])], "k int, x array<string>, y array<int>"), ["k"], ["x", "y"])
    assert sorted(tuple(r) for r in zipped.collect()) == [(1, "a", 5), (1, "b", 6)]


@pytest.mark.parametrize(("url", "name", "expected"), [("http://a/b/c.pdf?x=1", "", "c.pdf"), ("http://a/b", "kept", "kept")])
def test_names_from_urls(spark, url, name, expected):
    assert tabular.names_from_urls(spark.createDataFrame([(url, name)], "u string, n string"), "u", "n").first()["n"] == expected
