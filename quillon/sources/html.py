"""HTML pages to text and table blocks, in document order, without comments and hidden parts; outermost tables only."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

#: Elements that are dropped, that end a paragraph, and that have no end tag.
DROPPED = {"script", "style", "head", "meta", "link", "noscript", "ix:header"}
BLOCKS = {"p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "hr", "td"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("​", "")).strip()


class Blocks(HTMLParser):
    """Collects (kind, text); what a hidden element contains is skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.hidden: list[str] = []
        self.depth = 0  # of tables
        self.header: list[str] | None = None
        self.apart = 0
        self.dropped: list[str] = []
        self.row: list[tuple[str, str | None, str | None]] | None = None
        self.cell: tuple[list[str], str | None, str | None] | None = None

    def flush(self) -> None:
        if text := _plain("".join(self.text)):
            self.out.append(("text", text))
            self.apart += 1
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        style = re.sub(r"\s", "", dict(attrs).get("style") or "").lower()
        if self.hidden or tag in DROPPED or "display:none" in style or "visibility:hidden" in style:
            if tag not in VOID:
                self.hidden.append(tag)
            return
        if tag == "table":
            if not self.depth:
                self.flush()
                self.span = tables.Span()
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.end_row()
            self.row = []
        elif self.depth == 1 and tag in ("td", "th"):
            self.end_cell()
            self.row = [] if self.row is None else self.row
            a = dict(attrs)
            self.cell = ([], a.get("colspan"), a.get("rowspan"))
        elif not self.depth and tag in BLOCKS:
            self.flush()
        elif self.cell and tag in BLOCKS:
            self.cell[0].append(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.end_table()
        elif self.depth == 1 and tag == "tr":
            self.end_row()
        elif self.depth == 1 and tag in ("td", "th"):
            self.end_cell()
        elif not self.depth and tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.depth:
            if self.cell:
                self.cell[0].append(data)
        else:
            self.text.append(data)

    def end_cell(self) -> None:
        if self.cell and self.row is not None:
            self.row.append((_plain("".join(self.cell[0])), *self.cell[1:]))
        self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        if self.row is not None:
            self.span.add(self.row)
        self.row = None

    def end_table(self) -> None:
        self.end_row()
        rows = self.span.grid
        if why := tables.defect(rows):
            self.dropped.append(why)
            return
        width = max(map(len, tables.clean(rows)))
        flat, header = tables.flatten(rows, self.header if tables.may_inherit(self.header, width, self.apart) else None)
        self.header = header or self.header
        if flat:
            self.out.append(("table", flat))
        self.apart = 0

    @classmethod
    def of(cls, html: str | None) -> "Blocks":
        parser = cls()
        parser.feed(html or "")
        parser.close()
        while parser.depth:
            parser.depth = 1
            parser.handle_endtag("table")
        parser.flush()
        return parser


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block, kind, text, tables_dropped, drop_reasons): blocks are numbered from 1; drop reasons are the first six.

    A page without text has no rows; null pages are empty.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for k, page in zip(batch.column(key).to_pylist(), batch.column(html).to_pylist()):
                found = Blocks.of(page)
                rows += [(k, i, kind, text, len(found.dropped), found.dropped[:6]) for i, (kind, text) in enumerate(found.out, 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = [key, "block", "kind", "text", "tables_dropped", "drop_reasons"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
    return pages.select(F.col(key).cast("long"), html).mapInArrow(run, f"{key} long, block int, kind string, text string, tables_dropped int, drop_reasons array<string>")


def links(pages: DataFrame, key: str = "page_id", html: str = "html", pattern: str = r'(?i)href="([^"]+)"', keep: str | None = None, drop: str | None = None) -> DataFrame:
    """(key, url, name): each link once a page; protocol-relative ones get https, `&amp;` is read; name is what follows the last slash."""
    found = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("url"))
    url = F.replace(F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("https:"), F.col("url"))).otherwise(F.col("url")), F.lit("&amp;"), F.lit("&"))
    out = found.select(key, url.alias("url")).distinct().withColumn("name", F.regexp_extract("url", r"([^/]*)$", 1))
    if drop:
        out = out.where(~F.col("name").rlike(drop))
    return out.where(F.col("name").rlike(keep)) if keep else out
