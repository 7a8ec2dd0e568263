"""Pages as a layout parser leaves them (text and tables with boxes) to page rows; any parser can feed it, none is built in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

#: What a parser hands over: a row for each text block or table; rows is null for text.
LAYOUT = "doc_id string, page int, page_height double, x0 double, y0 double, x1 double, y1 double, text string, rows array<array<string>>"
PAGE = "doc_id string, page int, text string, tables int, tables_dropped int, drop_reasons array<string>, chars int, strategy string"


def inside(box: tuple[float, ...], x: float, y: float) -> bool:
    return box[0] <= x <= box[2] and box[1] <= y <= box[3]


def page_text(items: list[dict], header: list[str] | None) -> tuple[str, int, list[str], list[str] | None]:
    """(text, tables, reasons of dropped tables, header for the next page) of one page's blocks, from top to bottom.

    Text whose centre lies in a table's box is that table's. A table at the top may go on with the page before.
    """
    kept, reasons, boxes = [], [], []
    for item in sorted((x for x in items if x["rows"] is not None), key=lambda x: (x["y0"] or 0, x["x0"] or 0)):
        if why := tables.defect(item["rows"]):
            reasons.append(why)
            continue
        width = max(map(len, tables.clean(item["rows"])))
        flat, carried = tables.flatten(item["rows"], header if tables.may_inherit(header, width, 0, item["y0"], item["page_height"]) else None)
        header = carried or header
        boxes.append(tuple(item[k] or 0.0 for k in ("x0", "y0", "x1", "y1")))
        if flat:
            kept.append((item["y0"] or 0.0, item["x0"] or 0.0, flat))
    n = len(kept)
    for item in items:
        if item["rows"] is None and (text := tables.unwrap(item["text"]).strip()):
            x, y = ((item[a] or 0.0) + (item[b] or 0.0) for a, b in (("x0", "x1"), ("y0", "y1")))
            if not any(inside(b, x / 2, y / 2) for b in boxes):
                kept.append((item["y0"] or 0.0, item["x0"] or 0.0, text))
    return "\n".join(t for _, _, t in sorted(kept)), n, reasons, header


def from_layout(layout: DataFrame) -> DataFrame:
    """Page rows of a layout table; headers are carried over a document's pages in order, one document at a time.

    A page that cannot be read gets an empty row with strategy `err`, and the document goes on.
    """

    def fold(key, frame):
        import pandas as pd

        rows, header = [], None
        for page, items in sorted(frame.groupby("page"), key=lambda x: x[0]):
            try:
                text, n, reasons, header = page_text([{k: (None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v) for k, v in r.items()} for r in items.to_dict("records")], header)
                rows.append((key[0], int(page), text, n, len(reasons), reasons[:6], len(text), "layout"))
            except Exception as e:  # a bad page must not end the document
                rows.append((key[0], int(page), "", 0, 0, [type(e).__name__], 0, "err"))
        return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in PAGE.split(",")])

    return layout.groupBy("doc_id").applyInPandas(fold, PAGE)


def trailer(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, tables, tables_dropped): what a complete document's pages add up to."""
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("pages"), F.sum("chars").alias("chars"), F.sum("tables").alias("tables"), F.sum("tables_dropped").alias("tables_dropped"))

