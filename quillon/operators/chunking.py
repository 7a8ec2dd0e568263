"""From pages to chunks: units with their section, greedy packing with overlap, numbering, table titles."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters of a chunk, of its overlap, of the shortest chunk; pages a table title is carried over.
LIMIT, OVERLAP, TINY, CARRY = 800, 120, 40, 3
#: Sources whose extractor makes one block of each section.
SECTION_BLOCKS = ("fedreg", "govinfo", "ecfr")


class Unit(NamedTuple):
    text: str
    page: int
    label: str
    major: str


def lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, level, title) of pages(doc_id, page, text): the lines, and the headings among them."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    return rows.withColumn("h", T.section(F.col("text"))).select("doc_id", "page", "line", "text", F.col("h.level").alias("level"), F.col("h.title").alias("title"))


def carry_sections(rows: DataFrame, per_page: bool = False) -> DataFrame:
    """Adds `section` and `major`: the last heading, and the last one that cuts, up to each line; per_page begins anew on each page."""
    by = ["doc_id", "page"] if per_page else ["doc_id"]
    before = Window.partitionBy(*by).orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.coalesce(F.last(F.when(c, F.col("title")), True).over(before), F.lit(""))
    return rows.withColumns({"section": carried(F.col("level") > 0), "major": carried(F.col("level") == 1)})


def pack(units: list[Unit], limit: int = LIMIT, overlap: int = OVERLAP, tails: bool = False) -> list[list[Unit]]:
    """Groups of units up to `limit` characters that end where the major section changes.

    The next group begins again with the last whole units of at least `overlap` characters, and at least one unit on.
    tails keeps groups that repeat nothing but the end of the group before, which appear at section breaks.
    """
    out, begin = [], 0
    shown = 0  # units that are in a group already
    while begin < len(units):
        end, used = begin, 0
        while end < len(units):
            more = len(units[end].text) + 1
            if end > begin and (used + more > limit or units[end].major != units[begin].major):
                break
            used, end = used + more, end + 1
        if tails or end > shown:
            out.append(units[begin:end])
        shown = max(shown, end)
        if end == len(units):
            break
        back, kept = end, 0
        while back > begin + 1 and kept < overlap:
            back -= 1
            kept += len(units[back].text) + 1
        begin = back if overlap and kept >= overlap else max(begin + 1, back) if overlap else end
    return out


def chunk(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tiny: int = TINY, tails: bool = False) -> DataFrame:
    """(doc_id, chunk_id, seq, page_start, page_end, section, chars, n_units, text, period, amount_unit, table_title).

    pages(doc_id, source, page, text) are gathered by document, one document at a time; chunks under `tiny` characters
    go before they are numbered. A document's own sections go on over its pages, unless its source has a block for each.
    """
    marked = pages.select("doc_id", "source", F.col("page").cast("int"), F.transform(T.units(F.col("text")), lambda u: F.struct(u.alias("text"), T.section(u).alias("h"))).alias("units"))
    docs = marked.groupBy("doc_id").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("page", "units"))).alias("pages"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, source, found in zip(batch.column("doc_id").to_pylist(), batch.column("source").to_pylist(), batch.column("pages").to_pylist()):
                units, label, major = [], "", ""
                for page in found:
                    if source in SECTION_BLOCKS:
                        label = major = ""
                    for u in page["units"]:
                        if u["h"]["level"]:
                            label = u["h"]["title"]
                        if u["h"]["level"] == 1:
                            major = label
                        units.append(Unit(u["text"], page["page"], label, major))
                seq = 0
                for group in pack(units, limit, overlap, tails):
                    text = "\n".join(u.text for u in group)
                    if len(text) >= tiny:
                        rows.append((doc_id, f"{doc_id}::{seq:05d}", seq, group[0].page, group[-1].page, group[0].label, len(text), len(group), text))
                        seq += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["doc_id", "chunk_id", "seq", "page_start", "page_end", "section", "chars", "n_units", "text"]
    id_type = marked.schema["doc_id"].dataType
    types = [pa.string() if id_type.simpleString() == "string" else pa.int64(), pa.string(), *[pa.int32()] * 3, pa.string(), pa.int32(), pa.int32(), pa.string()]
    schema = f"doc_id {id_type.simpleString() if id_type.simpleString() == 'string' else 'long'}, chunk_id string, seq int, page_start int, page_end int, section string, chars int, n_units int, text string"
    chunks = docs.mapInArrow(run, schema)
    return carry_titles(chunks.withColumn("c", T.caliber(F.col("text"))).select("*", "c.*").drop("c"))


def carry_titles(chunks: DataFrame, pages: int = CARRY) -> DataFrame:
    """Fills a blank table_title with the last one of the document, up to `pages` pages after the page that has it."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("table_title") != "", F.struct("table_title", "page_end"))
    last = F.last(own, True).over(before)
    near = F.col("page_start") - last["page_end"] <= pages
    return chunks.withColumn("table_title", F.when(F.col("table_title") != "", F.col("table_title")).otherwise(F.coalesce(F.when(near, last["table_title"]), F.lit(""))))


def number_chunks(rows: DataFrame, doc: str, order: list[str], text: str = "text", tiny: int = TINY) -> DataFrame:
    """Drops rows under `tiny` characters and numbers the rest of each document: seq and chunk_id."""
    kept = rows.where(F.length(text) >= tiny)
    seq = (F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1).alias("seq")
    return kept.select("*", seq).withColumn("chunk_id", F.format_string("%s::%05d", F.col(doc).cast("string"), F.col("seq")))
