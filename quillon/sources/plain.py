"""Plain text and XML to blocks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that are one section, their substitutes, where a section of over LARGE characters is cut.
SECTIONS = {"SECTION", "DIV8", "DIV9"}
PARAGRAPHS = {"P", "FP", "FP-1", "FP-2", "HED", "NOTE", "SUBJECT"}
CUT, HEADING, CATEGORY, LARGE = "FP-2", "HD1", re.compile(r"Category\s|[A-F]\."), 50_000


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block, text): paragraphs between blank lines with collapsed white space, of two characters or more, from 1 on.

    Of a text that HTML wraps, the inside of its `<pre>`.
    """
    head = F.lower(F.substring(text, 1, 2000))
    wrapped = F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<pre"))
    inner = F.regexp_extract(text, r"(?is)<pre[^>]*>(.*?)</pre>", 1)
    bare = F.regexp_replace(F.when(inner != "", inner).otherwise(F.col(text)), r"(?s)<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    body = F.when(wrapped, bare).otherwise(F.col(text))
    cut = F.transform(F.split(F.coalesce(body, F.lit("")), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    rows = docs.select(key, F.posexplode(F.filter(cut, lambda p: F.length(p) >= 2)).alias("block", "text"))
    return rows.select(key, (F.col("block") + 1).alias("block"), "text")


def _name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("​", "")).strip()


def segments(section: ET.Element) -> list[str]:
    """A section's text, cut where an entry begins; each character once."""
    parts: list[list[str]] = [[]]

    def walk(node: ET.Element) -> None:
        for child in node:
            name = _name(child)
            if name == CUT or name == HEADING and CATEGORY.match(_plain(child.text or "")):
                parts.append([])
            parts[-1].append(child.text or "")
            walk(child)
            parts[-1].append(child.tail or "")

    parts[0].append(section.text or "")
    walk(section)
    return [t for t in (_plain(" ".join(p)) for p in parts) if len(t) >= 2]


def outermost(root: ET.Element, names: set[str]) -> list[ET.Element]:
    """Elements of these names that no other such element contains."""
    found: list[ET.Element] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if _name(node) in names:
            found.append(node)
        else:
            stack.extend(reversed(list(node)))
    return found


def xml_blocks(xml: str | None) -> list[str]:
    """One block of each outermost section, large ones cut; without sections, of each paragraph; of bad XML, none."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    out: list[str] = []
    for section in outermost(root, SECTIONS):
        whole = _plain(" ".join(section.itertext()))
        out += segments(section) if len(whole) > LARGE else [whole]
    if not any(out):
        out = [_plain("".join(p.itertext())) for p in outermost(root, PARAGRAPHS)]
    return [t for t in out if len(t) >= 2]


def sections(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(key, block, text) of XML documents; a document that is no XML, or has neither sections nor paragraphs, is read as text."""

    def run(batches):
        for batch in batches:
            rows = [(k, i, t) for k, x in zip(batch.column(key).to_pylist(), batch.column(xml).to_pylist()) for i, t in enumerate(xml_blocks(x), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))], names=[key, "block", "text"])

    found = docs.select(F.col(key).cast("long"), xml).mapInArrow(run, f"{key} long, block int, text string")
    rest = docs.select(F.col(key).cast("long"), F.col(xml).alias("text")).join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(paragraphs(rest, key))
