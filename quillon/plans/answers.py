"""Around the search: rewritten questions, answers by a pluggable function, settings, report text."""

from __future__ import annotations

import html
import os
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..operators.fusion import REWRITE

#: Rewrites of a question, and the length from which one is no rewrite; tokens and texts of a batch.
REWRITES, TOO_LONG, BATCH_TOKENS, BATCH_TEXTS = 3, 400, 16_384, 128


def expand(questions: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(query_id, pos, weight, text): each question at weight 1, and up to three of its rewrites(query_id, pos, text).

    List marks are cut; empty lines, the question itself and very long lines are no rewrites. A question without
    rewrites is asked alone.
    """
    lines = rewrites.select("query_id", "pos", T.rewrite_line(F.col("text")).alias("text")).join(questions.select("query_id", F.col("text").alias("q")), "query_id")
    lines = lines.where((F.col("text") != "") & (F.col("text") != F.col("q")) & (F.length("text") < TOO_LONG))
    lines = lines.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("pos") <= REWRITES)
    own = questions.select("query_id", F.lit(0).alias("pos"), F.lit(1.0).alias("weight"), "text")
    return own.unionByName(lines.select("query_id", "pos", F.lit(REWRITE).alias("weight"), "text"))


def uncached(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions that cache(text, rewrites) does not have; their rewrites are appended to it as a new file."""
    return questions.join(cache.select("text").distinct(), "text", "left_anti")


def batches(texts: Iterable[str], tokens: int = BATCH_TOKENS, most: int = BATCH_TEXTS) -> Iterator[list[str]]:
    """Texts in batches within a budget of estimated tokens (half the characters); an oversized text goes alone."""
    held: list[str] = []
    longest = 0
    for t in texts:
        size = max(1, len(t) // 2)
        if held and (len(held) == most or max(longest, size) * (len(held) + 1) > tokens):
            yield held
            held, longest = [], 0
        held.append(t)
        longest = max(longest, size)
    if held:
        yield held


def extract(question: str, passages: list[str]) -> str:
    """The answer when no model is given: the first sentence of the first passage, with its seat."""
    for seat, text in enumerate(passages, 1):
        if first := re.split(r"(?<=[。！？；.!?])\s|\n", text.strip(), maxsplit=1)[0]:
            return f"{first} [{seat}]"
    return T.UNCOVERED


def answer(questions: DataFrame, hits: DataFrame, model: Callable[[str, list[str]], str] = extract, query: str = "query_id") -> DataFrame:
    """(query, q, ans): the model's answer from a question's seated passages; an answer without text is an error."""
    seats = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("seat", "text"))).alias("p")).select(query, F.col("p.text").alias("passages"))
    rows = questions.select(query, F.col("text").alias("q")).join(seats, query, "left")

    def ask(batches):
        for frame in batches:
            said = [model(q, list(p) if p is not None else []) for q, p in zip(frame["q"], frame["passages"])]
            for q, text in zip(frame["q"], said):
                if not text:
                    raise ValueError(f"no answer to {q!r}")
            yield frame[[query, "q"]].assign(ans=said)

    rows = rows.select(query, "q", "passages")
    return rows.mapInPandas(ask, StructType([rows.schema[query], rows.schema["q"], StructField("ans", StringType())]))


def settings(allowed: Iterable[str], path: str | None = None) -> dict[str, str]:
    """Allowed keys of a KEY=value file, where the process's own environment wins."""
    found: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, sep, value = line.strip().partition("=")
                if sep and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
    return {k: os.environ.get(k, found.get(k, "")) for k in allowed if k in os.environ or k in found}


def seats_asked(value: str | None, default: int = 8, most: int = 50) -> int:
    """k of a request: the default where it is no number, and between 1 and `most`."""
    try:
        return max(1, min(most, int(value or default)))
    except ValueError:
        return default


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small report; nulls are dashes."""
    found = rows.limit(most).collect()
    cell = lambda v: "—" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *[[cell(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def page(question: str, hits: list[dict], said: str) -> str:
    """A result page: the answer with links to its seats, and the passages with their citations."""
    text = re.sub(r"\[(\d{1,3})\]", r'<a href="#h\1">[\1]</a>', html.escape(said, quote=False)).replace(T.UNCOVERED, f'<span class="no">{T.UNCOVERED}</span>')
    seats = "".join(f'<li id="h{k}"><cite>{html.escape(h["cite"])}</cite> <p>{html.escape(h["text"])}</p></li>' for k, h in enumerate(hits, 1))
    return f"<h1>{html.escape(question)}</h1><div>{text}</div><ol>{seats}</ol>"


def seats_by_company(pages: DataFrame, key: str, text: str = "html") -> DataFrame:
    """(key, company, n): how many of a result page's seats cite each company."""
    cites = pages.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"<cite>([^|<]*)\|"), F.lit(1))).alias("company"))
    return cites.groupBy(key, "company").agg(F.count(F.lit(1)).alias("n"))


def markdown_section(text: str, heading: str, stop: str = r"^#+ ") -> str:
    """A Markdown text from the first heading that matches up to the next one."""
    lines = text.split("\n")
    begin = next((k for k, x in enumerate(lines) if re.search(heading, x) and re.match(r"#+ ", x)), None)
    if begin is None:
        return ""
    end = next((k for k in range(begin + 1, len(lines)) if re.match(stop, lines[k])), len(lines))
    return "\n".join(lines[begin:end]).strip()


def lines_with(chunks: DataFrame, doc: str, at: int, label: str, most: int = 4, wide: int = 150) -> DataFrame:
    """The first distinct lines of a document's page that begin with a label, in order, cut to `wide` characters."""
    own = chunks.where((F.col("doc_id") == doc) & F.lit(at).between(F.col("page_start"), F.coalesce("page_end", "page_start")))
    rows = own.select("seq", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.startswith("text", F.lit(label)))
    firsts = rows.groupBy(F.substring("text", 1, wide).alias("text")).agg(F.min(F.struct("seq", "line")).alias("place"))
    return firsts.orderBy("place").limit(most).select("text")
