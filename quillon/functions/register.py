"""The engine's functions in SQL: scalar functions as temporary SQL functions, chunking as a table function."""

from __future__ import annotations

import re

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Name, argument names, result type, expression of columns with these names.
SCALARS = (
    ("tokenize", ("text",), "array<string>", T.tokens),
    ("detect_section", ("line",), "struct<level:int,title:string>", T.section),
    ("derive_caliber", ("text",), "struct<period:string,amount_unit:string,table_title:string>", T.caliber),
    ("row_label", ("line",), "string", T.row_label),
    ("label_hits", ("text", "anchor"), "int", T.label_hits),
    ("value_numbers", ("text",), "array<string>", T.value_numbers),
    ("report_kind", ("title",), "string", T.report_kind),
    ("version_tag", ("name",), "string", T.version_tag),
)


def callable_operators(sql: str) -> str:
    """Operators that a column prints as calls, like `=(a, b)`, as quoted function names; string literals are left alone."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", sql)
    return "".join(p if k % 2 else re.sub(r"(?<![\w`])(<=>|<=|>=|!=|=|<|>|!|\+|-|\*|/|%|or|and|not)\(", r"`\1`(", p) for k, p in enumerate(parts))


def chunk_table():
    """The table function chunk_text(text, limit, overlap): (seq, n_units, chars, text)."""
    from ..operators.chunking import LIMIT, OVERLAP, Unit, pack
    cut = re.compile(T.SENTENCE_END)

    class Chunks:
        def eval(self, text: str, limit: int = LIMIT, overlap: int = OVERLAP):
            lines = (re.sub(r"\s+", " ", x).strip() for x in (text or "").split("\n"))
            units = [Unit(u.strip(), 1, "", "") for x in lines if x and not re.fullmatch(T.PAGE_FOOTER, x) for u in ([x] if T.ROW_SEPARATOR in x else cut.split(x)) if u.strip()]
            for seq, group in enumerate(pack(units, limit, overlap)):
                whole = "\n".join(u.text for u in group)
                yield Row(seq=seq, n_units=len(group), chars=len(whole), text=whole)

    return F.udtf(Chunks, returnType="seq int, n_units int, chars int, text string")


def register(spark: SparkSession) -> None:
    """Registers all of them; the scalars are SQL expressions that Catalyst inlines, not Python."""
    for name, args, result, f in SCALARS:
        body = callable_operators(f(*map(F.col, args))._jc.node().sql())
        spark.sql(f"create or replace temporary function {name}({', '.join(f'{a} string' for a in args)}) returns {result} return {body}")
    spark.udtf.register("chunk_text", chunk_table())
