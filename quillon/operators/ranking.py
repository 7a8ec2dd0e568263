"""The first rows of each group, in a form whose window Spark limits before it sorts (WindowGroupLimit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(rows: DataFrame, by: list[str], order: list[Column | str], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, with their place, 0 and up. The filter is on the window's own column."""
    numbered = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.where(F.col(name) <= n).withColumn(name, F.col(name) - 1)
