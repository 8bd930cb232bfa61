"""Entries from tables: lines of a text column, cells of a wide table, distinct values of a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_values, not_blank, numbered, split_lines


def lines(rows: DataFrame, text: str, keep: list[str], where: Column | None = None) -> DataFrame:
    """A row for each line that is not blank; blank lines count for line_number. `where` filters rows before the split."""
    if where is not None:
        rows = rows.where(where)
    split = rows.select(*keep, F.posexplode(split_lines(text)).alias("__pos", "content"))
    return split.where(not_blank("content")).select(*keep, (F.col("__pos") + 1).cast("int").alias("line_number"), "content")


def cells(rows: DataFrame, row_key: str, columns: list[str]) -> DataFrame:
    """A row for each cell that is not blank: (row_key, column name, content)."""
    long = rows.select(row_key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(row_key, columns, "column_name", "content")
    return long.where(not_blank("content"))


def numbered_values(rows: DataFrame, keep: list[str], values: Column, label: str) -> DataFrame:
    """A row for each distinct value of an array, numbered from 1 within its row."""
    return rows.select(*keep, F.explode(numbered(distinct_values(values), label)).alias("__v")).select(*keep, F.col("__v.value").alias("content"), F.col("__v.object_name").alias("object_name"))
