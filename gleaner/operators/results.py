"""Results of a search: displayed rows, files, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, file_name, location, without_breaks
from ..schema import LABELS
from ..spec import EXCEL, SearchSpec


def displayed(entries: DataFrame, spec: SearchSpec, labels: dict[str, str] = LABELS) -> DataFrame:
    """Matched entries with file name and location; line breaks go from spreadsheet contents if so wanted, after the match."""
    content = F.col("content")
    if spec.remove_line_breaks:
        content = F.when(extension("file_path").isin(*EXCEL), without_breaks("content")).otherwise(content)
    return entries.withColumn("content", content).withColumns({"file_name": file_name("file_path"), "location": location(labels=labels)})


def matched_files(entries: DataFrame) -> DataFrame:
    """One row for each file, whatever the case of its path: the spelling seen first, and where that was."""
    order = F.struct("file_ord", "entry_ord")
    found = entries.groupBy(F.lower("file_path").alias("__key")).agg(F.min_by("file_path", order).alias("file_path"), F.min("file_ord").alias("file_ord"), F.count(F.lit(1)).alias("hits"))
    return found.drop("__key")


def counts(entries: DataFrame) -> DataFrame:
    """Results and files with results."""
    return entries.agg(F.count(F.lit(1)).alias("results"), F.count_distinct(F.lower("file_path")).alias("files"))
