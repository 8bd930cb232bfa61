"""Exports: the list of files, and the results as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tsv_clean
from ..operators.results import matched_files
from ..spec import SearchSpec

COLUMNS = ("File Path", "File Name", "Location", "Content")


def conditions(spec: SearchSpec) -> list[str]:
    """The conditions of a search as lines."""
    yes = lambda x: "Yes" if x else "No"
    types = "All files" if spec.include_all else " ".join(spec.included())
    out = ["[Search Conditions]", f"Target Folder\t{spec.target}"]
    out += [f"Keyword{n}\t{k}" for n, k in enumerate(spec.active(), 1)]
    out += [f"Condition\t{'AND' if spec.match_all else 'OR'}", f"Case Sensitive\t{yes(spec.case_sensitive)}", f"Regular Expression\t{yes(spec.regex)}", f"File Types\t{types}"]
    if spec.exclude_enabled:
        out.append(f"Excluded Extensions\t{' '.join(spec.excluded())}")
    if spec.exclude_folders_enabled:
        out.append(f"Excluded Folders\t{spec.exclude_folders}")
    out += [f"Excel Target\t{'Formula' if spec.formulas else 'Value'}", f"Remove Line Breaks\t{yes(spec.remove_line_breaks)}", ""]
    return out


def file_lines(found: DataFrame) -> DataFrame:
    """(file_ord, value): the matched files, one a line."""
    return matched_files(found).select("file_ord", F.col("file_path").alias("value"))


def result_lines(displayed: DataFrame) -> DataFrame:
    """(file_ord, entry_ord, value): results as lines; location and content are cleaned of breaks and tabs."""
    value = F.concat_ws("\t", "file_path", "file_name", tsv_clean("location"), tsv_clean("content"))
    return displayed.select("file_ord", "entry_ord", value.alias("value"))


def _write(lines: DataFrame, order: list[str], header: list[str], path: str, single: bool) -> None:
    head = lines.sparkSession.createDataFrame([(-1, n, x) for n, x in enumerate(header)], "a long, b int, value string")
    body = lines.select(F.col("file_ord").alias("a"), (F.col("entry_ord") if "entry_ord" in order else F.lit(0)).alias("b"), "value")
    rows = head.unionAll(body).orderBy("a", "b").select("value")
    (rows.coalesce(1) if single else rows).write.mode("overwrite").text(path)


def export_files(displayed: DataFrame, path: str, spec: SearchSpec, single: bool = False) -> None:
    """Write the list of files, in their order, as text; the parts of the folder in the order of their names are the whole."""
    _write(file_lines(displayed), ["file_ord"], conditions(spec) if spec.export_conditions else [], path, single)


def export_results(displayed: DataFrame, path: str, spec: SearchSpec, single: bool = False) -> None:
    header = (conditions(spec) if spec.export_conditions else []) + ["\t".join(COLUMNS)]
    _write(result_lines(displayed), ["file_ord", "entry_ord"], header, path, single)
