"""Filters: keywords against contents, within entries and within rows of spreadsheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import required
from ..functions.regex import regex_match
from ..functions.text import extension
from ..sources.readers import unpacked
from ..spec import EXCEL, SearchSpec


#: What names a row of a spreadsheet.
ROW = ["file_path", "sheet_name", "line_number"]


def plain_match(content: Column, keyword: str, case_sensitive: bool) -> Column:
    return F.contains(content, F.lit(keyword)) if case_sensitive else F.contains(F.lower(content), F.lower(F.lit(keyword)))


def keyword_match(spark: SparkSession, content: Column, keyword: str, spec: SearchSpec, timeout_s: float | None = None) -> Column:
    if spec.regex:
        return regex_match(spark, content, keyword, spec.case_sensitive, timeout_s)
    return plain_match(content, keyword, spec.case_sensitive)


def each_match(spark: SparkSession, content: Column, spec: SearchSpec, timeout_s: float | None = None) -> list[Column]:
    return [keyword_match(spark, content, k, spec, timeout_s) for k in spec.active()]


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def some(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def entry_match(spark: SparkSession, content: Column, spec: SearchSpec, timeout_s: float | None = None) -> Column:
    """All keywords in one entry, or any."""
    return (every if spec.match_all else some)(each_match(spark, content, spec, timeout_s))


def literals(spec: SearchSpec) -> list[list[tuple[str, ...]]]:
    """Of each keyword the literals that any match of it holds, one of each tuple. A keyword without them is certain of nothing."""
    if spec.regex:
        return [required(k, spec.case_sensitive) for k in spec.active()]
    return [[] if "\n" in k or "\r" in k else [(k,)] for k in spec.active()]


def prefilter(text: Column, spec: SearchSpec) -> Column | None:
    """What a whole text must hold for any of its lines or rows to match: None where nothing is certain.

    Catalyst does not push a filter on lines below the split that makes them. A keyword without a line break, or a literal that
    a pattern cannot do without, which an entry holds, is also held by the text around it, so the same condition can be put on the text first.
    """
    found = literals(spec)
    if spec.match_all:
        found = [x for x in found if x]
    if not found or not all(found):
        return None
    held = lambda clause: some([plain_match(text, x, spec.case_sensitive) for x in clause])
    return (every if spec.match_all else some)([every([held(c) for c in x]) for x in found])


def needed(spec: SearchSpec) -> tuple[tuple[tuple[str, ...], ...], ...]:
    """The same for readers to test on the whole text of a file; none where nothing is certain.

    Of keywords beyond ASCII the lower case can depend on the characters around.
    """
    found = [[c for c in x if spec.case_sensitive or "".join(c).isascii()] for x in literals(spec)]
    if spec.match_all:
        found = [x for x in found if x]
    if not all(found):
        return ()
    return tuple(tuple(tuple(k if spec.case_sensitive else k.lower() for k in c) for c in x) for x in found)


def packed_match(spark: SparkSession, rows: DataFrame, spec: SearchSpec, timeout_s: float | None = None) -> DataFrame:
    """Entries that match, of rows as readers give them: the cells of a row of a spreadsheet are together, in `cells`.

    With all keywords wanted, a row of cells that satisfies all is kept, and of it the cells that hold at least one; any other entry must
    hold all. No row leaves its task: there is no shuffle and no window.
    """
    rows = rows.where("error IS NULL")
    if not spec.match_all:
        own = F.col("cells").isNotNull() | some(each_match(spark, F.col("content"), spec, timeout_s))
        return unpacked(rows.where(own)).where(some(each_match(spark, F.col("content"), spec, timeout_s)))
    text = F.coalesce(F.array_join(F.transform("cells", lambda c: c["content"]), "\n"), F.col("content"))
    # once as a column: patterns of the engine with a limit are tested in Python
    rows = rows.withColumn("__text", text).where(every(each_match(spark, F.col("__text"), spec, timeout_s)))
    return unpacked(rows.drop("__text")).where(some(each_match(spark, F.col("content"), spec, timeout_s)))


def is_cell() -> Column:
    """Entries that are cells of spreadsheets: with a row, an address and no object."""
    filled = F.coalesce(F.col("cell_address"), F.lit("")) != ""
    return extension("file_path").isin(*EXCEL) & (F.col("line_number") > 0) & filled & (F.coalesce(F.col("object_name"), F.lit("")) == "")


def sheet_match(spark: SparkSession, entries: DataFrame, spec: SearchSpec, keys: list[str] | None = None, timeout_s: float | None = None) -> DataFrame:
    """Cells that match, where all keywords must be found in the cell's row.

    A row is the cells of one (file, sheet, line), joined by line feeds in their order. Of a row that satisfies all
    keywords the cells that hold at least one are kept. For plain keywords without line feeds the row need not be built: a
    row holds a keyword if one of its cells does, so boolean windows do, and only cells that hold a keyword are brought
    together. Else all cells are, by the keys.
    """
    own = each_match(spark, F.col("content"), spec, timeout_s)
    if not spec.match_all:
        return entries.where(some(own))
    names = [f"__k{i}" for i in range(len(own))]
    row = Window.partitionBy(*(keys or ROW))
    any_of, all_of = some([F.col(n) for n in names]), every([F.bool_or(n).over(row) for n in names])
    marked = entries.withColumns(dict(zip(names, own, strict=True)))
    if not spec.regex and not any("\n" in k for k in spec.active()):
        marked = marked.where(any_of)  # cells that hold none cannot make a row match
        return marked.withColumn("__whole", all_of).where("__whole").select(*entries.columns)
    ordered = row.orderBy("entry_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = marked.withColumn("__row", F.array_join(F.collect_list("content").over(ordered), "\n")).where(any_of)
    return marked.where(every(each_match(spark, F.col("__row"), spec, timeout_s))).select(*entries.columns)


def row_match(spark: SparkSession, entries: DataFrame, spec: SearchSpec, keys: list[str] | None = None, timeout_s: float | None = None) -> DataFrame:
    """Entries that match: cells by their rows, all others by themselves.

    Only cells are shuffled. Both kinds are taken from `entries`, which is read for each. For what readers give, packed_match does
    the same in one pass.
    """
    own = entry_match(spark, F.col("content"), spec, timeout_s)
    if not spec.match_all:
        return entries.where(own)
    return entries.where(~is_cell()).where(own).unionAll(sheet_match(spark, entries.where(is_cell()), spec, keys, timeout_s))
