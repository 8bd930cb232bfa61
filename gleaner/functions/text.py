"""Column functions on text. All are built-in expressions, so they stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LABELS

NEWLINES = "\r\n|\r|\n"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_blank(c: Column | str) -> Column:
    """Holds a character that is not Unicode white space."""
    return col(c).rlike(r"(?U)\S")


def trim(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def split_lines(c: Column | str) -> Column:
    """Lines ended by CR LF, CR or LF."""
    return F.split(col(c), NEWLINES, -1)


def without_breaks(c: Column | str) -> Column:
    """Each line break as a blank."""
    return F.regexp_replace(col(c), NEWLINES, " ")


def tsv_clean(c: Column | str) -> Column:
    """Line breaks and tabs as blanks."""
    return F.regexp_replace(col(c), NEWLINES + "|\t", " ")


def escape_line(c: Column | str) -> Column:
    """Backslash, CR, LF and tab as two-character codes."""
    out = F.replace(col(c), F.lit("\\"), F.lit("\\\\"))
    for raw, code in (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape_line(c: Column | str) -> Column:
    """Inverse of escape_line, from left to right; other codes and a final backslash stay.

    Text is split at doubled backslashes, which keeps codes apart from literal backslashes, and put together again.
    """
    out = F.split(col(c), r"\\\\", -1)

    def codes(x: Column) -> Column:
        for raw, code in (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
            x = F.replace(x, F.lit(code), F.lit(raw))
        return x

    return F.array_join(F.transform(out, codes), "\\")


def index_line() -> Column:
    """An entry as one line of six fields divided by tabs; only the content is escaped."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws("\t", "file_path", F.col("line_number").cast("string"), text("sheet_name"), text("cell_address"), text("object_name"), escape_line("content"))


def parse_index_line(c: Column | str) -> Column:
    """The entry of a line: null if it has less than six fields; a number that is none is 0, an empty field null."""
    return indexed(F.split(col(c), "\t", -1))


def indexed(fields: Column | str) -> Column:
    """The same of a line's fields; for many lines they should be a column of their own, as they are named often."""
    part = col(fields)
    field = lambda k: F.nullif(F.get(part, F.lit(k)), F.lit(""))
    number = F.coalesce(F.get(part, F.lit(1)).try_cast("int"), F.lit(0))
    content = F.get(part, F.lit(5))
    content = F.when(F.contains(content, F.lit("\\")), unescape_line(content)).otherwise(content)
    entry = F.struct(F.get(part, F.lit(0)).alias("file_path"), number.alias("line_number"), field(2).alias("sheet_name"), field(3).alias("cell_address"), field(4).alias("object_name"), content.alias("content"))
    return F.when(F.size(part) >= 6, entry)


def file_name(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"[^/\\]+$", 0)


def extension(c: Column | str) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(col(c), r"(\.[^./\\]+)$", 1))


def distinct_values(values: Column) -> Column:
    """Trimmed values that are not blank, each once, in order of first occurrence."""
    return F.array_distinct(F.transform(F.filter(values, not_blank), trim))


def numbered(values: Column, label: str) -> Column:
    """Array of (value, label with its number from 1)."""
    return F.transform(values, lambda v, i: F.struct((i + 1).alias("n"), v.alias("value"), F.concat(F.lit(label), (i + 1).cast("string")).alias("object_name")))


def header_footer(c: Column | str) -> Column:
    """Header or footer of a sheet without its codes."""
    return trim(F.regexp_replace(col(c), "(?i)&[LCRPNDTFA]", " "))


def location(sheet: Column | str = "sheet_name", cell: Column | str = "cell_address", obj: Column | str = "object_name", line: Column | str = "line_number", labels: dict[str, str] = LABELS) -> Column:
    """Where an entry stands, for display; null and empty are the same."""
    s, c, o = (F.nullif(col(x), F.lit("")) for x in (sheet, cell, obj))
    n = col(line).cast("string")
    sheet_part = F.concat(F.lit("["), s, F.lit("] "))
    row = F.lit(" " + labels["row"])
    return (
        F.when(s.isNotNull() & c.isNotNull() & o.isNotNull(), F.concat(sheet_part, c, F.lit(" "), o))
        .when(s.isNotNull() & c.isNotNull(), F.concat(sheet_part, c))
        .when(s.isNotNull() & o.isNotNull(), F.concat(sheet_part, o))
        .when(s.isNotNull(), F.concat(sheet_part, n, row))
        .when(o.isNotNull(), F.concat(F.lit(f"[{labels['object']}] "), o))
        .otherwise(F.concat(n, row))
    )
