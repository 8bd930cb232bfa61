"""Which reader reads which file, and entries from many files at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ENTRY
from ..spec import EXCEL
from .formats import doc, docx, pdf, ppt, pptx, text, xls, xlsx
from .formats.base import Options, Piece, blank
from .listing import content
from .monitor import Monitor
from .ranges import Range, cut, opened

Reader = Callable[[bytes, Options], Iterator[Piece]]
READERS: dict[str, Reader] = {e: m.read for m in (text, xlsx, xls, docx, doc, pptx, ppt, pdf) for e in m.EXTENSIONS}
#: A cell within a row of a spreadsheet.
CELL = T.StructType([T.StructField("entry_ord", T.IntegerType(), False), T.StructField("cell_address", T.StringType()), T.StructField("content", T.StringType(), False)])
#: Entries, but the cells of a row of a spreadsheet together, in `cells`, so that a row is matched where it was read; and a
#: row with entry_ord -1 and the reason for each file whose reader failed.
EXTRACTED = T.StructType([*ENTRY.fields, T.StructField("cells", T.ArrayType(CELL, False)), T.StructField("error", T.StringType())])
BATCH_ROWS, BATCH_CELLS = 5000, 20_000


def register(extension: str, reader: Reader) -> None:
    """Add or replace the reader of an extension. Plans made from then on take it along to the executors."""
    READERS[extension.lower()] = reader


def reader_of(extension: str) -> Reader:
    """Files of unknown extensions are read as text."""
    return READERS.get(extension.lower(), text.read)


def read_pieces(raw: bytes, extension: str, options: Options, known: dict[str, Reader] | None = None) -> Iterator[Piece | Exception]:
    """Entries of a file; after a failure what came before it, and the failure."""
    try:
        yield from (known or READERS).get(extension.lower(), text.read)(raw, options)
    except Exception as e:  # noqa: BLE001  whatever a damaged file does to a reader concerns this file alone
        yield e


_CELLS = pa.list_(pa.struct([("entry_ord", pa.int32()), ("cell_address", pa.string()), ("content", pa.string())]))
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), _CELLS, pa.string()]


class _Rows:
    """Rows of EXTRACTED; what is ready leaves in batches, so a large file need not fit as entries."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.size += 1

    def full(self) -> bool:
        return len(self.rows) >= BATCH_ROWS or self.size >= BATCH_CELLS

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_KINDS)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], EXTRACTED.names)

    def failed(self, path: str, order: int, e: Exception, kind: bool = True) -> None:
        self.add(path, order, -1, 0, None, None, None, "", None, f"{type(e).__name__}: {e}" if kind else str(e))


def _pieces(rows: _Rows, path: str, order: int, sheets: bool, pieces: Iterator[Piece | Exception]) -> Iterator[pa.RecordBatch]:
    """Adds the entries of a file to the rows, and gives batches as they fill."""
    at, cells = None, []

    def flush() -> None:
        if cells:
            rows.add(path, order, cells[0][0], at[1], at[0], None, None, "", list(cells), None)
            rows.size += len(cells)
            cells.clear()

    for n, p in enumerate(pieces):
        if isinstance(p, Exception):
            rows.failed(path, order, p)
        elif sheets and p.line > 0 and p.cell and not p.obj:
            if at != (p.sheet, p.line):
                flush()
                at = p.sheet, p.line
            cells.append((n, p.cell, p.content))
        else:
            rows.add(path, order, n, p.line, p.sheet, p.cell, p.obj, p.content, None, None)
        if rows.full():
            yield rows.batch()
    flush()


def _lines(rows: _Rows, path: str, order: int, part: Range, before: int, options: Options) -> Iterator[pa.RecordBatch]:
    """Lines of a range of a large text. They are numbered by their lines, which keeps the order of the file."""
    lines = part.lines()
    if options.of_interest("\n".join(lines)):
        for n, line in enumerate(lines, before + 1):
            if not blank(line):
                rows.add(path, order, n - 1, n, None, None, None, line, None, None)
                if rows.full():
                    yield rows.batch()


def is_text(extension) -> Column:
    """Files that are read as text, as those of unknown extensions are."""
    return ~extension.isin(*[x for x, reader in READERS.items() if reader is not text.read])


#: Files and bytes of a task.
TASK_FILES, TASK_BYTES = 1000, 64 << 20


def tasks(files: DataFrame, options: Options) -> int:
    """Tasks that read the files. A listing is a few bytes for each, so adaptive execution, which goes by bytes, would put all into one."""
    context = files.sparkSession.sparkContext
    if "length" not in files.columns:
        return max(context.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    units = size["n"] + size["bytes"] // options.range_bytes
    return max(1, min(units, max(context.defaultParallelism, size["n"] // TASK_FILES, size["bytes"] // TASK_BYTES)))


def extract(files: DataFrame, options: Options | None = None, monitor: Monitor | None = None) -> DataFrame:
    """Entries of all files, with failures as rows. files: file_path, ext, file_ord and, if they were read already, content.

    A file is read by one task, entry by entry. If the files' `length` is given, texts of more than two ranges (Options.range_bytes) are
    read by ranges, which are dealt to tasks like files. How many and how large the files are is looked up when the plan is made.
    """
    options = options or Options()
    given = "content" in files.columns
    columns = ["file_path", "ext", "file_ord"] + ["content"] * given
    whole = [F.lit(None).cast("long").alias(c) for c in ("a", "b", "before")]
    rows = files.select(*columns, *whole)
    if not given:
        n = tasks(files, options)
        if "length" in files.columns:
            large = is_text(F.col("ext")) & (F.col("length") > 2 * options.range_bytes)
            if not files.where(large).isEmpty():
                parts = cut(files.where(large).select(*columns, "length"), options.range_bytes, n, options.strict_probe)
                rows = files.where(~large).select(*columns, *whole).unionAll(parts.select(*columns, "a", "b", "before"))
        rows = rows.repartition(n, "file_path", "a")
    known = dict(READERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in batches:
            known_of = zip(*(batch.column(c).to_pylist() for c in ("file_path", "ext", "file_ord", "a", "b", "before")), strict=True)
            for k, (path, ext, order, a, b, before) in enumerate(known_of):
                if monitor is not None and monitor.stopped():
                    raise InterruptedError("the search was stopped")  # a part of the results must not pass for the whole
                if a is not None:
                    try:
                        with opened(path) as f:
                            yield from _lines(rows, path, order, Range(f, a, b, options.strict_probe), before, options)
                    except (OSError, ValueError) as e:
                        rows.failed(path, order, e, isinstance(e, ValueError))
                else:
                    try:
                        raw = batch.column("content")[k].as_py() if given else content(path)
                    except OSError as e:
                        rows.failed(path, order, e, False)
                    else:
                        yield from _pieces(rows, path, order, ext in EXCEL, read_pieces(raw, ext, options, known))
                if monitor is not None:
                    monitor.read(a)
                if rows.full():
                    yield rows.batch()
        if rows.rows:
            yield rows.batch()

    return rows.mapInArrow(run, EXTRACTED)


def entries(extracted: DataFrame) -> DataFrame:
    """A row for each entry, cells too."""
    return unpacked(extracted.where("error IS NULL"))


def unpacked(rows: DataFrame) -> DataFrame:
    """Rows of cells as a row for each cell."""
    one = F.array(F.struct("entry_ord", "cell_address", "content"))
    found = rows.select("file_path", "file_ord", "line_number", "sheet_name", "object_name", F.explode(F.coalesce("cells", one)).alias("__e"))
    return found.select(*[F.col(f"__e.{c}").alias(c) if c in CELL.names else F.col(c) for c in ENTRY.names])


def errors(extracted: DataFrame) -> DataFrame:
    """(file_path, error) of the files that could not be read to their end."""
    return extracted.where("error IS NOT NULL").select("file_path", "error").distinct()
