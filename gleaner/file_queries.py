"""Readers, searches, caches and exports as queries: files are made of table rows, read back, and held against SQL.

Each row of `part` makes one file of a format, whose texts carry the row's name, so the entries of all files follow from the
table alone. Files of the readers' queries are bytes in a column; those of folder queries are written by tasks to a new folder below the shared
one, some for each row of `supplier`, or all texts of `documents`. What a query finds is written there too, and its files are deleted.
"""

from __future__ import annotations

import codecs
import os
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions.regex import regex_match
from .operators import match as M
from .operators import results
from .plans import export
from .plans.cache import EntryCache, delete
from .plans.search import Search
from .schema import LABELS_JA
from .sources import listing, readers, writers
from .sources.formats import xls
from .sources.formats.base import Options
from .sources.monitor import Monitor, shared_dir
from .spec import SearchSpec, load, save
from .streaming import watch

Run = Callable[[SparkSession, str], DataFrame]
#: Entries of the sample files, as (content, line, sheet, cell, object); @ stands for the name of the row, after a blank.
PROPERTIES = [("My title@", 0, None, None, "Document Properties1"), ("Me@", 0, None, None, "Document Properties2")]
EXPECTED: dict[str, list[tuple]] = {
    "xlsx": [
        *PROPERTIES, ("picture of x@", 0, None, None, "Alt Text1"), ("t@", 0, None, None, "Alt Text2"), ("chart title@", 1, None, None, "Table/Chart"),
        ("art@", 1, None, None, "SmartArt"), ("said first@", 0, None, None, "Comment1"), ("said then@", 0, None, None, "Comment2"),
        ("Top@", 0, "First", None, "Header/Footer1"), ("shared@", 1, "First", "A1", None), ("inline@", 1, "First", "B1", None), ("TRUE", 1, "First", "C1", None),
        ("2024/01/01 12:00:00", 3, "First", "A3", None), ("12.5", 3, "First", "B3", None), ("7", 3, "First", "C3", None), ("1", 3, "First", "D3", None),
        ("shape text@", 0, "First", None, "Shape1"), ("remark@", 0, "First", "B1", "Comment"),
    ],
    "docx": [
        *PROPERTIES, ("one@", 1, None, None, None), ("three@", 3, None, None, None), ("boxed@", 4, None, None, None), ("boxed@", 0, None, None, "Shape1"), ("boxed@", 0, None, None, "Shape1"),
        ("head@", 0, None, None, "Header2"), ("foot@", 0, None, None, "Footer1"), ("said@", 0, None, None, "Comment1"),
    ],
    "pptx": [
        ("master@", 1, "Slide Master1", None, "Shape"), ("layout@", 1, "Slide Layout1", None, "Shape"), ("first shown@", 1, "Slide1", None, "Shape1"),
        ("a@", 1, "Slide2", None, "Title 1"), ("b@", 2, "Slide2", None, "Title 1"), ("c@", 1, "Slide2", None, "Shape2"), ("cell@", 1, "Slide2", None, "Table/Chart"),
        ("note one@", 1, "Slide2", None, "Note"), ("note two@", 2, "Slide2", None, "Note"), ("remark@", 0, "Slide2", None, "Comment1"),
    ],
    "doc": [("one@", 1, None, None, None), ("shown two@\t", 3, None, None, None), ("head@", 1, None, None, "Header/Footer"), ("remark@", 1, None, None, "Comment"), ("boxed Ж@", 1, None, None, "Shape")],
    "ppt": [
        ("before@", 1, "DocumentInfo", None, "Shape1"), ("one@", 1, "Slide1", None, "Shape1"), ("two@", 3, "Slide1", None, "Shape1"), ("three@", 1, "Slide1", None, "Shape2"),
        ("remark@", 0, "Slide1", None, "Comment1"), ("noted@", 1, "Slide1", None, "Note"),
    ],
    "xls": [
        ("shared@", 1, "One", "A1", None), ("remark@", 0, "One", "A1", "Comment"), ("splé@", 1, "One", "B1", None), ("2024/01/01 12:00:00", 2, "One", "A2", None), ("7", 2, "One", "B2", None),
        ("9.5", 3, "One", "A3", None), ("TRUE", 3, "One", "B3", None), ("in shape@", 0, "One", None, "Shape1"),
    ],
    "pdf": [
        ("The Title@", 0, None, None, "Document Properties1"), ("Me", 0, None, None, "Document Properties2"), ("Chapter (1) @", 0, None, None, "Bookmark1"), ("http://x.org", 0, None, None, "Bookmark2"),
        ("name your name Ann@", 0, "Page1", None, "Form Field1"), ("Hello world@", 1, "Page1", None, None), ("A", 2, "Page1", None, None), ("http://link.org", 0, "Page1", None, "Hyperlink1"),
        ("http://link.org", 0, "Page1", None, "Comment1"), ("free", 0, "Page1", None, "Shape1"), ("text@", 0, "Page1", None, "Shape1"), ("note", 0, "Page1", None, "Comment2"),
        ("second page@", 1, "Page2", None, None),
    ],
}
#: Functions by number, with a number of arguments and the name.
TWENTY = (
    (1, 3, "IF"), (4, 2, "SUM"), (13, 2, "DOLLAR"), (27, 2, "ROUND"), (36, 2, "AND"), (48, 2, "TEXT"), (56, 3, "PV"), (59, 4, "PMT"), (77, 1, "COLUMNS"), (98, 1, "ASIN"),
    (102, 4, "VLOOKUP"), (143, 4, "SYD"), (165, 2, "MMULT"), (194, 2, "VARP"), (229, 1, "SINH"), (261, 1, "ERROR.TYPE"), (307, 2, "CORREL"), (337, 2, "POWER"), (344, 2, "SUBTOTAL"), (359, 2, "HYPERLINK"),
)
FORMULAS = {"xlsx": [("=SUM(A1:A2)", 3, "First", "C3", None)], "xls": [("=SUM(A1:A2)", 3, "One", "A3", None)]}


#: Rows of a task at most, and files of a batch. A file is some hundred times its row, so Spark, which goes by the bytes of the table, would make them all in one task.
TASK_ROWS, BATCH_FILES = 2000, 250


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (key) dealt to tasks by number."""
    tasks = max(3 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK_ROWS)  # some for each core, as they differ
    return rows.repartition(tasks, "key")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")))


def made(rows: DataFrame, ext: str, more: Callable[[int], dict] = lambda k: {}) -> DataFrame:
    """A file of each row (key, name), with its bytes, as readers take it; more: what else its writer is told, by key."""
    write = getattr(writers, ext)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, BATCH_FILES) for b in batches for k in range(0, b.num_rows, BATCH_FILES)):
            keys, names = batch.column("key").to_pylist(), batch.column("name").to_pylist()
            files = [write(lambda x, n=n: f"{x} {n}", **more(k)) for k, n in zip(keys, names, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"/made/{k}.{ext}" for k in keys]), pa.array([f".{ext}"] * len(keys)), pa.array(keys, pa.int64()), pa.array(files, pa.binary())], ["file_path", "ext", "file_ord", "content"])

    return rows.mapInArrow(run, "file_path string, ext string, file_ord long, content binary")


def found(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("file_ord").alias("key"), "content", "line_number", "sheet_name", "cell_address", "object_name")


def encrypted_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of PDF files that are encrypted in turn by RC4, AES of 128 and of 256 bits, and open without a password."""
    methods = ["RC4", "AES-128", "AES-256"]
    return found(readers.entries(readers.extract(made(part(spark, sf_dir), "pdf", lambda k: {"method": methods[k % 3]}))))


def composite_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of composite fonts that only the embedded font's own table can tell, in turn by three ways from code to glyph."""
    files = made(part(spark, sf_dir), "pdf_composite", lambda k: {"way": k % 3}).withColumn("ext", F.lit(".pdf"))
    return found(readers.entries(readers.extract(files))).select("key", "content", "line_number", "sheet_name")


def doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of Word files whose last count reaches beyond the text: what is there is read."""
    return found(readers.entries(readers.extract(made(part(spark, sf_dir), "doc", lambda k: {"more": k % 7 * 50}))))


def read_back(ext: str, formulas: bool = False) -> Run:
    """Entries of the files of all rows; in the mode of formulas only cells."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        entries = readers.entries(readers.extract(made(part(spark, sf_dir), ext), Options(formulas=formulas)))
        return found(entries.where(M.is_cell()) if formulas else entries)

    return run


def text_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in several encodings, which the reader tells apart. Those that are UTF-8 without a mark hold what is no Shift_JIS."""
    names = ["utf-8", "utf-8-sig", "cp932", "utf-16", "utf-32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            texts = [f"{'日Å' if k % 5 == 0 else '日本語'} {n}\r\n \r{n}" for k, n in zip(keys, batch.column("name").to_pylist(), strict=True)]
            files = [t.encode(names[k % 5]) for k, t in zip(keys, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"/made/{k}.txt" for k in keys]), pa.array([".txt"] * len(keys)), pa.array(keys, pa.int64()), pa.array(files, pa.binary())], ["file_path", "ext", "file_ord", "content"])

    files = part(spark, sf_dir).mapInArrow(run, "file_path string, ext string, file_ord long, content binary")
    return found(readers.entries(readers.extract(files))).select("key", "line_number", "content")


def xls_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of workbooks from their tokens: twenty functions in turn, of a fixed or a given number of arguments, on cells of the row."""
    numbers = [(k, n) for k, n, _ in TWENTY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            made = []
            for k in keys:
                number, n = numbers[k % 20]
                tokens = b"".join(struct.pack("<BHH", 0x24, k % 1000, 0xC000 | c) for c in range(n))
                fixed = xls.FUNCTIONS[number][1] is not None
                made.append("=" + xls.formula_text(tokens + (struct.pack("<BH", 0x21, number) if fixed else struct.pack("<BBH", 0x22, n, number))))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(made)], ["key", "content"])

    return part(spark, sf_dir).mapInArrow(run, "key long, content string")


def form_rows(keys: list[int]) -> dict[str, list]:
    """The checks of these rows; settings of all are saved in one folder, each in a file of its own."""
    rows: dict[str, list] = {"nothing": [], "missing": [], "target": [], "same": []}
    with tempfile.TemporaryDirectory() as d:
        for k in keys:
            on = k % 5 != 0
            spec = SearchSpec.of("  " if k % 3 == 0 else f"word {k}", target="" if k % 2 else f"./x{k}/../y", excel=on, word=on, powerpoint=on, pdf=on, text=on, regex=k % 7 == 0, exclude_folders="a;é")
            rows["nothing"].append(spec.nothing_to_do())
            rows["missing"].append(", ".join(spec.validate_form()))
            rows["target"].append(spec.root("/base"))
            rows["same"].append(save(spec, f"{d}/{k}.json") and load(f"{d}/{k}.json", "/home") == replace(spec, target=spec.target or "/home"))
            os.unlink(f"{d}/{k}.json")
    return rows


def form_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications that lack something, made of each row: whether there is nothing to do, what the form asks for, and what is left after saving and loading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            rows = form_rows(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, rows.values())], ["key", *rows])

    return part(spark, sf_dir).mapInArrow(run, "key long, nothing boolean, missing string, target string, same boolean")


def cache_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache of four targets, of which one is forgotten: the files of the others are still stored."""
    root = folder(spark, sf_dir)
    for k in range(4):
        search = Search(spark, SearchSpec.of("nation", target=f"{root}/{k}", cache=f"{root}-cache", excel=False))
        search.results().count()
        search.close()
    EntryCache(spark, f"{root}-cache", f"{root}/1").clear()
    rows = EntryCache(spark, f"{root}-cache").rows()
    return done(rows.groupBy(F.regexp_extract("target", r"(\d)$", 1).cast("int").alias("target")).agg(F.count(F.lit(1)).alias("files")), root, f"{root}-cache")


def damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are cut off give a failure each, and no failure of the job."""
    files = made(part(spark, sf_dir), "xlsx").withColumn("content", F.substring("content", 1, 100))
    return readers.errors(readers.extract(files)).select("file_path", F.col("error").isNotNull().alias("failed"))


def damaged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole packages in which one main part is cut off: a failure each, with the entries that came before it."""
    parts = ["xl/workbook.xml", "xl/worksheets/sheet1.xml", "xl/styles.xml"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("file_ord").to_pylist()
            files = [writers.without_end(raw, parts[k % 3]) for k, raw in zip(keys, batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file_path", "ext", "file_ord")), pa.array(files, pa.binary())], ["file_path", "ext", "file_ord", "content"])

    files = made(part(spark, sf_dir), "xlsx")
    rows = readers.extract(files.mapInArrow(run, files.schema))
    said = F.max(F.regexp_extract("error", "the part (\\S+) cannot be read", 1)).alias("part")
    return rows.groupBy(F.col("file_ord").alias("key")).agg(said, F.count_if(F.col("error").isNull() & F.col("object_name").isNotNull()).alias("extras"), F.count_if(F.col("cells").isNotNull()).alias("rows"))


def sheet_rows(regex: bool) -> Run:
    """Cells of workbooks whose rows hold both keywords; rows are matched where they were read, in one pass over the files."""
    spec = SearchSpec.of(r"shared [a-m]" if regex else "shared", "inline", regex=regex)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = readers.extract(made(part(spark, sf_dir), "xlsx"))
        return results.displayed(M.packed_match(spark, rows, spec), spec).select(F.col("file_ord").alias("key"), "file_name", "location", "content")

    return run


def labels_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = readers.entries(readers.extract(made(part(spark, sf_dir), "pptx"), Options(labels=LABELS_JA)))
    shown = results.displayed(entries.where("sheet_name = 'スライド1' OR line_number = 0"), SearchSpec.of("x"), LABELS_JA)
    return shown.select(F.col("file_ord").alias("key"), "location", "content")


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries to lines of six fields and back; every third line lacks a field, every fifth has no number."""
    entries = readers.entries(readers.extract(made(part(spark, sf_dir), "xls")))
    k = F.col("file_ord") % 15
    line = F.when(k % 3 == 0, F.lit("a\t1\tb\tc\td")).when(k % 5 == 0, F.regexp_replace(X.index_line(), "\t(\\d+)\t", "\tnone\t")).otherwise(X.index_line())
    fields = entries.select(F.col("file_ord").alias("key"), line.alias("line")).select("key", F.split("line", "\t", -1).alias("fields"))  # each as a column, so that it is made once
    rows = fields.select("key", X.indexed("fields").alias("e"))
    return rows.groupBy("key").agg(F.count("e").alias("entries"), F.sum("e.line_number").cast("long").alias("lines"), F.count("e.object_name").alias("objects"), F.max("e.content").alias("last"))


def timed_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that could take long goes to the engine with a limit of time."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(X.split_lines("text")).alias("content"))
    return rows.where(regex_match(spark, F.col("content"), "(an)+[a-z]* (t[a-z]+ )+", False))


def put(path: str, raw: bytes, tops: set[str], old: bool = False) -> None:
    """Write a file; tops: folders that are there. Local files are written without Arrow, whose streams cost several times what the file does."""
    system, inside = listing.store(path) if "://" in path else (None, path)
    local = system is None or isinstance(system, pafs.LocalFileSystem)
    if (top := os.path.dirname(inside)) not in tops:
        os.makedirs(top, exist_ok=True) if local else system.create_dir(top, recursive=True)
        tops.add(top)
    with open(inside, "wb") if local else system.open_output_stream(inside, compression=None) as f:
        f.write(raw)
    if old and local:
        os.utime(inside, (1, 1))


def written(rows: DataFrame, make: Callable[[int], dict[str, bytes]], old: bool = False) -> int:
    """Files of every row (key), written by tasks; `old`: with a time long past, where the folder is local. Returns their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, tops = 0, set()
        for batch in batches:
            for key in batch.column("key").to_pylist():
                for path, raw in make(key).items():
                    put(path, raw, tops, old)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return dealt(rows.select(F.col("key").cast("long"))).mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def new_folder(spark: SparkSession) -> str:
    """A folder that is there, even if no task writes a file."""
    root = f"{shared_dir(spark).removeprefix('file://')}/files-{uuid.uuid4().hex}"
    system, top = listing.store(root) if "://" in root else (pafs.LocalFileSystem(), root)
    system.create_dir(top, recursive=True)
    return root


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"))


def top_of(root: str, k: int) -> str:
    return f"{root}/{k % 4}" + ("/deep/er" if k % 3 == 0 else "")


def folder(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with files of every supplier: a text, a hidden one, one of another kind, a workbook, and some that are damaged."""
    root = new_folder(spark)

    def make(k: int) -> dict[str, bytes]:
        top, n = top_of(root, k), f"NATION_{k}"
        texts = {f"{n}.TXT": f"nation {n}\n\nNumber {k} of all", f".{n}.txt": f"hidden {n} nation", f"{n}.md": f"nation {n} noted"}
        book = writers.xlsx(lambda x: f"{x} {k}") if k % 5 else b"damaged"
        return {f"{top}/{name}": text.encode() for name, text in texts.items()} | {f"{top}/{n}.xlsx": book}

    written(suppliers(spark, sf_dir), make)
    return root


def done(found: DataFrame, root: str, *tables: str) -> DataFrame:
    """What was found, written and read again; the files it was found in are deleted, by tasks since there are some of each row, and so are tables beside them."""
    spark = found.sparkSession
    where = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    found.write.parquet(where)
    if not listing.only_by_spark(root):
        listing.emptied(spark, root, f"{root}-gone")
    for folder in (root, f"{root}-gone", *tables):
        delete(spark, folder)
    return spark.read.schema(found.schema).parquet(where)


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("file_name", "location", "content")


def folder_search(more: dict, kept: bool = False) -> Run:
    """A search of a folder; `kept`: twice over a cache, the second one from it."""
    spec = SearchSpec.of(*more.pop("words"), **more)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = folder(spark, sf_dir)
        search = Search(spark, replace(spec, target=root, cache=f"{root}/.cache" if kept else None))
        if kept:
            search.results().count()
            search.close()
            search = Search(spark, search.spec)
        found = done(shown(search.results()), root)
        search.close()
        return found

    return run


def folder_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second search reads again: files that failed, and those that changed."""
    root = folder(spark, sf_dir)
    spec = SearchSpec.of("nation", target=root, cache=f"{root}/.cache")
    first = Search(spark, spec)
    first.results().count()
    first.close()
    written(suppliers(spark, sf_dir).where("key % 7 = 6"), lambda k: {f"{top_of(root, k)}/NATION_{k}.TXT": b"changed"}, old=True)
    search = Search(spark, spec)
    name = X.file_name("file_path").alias("file_name")
    again = done(search.extracted().select(name, F.col("error").isNotNull().alias("failed")).distinct(), root)
    search.close()
    return again


def cache_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after ten searches, before each of which some files changed: a manifest row for each file, and its entries once."""
    root = folder(spark, sf_dir)
    spec = SearchSpec.of("nation", target=root, cache=f"{root}/.cache", excel=False)
    for turn in range(10):
        changed = suppliers(spark, sf_dir).where((F.col("key") + turn) % 3 == 0)
        written(changed, lambda k, turn=turn: {f"{top_of(root, k)}/NATION_{k}.TXT": f"nation {k}\nin turn {turn}".encode()}, old=turn % 2 == 0)
        search = Search(spark, spec)
        search.results().count()
        search.close()
    store = EntryCache(spark, spec.cache, root)
    state = store.compact()
    store.vacuum()
    rows = store.rows()
    stored = store.stored(state).join(rows.select("file_path", "batch"), ["file_path", "batch"]).groupBy("file_path").agg(F.count(F.lit(1)).alias("entries"), F.max("content").alias("last"))
    files = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("manifest_rows"))
    return done(files.join(stored, "file_path").select(X.file_name("file_path").alias("file_name"), "manifest_rows", "entries", "last"), root)


def folder_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, sf_dir)
    search = Search(spark, SearchSpec.of("nation", target=root))
    found = done(search.errors().select(X.file_name("file_path").alias("file_name"), F.col("error").isNotNull().alias("failed")), root)
    search.close()
    return found


def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results, files with results, and the files that tasks told of while the search ran."""
    root = folder(spark, sf_dir)
    monitor = Monitor(spark)
    search = Search(spark, SearchSpec.of("nation", target=root), monitor=monitor)
    counted = done(results.counts(search.results()), root)
    search.close()
    return counted.withColumn("files_read", F.lit(monitor.files).cast("long"))


def folder_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of forty folders, one in another, listed in rounds in which a task takes five folders: the order of each chain's files."""
    root = new_folder(spark)

    def make(k: int) -> dict[str, bytes]:
        top = f"{root}/{k // 40:06}" + "".join(f"/{n:02}" for n in range(k % 40))
        return {f"{top}/.{k}.txt": b"x" * k}

    written(suppliers(spark, sf_dir), make)
    found = listing.rounds(spark, SearchSpec.of("x", target=root), f"{root}-rounds", limit=5)
    key = F.regexp_extract("file_path", r"\.(\d+)\.txt$", 1).cast("long")
    place = F.row_number().over(Window.partitionBy(F.floor(key / 40)).orderBy("file_ord")).alias("place")
    return done(found.select(key.alias("key"), "ext", "length", place), root, f"{root}-rounds")


def text_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents as files of two hundred each, read by ranges of 32 KB: the lines of each file with their numbers."""
    root = new_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    docs = docs.select(F.expr("doc_id div 200").alias("file"), "doc_id", "text")  # whole numbers, as doubles would round large ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a file is written text by text."""
        system, top = listing.store(root) if "://" in root else (pafs.LocalFileSystem(), root)
        at, out = None, None
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if out is None or file != at:
                    if out is not None:
                        out.close()
                    at, out = file, system.open_output_stream(f"{top}/{file}.txt", compression=None)
                    out.write(codecs.BOM_UTF8)
                out.write(text.encode() + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], ["n"])

    docs.repartition("file").sortWithinPartitions("file", "doc_id").mapInArrow(run, "n int").agg(F.sum("n")).collect()
    search = Search(spark, SearchSpec.of("x", target=root), range_bytes=32 << 10)
    name = F.nullif(X.file_name("file_path"), F.lit("None.txt"))  # that of texts without an id
    found = done(search.entries().select(name.alias("file_name"), "line_number", "content"), root)
    search.close()
    return found


def text_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are valid in both encodings go to the one with more Japanese characters, even if these are letters with accents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            files = [("日日 " if k % 2 else "éé ").encode() + n.encode() for k, n in zip(keys, batch.column("name").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"/made/{k}.txt" for k in keys]), pa.array([".txt"] * len(keys)), pa.array(keys, pa.int64()), pa.array(files, pa.binary())], ["file_path", "ext", "file_ord", "content"])

    files = part(spark, sf_dir).mapInArrow(run, "file_path string, ext string, file_ord long, content binary")
    return found(readers.entries(readers.extract(files))).select("key", "line_number", "content")


def exported(files: bool) -> Run:
    """The lines of an export, read back, without those that name the folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = folder(spark, sf_dir)
        spec = SearchSpec.of("nation", target=root, export_conditions=True)
        search = Search(spark, spec)
        (export.export_files if files else export.export_results)(search.results(), f"{root}/out", spec)
        search.close()
        lines = spark.read.text(f"{root}/out").where(~F.startswith("value", F.lit("Target Folder")))
        return done(lines.select(F.regexp_replace("value", r"^/.*/([^/\t]+)(\t|$)", "$1$2").alias("line")), root)

    return run


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they arrive, searched in batches; the third run of the stream sees those that have changed after the second, hidden ones too."""
    root = folder(spark, sf_dir)
    spec = SearchSpec.of("nation", target=root)
    for turn in range(3):
        if turn == 2:
            written(suppliers(spark, sf_dir).where("key % 2 = 1"), lambda k: {f"{top_of(root, k)}/.NATION_{k}.txt": b"nation changed"}, old=True)
            written(suppliers(spark, sf_dir).where("key % 5 = 2"), lambda k: {f"{root}/later/{k}/NEW_{k}.txt": f"nation new {k}".encode()})
        watch.watch(spark, spec, lambda rows, n: shown(rows).write.mode("append").parquet(f"{root}-found"), f"{root}-checkpoint").awaitTermination()
    return done(spark.read.parquet(f"{root}-found"), root, f"{root}-found", f"{root}-checkpoint")


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("\t", "' || chr(9) || '") + "'"


def _entries_sql(rows: list[tuple], more: str = "") -> str:
    values = ", ".join(f"({_text(c)}, {n}, {_text(s)}, {_text(a)}, {_text(o)})" for c, n, s, a, o in rows)
    first = "SELECT p_partkey AS key, replace(c, '@', ' ' || p_name) AS content, n::INTEGER AS line_number, s::VARCHAR AS sheet_name, a::VARCHAR AS cell_address, o::VARCHAR AS object_name"
    return f"{first} FROM part, (VALUES {values}) AS v(c, n, s, a, o){more}"


_NATIONS = "(SELECT s_suppkey AS k, 'NATION_' || s_suppkey AS n FROM supplier)"
_LINKS = " UNION ALL SELECT p_partkey, 'http://example.org/' || replace('x ' || p_name, ' ', '/'), 0, NULL, NULL, 'Hyperlink1' FROM part"
_TEXTS = f"""SELECT n || '.TXT' AS file_name, '1 Row' AS location, 'nation ' || n AS content FROM {_NATIONS} UNION ALL SELECT n || '.TXT', '3 Row', 'Number ' || k || ' of all' FROM {_NATIONS}
 UNION ALL SELECT '.' || n || '.txt', '1 Row', 'hidden ' || n || ' nation' FROM {_NATIONS}"""
_WITH_NATION = f"SELECT * FROM ({_TEXTS}) WHERE contains(lower(content), 'nation')"
_SHEET = "SELECT p_partkey AS key, p_partkey || '.xlsx' AS file_name, v.l AS location, v.c || p_name AS content FROM part, (VALUES ('[First] A1', 'shared '), ('[First] B1', 'inline ')) AS v(l, c)"
_CONDITIONS = """SELECT unnest(['[Search Conditions]', 'Keyword1' || chr(9) || 'nation', 'Condition' || chr(9) || 'AND', 'Case Sensitive' || chr(9) || 'No', 'Regular Expression' || chr(9) || 'No',
 'File Types' || chr(9) || '.xlsx .xlsm .xls .docx .docm .doc .pptx .pptm .ppt .pdf .txt', 'Excel Target' || chr(9) || 'Value', 'Remove Line Breaks' || chr(9) || 'No', '']) AS line"""

QUERIES: dict[str, tuple[Run, str]] = {
    "read_xlsx": (read_back("xlsx"), _entries_sql(EXPECTED["xlsx"], _LINKS)),
    **{f"read_{x}": (read_back(x), _entries_sql(EXPECTED[x])) for x in ("docx", "pptx", "doc", "ppt", "xls", "pdf")},
    "doc_counts": (doc_counts, _entries_sql(EXPECTED["doc"])),
    "composite_pdfs": (composite_pdfs, "SELECT p_partkey AS key, v.c || ' ' || p_name AS content, v.n::INTEGER AS line_number, 'Page1' AS sheet_name FROM part, (VALUES ('Zeile 日本', 1), ('second', 2)) AS v(c, n)"),
    "encrypted_pdfs": (encrypted_pdfs, _entries_sql(EXPECTED["pdf"])),
    **{f"formulas_{x}": (read_back(x, True), _entries_sql(rows)) for x, rows in FORMULAS.items()},
    "text_encodings": (
        text_encodings,
        "SELECT p_partkey AS key, 1::INTEGER AS line_number, CASE WHEN p_partkey % 5 = 0 THEN '日Å ' ELSE '日本語 ' END || p_name AS content FROM part UNION ALL SELECT p_partkey, 3, p_name FROM part",
    ),
    "damaged_files": (damaged_files, "SELECT '/made/' || p_partkey || '.xlsx' AS file_path, true AS failed FROM part"),
    "damaged_parts": (damaged_parts, "SELECT p_partkey AS key, ['xl/workbook.xml', 'xl/worksheets/sheet1.xml', 'xl/styles.xml'][p_partkey % 3 + 1] AS part, 9::BIGINT AS extras, 0::BIGINT AS rows FROM part"),
    "sheet_rows": (sheet_rows(False), _SHEET),
    "sheet_rows_regex": (sheet_rows(True), f"SELECT s.* FROM ({_SHEET}) s JOIN part ON key = p_partkey WHERE regexp_matches(p_name, '^[a-m]', 'i')"),
    "labels_japanese": (
        labels_japanese,
        "SELECT p_partkey AS key, v.l AS location, v.c || p_name AS content FROM part, (VALUES ('[スライド1] 図形1', 'first shown '), ('[スライド2] コメント1', 'remark ')) AS v(l, c)",
    ),
    "index_lines": (
        index_lines,
        """SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 8 END::BIGINT AS entries, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 0 ELSE 12 END::BIGINT AS lines,
 CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS objects, CASE WHEN p_partkey % 3 <> 0 THEN 'splé ' || p_name END AS last FROM part""",
    ),
    "timed_pattern": (
        timed_pattern,
        "SELECT doc_id, content FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS content FROM documents) WHERE regexp_matches(content, '(an)+[a-z]* (t[a-z]+ )+', 'i')",
    ),
    "folder_search": (folder_search({"words": ["nation"]}), _WITH_NATION),
    "folder_cached": (folder_search({"words": ["nation"]}, True), _WITH_NATION),
    "folder_any": (folder_search({"words": ["hidden", "of all"], "match_all": False, "excel": False}), f"SELECT * FROM ({_TEXTS}) WHERE contains(content, 'hidden') OR contains(content, 'of all')"),
    "folder_regex": (folder_search({"words": ["n(a|o)[a-z]+n", "^.{1,7}N[A-M].*[02468]"], "regex": True, "case_sensitive": True}), f"SELECT * FROM ({_TEXTS}) WHERE regexp_matches(content, 'n(a|o)[a-z]+n') AND regexp_matches(content, '^.{{1,7}}N[A-M].*[02468]')"),
    "folder_custom": (
        folder_search({"words": ["nation"], "text": False, "excel": False, "custom_enabled": True, "custom_extensions": "md; TXT", "exclude_enabled": True, "exclude_extensions": ".txt", "exclude_folders_enabled": True, "exclude_folders": "1;2/DEEP"}),
        f"SELECT n || '.md' AS file_name, '1 Row' AS location, 'nation ' || n || ' noted' AS content FROM {_NATIONS} WHERE k % 4 <> 1 AND NOT (k % 4 = 2 AND k % 3 = 0)",
    ),
    "folder_errors": (folder_errors, f"SELECT n || '.xlsx' AS file_name, true AS failed FROM {_NATIONS} WHERE k % 5 = 0"),
    "folder_cache": (folder_cache, f"SELECT n || '.xlsx' AS file_name, true AS failed FROM {_NATIONS} WHERE k % 5 = 0 UNION ALL SELECT n || '.TXT', false FROM {_NATIONS} WHERE k % 7 = 6"),
    "cache_store": (
        cache_store,
        f"""SELECT n || '.TXT' AS file_name, 1::BIGINT AS manifest_rows, 2::BIGINT AS entries, 'nation ' || k AS last FROM {_NATIONS}
 UNION ALL SELECT '.' || n || '.txt', 1, 1, 'hidden ' || n || ' nation' FROM {_NATIONS}""",
    ),
    "folder_counts": (
        folder_counts,
        f"""SELECT (SELECT count(*) FROM ({_WITH_NATION}))::BIGINT AS results, (SELECT count(DISTINCT file_name) FROM ({_WITH_NATION}))::BIGINT AS files, (SELECT 3 * count(*) FROM {_NATIONS})::BIGINT AS files_read""",
    ),
    "folder_chain": (folder_chain, f"SELECT k AS key, '.txt' AS ext, k AS length, (k % 40 + 1)::INTEGER AS place FROM {_NATIONS}"),
    "cache_of_targets": (cache_of_targets, f"SELECT (k % 4)::INTEGER AS target, 2 * count(*)::BIGINT AS files FROM {_NATIONS} WHERE k % 4 <> 1 GROUP BY k % 4"),
    "form_checks": (
        form_checks,
        """SELECT p_partkey AS key, p_partkey % 3 = 0 OR p_partkey % 2 = 1 OR p_partkey % 5 = 0 AS nothing,
 concat_ws(', ', CASE WHEN p_partkey % 2 = 1 THEN 'target folder' END, CASE WHEN p_partkey % 3 = 0 THEN 'keyword' END, CASE WHEN p_partkey % 5 = 0 THEN 'file type' END) AS missing,
 CASE WHEN p_partkey % 2 = 1 THEN '/base' ELSE '/base/y' END AS target, true AS same FROM part""",
    ),
    "xls_functions": (
        xls_functions,
        f"""SELECT p_partkey AS key, '=' || f.name || '(' || array_to_string(list_transform(range(f.n), lambda c: chr((65 + c)::INTEGER) || (p_partkey % 1000 + 1)), ',') || ')' AS content
 FROM part JOIN (VALUES {", ".join(f"({i}, {n}, '{name}')" for i, (_, n, name) in enumerate(TWENTY))}) AS f(i, n, name) ON p_partkey % 20 = f.i""",
    ),
    "text_ranges": (
        text_ranges,
        """SELECT file_name, i::INTEGER AS line_number, parts[i] AS content FROM (SELECT file_name, parts, unnest(range(1, len(parts) + 1)) AS i FROM
 (SELECT doc_id // 200 || '.txt' AS file_name, regexp_split_to_array(string_agg(text, chr(10) ORDER BY doc_id) || chr(10), '\\r\\n|\\r|\\n') AS parts FROM documents WHERE text IS NOT NULL GROUP BY doc_id // 200))
 WHERE length(trim(parts[i], ' ' || chr(9) || chr(11) || chr(12))) > 0""",
    ),
    "text_ambiguous": (text_ambiguous, "SELECT p_partkey AS key, 1::INTEGER AS line_number, CASE WHEN p_partkey % 2 = 1 THEN '譌･譌･ ' ELSE 'ﾃｩﾃｩ ' END || p_name AS content FROM part"),
    "export_results": (exported(False), f"{_CONDITIONS} UNION ALL SELECT 'File Path' || chr(9) || 'File Name' || chr(9) || 'Location' || chr(9) || 'Content' UNION ALL SELECT file_name || chr(9) || file_name || chr(9) || location || chr(9) || content FROM ({_WITH_NATION})"),
    "export_files": (exported(True), f"{_CONDITIONS} UNION ALL SELECT DISTINCT file_name FROM ({_WITH_NATION})"),
    "streamed_files": (
        streamed,
        f"""{_WITH_NATION} UNION ALL SELECT '.' || n || '.txt', '1 Row', 'nation changed' FROM {_NATIONS} WHERE k % 2 = 1
 UNION ALL SELECT 'NEW_' || k || '.txt', '1 Row', 'nation new ' || k FROM {_NATIONS} WHERE k % 5 = 2""",
    ),
}
