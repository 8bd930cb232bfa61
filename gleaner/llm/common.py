"""Storage and batching shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer single text is a step of its own.
SLICE_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that materialize() made, for each block of leftovers() that is open.
_made: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and outlives executors.

    The table stays until remove() is called; leftovers() tells which were made.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def leftovers() -> Iterator[list[str]]:
    """The folders that materialize() makes within the block. Once what was made of them is written, remove() may take them."""
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made[:] = [m for m in _made if m is not made]


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders, and take them off the list."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    folders.clear()


class Scratch:
    """Tables of one run of an operator, in a folder of their own that goes when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table and read it again; lets go of the shuffles that made it."""
        self.n += 1
        path = f"{self.folder}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete all tables. What was made of them must be written by now."""
        remove(self.spark, [self.folder])
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are materialised."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that is free back to the system: a worker process lives on and its peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that trims its worker's memory when a task is done."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return task


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle that the optimizer cannot size itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) with about `limit` bytes of texts each; one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    return slices(batch.column(column), limit)


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows, or of one group if it has more. Rows come sorted by `column`, whose values name the groups; none is cut."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            name = part.column(column).to_numpy(zero_copy_only=False)
            border = int(np.searchsorted(name, name[-1])) if name[0] != name[-1] else 0
            if held and (border or held[-1].column(column)[-1].as_py() != name[0]):
                held += [part.slice(0, border)] if border else []
                n += border
                part = part.slice(border)
                if n >= rows:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


#: One in so many members is counted to estimate the sizes of groups.
COUNTED = 16
