"""Searches whose results come while files are read: one by one, by progress, or over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import match, results
from ..sources import listing, readers
from ..sources.formats.base import Options
from ..sources.monitor import Monitor
from ..spec import SearchSpec


def live(displayed: DataFrame) -> Iterator[Row]:
    """Results as their partitions are done, without holding them all."""
    return displayed.toLocalIterator(prefetchPartitions=True)


class Cancellable:
    """Jobs started within the block can be stopped from another thread. With the search's monitor, tasks that run open no further file."""

    def __init__(self, spark: SparkSession, tag: str = "search", monitor: Monitor | None = None):
        self.spark, self.tag, self.monitor = spark, tag, monitor

    def __enter__(self) -> Cancellable:
        self.spark.addTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.removeTag(self.tag)
        if self.monitor is not None:
            self.monitor.clear()

    def cancel(self) -> None:
        if self.monitor is not None:
            self.monitor.stop()
        self.spark.interruptTag(self.tag)


def watch(spark: SparkSession, spec: SearchSpec, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Search files of the target as they arrive or change; sink gets the results of each batch and its number.

    The checkpoint remembers what was read, so that a next run takes only what is new. Hidden files are seen. Files are read in one pass.
    The checkpoint's folder is not searched.
    """
    where = checkpoint.removeprefix("file://").rstrip("/") + "/"
    files = listing.arriving(spark, spec, f"{where}listings").where(~F.startswith("file_path", F.lit(where)))

    def batch(rows: DataFrame, number: int) -> None:
        options = Options(formulas=spec.formulas, needed=match.needed(spec), needed_all=spec.match_all, fold=not spec.case_sensitive)
        rows = rows.persist()
        try:
            found = match.packed_match(rows.sparkSession, readers.extract(rows, options), spec)
            sink(results.displayed(found, spec), number)
        finally:
            rows.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
