"""A whole search: list, extract or load, match, display."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.regex import validate
from ..operators import match, results
from ..schema import ENTRY, LABELS
from ..sources import listing, readers
from ..sources.formats.base import Options
from ..sources.monitor import Monitor, shared_dir
from ..spec import SearchSpec
from .cache import EntryCache, delete


class Search:
    """Plans of one search. When the first is made the folder is listed, and a cache is brought up to date; files are read when a result is asked for.

    The listing is taken once and kept as a table until close(); a search is one pass over the files, of whatever kinds.
    """

    def __init__(self, spark: SparkSession, spec: SearchSpec, labels: dict[str, str] = LABELS, monitor: Monitor | None = None, range_bytes: int | None = None):
        self.spark, self.spec, self.labels, self.monitor = spark, spec, labels, monitor
        self.options = Options(formulas=spec.formulas, labels=dict(labels))
        if range_bytes:
            self.options = replace(self.options, range_bytes=range_bytes)
        if spec.regex:
            validate(spark, spec.active(), spec.case_sensitive)
        self._files: DataFrame | None = None
        self._listing: str | None = None
        self._extracted: DataFrame | None = None
        self._stored: DataFrame | None = None
        self._cache: EntryCache | None = None

    def close(self) -> None:
        """Let go of the listing. The results must be written by now."""
        if self._cache is not None:
            self._cache.forget()
        if self._listing is not None:
            delete(self.spark, self._listing)
            self._files = self._listing = None

    def files(self) -> DataFrame:
        """The listing, a table in the shared folder. What only Spark can read comes with its contents, and is not kept."""
        if self._files is None:
            if listing.only_by_spark(self.spec.root()):
                self._files = listing.files(self.spark, self.spec)
            else:
                self._listing = f"{shared_dir(self.spark)}/listing-{uuid.uuid4().hex}"
                self._files = listing.rounds(self.spark, self.spec, self._listing)
        return self._files

    def _plan(self) -> DataFrame:
        """What readers give for all files, or what a cache holds for them."""
        if self._extracted is None:
            if self.spec.cache is None:
                options = replace(self.options, needed=match.needed(self.spec), needed_all=self.spec.match_all, fold=not self.spec.case_sensitive)
                self._extracted = readers.extract(self.files(), options, self.monitor)
            else:
                self._cache = cache = EntryCache(self.spark, self.spec.cache, self.spec.root(), dict(self.labels))
                if self.spec.rebuild_cache:
                    cache.clear()
                files = cache.listed(self.files(), self.spec.formulas)
                missing = cache.misses(files)
                self._stored = cache.store(missing, readers.extract(missing, self.options, self.monitor), self.spec.formulas)
                self._extracted = self._stored.unionByName(cache.load(cache.hits(files)))
        return self._extracted

    def extracted(self) -> DataFrame:
        """What readers give for the files that must be read, failures included."""
        found = self._plan()
        return found if self._stored is None else self._stored

    def entries(self) -> DataFrame:
        if self.spec.nothing_to_do():
            return self.spark.createDataFrame([], ENTRY)
        # all of them: the plan of a search leaves out texts that cannot match
        return readers.entries(readers.extract(self.files(), self.options, self.monitor) if self.spec.cache is None else self._plan())

    def errors(self) -> DataFrame:
        return readers.errors(self.extracted())

    def matches(self) -> DataFrame:
        """Entries that match."""
        if self.spec.nothing_to_do():
            return self.entries()
        return match.packed_match(self.spark, self._plan(), self.spec)

    def results(self) -> DataFrame:
        """Matches with file name and location, in no order: orderBy("file_ord", "entry_ord") gives that of the files."""
        return results.displayed(self.matches(), self.spec, self.labels)

    def after(self) -> SearchSpec:
        """The specification for the next search: a cache is rebuilt once."""
        return replace(self.spec, rebuild_cache=False)
