"""Cache of extracted entries: files that have not changed are not read again.

The store is one state at a time. `entries` holds what readers gave, in folders by batch: one batch for each search that read
something. `manifest` has one row for each file: when it was last changed, the target of the search, the mode of formulas, the labels, the
failure if any, and the batch that has its entries. A search writes a new manifest, without the rows that it replaces, as a table in buckets by path, so that
the join with a listing moves the listing alone. A state is a small file that names the manifest and the batches; it is put in
place by a rename, which fails if another search was faster. Only then goes what no state names: the last state's tables stay
until the next search, for searches that still read them.

Entries of files that were read again are dead weight in their batches. When less than half of a batch's files are alive, or there are
more than MAX_BATCHES, the next search first writes the live entries of those batches as one new batch.

A file is a hit if its manifest row was written without failure, differs by less than a second in time, has the same labels,
and, for spreadsheets, was read in the same mode. The time of a file is that of the listing from which it was read, and
the listing is taken once: a file that changes while it is read keeps its old time in the manifest and is read again by the next search.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LABELS
from ..sources.readers import EXTRACTED
from ..spec import EXCEL

TOLERANCE_US = 1_000_000
MANIFEST = "file_path string, modified timestamp, formulas boolean, labels string, target string, error string, batch string"
STORED = T.StructType([*EXTRACTED.fields, T.StructField("batch", T.StringType())])
MAX_BATCHES = 8
#: Files of a bucket of the manifest, on average, and the fewest buckets.
BUCKET_FILES, BUCKETS = 500_000, 8


class Conflict(RuntimeError):
    """Another search has changed the store meanwhile."""


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def delete(spark: SparkSession, folder: str) -> None:
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def fresh(modified: Column, stored: Column) -> Column:
    """Times that differ by less than a second."""
    return F.abs(F.unix_micros(modified) - F.unix_micros(stored)) < TOLERANCE_US


def digest(labels: dict[str, str]) -> str:
    return hashlib.md5(json.dumps(labels, sort_keys=True).encode()).hexdigest()


def valid(files: DataFrame, manifest: DataFrame, formulas: bool, labels: str) -> Column:
    """Condition of a hit between a file and a manifest row."""
    same_mode = (manifest["formulas"] == F.lit(formulas)) | ~files["ext"].isin(*EXCEL)
    return (files["file_path"] == manifest["file_path"]) & fresh(files["modified"], manifest["modified"]) & same_mode & (manifest["labels"] == F.lit(labels)) & manifest["error"].isNull()


class State:
    """A version of the store: the manifest's folder and buckets, and the files of each batch when it was written."""

    def __init__(self, version: int = 0, manifest: str | None = None, buckets: int = BUCKETS, batches: dict[str, int] | None = None):
        self.version, self.manifest, self.buckets, self.batches = version, manifest, buckets, batches or {}


class EntryCache:
    """Entries of the files of one target; other targets may share the folder."""

    def __init__(self, spark: SparkSession, folder: str, target: str = "", labels: dict[str, str] = LABELS):
        self.spark, self.folder, self.target, self.labels = spark, folder.rstrip("/"), target, digest(labels)
        self.listing: str | None = None

    # states

    def state(self) -> State:
        names = [n for n in names_in(self.spark, f"{self.folder}/state") if n.endswith(".json")]
        if not names:
            return State()
        path, fs = _path(self.spark, f"{self.folder}/state/{names[-1]}")
        stream = fs.open(path)
        try:
            return State(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def rows(self) -> DataFrame:
        """The manifest of the newest state."""
        return self._manifest(self.state())

    def _manifest(self, state: State) -> DataFrame:
        if state.manifest is None:
            return self.spark.createDataFrame([], MANIFEST)
        name = f"gleaner_manifest_{uuid.uuid4().hex}"
        where = f"{self.folder}/manifest/{state.manifest}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({MANIFEST}) USING parquet CLUSTERED BY (file_path) INTO {state.buckets} BUCKETS LOCATION '{where}'")
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the files stay, the plan keeps what it needs

    def commit(self, last: State, manifest: DataFrame, batches: dict[str, int]) -> State:
        """Put a new state in place of `last`; what neither of the two names goes."""
        count = sum(batches.values())
        buckets = max(BUCKETS, 1 << max(0, (count // BUCKET_FILES).bit_length()))
        state = State(last.version + 1, uuid.uuid4().hex, buckets, batches)
        table = f"gleaner_manifest_{state.manifest}"
        where = f"{self.folder}/manifest/{state.manifest}"
        manifest.repartition(buckets, "file_path").write.bucketBy(buckets, "file_path").option("path", where).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")
        draft, fs = _path(self.spark, f"{self.folder}/state/{state.manifest}.draft")
        out = fs.create(draft, True)
        out.write(json.dumps(vars(state)).encode())
        out.close()
        final = _path(self.spark, f"{self.folder}/state/{state.version:012}.json")[0]
        if fs.exists(final) or not self._renamed(fs, draft, final):
            delete(self.spark, where)
            raise Conflict(f"the cache {self.folder} was changed by another search")
        self.vacuum(last, state)
        return state

    @staticmethod
    def _renamed(fs, draft, final) -> bool:
        try:
            return fs.rename(draft, final)
        except Py4JJavaError:
            return False

    def vacuum(self, *states: State) -> None:
        """Delete manifests, batches and states other than those of the given states (the newest one if none is given)."""
        states = states or (self.state(),)
        kept = {"manifest": {s.manifest for s in states}, "entries": {f"batch={b}" for s in states for b in s.batches}, "state": {f"{s.version:012}.json" for s in states}}
        for folder, names in kept.items():
            for name in names_in(self.spark, f"{self.folder}/{folder}"):
                if name not in names and not name.endswith((".crc", ".draft")):
                    delete(self.spark, f"{self.folder}/{folder}/{name}")

    def compact(self) -> State:
        """Write the live entries of poor batches as one new batch, if there is reason to."""
        state = self.state()
        if len(state.batches) < 2:
            return state
        manifest = self._manifest(state)
        alive = {r["batch"]: r["count"] for r in manifest.groupBy("batch").count().collect()}  # a row for each batch
        poor = [b for b, n in state.batches.items() if 2 * alive.get(b, 0) < n]
        if len(state.batches) - len(poor) >= MAX_BATCHES:
            poor = list(state.batches)
        if not poor:
            return state
        batch = uuid.uuid4().hex
        moved = manifest.where(F.col("batch").isin(poor)).select("file_path", "batch")
        self._entries(poor).join(moved, ["file_path", "batch"]).drop("batch").select(*EXTRACTED.names).write.parquet(f"{self.folder}/entries/batch={batch}")
        batches = {b: n for b, n in state.batches.items() if b not in poor} | {batch: sum(alive.get(b, 0) for b in poor)}
        return self.commit(state, manifest.withColumn("batch", F.when(F.col("batch").isin(poor), F.lit(batch)).otherwise(F.col("batch"))), batches)

    # searches

    def listed(self, files: DataFrame, formulas: bool) -> DataFrame:
        """The listing with the batch that has a file's entries, if any is valid; taken once, so that what is read, stored and compared is one
        state of the folder. forget() deletes it."""
        self.base = self.compact()
        m = self._manifest(self.base)
        found = files.drop("content").join(m, valid(files, m, formulas, self.labels), "left").select(*[files[c] for c in files.columns if c != "content"], m["batch"])
        self.listing = f"{self.folder}/listing/{uuid.uuid4().hex}"
        found.write.parquet(self.listing)
        listed = self.spark.read.schema(found.schema).parquet(self.listing)
        if "content" in files.columns:  # stores that only Spark reads
            listed = listed.join(files.select("file_path", "content"), "file_path")
        return listed

    def forget(self) -> None:
        if self.listing is not None:
            delete(self.spark, self.listing)

    def hits(self, listed: DataFrame) -> DataFrame:
        """(file_path, file_ord, batch) of files whose entries can be loaded."""
        return listed.where("batch IS NOT NULL").select("file_path", "file_ord", "batch")

    def misses(self, listed: DataFrame) -> DataFrame:
        return listed.where("batch IS NULL").drop("batch")

    def _entries(self, batches: list[str]) -> DataFrame:
        found = [f"{self.folder}/entries/batch={b}" for b in batches]
        if not found:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).option("basePath", f"{self.folder}/entries").parquet(*found)

    def stored(self, state: State) -> DataFrame:
        """All entries of a state, and the batch of each; the live ones are those whose file and batch are in the manifest."""
        return self._entries(list(state.batches))

    def load(self, hits: DataFrame) -> DataFrame:
        """Stored entries of the hits, with the order that files have now."""
        rows = self._entries(list(self.base.batches)).where("error IS NULL").drop("file_ord")
        return rows.join(hits, ["file_path", "batch"]).select(*EXTRACTED.names)

    def store(self, files: DataFrame, extracted: DataFrame, formulas: bool) -> DataFrame:
        """Write what was extracted from the files as the newest state; returns it as read from the cache (with failures as rows)."""
        count = files.count()
        if not count:
            return self.spark.createDataFrame([], EXTRACTED)
        batch = uuid.uuid4().hex
        where = f"{self.folder}/entries/batch={batch}"
        extracted.write.parquet(where)
        rows = self.spark.read.schema(EXTRACTED).parquet(where)
        failed = rows.where("error IS NOT NULL").groupBy("file_path").agg(F.min("error").alias("error"))
        done = files.select("file_path", "modified").join(failed, "file_path", "left")
        done = done.select("file_path", "modified", F.lit(formulas).alias("formulas"), F.lit(self.labels).alias("labels"), F.lit(self.target).alias("target"), "error", F.lit(batch).alias("batch"))
        kept = self._manifest(self.base).join(files.select("file_path"), "file_path", "left_anti").select(*done.columns)
        self.base = self.commit(self.base, kept.unionAll(done), {**self.base.batches, batch: count})
        return rows

    def clear(self) -> None:
        """Forget what searches of this target have stored; its entries go with the next compaction."""
        state = self.state()
        if state.manifest is not None:
            left = self._manifest(state).where(~F.col("target").eqNullSafe(F.lit(self.target)))
            alive = {r["batch"] for r in left.select("batch").distinct().collect()}  # a row for each batch
            self.commit(state, left, {b: n for b, n in state.batches.items() if b in alive})
