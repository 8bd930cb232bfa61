"""Listing of a folder tree, in rounds of tasks for a search, or as a data source: `spark.read.format("folder")`, `spark.readStream.format("folder")`.

Spark's own file sources leave out names that begin with a dot or an underscore, and their streams do not see that a file has changed; these do.
Tasks must see the folder.

Rounds: the folders that are still to be listed are a table. Each task takes its share of it, goes down depth first through a
bounded number of folders, and gives back those it did not reach, for the next round. So a tree of any shape, one long chain too, is dealt to
tasks anew again and again, and the driver sees no path but the first.

The source deals a tree once: its upper levels are listed first, until there are some dozens of folders. Its stream lists in tasks as
well: an offset is the number of a listing, each task keeps what it has seen of its folders in the `state` folder, and gives what is new or has another
time or size since the listing before. A listing that is there is not made again, so a repeated batch has the same rows.

A path is local, or a URI that Arrow's file systems know (s3, gs, hdfs, file and others), which tasks list and read themselves.
Other URIs are left to Spark's binary file source, and so without hidden names.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import extension
from ..spec import SearchSpec

SCHEMA = "file_path string, ext string, modified timestamp, length long, file_ord long"


def extension_of(name: str) -> str:
    """From the last dot on, in lower case; a name that begins with its only dot is all extension."""
    dot = name.rfind(".")
    return name[dot:].lower() if dot >= 0 and dot < len(name) - 1 else ""


def skipped(folder: str, skip: list[str]) -> bool:
    """Whether a folder lies in one of `skip` (with final separators), whatever their case."""
    folder = (folder.rstrip(os.sep) + os.sep).lower()
    return any(folder.startswith(s.lower()) for s in skip)


def store(uri: str) -> tuple[pafs.FileSystem, str] | None:
    """Arrow's file system of a URI and the path in it; None if it knows none."""
    try:
        return pafs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def scan(top: str, skip: list[str]) -> tuple[list[str], list[tuple[str, datetime, int]]]:
    """Folders and files (path, time, size) in a folder, by name; what cannot be read is passed over, links to folders are not followed."""
    folders, found = [], []
    if "://" in top:
        system, path = store(top)
        for x in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            name = f"{top.rstrip('/')}/{x.base_name}"
            if x.type == pafs.FileType.Directory:
                folders.append(name)
            elif x.type == pafs.FileType.File:
                found.append((name, x.mtime or datetime.fromtimestamp(0, timezone.utc), x.size or 0))
    else:
        try:
            with os.scandir(top) as entries:
                for e in entries:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            folders.append(e.path)
                        elif not e.is_dir():
                            stat = e.stat()
                            found.append((e.path, datetime.fromtimestamp(stat.st_mtime, timezone.utc), stat.st_size))
                    except OSError:
                        continue
        except OSError:
            return [], []
    return sorted(f for f in folders if not skipped(f, skip)), sorted(found)


def walk(top: str, skip: list[str], deep: bool = True) -> Iterator[tuple[str, datetime, int]]:
    """Files of a tree, those of a folder before those of the folders in it."""
    waiting = [top]
    while waiting:
        folders, found = scan(waiting.pop(), skip)
        yield from found
        waiting += reversed(folders) if deep else []


class Part(InputPartition):
    def __init__(self, number: int, top: str, deep: bool):
        self.number, self.top, self.deep = number, top, deep


#: Folders that are enough to keep tasks busy, and levels that are listed first at most.
FOLDERS, LEVELS = 64, 4


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/") or "/"
        self.include: list[str] = json.loads(options.get("include", "[]"))
        self.exclude: list[str] = json.loads(options.get("exclude", "[]"))
        self.skip: list[str] = json.loads(options.get("skip", "[]"))

    def partitions(self) -> list[InputPartition]:
        if "://" not in self.root and not os.path.isdir(self.root):
            raise ValueError(f"the folder {self.root} cannot be listed")
        return [Part(k, *p) for k, p in enumerate(self.dealt())]

    def dealt(self) -> list[tuple[str, bool]]:
        """Folders that are a part alone, and those that are one with all below."""
        flat, deep = [], [self.root]
        for _ in range(LEVELS):
            if len(deep) >= FOLDERS:
                break
            flat += deep
            deep = [f for top in deep for f in scan(top, self.skip)[0]]
        return sorted([(f, False) for f in flat] + [(f, True) for f in deep])

    def wanted(self, path: str) -> str | None:
        """The extension of a file that is searched."""
        ext = extension_of(path.rsplit("/", 1)[-1])
        return None if ext in self.exclude or (self.include and ext not in self.include) else ext

    def read(self, part: Part) -> Iterator[tuple]:
        for n, (path, modified, size) in enumerate(walk(part.top, self.skip, part.deep)):
            ext = self.wanted(path)
            if ext is not None:
                yield path, ext, modified, size, (part.number << 32) + n


class StreamPart(InputPartition):
    def __init__(self, number: int, top: str, deep: bool, start: int, end: int):
        self.number, self.top, self.deep, self.start, self.end = number, top, deep, start, end


class FolderStream(DataSourceStreamReader):
    """Each batch is a listing. The parts of the tree stay as they are first dealt; new folders beside them become parts of their own."""

    def __init__(self, options: dict[str, str]):
        self.tree = FolderReader(options)
        self.state = options["state"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        made = [int(n.removeprefix("listing=")) for n in _names(self.state) if n.startswith("listing=")]
        return {"listing": max(made, default=0) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["listing"], end["listing"]
        if a == b:
            return []
        parts = _load(f"{self.state}/listing={b}/parts")
        if parts is None:
            old = _load(f"{self.state}/listing={a}/parts")
            parts = self._grown(old) if old else self.tree.dealt()
            _save(f"{self.state}/listing={b}/parts", parts)
        return [StreamPart(k, top, deep, a, b) for k, (top, deep) in enumerate(parts)]

    def _grown(self, parts: list) -> list:
        """The parts of the last listing, and folders that have appeared in those that are listed alone."""
        known = {top for top, _ in parts}
        new = [f for top, deep in parts if not deep for f in scan(top, self.tree.skip)[0] if f not in known]
        return [*parts, *((f, True) for f in sorted(new))]

    def read(self, part: StreamPart) -> Iterator[tuple]:
        name = hashlib.md5(f"{part.deep} {part.top}".encode()).hexdigest()
        now = _load(f"{self.state}/listing={part.end}/{name}")
        if now is None:
            listed = ((p, m, s) for p, m, s in walk(part.top, self.tree.skip, part.deep) if self.tree.wanted(p) is not None)
            _save(f"{self.state}/listing={part.end}/{name}", [[p, int(m.timestamp() * 1_000_000), s] for p, m, s in listed])
            now = _load(f"{self.state}/listing={part.end}/{name}")  # of two tasks at once the first counts
        seen = {p: (m, s) for p, m, s in _load(f"{self.state}/listing={part.start}/{name}") or ()}
        for n, (path, micros, size) in enumerate(now):
            if seen.get(path) != (micros, size):
                yield path, extension_of(path.rsplit("/", 1)[-1]), datetime.fromtimestamp(micros / 1_000_000, timezone.utc), size, (part.end << 48) + (part.number << 32) + n

    def commit(self, end: dict) -> None:
        for name in _names(self.state):
            if name.startswith("listing=") and int(name.removeprefix("listing=")) < end["listing"]:
                system, path = _where(f"{self.state}/{name}")
                system.delete_dir(path)


def _where(path: str) -> tuple[pafs.FileSystem, str]:
    found = store(path) if "://" in path else (pafs.LocalFileSystem(), path)
    if found is None:
        raise ValueError(f"{path} lies in a store that tasks cannot see")
    return found


def _names(folder: str) -> list[str]:
    system, path = _where(folder)
    return [x.base_name for x in system.get_file_info(pafs.FileSelector(path, allow_not_found=True))]


def _load(path: str):
    system, inside = _where(path)
    try:
        with system.open_input_stream(inside) as f:
            return json.loads(gzip.decompress(f.read()))
    except FileNotFoundError:
        return None


def _save(path: str, value) -> None:
    """Written whole or not at all; what is there stays."""
    system, inside = _where(path)
    system.create_dir(inside.rpartition("/")[0], recursive=True)
    draft = f"{inside}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as f:
        f.write(gzip.compress(json.dumps(value).encode()))
    if system.get_file_info(inside).type == pafs.FileType.NotFound:
        system.move(draft, inside)
    else:
        system.delete_file(draft)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(dict(self.options))


def options_of(spec: SearchSpec) -> dict[str, str]:
    return {"include": json.dumps(spec.included()), "exclude": json.dumps(spec.excluded()), "skip": json.dumps(spec.skipped_folders())}


#: Folders that a task lists in one round; so many files count as a folder more, so that large folders that lie together go to several tasks.
ROUND_FOLDERS, FOLDER_FILES = 1000, 10
#: Files that a task deletes, about.
DELETED_FILES = 20_000
_LISTED = "file_path string, ext string, modified timestamp, length long, folder string, todo boolean"
#: Folders of a tree, and files found in one: (path, extension, time, size).
Look = Callable[[str], tuple[list[str], list[tuple]]]


def _round(look: Look, limit: int):
    """Folders (folder) as the files below, and as folders for the next round once the task has listed `limit` of them."""

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.bool_()]
        columns = list(zip(*found, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_path", "ext", "modified", "length", "folder", "todo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, out = limit, []
        for batch in batches:
            waiting = batch.column("folder").to_pylist()[::-1]
            while waiting:
                folder = waiting.pop()
                if left <= 0:
                    out.append((None, None, None, None, folder, True))
                else:
                    folders, found = look(folder)
                    left -= 1 + len(found) // FOLDER_FILES
                    waiting += reversed(folders)
                    out += [(*f, folder, False) for f in found]
                if len(out) >= 10_000:
                    yield rows(out)
                    out = []
        yield rows(out)

    return run


def _listed(spark: SparkSession, root: str, look: Look, folder: str, limit: int) -> DataFrame:
    """What `look` gives for all folders of a tree, by rounds, each a table in `folder`."""
    todo, tables = spark.createDataFrame([(root,)], "folder string").coalesce(1), []
    while True:
        tables.append(f"{folder}/round={len(tables)}")
        todo.mapInArrow(_round(look, limit), _LISTED).write.parquet(tables[-1])
        todo = spark.read.schema(_LISTED).parquet(tables[-1]).where("todo").select("folder")
        waiting = todo.count()
        if not waiting:
            return spark.read.schema(_LISTED).parquet(*tables).where("NOT todo")
        # as many tasks as can begin all that waits, so that rounds grow with the depth of a tree and not with its folders
        todo = todo.repartition(max(spark.sparkContext.defaultParallelism * 2, -(-waiting // limit)))


def rounds(spark: SparkSession, spec: SearchSpec, folder: str, limit: int = ROUND_FOLDERS) -> DataFrame:
    """The files of a tree, listed by tasks in rounds, as a table in `folder`. file_ord: those of a folder by name, before those of the folders in it."""
    root = spec.root()
    if "://" not in root and not os.path.isdir(root):
        raise ValueError(f"the folder {root} cannot be listed")
    reader = FolderReader(options_of(spec) | {"path": ""})

    def look(folder: str) -> tuple[list[str], list[tuple]]:
        folders, found = scan(folder, reader.skip)
        return folders, [(p, ext, m, s) for p, m, s in found if (ext := reader.wanted(p)) is not None]

    found = _listed(spark, root, look, folder, limit)
    found = found.orderBy(F.split("folder", "/"), "file_path").select("file_path", "ext", "modified", "length", F.monotonically_increasing_id().alias("file_ord"))
    found.write.parquet(f"{folder}/files")
    return spark.read.schema(SCHEMA).parquet(f"{folder}/files")


def _within(top: str) -> tuple[list[str], list[tuple]]:
    """Folders in a folder; its files and the folder itself, whose extension is a separator."""
    folders, found = [], [(top, os.sep, None, None)]
    if "://" in top:
        system, path = store(top)
        for x in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            name = f"{top.rstrip('/')}/{x.base_name}"
            if x.type == pafs.FileType.Directory:
                folders.append(name)
            else:
                found.append((name, None, None, None))
    else:
        with os.scandir(top) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    folders.append(e.path)
                else:
                    found.append((e.path, None, None, None))
    return folders, found


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletes files, and folders that are empty, by their paths; gives how many it could not."""
    kept = 0
    for batch in batches:
        for path, ext in zip(batch.column("file_path").to_pylist(), batch.column("ext").to_pylist(), strict=True):
            try:
                if "://" in path:
                    system, inside = store(path)
                    (system.delete_dir if ext else system.delete_file)(inside)
                else:
                    (os.rmdir if ext else os.unlink)(path)
            except FileNotFoundError:  # by an attempt before
                continue
            except OSError:
                kept += 1
    yield pa.RecordBatch.from_arrays([pa.array([kept], pa.int64())], ["kept"])


def _delete(paths: DataFrame) -> int:
    """Delete files or empty folders by tasks. Returns how many could not be deleted. Of an empty table, such as the folders of a flat one, there may be no task, and so no sum."""
    return paths.mapInArrow(_gone, "kept long").agg(F.coalesce(F.sum("kept"), F.lit(0))).first()[0]


def emptied(spark: SparkSession, root: str, folder: str, limit: int = ROUND_FOLDERS) -> int:
    """Delete a tree by tasks, files first; `folder` is for the rounds of its listing. The root stays. Returns how many files and folders could not be deleted."""
    found = _listed(spark, root, _within, folder, limit).select("file_path", "ext")
    files = found.where("ext IS NULL")
    tasks = max(2 * spark.sparkContext.defaultParallelism, files.count() // DELETED_FILES)
    left = _delete(files.repartition(tasks))
    # folders of one branch by one task, the deepest first
    folders = found.where("ext IS NOT NULL").repartition(tasks, F.get(F.split("file_path", "/"), F.lit(root.rstrip("/").count("/") + 1)))
    left += _delete(folders.where(F.col("file_path") != F.lit(root)).sortWithinPartitions(F.length("file_path").desc()))
    return left


def only_by_spark(root: str) -> bool:
    """Whether tasks cannot list and read the target themselves."""
    return "://" in root and store(root) is None


def files(spark: SparkSession, spec: SearchSpec) -> DataFrame:
    """Files that a search reads: (file_path, ext, modified, length, file_ord), and content where Spark alone can read them."""
    root = spec.root()
    if only_by_spark(root):
        return filtered(opened(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)), spec)
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").options(**options_of(spec)).load(root)


def arriving(spark: SparkSession, spec: SearchSpec, state: str) -> DataFrame:
    """A stream of the files of the target, new and changed ones in each batch; `state` is a folder that all tasks see."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("folder").options(**options_of(spec), state=state.removeprefix("file://")).load(spec.root())


def opened(found: DataFrame) -> DataFrame:
    """Files of Spark's binary source (path, modificationTime, length, content) as readers take them."""
    path = F.regexp_replace("path", "^file:(//)?", "")
    return found.select(path.alias("file_path"), extension("path").alias("ext"), F.col("modificationTime").alias("modified"), "length", F.xxhash64("path").alias("file_ord"), "content")


def filtered(found: DataFrame, spec: SearchSpec) -> DataFrame:
    """Without files in skipped folders, of excluded extensions, and of others than those included."""
    for x in spec.skipped_folders():
        found = found.where(~F.startswith(F.lower("file_path"), F.lit(x.lower())))
    if spec.excluded():
        found = found.where(~F.col("ext").isin(*spec.excluded()))
    return found if spec.include_all else found.where(F.col("ext").isin(*spec.included()))


def content(path: str) -> bytes:
    """The bytes of a file, by its path or URI."""
    if "://" in path:
        system, inside = store(path)
        with system.open_input_stream(inside) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()
