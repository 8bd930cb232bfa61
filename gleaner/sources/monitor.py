"""Progress and interruption of a search while its tasks run.

Tasks count the files they have read; a count reaches the driver when its task ends, so a reading thread sees it rise while an
action runs. Before each file a task looks for a marker in the shared folder; once it is there no further file is opened.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from .listing import store


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the session names none and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Monitor:
    """Sent to tasks with the plan; `files` and `stop` are for the driver."""

    def __init__(self, spark: SparkSession, marker: str | None = None):
        self.marker = marker or f"{shared_dir(spark)}/stop-{uuid.uuid4().hex}"
        self._files = spark.sparkContext.accumulator(0)

    @property
    def files(self) -> int:
        """Files that tasks have read to their end, in tasks that have ended; a large text counts with its first range."""
        return self._files.value

    def stop(self) -> None:
        """No task opens a further file from now on."""
        system, path = self._where()
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as f:
            f.write(b"stop")

    def clear(self) -> None:
        system, path = self._where()
        if system.get_file_info(path).type == pafs.FileType.File:
            system.delete_file(path)

    # in tasks

    def _where(self) -> tuple[pafs.FileSystem, str]:
        found = store(self.marker) if "://" in self.marker else (pafs.LocalFileSystem(), self.marker)
        if found is None:
            raise ValueError(f"the marker {self.marker} lies in a store that tasks cannot see")
        return found

    def stopped(self) -> bool:
        system, path = self._where()
        return system.get_file_info(path).type == pafs.FileType.File

    def read(self, start: int | None) -> None:
        """A file, or the range of a file that begins at `start`, is done."""
        if not start:
            self._files.add(1)
