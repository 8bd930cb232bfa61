"""Large text files by ranges of bytes, so that several tasks read one file and none holds it whole.

A range has the lines that begin in it; the last of them is read on beyond its end. A line begins at the start of the file, after a
line feed, and after a carriage return that no line feed follows. Ranges begin at multiples of four bytes, so that the units of UTF-16 and
UTF-32 are never cut; in UTF-8 and Shift_JIS the bytes of the two line ends are part of no other character. A first pass
counts the lines that begin in each range, sums of those give each range the lines before it, and a second pass reads. Counting looks at
bytes alone. A file's encoding is told from its first bytes, as for whole files.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import PROBE_BYTES, detect
from .formats.base import new_lines
from .listing import store

#: A line of more bytes is a failure of its file: it could not be a row.
LINE_BYTES = 1 << 30
_TAIL = 1 << 20
#: The width of a unit and the codec without a mark, by the detected encoding and the mark's byte order.
_UNITS = {"utf-16": ("u2", "utf-16-{}"), "utf-32": ("u4", "utf-32-{}")}


@contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    """A file whose bytes can be read from anywhere, by its path or URI."""
    if "://" in path:
        system, inside = store(path)
        with system.open_input_file(inside) as f:
            yield f
    else:
        with open(path, "rb") as f:
            yield f


class Range:
    """The lines of a file that begin at bytes from `a` on and before `b`."""

    def __init__(self, f: BinaryIO, a: int, b: int, strict_probe: bool = False):
        self.f, self.a, self.b = f, a, b
        head = f.read(PROBE_BYTES + 1)
        name = detect(head[:PROBE_BYTES], len(head) <= PROBE_BYTES, strict_probe)
        self.codec, self.unit, self.mark = name, np.dtype("u1"), 0
        if name in _UNITS:
            kind, codec = _UNITS[name]
            little = head[0] == 0xFF
            self.unit, self.codec = np.dtype(("<" if little else ">") + kind), codec.format("le" if little else "be")
            self.mark = self.unit.itemsize
        elif name == "utf-8-sig":
            self.codec, self.mark = "utf-8", 3

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _units(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw[: len(raw) // self.unit.itemsize * self.unit.itemsize], self.unit)

    def _begins(self, raw: bytes) -> np.ndarray:
        """Units of the bytes from just before the range on at which a line begins; the first of a file aside."""
        u = self._units(raw)
        return np.flatnonzero((u[:-1] == 10) | (u[:-1] == 13) & (u[1:] != 10)) + 1

    def _before(self) -> int:
        return self.unit.itemsize if self.a else 0

    def count(self) -> int:
        """The number of lines that begin here."""
        n, at, carry = int(self.a == 0), self.a - self._before(), b""
        while at < self.b:  # some megabytes at a time, with the last unit of those before
            raw = carry + self._read(at, min(_TAIL, self.b - at))
            if len(raw) == len(carry):
                break
            n += len(self._begins(raw))
            at += len(raw) - len(carry)
            carry = raw[len(raw) - self.unit.itemsize :]
        return n

    def lines(self) -> list[str]:
        """The lines, in their order."""
        raw = self._read(self.a - self._before(), self.b - self.a + self._before())
        if self.a:
            begins = self._begins(raw)
            if not len(begins):
                return []
            raw = raw[int(begins[0]) * self.unit.itemsize :]
        else:
            raw = raw[self.mark :]
        parts, size, at, units = [raw], len(raw), self.b, self._units(raw)
        while not (len(units) and units[-1] in (10, 13)) or len(units) * self.unit.itemsize < len(parts[-1]):
            more = self._read(at, _TAIL)
            if not more:
                break
            at += len(more)
            units = self._units(more)
            ends = np.flatnonzero((units == 10) | (units == 13))
            if len(ends):
                parts.append(more[: int(ends[0]) * self.unit.itemsize])
                break
            parts.append(more)
            size += len(more)
            if size > LINE_BYTES:
                raise ValueError(f"a line has more than {LINE_BYTES} bytes")
        found = new_lines(b"".join(parts).decode(self.codec, "replace"))
        return found[:-1] if found[-1] == "" else found


def _count(strict_probe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for path, a, b in zip(*(batch.column(c).to_pylist() for c in ("file_path", "a", "b")), strict=True):
                try:
                    with opened(path) as f:
                        counts.append(Range(f, a, b, strict_probe).count())
                except OSError:  # the task that reads the range will say so
                    counts.append(0)
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), batch.column("a"), pa.array(counts, pa.int64())], ["file_path", "a", "n"])

    return run


def cut(files: DataFrame, range_bytes: int, tasks: int, strict_probe: bool = False) -> DataFrame:
    """The ranges of large text files: their columns, a, b and the number of lines before. The listing is read twice."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("a")
    parts = files.select("*", at).withColumn("b", F.least(F.col("a") + range_bytes, "length"))
    counts = parts.select("file_path", "a", "b").repartition(tasks, "file_path", "a").mapInArrow(_count(strict_probe), "file_path string, a long, n long")
    upto = Window.partitionBy("file_path").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file_path", "a", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return parts.join(before, ["file_path", "a"])
