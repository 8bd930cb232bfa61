"""Vectorised work on the UTF-8 bytes of many texts at once.

Texts are held as one byte buffer with offsets, as Arrow holds them. Hashes of substrings come from prefix
sums of a polynomial modulo 2**64, so that the hash of any span costs two look-ups whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomials and their inverses modulo 2**64.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 booleans, true within the ranges (both ends included)."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
WORDLY = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: a-z for A-Z, every other byte for itself
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each text within them; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, width, len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(inside: np.ndarray, offs: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes within each text, and of each text its first run's number.

    cuts: places of bytes within runs at which a new run starts nevertheless."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    begin = offs[:-1][offs[:-1] < n]
    before[begin] = False
    if cuts is not None:
        before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offs[1:]
    after[last[last > 0] - 1] = False
    if cuts is not None:
        after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        m = MULTIPLIERS[which]
        out = []
        for x in (m, pow(m, -1, 1 << 64)):
            a = np.full(size, x, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = (out[0], out[1])
        if size <= 1 << 23:
            _powers[which] = have
    return have[0][:n], have[1][:n]


class Prefix:
    """Hashes of spans of a byte buffer."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        p, self.inverse = powers(n + 1, which)
        self.sums = np.zeros(n + 1, U64)
        terms = data.astype(U64)
        terms += U64(1)
        terms *= p[:n]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One well mixed 64-bit hash for each span."""
        h = self.sums[ends]
        h -= self.sums[starts]
        h *= self.inverse[starts]
        return mix(h)

    def windows(self, k: int) -> np.ndarray:
        """The hash of every window of k bytes."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.inverse[: len(h)]
        return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def reduce_spans(ufunc: np.ufunc, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, empty) -> np.ndarray:
    """ufunc over values[starts[i]:ends[i]]; `empty` where the range is empty. Ranges ascend and do not overlap."""
    out = np.full(len(starts), empty, values.dtype)
    full = np.flatnonzero(ends > starts)
    if len(full):
        edges = np.empty(2 * len(full), np.int64)
        edges[0::2] = starts[full]
        edges[1::2] = ends[full]
        if edges[-1] >= len(values):
            values = np.append(values, values[-1:])
        out[full] = ufunc.reduceat(values, edges)[0::2]
    return out


def segment_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values[offs[i]:offs[i+1]]."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]
