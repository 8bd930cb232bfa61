"""Fuzzy line deduplication by MinHash.

A line is what stands between line feeds; a blank one (ASCII white space only) is no line and always stays. Lines are compared
with A-Z as a-z, as sets of shingles of SHINGLE characters (a shorter line is one shingle). Lines with a Jaccard
similarity of at least THRESHOLD are linked, and of every component of links the first line, by doc_id and place, stays.

1. One pass gives every line a 128-bit BLAKE2 digest of its content, its key. Of the lines with one key in a flush the first
   goes on, with BANDS hashes of ROWS minima each; the others are repeats. What goes on is packed by bucket: keys by key,
   band hashes by band, so that few rows are shuffled. With 10 bands of 4 a pair at the threshold shares a band
   with probability 0.995, at 0.9 with 0.99997.
2. Where keys meet, the first place of each is found and the distinct line gets a number; where band hashes meet, different lines
   with one hash become a unit. A large group is cut into parts that meet pairwise, so no unit is unbounded. Equal
   member sets of several bands become one unit.
3. The text of one occurrence of each such line is looked up. Rows are sorted by unit, and a task goes through them unit by unit.
   Similarity is exact: shingles are compared as they are, as numbers of up to 63 bits. A signature of 1024 bits of each set
   bounds what two sets can share and spares most pairs of unlike lines; pairs that are joined already are not compared. A unit
   gives links that span its components, never all pairs.
4. Distributed union-find over the links, by number; the first occurrence of each component stays.

A null text has no lines and stays null. Rows with a null doc_id come first. Rows that agree in doc_id and text
count as one row and are treated alike. A text all of whose lines go becomes the blank lines it had, or the empty text.
Columns of any name pass through as they are, but text and n_chars (its length).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import Scratch, materialize, release, tasks, text_slices, trimmed, whole_groups
from .components import components

SHINGLE = 7
#: The least similarity, as a fraction.
THRESHOLD = (4, 5)
BANDS, ROWS = 10, 4
GROUP_LINES = 500
#: Lines that a task packs at a time, and lines that it compares at a time (one unit at least).
FLUSH_LINES = 60_000
CHUNK = 800
#: Characters whose hashes fit the processor's cache.
CACHE_CHARS = 50_000
NO_ID = -(1 << 63)
_ENTRY = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("doc", "<i8"), ("row", "<i8"), ("line", "<i4"), ("multi", "u1")])
_BAND = np.dtype([("band", "<u4"), ("k1", "<i8"), ("k2", "<i8")])
_BANDED = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("bands", "<u4", (BANDS,))])
_SENT = "bucket int, firsts binary, repeats binary, bands binary"
#: kind: 0 the first of each different line (id: its number, multi: it occurs again), 1 a later occurrence, 2 a member of a unit.
_MET = "kind byte, k1 long, k2 long, id long, multi boolean, doc_id long, row_key long, line_no int, unit long"


def functions() -> np.ndarray:
    """The odd multipliers of the hash functions x -> x * a modulo 2**32 of well mixed hashes x of shingles."""
    return np.random.default_rng(20).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place, start and end of every line that is not blank."""
    feed = data == 10
    starts, ends, _ = bv.spans(~feed, offs)
    some = bv.reduce_spans(np.logical_or, bv.NOT_SPACE[data], starts, ends, False)
    starts, ends = starts[some], ends[some]
    text = np.searchsorted(offs, starts, side="right") - 1
    feeds = np.flatnonzero(feed)
    return text, np.searchsorted(feeds, starts) - np.searchsorted(feeds, offs[text]), starts, ends


def characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, SHINGLE zeros after them, and the spans of bytes as spans of code points."""
    begins = (data & 0xC0) != 0x80
    if begins.all():
        points = data.astype(np.uint32)
    else:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        upto = np.append(0, np.cumsum(begins))
        starts, ends = upto[starts], upto[ends]
    return np.append(points, np.zeros(SHINGLE, np.uint32)), starts, ends


def shingle_hashes(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the shingle at each code point; of a line of less than SHINGLE the first is that of the line."""
    n = len(points) - SHINGLE
    short = np.flatnonzero(hi - lo < SHINGLE)
    rows = np.where(np.arange(SHINGLE) < (hi - lo)[short, None], points[np.minimum(lo[short, None] + np.arange(SHINGLE), n)], 0)
    out, few = np.zeros(n, np.uint32), np.zeros(len(short), np.uint32)
    for j in range(SHINGLE):
        out *= np.uint32(0x01000193)
        out += points[j : n + j]
        few = few * np.uint32(0x01000193) + rows[:, j].astype(np.uint32)
    out[lo[short]] = few
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        out ^= out >> np.uint32(shift)
        out *= np.uint32(times)
    return out


def band_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, BANDS) hashes of the minima of each line's shingles. The lines ascend."""
    points, lo, hi = characters(data, starts, ends)
    h = shingle_hashes(points, lo, hi)
    stop = np.maximum(hi - SHINGLE + 1, lo + 1)
    times = functions()
    minima = np.empty((len(times), len(lo)), np.uint32)
    at = 0
    while at < len(lo):  # as many lines as fit the processor's cache
        to = max(at + 1, int(np.searchsorted(stop, lo[at] + CACHE_CHARS)))
        part = h[lo[at] : stop[to - 1] + 1]
        edges = np.stack([lo[at:to], stop[at:to]], 1).reshape(-1) - lo[at]
        edges = edges[:-1] if edges[-1] >= len(part) else edges
        mixed = np.empty_like(part)
        for k in range(len(times)):
            np.multiply(part, times[k], out=mixed)
            minima[k, at:to] = np.minimum.reduceat(mixed, edges)[0::2]
        at = to
    out = np.empty((len(lo), BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(len(lo), b + 1, np.uint64)
        for r in range(ROWS):
            value = bv.mix(value * np.uint64(0x9E3779B97F4A7C15) + minima[b * ROWS + r])
        out[:, b] = value
    return out


def entry_order(x: np.ndarray) -> np.ndarray:
    return np.lexsort((x["line"], x["row"], x["doc"], x["k2"], x["k1"]))


def first_of_each(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first entry of each key (multi: there were more), and the later ones. Entries of one place, which repeated rows give, are one."""
    x = x[entry_order(x)]
    same_key = np.append(False, (x["k1"][1:] == x["k1"][:-1]) & (x["k2"][1:] == x["k2"][:-1]))[: len(x)]
    again = same_key & np.append(False, (x["doc"][1:] == x["doc"][:-1]) & (x["row"][1:] == x["row"][:-1]) & (x["line"][1:] == x["line"][:-1]))[: len(x)]
    head = np.flatnonzero(~same_key)
    firsts = x[head]
    if len(x):
        firsts["multi"] = np.maximum.reduceat(np.maximum(x["multi"], same_key & ~again), head)
    return firsts, x[same_key & ~again]


def distinct(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Places of one of each different key."""
    order = np.lexsort((k2, k1))
    return order[np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))[: len(order)]]


def by_bucket(to: np.ndarray, x: np.ndarray, buckets: int) -> list[bytes]:
    order = np.argsort(to.astype(np.uint16) if buckets < 1 << 16 else to, kind="stable")  # 16 bits are sorted by radix
    x, edges = x[order], np.searchsorted(to[order], np.arange(buckets + 1)).tolist()
    return [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _send(buckets: int):
    """Lines by bucket, packed: one row for each bucket and flush."""
    n = np.uint64(buckets)

    def flush(entries: list[np.ndarray], bands: list[np.ndarray]) -> pa.RecordBatch:
        firsts, repeats = first_of_each(np.concatenate(entries))
        band = np.concatenate(bands)
        band = band[distinct(band["k1"], band["k2"])]
        rows = np.empty((len(band), BANDS), _BAND)
        rows["band"], rows["k1"], rows["k2"] = band["bands"], band["k1"][:, None], band["k2"][:, None]
        band = rows.reshape(-1)
        columns = [
            by_bucket((firsts["k1"].view(np.uint64) % n).astype(np.int32), firsts, buckets),
            by_bucket((bv.mix(repeats["row"].astype(np.uint64)) % n).astype(np.int32), repeats, buckets),
            by_bucket((band["band"].astype(np.uint64) % n).astype(np.int32), band, buckets),
        ]
        some = [k for k in range(buckets) if any(c[k] for c in columns)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([c[k] for k in some], pa.binary()) for c in columns)], ["bucket", "firsts", "repeats", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, bands, count = [], [], 0
        for batch in batches:
            for a, b in text_slices(batch, "text", 1_000_000):
                part = batch.slice(a, b - a)
                data, offs = bv.buffers(part.column("text"))
                data = bv.LOWER[data]
                text, place, starts, ends = line_spans(data, offs)
                if len(starts) == 0:
                    continue
                raw = memoryview(data.tobytes())
                keys = b"".join(blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(starts.tolist(), ends.tolist(), strict=True))
                x = np.zeros(len(starts), _ENTRY)
                x["k1"], x["k2"] = np.frombuffer(keys, "<i8").reshape(-1, 2).T
                x["doc"], x["row"] = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "row_key"))
                x["line"] = place
                new = np.sort(distinct(x["k1"], x["k2"]))
                band = np.empty(len(new), _BANDED)
                band["bands"] = band_hashes(data, starts[new], ends[new]) >> np.uint64(32)
                band["k1"], band["k2"] = x["k1"][new], x["k2"][new]
                entries.append(x)
                bands.append(band)
                count += len(x)
                if count >= FLUSH_LINES:
                    yield flush(entries, bands)
                    entries, bands, count = [], [], 0
        if count:
            yield flush(entries, bands)

    return run


def units_of(band: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, k1, k2): different lines with one band hash; units of equal members have equal names."""
    if len(band) == 0:  # a bucket of lines whose hashes all went elsewhere
        return band["k1"], band["k1"], band["k2"]
    order = np.argsort(band["band"], kind="stable")
    same = band["band"][order][1:] == band["band"][order][:-1]
    order = order[np.append(False, same) | np.append(same, False)]  # all others are alone
    band = band[order]
    band = band[np.lexsort((band["k2"], band["k1"], band["band"]))]
    new = np.append(True, np.any([band[c][1:] != band[c][:-1] for c in band.dtype.names], axis=0))[: len(band)]
    band = band[new]
    head = np.flatnonzero(np.append(True, band["band"][1:] != band["band"][:-1])[: len(band)])
    sizes = np.diff(np.append(head, len(band)))
    group = np.repeat(np.arange(len(sizes)), sizes)
    some = sizes[group] > 1
    band, group, size = band[some], group[some], sizes[group][some]
    mixed = bv.mix(band["k1"].view(np.uint64) ^ bv.mix(band["k2"].view(np.uint64).copy()))
    parts = -(-size // limit)
    own = (mixed % parts.astype(np.uint64)).astype(np.int64)
    row = np.repeat(np.arange(len(band)), parts)
    other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    low, high = np.minimum(own[row], other), np.maximum(own[row], other)
    order = np.lexsort((high, low, group[row]))
    row, low, high = row[order], low[order], high[order]
    head = np.flatnonzero(np.append(True, (group[row][1:] != group[row][:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(row)])
    sizes = np.diff(np.append(head, len(row)))
    name = bv.mix(np.add.reduceat(mixed[row], head) + sizes.astype(np.uint64)) if len(row) else np.zeros(0, np.uint64)
    keep = np.repeat(sizes > 1, sizes)
    return np.repeat(name.view(np.int64), sizes)[keep], band["k1"][row][keep], band["k2"][row][keep]


def _met(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"kind": pa.int8(), "k1": pa.int64(), "k2": pa.int64(), "id": pa.int64(), "multi": pa.bool_(), "doc_id": pa.int64(), "row_key": pa.int64(), "line_no": pa.int32(), "unit": pa.int64()}
    columns["kind"] = np.full(n, kind, np.int8)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))


def _meet(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[list, list, list] = ([], [], [])
        bucket = 0
        for batch in batches:
            for k, (column, kind) in enumerate((("firsts", _ENTRY), ("repeats", _ENTRY), ("bands", _BAND))):
                got[k].extend(np.frombuffer(x, kind) for x in batch.column(column).to_pylist())
            bucket = batch.column("bucket")[0].as_py()
        if not got[0]:
            return
        firsts, later = first_of_each(np.concatenate(got[0]))
        x = firsts
        yield _met(0, len(x), k1=x["k1"], k2=x["k2"], id=(bucket << 36) + np.arange(len(x)), multi=x["multi"] > 0, doc_id=x["doc"], row_key=x["row"], line_no=x["line"])
        for x in (*got[1], later):
            if len(x):
                yield _met(1, len(x), k1=x["k1"], k2=x["k2"], doc_id=x["doc"], row_key=x["row"], line_no=x["line"])
        unit, k1, k2 = units_of(np.concatenate(got[2]), limit)
        del got, firsts, later
        for lo in range(0, len(unit), 100_000):
            part = slice(lo, lo + 100_000)
            yield _met(2, len(unit[part]), k1=k1[part], k2=k2[part], unit=unit[part])

    return run


class Sets:
    """The shingles of lines as sorted distinct numbers, and a signature of each set."""

    def __init__(self, lines: list[str]):
        points = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
        points = np.where((points >= 65) & (points <= 90), points + 32, points)
        sizes = np.array([len(x) for x in lines], np.int64)
        lo = np.cumsum(sizes) - sizes
        used = np.zeros(int(points.max(initial=0)) + 1, bool)
        used[points] = True
        rank = np.append(np.cumsum(used)[points], np.zeros(SHINGLE, np.int64)).astype(np.uint64)  # 0: beyond the end
        n, count = len(points), np.maximum(sizes - SHINGLE + 1, 1)
        bits = np.uint64(9)
        short = np.flatnonzero(sizes < SHINGLE)
        if int(used.sum()) < 1 << 9:
            value = np.zeros(n, np.uint64)
            for j in range(SHINGLE):
                value = (value << bits) | rank[j : n + j]
            drop = bits * (SHINGLE - sizes[short]).astype(np.uint64)
            value[lo[short]] = value[lo[short]] >> drop << drop
        else:  # many different characters: shingles are numbered by sorting them whole
            table = np.stack([rank[j : n + j] for j in range(SHINGLE)], 1).astype(">u4")
            for i in short.tolist():
                table[lo[i], sizes[i] :] = 0
            value = np.unique(np.ascontiguousarray(table).view(f"V{4 * SHINGLE}")[:, 0], return_inverse=True)[1].astype(np.uint64)
        begin = np.cumsum(count) - count
        line = np.repeat(np.arange(len(lines)), count)
        value = value[np.arange(len(line)) + (lo - begin)[line]]
        for a, b in zip(begin.tolist(), (begin + count).tolist(), strict=True):
            value[a:b].sort()
        new = np.append(True, (value[1:] != value[:-1]) | (line[1:] != line[:-1]))[: len(value)]
        self.values, line = value[new], line[new]
        self.edges = np.searchsorted(line, np.arange(len(lines) + 1))
        self.sizes = np.diff(self.edges)
        marks = np.zeros((len(lines), 1024), bool)
        marks[line, (bv.mix(self.values.copy()) >> np.uint64(54)).astype(np.intp)] = True
        self.signature = np.packbits(marks, axis=1).view(np.uint64)

    def possible(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        """Whether the signatures allow a[i] and b[i] to be similar: what only one signature has is not shared."""
        x, y = self.signature[a], self.signature[b]
        only_x, only_y = (np.bitwise_count(p & ~q).sum(axis=-1, dtype=np.int64) for p, q in ((x, y), (y, x)))
        n, m = self.sizes[a], self.sizes[b]
        both = np.minimum(n - only_x, m - only_y)
        return THRESHOLD[1] * both >= THRESHOLD[0] * (n + m - both)

    def similar(self, a: int, b: int) -> bool:
        e = self.edges
        both = np.concatenate((self.values[e[a] : e[a + 1]], self.values[e[b] : e[b + 1]]))
        union = len(both)
        both.sort()
        both = int(np.count_nonzero(both[1:] == both[:-1]))
        return THRESHOLD[1] * both >= THRESHOLD[0] * (union - both)

    def links(self, a: int, b: int) -> list[tuple[int, int]]:
        """Links that span the components of the lines from a to b."""
        tree = np.arange(a, b)
        found = []
        for i in range(a, b - 1):
            others = np.arange(i + 1, b)
            others = others[tree[i + 1 - a :] != tree[i - a]]
            for j in others[self.possible(others, i)].tolist():
                if tree[j - a] != tree[i - a] and self.similar(i, j):
                    found.append((i, j))
                    tree[tree == tree[j - a]] = tree[i - a]
            if (tree == tree[0]).all():
                break
        return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) within each unit. Rows come sorted by unit."""
    for rows in whole_groups(batches, "unit", CHUNK):
        unit, ids = rows.column("unit").to_numpy(), rows.column("id").to_numpy()
        sets = Sets(rows.column("line").to_pylist())
        head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        edges = np.append(head, len(unit)).tolist()
        first = np.repeat(head, np.diff(edges))
        may = sets.possible(np.arange(len(unit)), first)
        found = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a == 2:
                found += [(a, a + 1)] if may[a + 1] and sets.similar(a, a + 1) else []
            else:
                found += sets.links(a, b)
        u, v = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked lines of each text."""
    for part in (batch.slice(a, b - a) for batch in batches for a, b in text_slices(batch, "text")):
        rows, lines = [], []
        for text, asked in zip(part.column("text").to_pylist(), part.column("asked").to_pylist(), strict=True):
            all_lines = text.split("\n")
            rows += asked
            lines += [all_lines[x["line_no"]] for x in asked]
        yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in rows], pa.int64()) for c in ("k1", "k2", "id")), pa.array(lines, pa.string())], ["k1", "k2", "id", "line"])


def removals(documents: DataFrame, group_lines: int = GROUP_LINES) -> DataFrame:
    """(doc_id, row_key, removed) of every text that loses a line. documents: doc_id (NO_ID for null), row_key, text.

    removed: for each line that goes its place, and doc_id and place of the first line of its component.
    """
    spark = documents.sparkSession
    scratch, n = Scratch(spark, "lines"), tasks(spark)
    sent = documents.where("text IS NOT NULL").mapInArrow(trimmed(_send(n)), _SENT).repartitionById(n, F.col("bucket"))
    met = scratch.keep(sent.mapInArrow(trimmed(_meet(group_lines)), _MET), "met")
    release(spark)
    units = scratch.keep(met.where("kind = 2").select("unit", "k1", "k2").distinct(), "units")
    place = F.struct("doc_id", "row_key", "line_no")
    firsts = met.where("kind = 0").select("k1", "k2", "id", "multi", place.alias("place"))
    found = scratch.keep(firsts.join(units.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi"), "candidates")
    asked = found.groupBy("place.row_key", "place.doc_id").agg(F.collect_list(F.struct("place.line_no", "k1", "k2", "id")).alias("asked"))
    texts = documents.join(asked, ["row_key", "doc_id"]).select("text", "asked")
    texts = scratch.keep(texts.mapInArrow(trimmed(_texts), "k1 long, k2 long, id long, line string"), "texts")
    release(spark)
    rows = units.join(texts, ["k1", "k2"]).select("unit", "id", "line").repartition(n, "unit").sortWithinPartitions("unit", "id")
    trees = components(rows.mapInArrow(trimmed(_verify), "u long, v long"), "line-links")
    linked = found.join(trees.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    linked = scratch.keep(linked.join(trees.select("root").distinct(), "root", "left_semi"), "linked")
    best = scratch.keep(linked.groupBy("root").agg(F.min("place").alias("best")), "best")
    named = scratch.keep(linked.join(best, "root").select("k1", "k2", "multi", "place", "best"), "named")
    alone = firsts.where("multi").join(named.where("multi").select("k1", "k2"), ["k1", "k2"], "left_anti").select("k1", "k2", F.col("place").alias("best"))
    kept = named.where("multi").select("k1", "k2", "best").unionAll(alone)
    later = met.where("kind = 1").join(kept, ["k1", "k2"]).select(place.alias("place"), "best")
    gone = later.unionAll(named.where("place <> best").select("place", "best"))
    gone = gone.groupBy("place.doc_id", "place.row_key").agg(F.sort_array(F.collect_set(F.struct("place.line_no", F.col("best.doc_id").alias("first_doc"), F.col("best.line_no").alias("first_line")))).alias("removed"))
    gone = materialize(gone, "line-removals")
    scratch.clear()
    return gone


_REMOVED = "array<struct<line_no:int,first_doc:bigint,first_line:int>>"


def marked(documents: DataFrame, group_lines: int = GROUP_LINES) -> DataFrame:
    """(d, removed): every row of the documents as a struct, and its lines that go (an empty array if none does)."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row_key")
    gone = removals(documents.select(number, row, "text"), group_lines)
    rows = documents.select(number, row, F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d")).join(gone, ["row_key", "doc_id"], "left")
    return rows.select("d", F.coalesce("removed", F.array().cast(_REMOVED)).alias("removed"))


def remaining(text: F.Column, removed: F.Column) -> F.Column:
    """The text without the removed lines."""
    gone = removed["line_no"]
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(kept, "\n"))


def deduplicated(documents: DataFrame, group_lines: int = GROUP_LINES) -> DataFrame:
    """The documents, all columns as they were but text, which lacks the lines that go, and n_chars."""
    text = remaining(F.col("d.text"), F.col("removed"))
    new = {"text": text}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.length(text).cast(documents.schema["n_chars"].dataType)
    return marked(documents, group_lines).select(*[new.get(c, F.col("d")[c]).alias(c) for c in documents.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the number of lines, those removed, their places, the first line of the component of each, and the text left.

    removed: places joined by commas; first_lines: doc_id:place, in the same order.
    """
    rows = marked(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumnRenamed("removed", "gone")
    text = F.coalesce("d.text", F.lit(""))
    n_lines = F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))).cast("long")
    first = lambda r: F.concat_ws(":", F.coalesce(F.nullif(r["first_doc"], F.lit(NO_ID)).cast("string"), F.lit("")), r["first_line"].cast("string"))
    return rows.select(
        "d.doc_id", n_lines.alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        F.array_join(F.col("gone.line_no").cast("array<string>"), ",").alias("removed"), F.array_join(F.transform("gone", first), ",").alias("first_lines"),
        F.sha2(remaining(text, F.col("gone")).cast("binary"), 256).alias("kept_sha256"),
    )
