"""Benchmark decontamination by Wu-Manber search for many patterns at once.

The alphabet is words: runs of digits, a-z (A-Z lower-cased) and bytes above 127. A pattern is a window of WINDOW
consecutive words of a benchmark item, or a whole shorter item; patterns of one length form a class with tables of its
own. Over the words of a document a cursor stands at the last word of a possible occurrence. The hash of the block of
the last two words leads to the shift table, which says how many words can be skipped. Where the shift is zero the block
names a bucket: the patterns that end in it, sorted by the hash of their other words, their prefix. Those with the
prefix of the text are compared with it byte by byte. Cursors of many stretches of text move at once, in numpy. Hashes
choose only what is compared; bytes decide.

The patterns are arrays over one buffer of item text, about ten times its size, built once in each worker process. Items are sent
in blocks of at most `block_bytes` of text (a longer item is a block alone), so what is broadcast and held at once has a fixed bound.
With more blocks there is one pass over the rows for each; of all but the last only the rows with an occurrence are written, without their texts, and the last
pass is joined with them.

A word is hit if it lies in any occurrence. A null text or item has no words; items without words never occur. Repeated
item ids count once. Repeated documents each get a row. Other columns are ignored, and kept by decontaminated().
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bytesvec as bv
from .common import materialize, slices, trimmed

WINDOW = 10
BLOCK_BYTES = 16_000_000
#: Words between the cursors that start in one text.
STRETCH = 256
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


@dataclass
class Words:
    """The words of many texts: hashes, places in the lower-cased bytes, and each text's range of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, arr: pa.Array) -> Words:
        data, offs = bv.buffers(arr)
        data = bv.LOWER[data]
        starts, ends, first = bv.spans(bv.WORDLY[data], offs)
        return cls(data, starts, ends, first, bv.Prefix(data).of(starts, ends) if len(starts) else np.zeros(0, np.uint64))

    def squeezed(self) -> Words:
        """The same words with one blank after each and nothing else, so that a window is a range of bytes."""
        sizes = self.ends - self.starts
        ends = np.cumsum(sizes + 1) - 1
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = self.data[bv.WORDLY[self.data]]
        return Words(out, ends - sizes, ends, self.first, self.hashes)

    def sequence(self, at: int, n: int) -> bytes:
        """The n words from number `at`, joined by blanks."""
        raw = self.data
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True))


def _blocks(hashes: np.ndarray, wide: int) -> np.ndarray:
    """Hash of the block of `wide` words that ends at each word; the first wide-1 values mean nothing."""
    out = hashes * np.uint64(0x9E3779B97F4A7C15)
    if wide == 2:
        out[1:] += bv.mix(hashes[:-1].copy())
    return out


def _run_hash(hashes: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that end at each of `ends`."""
    out = np.zeros(len(ends), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[ends - n + 1 + k]
    return bv.mix(out)


class Tables:
    """The tables of one class: patterns of n words.

    words: of all items, squeezed; last: the last word's number of each window; items: the item of each window.
    """

    def __init__(self, words: Words, last: np.ndarray, items: np.ndarray, n: int):
        self.n, self.wide, self.words = n, min(2, n), words
        block = _blocks(words.hashes, self.wide)
        longest = n - self.wide + 1
        # one word can end the blocks of n windows, so there are no more different blocks than words
        self.bits = max(12, int(np.ceil(np.log2(8 * len(words.hashes) + 1))))
        self.shift = np.full(1 << self.bits, longest, np.int8 if longest < 128 else np.int32)
        top = (block >> np.uint64(64 - self.bits)).astype(np.int64)
        for back in range(longest - 1, -1, -1):  # the nearer to the end, the smaller the shift
            self.shift[top[last - back]] = back
        prefix = _run_hash(words.hashes, last - self.wide, n - self.wide)
        order = np.lexsort((prefix, block[last]))
        last, block, prefix, items = last[order], block[last][order], prefix[order], items[order]
        begin, end = words.starts[last - n + 1], words.ends[last]
        alike = (block[1:] == block[:-1]) & (prefix[1:] == prefix[:-1]) & (end[1:] - begin[1:] == end[:-1] - begin[:-1])
        at = np.flatnonzero(alike)
        alike[at] = same_bytes(words.data, begin[at], words.data, begin[at + 1], (end - begin)[at])
        head = np.flatnonzero(np.append(True, ~alike))
        #: Each different pattern: its block and prefix, its bytes, and its range of `items`.
        self.block, self.prefix, self.begin, self.end = block[head], prefix[head], begin[head], end[head]
        self.edges, self.items = np.append(head, len(last)), items
        self.names, self.bucket = np.unique(self.block, return_index=True)
        self.bucket = np.append(self.bucket, len(self.block))

    def search(self, w: Words) -> np.ndarray:
        """Word numbers at which cursors stop: ends of patterns by the hash of the block."""
        lo, hi = w.first[:-1], w.first[1:]
        n_cursors = np.where(hi - lo >= self.n, -(-(hi - lo - self.n + 1) // STRETCH), 0)
        text = np.repeat(np.arange(len(lo)), n_cursors)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n_cursors) - n_cursors, n_cursors)
        at = lo[text] + self.n - 1 + nth * STRETCH
        stop = np.minimum(at + STRETCH, hi[text])
        block = (_blocks(w.hashes, self.wide) >> np.uint64(64 - self.bits)).astype(np.intp)
        found = []
        while len(at):
            skip = self.shift[block[at]].astype(np.int64)
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of every occurrence."""
        at = self.search(w)
        block = _blocks(w.hashes, self.wide)[at]
        k = np.minimum(np.searchsorted(self.names, block), len(self.names) - 1)
        some = self.names[k] == block
        at, k = at[some], k[some]
        prefix = _run_hash(w.hashes, at - self.wide, self.n - self.wide)
        # within each bucket the first pattern whose prefix is not smaller, by halving
        low, high = self.bucket[k], self.bucket[k + 1]
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (self.prefix[np.minimum(middle, len(self.prefix) - 1)] < prefix)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        ends, patterns = [], []
        stop = self.bucket[k + 1]
        while len(at):  # one round, but for different patterns of equal hashes
            on = low < stop
            on[on] = self.prefix[low[on]] == prefix[on]
            at, low, stop, prefix = at[on], low[on], stop[on], prefix[on]
            for a, p in zip(at.tolist(), low.tolist(), strict=True):
                if w.sequence(a - self.n + 1, self.n) == self.words.data[self.begin[p] : self.end[p]].tobytes():
                    ends.append(a)
                    patterns.append(p)
            low = low + 1
        return np.array(ends, np.int64), np.array(patterns, np.int64)


def same_bytes(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether x[a[i]:a[i]+sizes[i]] equals y[b[i]:b[i]+sizes[i]]; no size is 0."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 50_000):
        n = sizes[lo : lo + 50_000]
        begin = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(begin, n)
        out[lo : lo + 50_000] = np.logical_and.reduceat(x[np.repeat(a[lo : lo + 50_000], n) + within] == y[np.repeat(b[lo : lo + 50_000], n) + within], begin)
    return out


class Patterns:
    """All patterns of a block of items, by length."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        w = Words.of(pa.array([t for _, t in items], pa.string())).squeezed()
        ids = np.array([i for i, _ in items], np.int64)
        count = np.diff(w.first)
        length = np.minimum(count, window)
        self.classes = []
        for n in np.unique(length[length > 0]).tolist():
            of = np.flatnonzero(length == n)
            windows = count[of] - n + 1
            item = np.repeat(of, windows)
            last = w.first[item] + n - 1 + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
            self.classes.append(Tables(w, last, ids[item], n))

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """First word, word after the last, and the items of each occurrence."""
        begin, end, items = [], [], []
        for t in self.classes:
            at, pattern = t.occurrences(w)
            begin.append(at - t.n + 1)
            end.append(at + 1)
            items += [sorted(set(t.items[t.edges[p] : t.edges[p + 1]].tolist())) for p in pattern.tolist()]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *begin]), np.concatenate([none, *end]), items


_built: dict[str, Patterns] = {}


def patterns_of(name: str, items: list[tuple[int, str | None]]) -> Patterns:
    """The patterns of a block, kept by its name for the next task of this worker process; others are let go."""
    if name not in _built:
        _built.clear()
        _built[name] = Patterns(items)
    return _built[name]


def hit_words(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n words lie in any of the ranges."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges)[:n] > 0


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of at most block_bytes (a longer item is a block alone), brought over one by one."""
    block, size = [], 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    for r in rows.toLocalIterator():
        n = len(r["text"].encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    yield block


def _search(shared, name: str, path: list[str]):
    """Ranges of hit words, and items, of every row; path: where the text is within the struct d."""
    ranges = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = patterns_of(name, shared.value)
        for batch in batches:
            texts = pc.struct_field(batch.column("d"), path)
            for a, b in slices(texts):
                w = Words.of(texts.slice(a, b - a))
                begin, end, items = patterns.occurrences(w)
                hit = hit_words(len(w.hashes), begin, end)
                doc = np.searchsorted(w.first, begin, side="right") - 1
                names: dict[int, set[int]] = defaultdict(set)
                for k, ids in zip(doc.tolist(), items, strict=True):
                    names[k].update(ids)
                runs, ids = [[] for _ in range(b - a)], [sorted(names.get(k, ())) for k in range(b - a)]
                starts, ends, first = bv.spans(hit, w.first)
                for k in names:
                    runs[k] = [{"a": x, "b": y} for x, y in zip((starts[first[k] : first[k + 1]] - w.first[k]).tolist(), (ends[first[k] : first[k + 1]] - w.first[k]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(a, b - a), pa.array(np.diff(w.first)), pa.array(runs, ranges), pa.array(ids, pa.list_(pa.int64()))], ["d", "n_words", "ranges", "items"])

    return run


_FOUND = "n_words long, ranges array<struct<a:int,b:int>>, items array<long>"


def searched(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of the documents with its columns as a struct d, n_words, the ranges of hit words and the items that occur.

    Each block of items is a pass over the rows.
    """
    spark = documents.sparkSession
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"))
    text, number = F.col("d.text"), F.col("d.doc_id").cast("long")
    key = F.md5(F.concat(F.coalesce(number.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))).alias("key")

    def searched_for(block: list[tuple[int, str]], carried: DataFrame) -> DataFrame:
        schema = StructType([*carried.schema.fields, *StructType.fromDDL(_FOUND).fields])
        return carried.mapInArrow(trimmed(_search(spark.sparkContext.broadcast(block), uuid.uuid4().hex, ["text"])), schema)

    blocks = blocks_of(benchmark, block_bytes)
    block, earlier = next(blocks), []
    for further in blocks:
        hit = searched_for(block, rows.select(F.struct(key, text.alias("text")).alias("d"))).where(F.size("items") > 0)
        earlier.append(materialize(hit.select("d.key", "ranges", "items"), "occurrences"))
        block = further
    found = searched_for(block, rows)
    if not earlier:
        return found
    # rows with one key are equal in doc_id and text, and so in what occurs in them
    hits = reduce(DataFrame.unionAll, [x.dropDuplicates(["key"]) for x in earlier])
    hits = hits.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("more"), F.flatten(F.collect_list("items")).alias("others"))
    hits = materialize(hits, "occurrences")
    found = found.withColumn("key", key).join(hits, "key", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return found.select("d", "n_words", F.concat("ranges", none("more", "array<struct<a:int,b:int>>")).alias("ranges"), F.array_distinct(F.concat("items", none("others", "array<long>"))).alias("items"))


def covered(ranges: F.Column) -> F.Column:
    """Words in the union of the ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["upto"]))).cast("long").alias("n"), F.greatest(s["upto"], r["b"]).alias("upto"))
    return F.aggregate(F.array_sort(ranges), start, step, lambda s: s["n"])


def query(spark: SparkSession, sf_dir: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = searched(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, block_bytes)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = covered(F.col("ranges"))
    return rows.select(
        "d.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns as they were, in which no window of the benchmark occurs."""
    return searched(documents, benchmark, block_bytes).where(F.size("items") == 0).select("d.*")


ORACLE_SQL = r"""
WITH t AS (SELECT translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS rid, doc_id FROM documents),
d AS (SELECT rid, doc_id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
o AS (SELECT rid, i, x.n, item_id FROM x JOIN p ON x.s = p.s AND x.n = p.n),
h AS (SELECT rid, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM o) GROUP BY rid),
k AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(c, ',' ORDER BY c) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS c FROM o) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
