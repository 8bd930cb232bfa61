"""SimHash near-duplicates by BK-trees.

A fingerprint has 64 bits from the XXH64 of all 3-word shingles of a text. Documents with equal fingerprints are one node.
Nodes that differ in at most RADIUS = 3 bits are linked, and a component is what links reach.

Shards: of the four 16-bit blocks of a fingerprint one at least is equal in both nodes of a link, and of the four
12-bit blocks of the rest one more. So each node goes to 16 shards, each named by two blocks and their 28 bits, and
both nodes of every link meet in one of them. Each shard has its own BK-tree: children are keyed by
the distance to their parent, and a search at distance d follows only the edges d-3 to d+3. The trees of all shards of
a task form one forest, built and searched level by level in numpy.

A shard of more than SHARD_NODES nodes is split by the same rule: of four blocks of the bits that its name does not hold
one at least is equal in both nodes of a link, so a node goes to four narrower shards, and so on until shards are small. A name that
leaves OPEN_BITS = 11 bits open cannot have more than 2048 nodes and is not split, which is so after five splits: a node has at most 16 * 4**5 rows whatever
the corpus holds, no task gets an unbounded shard, and no link is lost. Trees are sent to the nodes of their shard alone: a
broadcast of all trees to all tasks would grow with the corpus.

A null or empty text has no words and the fingerprint zero, which links like any other. Repeated rows each get a row. A
null doc_id takes part, but never names a component unless all of its component are null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import COUNTED, Scratch, materialize, tasks, text_slices, trimmed, whole_groups
from .components import Forest, components

SHINGLE = 3
RADIUS = 3
SEED = 42
SHARD_NODES = 4000
#: A shard whose name leaves no more bits open is never split.
OPEN_BITS = 11
#: Nodes of a task whose trees are held at once.
BATCH_NODES = 200_000
#: (node, node) pairs that a search holds at once.
FRONTIER = 1_000_000


def fingerprints(arr: pa.Array) -> np.ndarray:
    """The fingerprint of every text, unsigned."""
    data, offs = bv.buffers(arr)
    data = bv.LOWER[data]
    inside = bv.NOT_SPACE[data]
    starts, ends, first = bv.spans(inside, offs)
    out = np.zeros(len(offs) - 1, np.uint64)
    if len(starts) == 0:
        return out
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int(begin[-1] + sizes[-1]), 32, np.uint8)
    joined[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = data[inside]
    raw, stop = joined.tobytes(), begin + sizes
    counts = np.diff(first)
    n = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    lo = first[:-1][doc] + nth
    hi = np.minimum(lo + SHINGLE, first[1:][doc]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin[lo].tolist(), stop[hi].tolist(), strict=True)), np.uint64, len(doc))
    some = np.flatnonzero(n)
    where = (np.cumsum(n) - n)[some]
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, where, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch, "text", 1_000_000):
            part = batch.slice(a, b - a)
            rest = [k for k in part.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array(fingerprints(part.column("text")).view(np.int64))], [*rest, "fp"])


def shards(fps: np.ndarray) -> np.ndarray:
    """(n, 16) names of the shards of each fingerprint."""
    out = np.empty((len(fps), 16), np.int64)
    u = np.uint64
    for i in range(4):
        block = (fps >> u(16 * i)) & u(0xFFFF)
        low = fps & u((1 << (16 * i)) - 1)
        rest = low | ((fps >> u(16 * i + 16)) << u(16 * i)) if i < 3 else low
        for j in range(4):
            part = (rest >> u(12 * j)) & u(0xFFF)
            out[:, 4 * i + j] = (u(4 * i + j) << u(28) | block << u(12) | part).astype(np.int64)
    return out


def _to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for lo in range(0, len(fps), 20_000):
            part = fps[lo : lo + 20_000]
            names = shards(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(names.reshape(-1)), pa.array(np.repeat(part, 16))], ["shard", "fp"])


@lru_cache(maxsize=65536)
def blocks(free: int) -> tuple[int, ...]:
    """The bits of `free` in RADIUS + 1 blocks of about one size."""
    bits = [b for b in range(64) if free >> b & 1]
    return tuple(sum(1 << int(b) for b in part) for part in np.array_split(bits, RADIUS + 1))


def _free(kind: int) -> int:
    """The bits that the name of a shard of this kind (0 to 15) leaves open."""
    base = int(shards(np.zeros(1, np.uint64))[0, kind])
    return sum(1 << b for b in range(64) if int(shards(np.array([1 << b], np.uint64))[0, kind]) == base)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, fp, free) of large shards as rows of RADIUS + 1 narrower ones."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 20_000):
            shard, fp, free = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in batch.slice(lo, 20_000).columns)
            masks, at = np.unique(free, return_inverse=True)
            block = np.array([blocks(m) for m in masks.tolist()], np.uint64)[at]
            name = bv.mix(bv.mix(fp[:, None] & block) ^ bv.mix(block + shard[:, None]))
            rest = free[:, None] & ~block
            yield pa.RecordBatch.from_arrays([pa.array(x.reshape(-1).view(np.int64)) for x in (name, np.repeat(fp, RADIUS + 1), rest)], ["shard", "fp", "free"])


def in_shards(scratch: Scratch, nodes: DataFrame, limit: int) -> DataFrame:
    """(unit, fp): each node in its shards, those of more than about `limit` nodes split into narrower ones.

    Sizes are estimated from one in COUNTED nodes; the estimate only decides on splitting, so its error changes no result.
    """
    rows = nodes.select("fp").mapInArrow(trimmed(_to_shards), "shard long, fp long")
    masks = [_free(kind) for kind in range(16)]
    kind = F.shiftright("shard", 28).cast("int")
    rows = rows.withColumn("free", F.element_at(F.array(*[F.lit(m - (m >> 63 << 64)).cast("long") for m in masks]), kind + 1))
    done, free = [], masks[0].bit_count()
    while free > OPEN_BITS:
        counted = rows.where(F.pmod(F.xxhash64("fp"), F.lit(COUNTED)) == 0).groupBy("shard").count()
        large = scratch.keep(counted.where(F.col("count") * COUNTED > max(limit, COUNTED)).select("shard"), "large-shards")
        if large.isEmpty():
            break
        done.append(rows.join(large, "shard", "left_anti"))
        rows = scratch.keep(rows.join(large, "shard", "left_semi").mapInArrow(trimmed(_split), rows.schema), "split")
        free -= free // (RADIUS + 1)
    return reduce(DataFrame.unionAll, [*done, rows]).select(F.col("shard").alias("unit"), "fp")


class Trees:
    """BK-trees of many groups of distinct fingerprints, as arrays."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        """group: ascending; the first of each group is its root."""
        n = len(fps)
        self.fps = fps
        self.root = np.searchsorted(group, group)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        items, at = np.flatnonzero(self.root != np.arange(n)), None
        at = self.root[items]
        while len(items):
            d = np.bitwise_count(fps[items] ^ fps[at]).astype(np.int64)
            slot = at * 65 + d
            order = np.argsort(slot, kind="stable")
            items, slot, at, d = items[order], slot[order], at[order], d[order]
            head = np.append(True, slot[1:] != slot[:-1])
            new = items[head]
            parent[new], edge[new] = at[head], d[head]
            at = np.repeat(new, np.diff(np.append(np.flatnonzero(head), len(slot))))
            items, at = items[~head], at[~head]
        self.child = np.lexsort((edge, parent))
        self.slots = parent[self.child] * 65 + edge[self.child]

    def links(self, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of numbers (query, found), each within the radius; every pair from both sides."""
        n = len(self.fps)
        width = max(1, FRONTIER // 50)
        todo = [(np.arange(lo, min(n, lo + width)), self.root[lo : lo + width]) for lo in range(0, n, width)]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = np.bitwise_count(self.fps[query] ^ self.fps[node]).astype(np.int64)
            near = (d <= radius) & (query != node)
            yield query[near], node[near]
            lo = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), side="right")
            count = hi - lo
            query = np.repeat(query, count)
            if len(query):
                within = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
                todo.append((query, self.child[np.repeat(lo, count) + within]))


def joined(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest of its tree) that join all fingerprints of a group within the radius of each other."""
    order = np.lexsort((fps, group))
    group, fps = group[order], fps[order]
    same = np.zeros(len(fps), bool)
    same[1:] = (group[1:] == group[:-1]) & (fps[1:] == fps[:-1])
    group, fps = group[~same], fps[~same]
    lone = np.ones(len(fps), bool)
    lone[1:] &= group[1:] != group[:-1]
    lone[:-1] &= group[1:] != group[:-1]
    group, fps = group[~lone], fps[~lone]
    if len(fps) == 0:
        return fps, fps
    values, at = np.unique(fps, return_inverse=True)
    forest = Forest(len(values))
    for a, b in Trees(group, fps).links(radius):
        forest.link(at[a], at[b])
    root = forest.flatten()
    child = np.flatnonzero(root != np.arange(len(root)))
    return values[child], values[root[child]]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all units of a task, some at a time. Rows come sorted by unit."""
    for rows in whole_groups(batches, "unit", BATCH_NODES):
        child, root = joined(rows.column("unit").to_numpy(), rows.column("fp").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(root.view(np.int64))], ["u", "v"])


def links(scratch: Scratch, nodes: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Links (u, v) that join all nodes (distinct fp) within the radius of each other."""
    units = in_shards(scratch, nodes, shard_nodes)
    return units.repartition(tasks(nodes.sparkSession), "unit").sortWithinPartitions("unit").mapInArrow(trimmed(_search), "u long, v long")


def rooted(scratch: Scratch, rows: DataFrame, least: F.Column) -> DataFrame:
    """(fp, least, root) of every fingerprint: the minimum of `least` over its rows; root is null where nothing is linked."""
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min(least).alias("least")), "nodes")
    found = components(links(scratch, nodes), "simhash-links")
    # of signed numbers the root is any node of its component, the smallest doc_id is found by the caller
    linked = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
    roots = found.select(F.col("root").alias("fp")).distinct().withColumn("is_root", F.lit(True))
    return scratch.keep(linked.join(roots, "fp", "left").select("fp", "least", F.when(F.col("is_root"), F.col("fp")).otherwise(F.col("root")).alias("root")), "rooted")


def grouped(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    scratch = Scratch(documents.sparkSession, "simhash")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(rows.mapInArrow(trimmed(_fingerprints), "doc_id long, fp long"), "simhash-fp")
    tree = rooted(scratch, rows, F.col("doc_id"))
    ids = scratch.keep(tree.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = tree.join(ids, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    named = materialize(named, "simhash-named")
    scratch.clear()
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key that the task meets."""
    seen: set[tuple[bytes, bytes]] = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(zip(batch.column("row").to_pylist(), batch.column("rest").to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int32()))


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents, all columns as they were: of each component one row, that with the smallest doc_id.

    Rows are told apart by doc_id and text, so different texts with one doc_id stay if their components differ. Of one
    doc_id in a component the smallest digest of doc_id and text stays; a row without a doc_id stays only if no row of its
    component has one. Of rows equal in both the smallest digest of the other columns, as JSON, stays. Rows that are equal in all are
    reduced within each task before they meet; only of them are texts sorted.
    """
    scratch = Scratch(documents.sparkSession, "simhash")
    number = F.col("doc_id").cast("long")
    row = F.unhex(F.md5(F.concat(F.coalesce(number.cast("string"), F.lit("")), F.when(F.col("text").isNull(), ".").otherwise(":"), F.coalesce("text", F.lit(""))))).alias("row")
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    rest = (F.unhex(F.md5(F.to_json(F.struct(*others)))) if others else F.lit(b"")).alias("rest")
    rows = documents.select(number.alias("doc_id"), row, rest, "text").mapInArrow(trimmed(_fingerprints), "doc_id long, row binary, rest binary, fp long")
    rows = scratch.keep(rows, "fp")
    tree = rooted(scratch, rows, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "rest"))
    stays = tree.groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("least")).select("least.row", "least.rest")
    times = rows.groupBy("row", "rest").agg(F.count(F.lit(1)).alias("times"))
    stays = materialize(stays.join(times, ["row", "rest"]), "simhash-stays")
    scratch.clear()
    kept = documents.select(row, rest, F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d")).join(stays, ["row", "rest"])
    copies = kept.where("times > 1").select("row", "rest", "d")
    copies = copies.mapInArrow(trimmed(_once), copies.schema).withColumn("nth", F.row_number().over(Window.partitionBy("row", "rest").orderBy(F.lit(0))))
    return kept.where("times = 1").select("d.*").unionAll(copies.where("nth = 1").select("d.*"))
