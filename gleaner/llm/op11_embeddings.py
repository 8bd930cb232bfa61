"""Embedding near-duplicates by product quantisation.

Two vectors are linked if their cosine, in double precision, is at least THRESHOLD; components are what links reach.

1. Equal vectors become one class with a weight. The index is fitted on a bounded sample of the classes, in expectation of SAMPLE, or of LIST_SAMPLE for
   each list, and MAX_SAMPLE at most: a coarse centroid for each inverted list (about LISTS * sqrt(n), MAX_LISTS at most; no two seeds are themselves linked,
   so a dense group gets one list and is not torn into many), and for each of SUBSPACES parts of a residual a code book of CODES entries.
2. Every class is indexed: its unit vector goes to the list of the nearest centroid, with the code of its residual and the exact
   distance between vector and code. As a query it visits the PROBES nearest lists.
3. A task goes through lists one by one. A query's table of products with the code books gives the distance to every code of the list by
   look-up. A vector is at least as far away as its code less its own distance from the code, so what that
   rules out cannot be linked: within the visited lists nothing is lost. What is left gets its exact cosine.
4. A task returns the number of links of each class and links that span the components it saw, never pairs. A pair that two
   lists show is counted once for either end: a list's own vector is counted there only if it does not visit the other's list itself.

Groups of thousands of near copies do not cost all their pairs: vectors within half the threshold's angle of their list's centroid are
its core. By the triangle inequality any two of them are linked, so these pairs are counted by a sum and not compared. All other pairs
of a core's vector are. A list of more than PART_ROWS vectors is cut into parts by a hash, each visited by all queries of the list, so no
task holds an unbounded list.

Links are exact within the visited lists. Recall depends on PROBES alone; the tests measure it against brute force.

Defined cases: a null or empty vector, a zero one, and one with a null or non-finite component link with nothing and keep themselves.
Vectors of different lengths are not linked; each length has an index of its own, and one too rare for the sample is a single list without
codes. Repeated rows are vectors of their own. A null vec_id takes part, but names a component only if all of it are null. Labels and other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, release, tasks, trimmed
from .components import Forest, components

THRESHOLD = 0.9
SAMPLE, LIST_SAMPLE, MAX_SAMPLE = 32_768, 16, 524_288
LISTS, MAX_LISTS = 1.0, 32_768
SUBSPACES, CODES = 8, 256
PROBES = 8
PART_ROWS = 50_000
SEED = 11
#: Fewer sampled vectors of one length than this get no lists and no codes.
LEAST_SAMPLE = 64
#: Queries that meet a list at once, and products that are held at once.
QUERIES, PRODUCTS = 512, 4_000_000
_INDEXED = "id long, weight long, list int, probes array<int>, core boolean, code binary, err double, v binary"
_ROUTED = "unit long, query boolean, id long, weight long, list int, probes array<int>, core boolean, code binary, err double, v binary"
_FOUND = "kind byte, a long, b long"


def units(x: np.ndarray) -> np.ndarray:
    """Vectors of length one. Powers of two take out very large and very small scales without an error."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _pack(kind: np.dtype):
    """(vec_id, v): the bytes of each vector; null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = part.column("embedding")
                sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = x.drop_null().flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # a null is NaN, and -0.0 becomes 0.0
                ends = np.cumsum(sizes)
                bad, some = (np.append(0, np.cumsum(y)) for y in (~np.isfinite(flat), flat != 0))
                fine = (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes])
                raw, w = flat.tobytes(), kind.itemsize
                packed = [raw[w * (b - n) : w * b] if ok else None for b, n, ok in zip(ends.tolist(), sizes.tolist(), fine.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(packed, pa.binary())], ["vec_id", "v"])

    return run


def lloyd(x: np.ndarray, centers: np.ndarray, rounds: int) -> np.ndarray:
    """k-means; a centre without points stays."""
    for _ in range(rounds):
        at = closest(x, centers)
        order = np.argsort(at, kind="stable")
        head = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
        sizes = np.diff(np.append(head, len(at)))
        centers = centers.copy()
        centers[at[order][head]] = np.add.reduceat(x[order], head, axis=0) / sizes[:, None]
    return centers


def closest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    size = (centers**2).sum(axis=1)
    step = max(1, PRODUCTS // len(centers))
    return np.concatenate([(size - 2 * x[lo : lo + step] @ centers.T).argmin(axis=1) for lo in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    """Centroids of the lists, code books of the subspaces, and the number of the first list."""

    centroids: np.ndarray
    books: list[np.ndarray]
    first: int = 0

    @classmethod
    def fitted(cls, x: np.ndarray, n_lists: int) -> Index:
        """x: sampled unit vectors in random order."""
        seeds = np.empty((n_lists, x.shape[1]))
        count = 0
        for v in x:
            if count == n_lists:
                break
            if not count or (seeds[:count] @ v).max() < THRESHOLD:
                seeds[count] = v
                count += 1
        centroids = lloyd(x, seeds[:count], 5)
        rest = x - centroids[closest(x, centroids)]
        books = [lloyd(part, part[:CODES], 4) for part in np.array_split(rest, min(SUBSPACES, x.shape[1]), axis=1)]
        return cls(centroids, books)

    @classmethod
    def single(cls, dim: int) -> Index:
        """One list around zero, without codes."""
        return cls(np.zeros((1, dim)), [])

    def near(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of every vector, the nearest first."""
        probes = min(probes, len(self.centroids))
        out = np.empty((len(x), probes), np.int64)
        step = max(1, PRODUCTS // len(self.centroids))
        for lo in range(0, len(x), step):
            d = (self.centroids**2).sum(axis=1) - 2 * x[lo : lo + step] @ self.centroids.T
            part = np.argpartition(d, probes - 1, axis=1)[:, :probes]
            out[lo : lo + step] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
        return out

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of residuals, and how far each is from its residual."""
        if not self.books:
            return np.zeros((len(rest), 0), np.uint8), np.sqrt(np.einsum("ij,ij->i", rest, rest))
        parts = np.array_split(rest, len(self.books), axis=1)
        codes = np.stack([closest(part, book) for part, book in zip(parts, self.books, strict=True)], 1).astype(np.uint8)
        off = rest - self.decode(codes)
        return codes, np.sqrt(np.einsum("ij,ij->i", off, off))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1) if self.books else np.zeros((len(codes), self.centroids.shape[1]))

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """Of every query its products with the entries of each book."""
        parts = np.array_split(x, max(1, len(self.books)), axis=1)
        return [(part @ book.T).astype(np.float32) for part, book in zip(parts, self.books, strict=False)]


class Indexes(dict):
    """The indexes by length of the vectors; a length that the sample lacks gets a single list. Lists are numbered through.

    kind: the type of the components, as which vectors are moved; all that is computed is computed in doubles.
    """

    def __init__(self, sample: list[bytes], n: int, kind: np.dtype = np.dtype("f8")):
        self.kind = kind
        by_length: dict[int, list[np.ndarray]] = {}
        for v in sample:
            by_length.setdefault(len(v) // kind.itemsize, []).append(np.frombuffer(v, kind).astype(np.float64))
        first = 0
        for dim in sorted(by_length):
            x = np.array(by_length[dim])
            if len(x) >= LEAST_SAMPLE:
                x = units(x)[np.random.default_rng(SEED).permutation(len(x))]
                rows = n * len(x) / len(sample)
                self[dim] = Index.fitted(x, max(1, min(MAX_LISTS, round(LISTS * math.sqrt(rows)), len(x) // 8)))
                self[dim].first = first
                first += len(self[dim].centroids)

    def vectors(self, packed: list[bytes], dim: int) -> np.ndarray:
        """Unit vectors of one length."""
        return units(np.frombuffer(b"".join(packed), self.kind).reshape(-1, dim).astype(np.float64))

    def of(self, dim: int) -> Index:
        """Single lists have numbers below zero."""
        if dim in self:
            return self[dim]
        index = Index.single(dim)
        index.first = -dim
        return index


#: The cosine to the centroid from which on any two vectors are linked, with room for rounding.
CORE = math.cos(math.acos(THRESHOLD) / 2) + 1e-9
#: The distance of linked unit vectors, with room for single precision.
REACH = math.sqrt(2 - 2 * THRESHOLD) + 1e-3


def _index(indexes, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                sizes = pc.binary_length(part.column("v")).to_numpy() // indexes.value.kind.itemsize
                for dim in np.unique(sizes).tolist():
                    rows = part.take(pa.array(np.flatnonzero(sizes == dim)))
                    index = indexes.value.of(dim)
                    x = indexes.value.vectors(rows.column("v").to_pylist(), dim)
                    near = index.near(x, probes)
                    center = index.centroids[near[:, 0]]
                    code, err = index.encode(x - center)
                    length = np.sqrt(np.einsum("ij,ij->i", center, center))
                    core = np.einsum("ij,ij->i", x, center) >= CORE * length
                    core &= length > 0
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("id"), rows.column("weight"), pa.array(near[:, 0] + index.first, pa.int32()), pa.array(list((near + index.first).astype(np.int32)), pa.list_(pa.int32())), pa.array(core), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err), rows.column("v")],
                        ["id", "weight", "list", "probes", "core", "code", "err", "v"],
                    )

    return run


class Part:
    """The vectors of one part of an inverted list. Queries meet it block by block; counts and trees are told at the end."""

    def __init__(self, rows: pa.Table, indexes: Indexes):
        self.ids, self.weight = (rows.column(c).to_numpy() for c in ("id", "weight"))
        self.core = rows.column("core").to_numpy()
        raw = rows.column("v").to_pylist()
        #: The lengths of one list's vectors are one.
        self.dim, self.list, self.indexes = len(raw[0]) // indexes.kind.itemsize, rows.column("list")[0].as_py(), indexes
        self.x = indexes.vectors(raw, self.dim)
        self.index = indexes.of(self.dim)
        self.codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        probes = rows.column("probes").combine_chunks()
        self.probes = probes.flatten().to_numpy().reshape(len(self.ids), -1)
        self.center = self.index.centroids[self.list - self.index.first]
        near = self.center + self.index.decode(self.codes)
        reach = (REACH + rows.column("err").to_numpy()) ** 2
        #: A query's product with a code must reach this, less its product with the centroid, if both can be linked.
        self.least = ((1 + np.einsum("ij,ij->i", near, near) - reach) / 2).astype(np.float32)
        self.count, self.forest = np.zeros(len(self.ids), np.int64), Forest(len(self.ids))

    def meet(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """The queries' numbers of links here, and a link of each to one of them."""
        ids, weight, lists = (rows.column(c).to_numpy() for c in ("id", "weight", "list"))
        x = self.indexes.vectors(rows.column("v").to_pylist(), self.dim)
        tables, base = self.index.tables(x), (x @ self.center).astype(np.float32)
        count, ends = np.zeros(len(ids), np.int64), []
        step = max(1, PRODUCTS // len(ids))
        for lo in range(0, len(self.ids), step):
            codes = self.codes[lo : lo + step]
            products = np.broadcast_to(base[:, None], (len(ids), len(codes))).copy()
            for m, table in enumerate(tables):
                products += table[:, codes[:, m]]
            q, r = np.nonzero(products >= self.least[lo : lo + step])
            q, r = self.linked(x, q, r + lo)
            other = ids[q] != self.ids[r]
            q, r = q[other], r[other]
            count += np.bincount(q, self.weight[r], len(ids)).astype(np.int64)
            # does the list's own vector meet this query as a query itself?
            own = np.where(lists[q] == self.list, ~self.core[r], (self.probes[r] == lists[q][:, None]).any(axis=1))
            self.count += np.bincount(r[~own], weight[q[~own]], len(self.ids)).astype(np.int64)
            if len(q):
                head = np.flatnonzero(np.append(True, np.diff(q) > 0))
                first = np.repeat(r[head], np.diff(np.append(head, len(q))))
                self.forest.link(first, r)
                ends.append((ids[q[head]], self.ids[r[head]]))
        some = np.flatnonzero(count)
        return found([(0, ids[some], count[some]), *((1, a, b) for a, b in ends)])

    def linked(self, x: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose exact cosine reaches the threshold."""
        keep = [np.zeros(0, bool)]
        step = max(1, PRODUCTS // self.dim)
        for lo in range(0, len(q), step):
            part = slice(lo, lo + step)
            keep.append(np.einsum("ij,ij->i", x[q[part]], self.x[r[part]]) >= THRESHOLD)
        keep = np.concatenate(keep)
        return q[keep], r[keep]

    def told(self) -> pa.RecordBatch:
        """The further links of the list's own vectors, and its trees."""
        some, root = np.flatnonzero(self.count), self.forest.flatten()
        child = np.flatnonzero(root != np.arange(len(root)))
        return found([(0, self.ids[some], self.count[some]), (1, self.ids[child], self.ids[root[child]])])


def found(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """kind 0: class a has b more links; kind 1: a and b are linked."""
    kinds = np.concatenate([np.full(len(a), k, np.int8) for k, a, _ in rows])
    return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(np.concatenate(x).astype(np.int64)) for x in ([a for _, a, _ in rows], [b for *_, b in rows]))], ["kind", "a", "b"])


def _search(indexes):
    """Rows come sorted by unit, a list's own vectors before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, part = None, [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            units_, queries = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "query"))
            edges = np.flatnonzero(np.append(True, (units_[1:] != units_[:-1]) | (queries[1:] != queries[:-1])))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                if unit != units_[a]:
                    if part is not None:
                        yield part.told()
                    unit, held, part = units_[a], [], None
                if not queries[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    part, held = Part(pa.Table.from_batches(held), indexes.value), []
                for lo in range(a, b if part is not None else a, QUERIES):  # queries of an empty part find nothing
                    yield part.meet(batch.slice(lo, min(QUERIES, b - lo)))
        if part is not None:
            yield part.told()

    return run


def fitted(classes: DataFrame, n: int, kind: np.dtype, sample: int = SAMPLE) -> Indexes:
    """The indexes of n classes, from `sample` of them in expectation, or more if there are many lists, chosen by hash."""
    rows = classes.select("v")
    sample = min(MAX_SAMPLE, max(sample, LIST_SAMPLE * round(LISTS * math.sqrt(n))))
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "v"), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
    return Indexes(sorted(rows.toArrow().column("v").to_pylist()), n, kind)


def linked(embeddings: DataFrame, probes: int = PROBES, part_rows: int = PART_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id) of every vector."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "embeddings")
    kind = np.dtype("f4" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "f8")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(trimmed(_pack(kind)), "vec_id long, v binary")
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.keep(classes, "classes")
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "numbered")
    sent = spark.sparkContext.broadcast(fitted(classes, classes.count(), kind, sample))
    index = scratch.keep(classes.select("id", "weight", "v").mapInArrow(trimmed(_index(sent, probes)), _INDEXED), "index")
    release(spark)

    core = F.when(F.col("core"), F.col("weight"))
    sizes = scratch.keep(index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"), F.sum(core).alias("core_weight"), F.min(F.when(F.col("core"), F.col("id"))).alias("core_id")), "sizes")
    cut = sizes.select(F.col("list").alias("to"), "parts")
    own = index.withColumn("to", F.col("list")).join(cut, "to")
    own = own.select("to", F.lit(False).alias("query"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), *index.columns)
    asks = index.withColumn("to", F.explode("probes")).where("to <> list OR NOT core").join(cut, "to")
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("to", F.lit(True).alias("query"), "part", *index.columns)
    unit = (F.shiftleft(F.col("to").cast("long"), 31) + F.col("part")).alias("unit")
    routed = own.unionAll(asks).select(unit, "query", *index.columns).repartition(tasks(spark), "unit").sortWithinPartitions("unit", "query")
    out = scratch.keep(routed.mapInArrow(trimmed(_search(sent)), _FOUND), "found")

    cores = index.where("core").select("id", "list", "weight").join(sizes.select("list", "core_weight", "core_id"), "list")
    trees = components(out.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(cores.select("id", "core_id")), "embedding-links")
    counts = out.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n")).unionAll(cores.select("id", F.col("core_weight") - F.col("weight")))
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.join(counts, "id", "left").join(trees.select(F.col("node").alias("id"), "root"), "id", "left")
    named = scratch.keep(named.select("id", F.md5("v").alias("key"), "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "root").select("key", "n_links", "component_id"), "embedding-classes")
    scratch.clear()
    keyed = rows.select("vec_id", F.md5("v").alias("key"))
    alone = F.col("key").isNull()
    return keyed.join(named, "key", "left").select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
