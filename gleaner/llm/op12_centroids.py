"""Centroid clustering with block-norm screening: exact integer k-means that computes few distances.

A vector has DIM components x as integers floor(256 * x), cut into segments of SEGMENT components. The lengths of its segments
are computed once, when it is quantised, and stored beside it; those of a centroid once a round. By Cauchy and Schwarz a segment of a vector
and one of a centroid are at least as far apart as their lengths differ, so

    sum over segments of (|x_s| - |c_s|)**2  <=  |x - c|**2

A vector first meets the centroid with the smallest bound; only centroids whose bound does not exceed that exact distance, or the
best found so far, get one too. Bounds are taken in floating point and lowered by more than its error before they rule out
anything; distances are whole numbers, so the screen changes no result. Equal distances go to the smaller number.

Each round is one pass over the quantised table: a task returns one row of sums for each centroid, which Spark adds up, and K rows of sums
come to the driver, which makes the next centroids by exact integer division. Only centroids (K * DIM numbers) are sent to the tasks.

Defined cases: vectors of another length than DIM, null ones and those with a null or non-finite component get no row. A component beyond
+-2**27 after the scaling counts as that bound (so that a squared distance fits a long); sums beyond a long are null. Repeated
rows are vectors of their own; rows with one vec_id are in the order of their packed bytes where centroids are chosen. A null vec_id is the
empty string there. With fewer than K vectors each is a centroid of its own at first. Labels and other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, trimmed

DIM, K, ROUNDS = 64, 40, 5
SEGMENT = 4
SCALE, BOUND = 256.0, 1 << 27
SALT = "2:"
#: Vectors that a task holds at once.
BATCH = 4096
_KEPT = "vec_id long, q binary, norms binary"
_SUMS = "cluster int, n long, sums array<long>"
_NEAREST = "vec_id long, cluster int, distance long"


def quantised(embeddings: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are kept, and their components as integers."""
    sizes = pc.fill_null(pc.list_value_length(embeddings), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = embeddings.take(pa.array(rows)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null is NaN here
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return rows[fine], np.clip(np.floor(SCALE * x[fine]), -BOUND, BOUND).astype(np.int32)


def segment_norms(q: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The length of every segment of every vector."""
    squares = q.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, np.arange(0, q.shape[1], segment), axis=1))


def _quantise(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                rows, q = quantised(part.column("embedding"), dim)
                packed = (pa.array([x.tobytes() for x in y], pa.binary()) for y in (q, segment_norms(q)))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(rows)), *packed], ["vec_id", "q", "norms"])

    return run


def nearest(q: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every vector, its squared distance, and how many exact distances that took."""
    q, centroids = q.astype(np.int64), centroids.astype(np.int64)
    lengths = segment_norms(centroids)
    # |x|^2 - 2 |x||c| + |c|^2, segment by segment; off by some 2**-50 of the two squared lengths
    squares, mass = (norms**2).sum(axis=1), (lengths**2).sum(axis=1)
    bound = squares[:, None] - 2 * norms @ lengths.T + mass
    bound -= (squares[:, None] + mass) * 1e-12 + 1e-6
    rows, exact = np.arange(len(q)), 0

    def distance(row: np.ndarray, c: np.ndarray) -> np.ndarray:
        nonlocal exact
        exact += len(row)
        off = q[row] - centroids[c]
        return np.einsum("ij,ij->i", off, off)

    best = bound.argmin(axis=1)
    least = distance(rows, best)
    bound[rows, best] = np.inf
    for c in np.argsort(mass, kind="stable").tolist():
        row = np.flatnonzero(bound[:, c] <= least)
        if len(row):
            d = distance(row, np.full(len(row), c))
            better = (d < least[row]) | (d == least[row]) & (c < best[row])
            best[row[better]], least[row[better]] = c, d[better]
    return best, least, exact


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    q, norms = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1) for c, kind in (("q", np.int32), ("norms", np.float64)))
    return q.reshape(-1, dim), norms


def _sums(centroids: np.ndarray):
    """One row for each centroid that has vectors in the task: their number and sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                q, norms = _vectors(batch.slice(lo, BATCH), dim)
                best, _, _ = nearest(q, norms, centroids)
                order = np.argsort(best, kind="stable")
                head = np.flatnonzero(np.append(True, np.diff(best[order]) > 0))
                n += np.bincount(best, minlength=k)
                sums[best[order][head]] += np.add.reduceat(q[order].astype(np.int64), head, axis=0)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                best, least, _ = nearest(*_vectors(part, centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best, pa.int32()), pa.array(least)], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(kept: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in its order: k rows come to the driver."""
    name = F.sha2(F.concat(F.lit(SALT), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(name.alias("name"), "q").orderBy("name", "q").limit(k).collect()
    return np.array([np.frombuffer(r["q"], np.int32) for r in rows], np.int64)


def next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floor of the mean of the vectors of each centroid; one without vectors stays."""
    sums = kept.select("q", "norms").mapInArrow(trimmed(_sums(centroids)), _SUMS)
    added = sums.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in added.collect():  # K * DIM rows
        out[r["cluster"], r["at"]] = r["x"] // r["n"]
    return out


def clustered(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that is kept, and the final centroids."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "centroids")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = scratch.keep(rows.mapInArrow(trimmed(_quantise(dim)), _KEPT), "quantised")
    centroids = first_centroids(kept, k)
    if len(centroids) == 0:
        scratch.clear()
        return spark.createDataFrame([], _NEAREST), np.zeros((0, dim), np.int64)
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids)
    found = materialize(kept.mapInArrow(trimmed(_assign(centroids)), _NEAREST), "clustered")
    scratch.clear()
    return found, centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(total.alias("total")).collect()}  # K rows at most
    fits = lambda x: int(x) if x < 1 << 63 else None
    whole = fits(sum(sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    told = spark.createDataFrame([(c, fits(x), whole, digest(c)) for c, x in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds one after the other; vectors and centroids as one row for each component."""
    at = lambda k: f"""
d{k} AS (SELECT rid, n, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{k} c USING (j) GROUP BY rid, n),
a{k} AS MATERIALIZED (SELECT rid, arg_min(n, (d, n)) AS n, min(d) AS d FROM d{k} GROUP BY rid),"""  # noqa: E731
    move = lambda k: f"""
m{k} AS (SELECT n, j, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM v JOIN a{k - 1} USING (rid) GROUP BY n, j),
c{k} AS MATERIALIZED (SELECT c.n, c.j, coalesce(m.x, c.x) AS x FROM c{k - 1} c LEFT JOIN m{k} m ON m.n = c.n AND m.j = c.j),"""  # noqa: E731
    rounds = at(0) + "".join(move(k) + at(k) for k in range(1, ROUNDS + 1))
    return f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
k AS MATERIALIZED (SELECT * FROM e WHERE len(e) = {DIM} AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
v AS MATERIALIZED (SELECT rid, unnest(range({DIM})) AS j, unnest(list_transform(e, lambda x: floor(256 * x)::BIGINT)) AS x FROM k),
f AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SALT}' || vec_id::VARCHAR)) - 1 AS n FROM k QUALIFY n < {K}),
c0 AS MATERIALIZED (SELECT n, j, x FROM f JOIN v USING (rid)),{rounds}
s AS (SELECT n, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS h FROM c{ROUNDS} GROUP BY n)
SELECT vec_id, n::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN k USING (rid) JOIN s USING (n)
"""


ORACLE_SQL = _sql()
