"""Distributed union-find: connected components of a graph given as a table of links.

First every task joins the links at hand into trees (a forest is never larger than its links). The forests then meet by
alternating two steps on tables in the shared folder, until all trees are stars: in the first each node passes
its smallest neighbour to its larger neighbours, in the second to its smaller ones. Each step is one grouped minimum,
combined before the shuffle, and one join of two plain shuffles, so that a node with very many links is split by adaptive
execution. The number of rounds grows with the logarithm of the longest chain. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, trimmed


class Forest:
    """Union-find over the numbers 0 to n-1; the root of a tree is its smallest number."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def flatten(self) -> np.ndarray:
        """The root of every number."""
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] and b[i], for all i."""
        while True:
            ra, rb = self.flatten()[a], self.parent[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a task as links of each node to the smallest of its tree."""
    for batch in batches:
        u, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("u", "v"))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        forest = Forest(len(names))
        forest.link(at[: len(u)], at[len(u) :])
        root = forest.flatten()
        child = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(names[child], batch.column("u").type), pa.array(names[root[child]], batch.column("u").type)], ["u", "v"])


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has a link to another node; the root is the smallest node of its component.

    links: (u, v) of one integer type, in any direction; repeated links and links to itself are allowed, nulls dropped.
    """
    spark = links.sparkSession
    links = links.where("u <> v").mapInArrow(trimmed(forests), links.select("u", "v").schema).distinct()
    scratch = Scratch(spark, name)
    links = scratch.keep(links, "links")
    while not is_stars(links):
        last, scratch = scratch, Scratch(spark, name)
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = scratch.keep(large.where("u <> v").distinct(), "large")
        least = scratch.keep(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = scratch.keep(small.where("u <> v").distinct(), "links")
        last.clear()
    found = materialize(links.select(F.col("u").alias("node"), F.col("v").alias("root")), name)
    scratch.clear()
    return found


def is_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()
