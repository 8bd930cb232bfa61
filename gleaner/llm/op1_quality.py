"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse scoring.

Every word yields its own hash and that of its shape (case, punctuation, symbols, length class, equal to the
word before). Features are the n-grams of both, hashed into a table of weights. A text's value of a feature is its
count divided by the square root of the sum of squares, so that length does not count. The model is a
table of float weights of fixed size, so that its broadcast does not grow with the data.

Training takes at most `max_docs` labelled documents, whatever the length of their texts: those with the smallest hashes of
their ids, so the choice is spread evenly and repeats. That number is the documented bound of the sample. Features are
counted where the texts are, so only they reach the driver. Scoring is one pass without a shuffle.

Null and empty texts have no features and get the score of the bias alone. Rows with a repeated doc_id are scored
each; a null doc_id counts as held out or not by the checksum of the empty string. Of several labels of an id the greatest
counts, of several texts the smallest. With no labelled rows, or labels of one class only, the model is a constant. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import text_slices, trimmed

BITS = 18
MAX_DOCS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.4, 1.0, 0.02, 0.1
PREDICT_AT = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_FLAGS = np.zeros(256, np.uint8)
_FLAGS[65:91] = 1  # upper case
_FLAGS[97:123] = 2  # lower case
_FLAGS[[ord(c) for c in "#$%&*|<>^~@\\_=+"]] = 4
_FLAGS[[ord(c) for c in "!?"]] = 8
_FLAGS[[ord(c) for c in ".,;:"]] = 16
_FLAGS[48:58] = 32
_FLAGS[128:] = 64
_FLAGS[195] = 64


def features(arr: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts one after the other, and each text's range of them."""
    data, offs = bv.buffers(arr)
    starts, ends, first = bv.spans(bv.NOT_SPACE[data], offs)
    n = len(starts)
    mask = np.uint64((1 << bits) - 1)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = bv.Prefix(data).of(starts, ends)
    kind = bv.reduce_spans(np.bitwise_or, _FLAGS[data], starts, ends, 0).astype(np.uint64)
    opens = np.zeros(n, bool)
    opens[first[:-1][first[:-1] < n]] = True
    same = np.zeros(n, np.uint64)
    same[1:] = word[1:] == word[:-1]
    same[opens] = 0
    shape = kind | (same << np.uint64(8)) | (np.minimum(ends - starts, 31).astype(np.uint64) >> np.uint64(2) << np.uint64(9))
    shape = bv.mix(shape + np.uint64(77))
    before = np.empty(n, np.uint64)
    columns = [word, shape]
    for values, salt in ((word, 3), (shape, 5)):
        before[0] = 0
        before[1:] = values[:-1]
        before[opens] = np.uint64(salt)
        columns.append(bv.mix(before * np.uint64(0x9E3779B97F4A7C15) + values + np.uint64(salt)))
    table = np.empty((n, len(columns)), np.int64)
    for k, c in enumerate(columns):
        table[:, k] = (c >> np.uint64(64 - bits)) & mask
    return table.reshape(-1), first * len(columns)


def normed(feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one text and their values."""
    idx, counts = np.unique(feats, return_counts=True)
    return idx, counts / np.sqrt(max(1.0, (counts.astype(np.float64) ** 2).sum()))


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from the features and values of each text. Examples are taken in the order given; the classes are weighed alike."""
    size = 1 << bits
    z, g2 = np.zeros(size + 1), np.zeros(size + 1)
    weights = np.zeros(size + 1)
    positive = float(labels.sum())
    if len(labels) == 0 or positive in (0.0, float(len(labels))):
        return weights[:size].astype(np.float32), 3.0 if len(labels) == 0 or positive else -3.0
    weight_of = (len(labels) / (2 * (len(labels) - positive)), len(labels) / (2 * positive))
    for _ in range(epochs):
        for (idx, val), y in zip(examples, labels.tolist(), strict=True):
            idx, val = np.append(idx, size), np.append(val, 1.0)
            zi, ni = z[idx], g2[idx]
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ val, -30, 30)))
            g = (p - y) * weight_of[int(y)] * val
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[idx] = zi + g - sigma * w
            g2[idx] = ni + g * g
    weights = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(g2)) / ALPHA + L2))
    return weights[:size].astype(np.float32), float(weights[size])


def scores(arr: pa.Array, weights: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """Sparse dot products: weights of the features times their values, through the logistic function."""
    feats, offs = features(arr, bits)
    out = np.full(len(offs) - 1, bias)
    key = (np.repeat(np.arange(len(offs) - 1), np.diff(offs)) << bits) | feats
    key.sort()
    if len(key):
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.diff(np.append(head, len(key))).astype(np.float64)
        row, idx = key[head] >> bits, key[head] & ((1 << bits) - 1)
        dot = np.bincount(row, counts * weights[idx], len(out))
        norm = np.bincount(row, counts * counts, len(out))
        out += np.divide(dot, np.sqrt(norm), out=np.zeros(len(out)), where=norm > 0)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """At most max_docs training rows (doc_id, quality, text): not held out, with a text, the smallest hashes of the id first.

    One text for each id. The rows are chosen by id and label before any text is moved; only then are the chosen texts looked up.
    """
    number = F.col("doc_id").cast("long").alias("doc_id")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(bucket("doc_id", 5) != 0)
    known = known.groupBy(number).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    usable = documents.where("text IS NOT NULL")
    chosen = known.join(usable.select(number), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = usable.select(number, "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def examples(rows: DataFrame) -> DataFrame:
    """(doc_id, quality, idx, val): the features of each text and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                part = batch.slice(a, b - a)
                feats, offs = features(part.column("text"))
                got = [normed(feats[i:j]) for i, j in zip(offs[:-1], offs[1:], strict=True)]
                idx = pa.array([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), idx, pa.array([v for _, v in got], pa.list_(pa.float64()))], ["doc_id", "quality", "idx", "val"])

    return rows.mapInArrow(trimmed(run), "doc_id long, quality int, idx array<int>, val array<double>")


def fit(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[np.ndarray, float]:
    rows = examples(labelled(documents, labels, max_docs)).toArrow().combine_chunks()
    ids = rows.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (hash((ids[k], 17)), ids[k]))
    lists = [rows.column(c).chunk(0) if ids else None for c in ("idx", "val")]
    offs = [x.offsets.to_numpy() for x in lists] if ids else []
    values = [x.values.to_numpy() for x in lists] if ids else []
    got = [(values[0][offs[0][k] : offs[0][k + 1]].astype(np.int64), values[1][offs[1][k] : offs[1][k + 1]]) for k in order]
    quality = rows.column("quality").to_numpy() if ids else np.zeros(0, np.int64)
    return train(got, quality[order])


def score_documents(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                part = batch.slice(a, b - a)
                s = scores(part.column("text"), weights, bias)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= PREDICT_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), (bucket("doc_id", 5) == 0).alias("held_out"), "text").mapInArrow(trimmed(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(documents, fit(documents, labels))
