"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of WINDOW bytes that overlap by the widest filter less one, so that every n-gram of the whole
text lies in one of them. Per window: filters of several widths over learned byte vectors, the maximum of each filter
over the window, a softmax layer. A text's probabilities are the mean of its windows', weighed by their bytes.

A filter of width w is a sum of look-ups: the vectors of a pair of bytes times the filter's slices for these places are
tabled for all 65,536 pairs, as 16-bit integers, so scoring needs no matrix product over the text and its memory is
bounded by the slice of text at hand. The model has a fixed size.

Training takes at most `max_docs` documents of each language (those with the smallest hashes of their ids, of texts that are
not empty) and of each at most `windows_per_doc` windows, drawn from all over the text whatever its length. These two numbers are
the documented bound of the sample; languages are not bounded. Windows are drawn where the texts are, so only they reach the driver.

A null text, or one without a letter (a character of a Unicode category L), is `und` with score 0. A null lang is not learned
from. With no rows to learn from every text is `und`. Of equal probabilities the language first by name counts. Repeated
rows are predicted each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import slices, trimmed
from .op1_quality import bucket

WIDTHS = (2, 3, 4)
FILTERS = 8
VECTOR = 8
WINDOW = 256
MAX_DOCS = 400
WINDOWS_PER_DOC = 6
SHARES = 32
STEPS = 500
BATCH = 64
#: Byte that no UTF-8 text holds.
PAD = 255
UNDETERMINED = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


@dataclass
class Network:
    langs: list[str]
    #: For each width: uint64 look-up tables by a pair of bytes, then by one byte where the width is odd; four filters of
    #: 16-bit integers in each uint64. FILTERS / 4 tables a step.
    tables: list[list[list[np.ndarray]]]
    bias: list[np.ndarray]
    #: What a unit of the integers stands for.
    unit: list[float]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """x: (windows, WINDOW) bytes, padded with PAD. Maximum of each filter over each window, 0 at least."""
        one = x.astype(np.intp)
        pair = one[:, :-1] * 256 + one[:, 1:]
        parts = []
        for w, steps, bias, unit in zip(WIDTHS, self.tables, self.bias, self.unit, strict=True):
            n = WINDOW - w + 1
            lanes = []
            for lane in range(FILTERS // 4):
                total = None
                for k, tables in enumerate(steps):
                    index = pair[:, 2 * k : 2 * k + n] if 2 * k + 1 < w else one[:, 2 * k : 2 * k + n]
                    got = tables[lane][index].view(np.int16)
                    total = got if total is None else np.add(total, got, out=total)
                while n > 1:  # halves may overlap: a maximum does not mind
                    half = -(-n // 2)
                    total = np.maximum(total[:, : 4 * half], total[:, 4 * (n - half) : 4 * n])
                    n = half
                n = WINDOW - w + 1
                lanes.append(total)
            parts.append(np.maximum(np.concatenate(lanes, 1) * np.float32(unit) + bias, 0))
        return np.concatenate(parts, axis=1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def packed(table: np.ndarray, unit: float) -> list[np.ndarray]:
    """(n, FILTERS) values as 16-bit integers, four to a uint64."""
    q = np.round(table / unit).astype(np.int16)
    return [np.ascontiguousarray(q[:, k : k + 4]).view(np.uint64)[:, 0] for k in range(0, FILTERS, 4)]


def network(langs: list[str], params: dict[str, np.ndarray]) -> Network:
    """Turn trained parameters into look-up tables."""
    vectors = params["E"][:256].copy()
    vectors[PAD] = params["E"][256]
    tables, units = [], []
    for w in WIDTHS:
        single = np.einsum("bv,wvf->wbf", vectors, params[f"F{w}"])
        unit = float(np.abs(single).max(axis=(1, 2)).sum()) / 32000 or 1.0
        steps = []
        for j in range(0, w, 2):
            table = (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS) if j + 1 < w else single[j]
            steps.append(packed(table, unit))
        tables.append(steps)
        units.append(unit)
    return Network(langs, tables, [params[f"b{w}"].astype(np.float32) for w in WIDTHS], units, params["O"].astype(np.float32), params["o"].astype(np.float32))


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The windows as rows of WINDOW bytes."""
    at = starts[:, None] + np.arange(WINDOW)
    x = np.append(data, np.uint8(PAD))[np.minimum(at, len(data))]
    x[at >= ends[:, None]] = PAD
    return x


def windows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every window; the windows of a text cover it."""
    step = WINDOW - max(WIDTHS) + 1
    sizes = np.diff(offs)
    counts = np.where(sizes > 0, np.maximum(-(-(sizes - (WINDOW - step)) // step), 1), 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offs[:-1][row] + nth * step
    return row, starts, np.minimum(starts + WINDOW, offs[1:][row])


def has_letter(text: str | None) -> bool:
    return text is not None and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def drawn(text: str, doc_id: int, n: int = WINDOWS_PER_DOC) -> list[bytes]:
    """At most n windows of a text, the same for the same id and text."""
    raw = text.encode()
    _, starts, ends = windows(np.array([0, len(raw)]))
    rng = np.random.default_rng([7, doc_id & 0xFFFFFFFF])
    return [raw[starts[i] : ends[i]] for i in np.sort(rng.permutation(len(starts))[:n]).tolist()]


def train(samples: list[bytes], langs: list[str], steps: int = STEPS, seed: int = 7) -> Network | None:
    """Fit by Adam on mini-batches of windows, the languages in equal parts. langs: the language of each window."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    data, offs = bv.buffers(pa.array(samples, pa.binary()))
    starts, ends = offs[:-1], offs[1:]
    number = {x: k for k, x in enumerate(names)}
    of = np.array([number[x] for x in langs], np.int64)
    keep, of = np.argsort(of, kind="stable"), np.sort(of)
    by_lang = [(k, x) for k, x in enumerate(np.split(keep, np.searchsorted(of, np.arange(1, len(names))))) if len(x)]
    params = {"E": rng.normal(0, 0.3, (257, VECTOR))}  # row 256: outside the window
    for w in WIDTHS:
        params[f"F{w}"] = rng.normal(0, 1 / np.sqrt(w * VECTOR), (w, VECTOR, FILTERS))
        params[f"b{w}"] = np.zeros(FILTERS)
    n_out = FILTERS * len(WIDTHS)
    params["O"], params["o"] = rng.normal(0, 0.2, (n_out, len(names))), np.zeros(len(names))
    m1, m2 = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}
    for step in range(1, steps + 1 if by_lang else 1):
        ids = np.concatenate([rng.choice(x, BATCH // len(by_lang) + 1) for _, x in by_lang])
        y = np.concatenate([np.full(BATCH // len(by_lang) + 1, k) for k, _ in by_lang])
        n = len(ids)
        x = np.full((n, WINDOW), 256, np.int64)
        for r, i in enumerate(ids.tolist()):
            cut = starts[i] + rng.integers(0, max(1, (ends[i] - starts[i]) // 2)) if rng.random() < 0.3 else starts[i]
            x[r, : ends[i] - cut] = data[cut : ends[i]]
        emb = params["E"][x]
        acts, best = [], []
        for w in WIDTHS:
            z = sum(emb[:, j : WINDOW - w + 1 + j] @ params[f"F{w}"][j] for j in range(w))
            arg = z.argmax(axis=1)
            best.append(arg)
            acts.append(np.take_along_axis(z, arg[:, None], 1)[:, 0] + params[f"b{w}"])
        pre = np.concatenate(acts, 1)
        hidden = np.maximum(pre, 0)
        z = hidden @ params["O"] + params["o"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        grad = {"O": hidden.T @ p + 1e-4 * params["O"], "o": p.sum(0), "E": np.zeros_like(params["E"])}
        back = (p @ params["O"].T) * (pre > 0)
        for k, w in enumerate(WIDTHS):
            g, arg = back[:, k * FILTERS : (k + 1) * FILTERS], best[k]
            grad[f"b{w}"] = g.sum(0)
            gf = np.zeros_like(params[f"F{w}"])
            for j in range(w):
                at = x[np.arange(n)[:, None], arg + j]
                gf[j] = np.einsum("nfv,nf->vf", params["E"][at], g)
                np.add.at(grad["E"], at, g[:, :, None] * params[f"F{w}"][j].T[None])
            grad[f"F{w}"] = gf
        for k, v in params.items():
            m1[k] += 0.1 * (grad[k] - m1[k])
            m2[k] += 0.01 * (grad[k] ** 2 - m2[k])
            v -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return network(names, params)


def predict(arr: pa.Array, net: Network | None) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text."""
    texts = arr.to_pylist()
    lettered = np.array([has_letter(t) for t in texts], bool)
    if net is None or not lettered.any():
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    data, offs = bv.buffers(arr)
    row, starts, ends = windows(offs)
    p = net.probabilities(net.pooled(cut(data, starts, ends))) * (ends - starts)[:, None]
    mean = np.stack([np.bincount(row, p[:, k], len(texts)) for k in range(len(net.langs))], 1)
    mean /= np.maximum(mean.sum(1, keepdims=True), 1e-9)
    best = mean.argmax(1)
    score = np.where(lettered, mean[np.arange(len(texts)), best], 0.0)
    return [net.langs[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.clip(score, 0, 1)


def sample(documents: DataFrame, max_docs: int = MAX_DOCS, windows_per_doc: int = WINDOWS_PER_DOC) -> DataFrame:
    """(doc_id, lang, windows) to learn from: documents with a lang whose checksum modulo 3 is not 1.

    Ids are chosen before any text is moved; one text for each id. They are chosen within SHARES shares of each language first,
    then of those, so that no task gets all ids of a language.
    """
    usable = documents.where("octet_length(text) > 0")
    known = usable.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(bucket("doc_id", 3) != 1).select(F.col("doc_id").cast("long").alias("doc_id"), "lang").distinct()
    share = F.pmod(F.xxhash64(F.lit("share"), "doc_id"), F.lit(SHARES)).cast("int")
    chosen = known.select("doc_id", "lang", share.alias("share"))
    for keys in (("lang", "share"), ("lang",)):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
        chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= max_docs).drop("nth")
    chosen = chosen.drop("share")
    texts = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [drawn(t, d, windows_per_doc) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "lang", "windows"])

    return texts.mapInArrow(trimmed(run), "doc_id long, lang string, windows array<binary>")


def fit(documents: DataFrame, max_docs: int = MAX_DOCS, windows_per_doc: int = WINDOWS_PER_DOC) -> Network | None:
    """Learn from a sample of all languages that documents have."""
    rows = sorted(sample(documents, max_docs, windows_per_doc).toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["lang"], r["windows"]))
    return train([w for r in rows for w in r["windows"]], [r["lang"] for r in rows for _ in r["windows"]])


def run_model(rows: DataFrame, net: Network | None) -> DataFrame:
    """Rows with lang_pred and score, in one pass without a shuffle. rows: a struct d with a field text."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("d"), "text")
            for a, b in slices(texts, 400_000):
                langs, score = predict(texts.slice(a, b - a), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(a, b - a), pa.array(langs, pa.string()), pa.array(score)], ["d", "lang_pred", "score"])

    return rows.select("d").mapInArrow(trimmed(run), rows.select("d").schema.add("lang_pred", "string").add("score", "double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = documents.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), (bucket("doc_id", 3) == 1).alias("held_out"), "text").alias("d"))
    return run_model(rows, fit(documents)).select("d.doc_id", "d.held_out", "lang_pred", "score")


#: How far a score must rise above chance, 1 / k of k languages, as a share of the way to 1: with four languages 0.3.
LEAST_GAIN = 1 / 15


def least_score(net: Network | None) -> float:
    """The score that a document must have to pass the filter; a single language needs none."""
    k = len(net.langs) if net else 1
    return 1 / k + LEAST_GAIN * (1 - 1 / k) if k > 1 else 0.0


def identified(documents: DataFrame, net: Network | None, least: float | None = None) -> DataFrame:
    """The documents, all columns as they were, whose language could be told: with at least the score `least`, by default least_score."""
    least = least_score(net) if least is None else least
    marked = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"))
    rows = run_model(marked, net).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return rows.select("d.*")
