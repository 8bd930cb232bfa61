"""Removal of repeated byte strings by an enhanced suffix array.

A byte goes if a string of LENGTH = 100 bytes that covers it also starts earlier: in a document with a smaller doc_id, or
before in the same one. Strings never cross documents; all are judged on the texts as given.

A suffix array of the whole corpus would sort every byte's suffix. Here only the suffixes at anchors are sorted: of the
51 strings of GRAM = 50 bytes in a window of 100, the one with the smallest hash. Equal windows choose equal anchors, so all
occurrences of a repeat are found, and anything that repeats comes with its anchor and at most LEFT bytes before and
LENGTH bytes after it: the context.

0. Whole texts that an earlier document has too go as they are, by their SHA-256; only the first of each is looked into.
1. One pass finds the anchors (about 4 in 100 bytes) and sends the hashes of anchor and context by the anchor's hash.
   Copies of one context within a task are settled there: all but the first are covered, and only the first is sent.
2. Where anchors meet: of equal contexts all but the first are covered. Anchors with one context only are done. Of
   others one occurrence of each context goes on. Groups of more than `group_contexts` are cut into parts that meet pairwise.
3. The bytes of these contexts are looked up and the suffixes of each group sorted. A stack scan of the common prefixes of
   neighbours gives the tree of common-prefix intervals; an interval whose members differ to the left is split by
   the same scan over the reversed left contexts. Each result is a maximal repeat with all of its occurrences in the group; if
   it has LENGTH bytes, all but its first occurrence are covered.
4. The covered ranges of each document are united, and its bytes cut.

The hash of an anchor only brings contexts together. Two contexts of one anchor are taken as equal if their XXH3 hashes of 64 bits
and their places within are; whole texts if their SHA-256 is. A null text is empty. A null doc_id is smaller than any other. Rows
that agree in doc_id and text count as one document and get equal results; different texts with one doc_id are different
documents, in the order of a hash of the text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import Scratch, materialize, release, slices, tasks, text_slices, trimmed, whole_groups

LENGTH = 100
GRAM = 50
LEFT = LENGTH - GRAM
GROUP_CONTEXTS = 1000
FLUSH_ANCHORS = 300_000
#: Contexts whose suffixes are sorted at a time, one unit at least.
BATCH_CONTEXTS = 20_000
_FOUND = "doc_id long, twin int, spans binary, asks binary"
_PLACE = np.dtype([("doc", "<i8"), ("twin", "<i4"), ("pos", "<i4"), ("right", "u1")])
_SPAN = np.dtype([("doc", "<i8"), ("twin", "<i4"), ("start", "<i4"), ("end", "<i4")])
_ASK = np.dtype([("unit", "<i8"), ("pos", "<i4")])


def _slide(ufunc: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """ufunc over every `width` successive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = ufunc(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place, bytes to the right (LENGTH at most), hash and context hash of every anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = bv.Prefix(data)
    gram = prefix.windows(GRAM)
    small = (gram >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    least = _slide(np.minimum, small, LENGTH - GRAM + 1)  # for each window of LENGTH bytes
    ok = np.zeros(len(least), bool)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            ok[a : b - LENGTH + 1] = True
    least[~ok] = 0
    pad = np.zeros(LENGTH - GRAM, np.uint32)
    chosen = _slide(np.maximum, np.concatenate([pad, least, pad]), LENGTH - GRAM + 1) == small
    at = np.flatnonzero(chosen)
    text = np.searchsorted(offs, at, side="right") - 1
    lo, hi = np.maximum(at - LEFT, offs[text]), np.minimum(at + LENGTH, offs[text + 1])
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    context = np.fromiter((digest(raw[a:b], left) for a, b, left in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)), np.uint64, len(at))
    return text, at - offs[text], hi - at, gram[at], context


def merged(spans: np.ndarray) -> np.ndarray:
    """The union of the ranges of each document, as ranges that do not touch."""
    if len(spans) == 0:
        return spans
    spans = spans[np.lexsort((spans["start"], spans["twin"], spans["doc"]))]
    new = np.append(True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["twin"][1:] != spans["twin"][:-1]))
    base = (np.cumsum(new) - 1) << 32
    upto = np.maximum.accumulate(base + spans["end"])
    head = np.append(True, (base + spans["start"])[1:] > upto[:-1])
    first = np.flatnonzero(head)
    out = spans[first].copy()
    out["end"] = (upto[np.append(first[1:], len(spans)) - 1] - base[first]).astype(np.int32)
    return out


def covered_by_context(place: np.ndarray) -> np.ndarray:
    out = np.empty(len(place), _SPAN)
    out["doc"], out["twin"] = place["doc"], place["twin"]
    out["start"] = np.maximum(place["pos"] - LEFT, 0)
    out["end"] = place["pos"] + place["right"]
    return out


def sorted_anchors(gram: np.ndarray, context: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the order of gram, context and place; equal ones, which repeated rows send, count once."""
    order = np.lexsort((place["pos"], place["twin"], place["doc"], context, gram))
    gram, context, place = gram[order], context[order], place[order]
    new = np.ones(len(gram), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (gram, context, place["doc"], place["twin"], place["pos"])], axis=0)
    return (gram, context, place) if new.all() else (gram[new], context[new], place[new])


def _pack(gram: np.ndarray, context: np.ndarray, place: np.ndarray, spans: np.ndarray) -> bytes:
    columns = b"".join(np.ascontiguousarray(x[k]).tobytes() for x in (place, spans) for k in x.dtype.names)
    return np.array([len(gram), len(spans)], "<i8").tobytes() + gram.tobytes() + context.tobytes() + zstandard.ZstdCompressor(1).compress(columns)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, "<i8", 2).tolist()
    gram, context = np.frombuffer(blob, "<u8", n, 16), np.frombuffer(blob, "<u8", n, 16 + 8 * n)
    columns, at, out = zstandard.ZstdDecompressor().decompress(blob[16 + 16 * n :]), 0, []
    for kind, size in ((_PLACE, n), (_SPAN, m)):
        x = np.empty(size, kind)
        for k in kind.names:
            x[k] = np.frombuffer(columns, kind[k], size, at)
            at += size * kind[k].itemsize
        out.append(x)
    return gram, context, *out


def _send(buckets: int):
    """Anchors by bucket, packed: one row for each bucket and flush."""

    def flush(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, context, place = sorted_anchors(*(np.concatenate(x) for x in zip(*got, strict=True)))
        twice = np.append(False, (gram[1:] == gram[:-1]) & (context[1:] == context[:-1]))
        spans = merged(covered_by_context(place[twice]))
        gram, context, place = gram[~twice], context[~twice], place[~twice]
        to = (gram % np.uint64(buckets)).astype(np.int64)
        span_to = (bv.mix(spans["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order, span_order = np.lexsort((place["pos"], place["doc"], to)), np.argsort(span_to, kind="stable")
        gram, context, place, to, spans, span_to = gram[order], context[order], place[order], to[order], spans[span_order], span_to[span_order]
        edges, span_edges = np.searchsorted(to, np.arange(buckets + 1)), np.searchsorted(span_to, np.arange(buckets + 1))
        for k in range(buckets):
            a, b, c, d = edges[k], edges[k + 1], span_edges[k], span_edges[k + 1]
            if b > a or d > c:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(gram[a:b], context[a:b], place[a:b], spans[c:d])], pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = [], 0
        for batch in batches:
            for a, b in text_slices(batch, "text", 1_000_000):
                part = batch.slice(a, b - a)
                data, offs = bv.buffers(part.column("text"))
                text, pos, right, gram, context = anchors(data, offs)
                place = np.empty(len(text), _PLACE)
                place["doc"] = part.column("doc_id").to_numpy(zero_copy_only=False)[text]
                place["twin"] = part.column("twin").to_numpy(zero_copy_only=False)[text]
                place["pos"], place["right"] = pos, right
                got.append((gram, context, place))
                n += len(text)
                if n >= FLUSH_ANCHORS:
                    yield from flush(got)
                    got, n = [], 0
        if n:
            yield from flush(got)

    return run


def _by_document(spans: np.ndarray, asks: np.ndarray, ask_doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, twin, spans, asks), some thousand documents at a time. ask_doc: places of the asks."""
    spans = merged(spans)
    order = np.lexsort((ask_doc["twin"], ask_doc["doc"]))
    asks, ask_doc = asks[order], ask_doc[order]
    names = np.concatenate([np.ascontiguousarray(x[["doc", "twin"]]).astype([("doc", "<i8"), ("twin", "<i4")]) for x in (spans, ask_doc)])
    if len(names) == 0:
        return
    order = np.lexsort((names["twin"], names["doc"]))
    names = names[order]
    names = names[np.append(True, names[1:] != names[:-1])]

    def edges(x: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(np.append(True, (x["doc"][1:] != x["doc"][:-1]) | (x["twin"][1:] != x["twin"][:-1]))) if len(x) else [], len(x)).astype(np.int64)

    out: dict[tuple[int, int], list[bytes]] = {}
    pairs = np.stack([spans["start"], spans["end"]], 1).astype("<i4")
    for k, (x, raw) in enumerate(((spans, pairs), (ask_doc, asks))):
        e = edges(x).tolist()
        docs, twins = x["doc"].tolist(), x["twin"].tolist()
        for a, b in zip(e[:-1], e[1:], strict=True):
            out.setdefault((docs[a], twins[a]), [b"", b""])[k] = raw[a:b].tobytes()
    rows = list(out.items())
    for lo in range(0, len(rows), 5000):
        part = rows[lo : lo + 5000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in part], pa.int64()), pa.array([r[0][1] for r in part], pa.int32()), pa.array([r[1][0] for r in part], pa.binary()), pa.array([r[1][1] for r in part], pa.binary())], ["doc_id", "twin", "spans", "asks"])


def _meet(group_contexts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpack(x) for batch in batches for x in batch.column("blob").to_pylist()]
        if not got:
            return
        gram, context, place, spans = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        if len(gram):
            order = np.argsort(gram, kind="stable")
            same = gram[order][1:] == gram[order][:-1]
            again = order[np.append(False, same) | np.append(same, False)]  # all other anchors do not repeat
            gram, context, place = sorted_anchors(gram[again], context[again], place[again])
        if len(gram) == 0:
            yield from _by_document(spans, np.zeros(0, _ASK), np.zeros(0, _PLACE))
            return
        head = np.append(True, gram[1:] != gram[:-1])
        first = head | np.append(True, context[1:] != context[:-1])
        spans = np.concatenate([spans, covered_by_context(place[~first])])
        gram, place = gram[first], place[first]
        head = np.flatnonzero(head[first])
        sizes = np.diff(np.append(head, len(gram)))
        size = np.repeat(sizes, sizes)
        many = size > 1
        gram, place, size = gram[many], place[many], size[many]
        parts = -(-size // group_contexts)
        salt = bv.mix(place["doc"].astype(np.uint64) * np.uint64(31) + place["pos"].astype(np.uint64))
        own = (salt % parts.astype(np.uint64)).astype(np.int64)
        row = np.repeat(np.arange(len(gram)), parts)
        other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        low, high = np.minimum(own[row], other), np.maximum(own[row], other)
        asks = np.empty(len(row), _ASK)
        asks["unit"] = bv.mix(gram[row] ^ bv.mix((low * 1_000_003 + high).astype(np.uint64))).view(np.int64)
        asks["pos"] = place["pos"][row]
        yield from _by_document(spans, asks, place[row])

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x.slice(a, b - a) for x in batches for a, b in slices(x.column("text"))):
        unit, doc, twin, pos, left, context = [], [], [], [], [], []
        for d, t, text, blobs in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "twin", "text", "asks")), strict=True):
            raw = text.encode()
            for a in (np.frombuffer(b, _ASK) for b in blobs):
                for u, p in zip(a["unit"].tolist(), a["pos"].tolist(), strict=True):
                    lo = max(0, p - LEFT)
                    unit.append(u)
                    pos.append(p)
                    left.append(p - lo)
                    context.append(raw[lo : p + LENGTH])
                doc += [d] * len(a)
                twin += [t] * len(a)
            if len(unit) > 50_000:
                yield _context_rows(unit, doc, twin, pos, left, context)
                unit, doc, twin, pos, left, context = [], [], [], [], [], []
        if unit:
            yield _context_rows(unit, doc, twin, pos, left, context)


def _context_rows(unit, doc, twin, pos, left, context) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(doc, pa.int64()), pa.array(twin, pa.int32()), pa.array(pos, pa.int32()), pa.array(left, pa.int32()), pa.array(context, pa.binary())], ["unit", "doc_id", "twin", "pos", "left", "context"])


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def prefix_intervals(strings: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """The tree of common-prefix intervals of the sorted strings: (common bytes, numbers of the members), children first.

    The strings are sorted, the common prefixes of neighbours computed, and the intervals read off with a stack.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    stack: list[tuple[int, int]] = []  # (common bytes, first place)
    for place in range(1, len(order) + 1):
        common = common_prefix(strings[order[place - 1]], strings[order[place]]) if place < len(order) else -1
        begin = place - 1
        while stack and stack[-1][0] > common:
            depth, begin = stack.pop()
            yield depth, order[begin:place]
        if common >= 0 and (not stack or stack[-1][0] < common):
            stack.append((common, begin))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of the repeats of at least `length` bytes around the anchors.

    lefts: the left contexts, reversed. An interval whose members all agree on the left is a repeat as it is; one whose
    members differ there is split by the tree of their left contexts.
    """
    for right, members in prefix_intervals(rights):
        if length - right > LEFT:
            continue
        some = lefts[members[0]]
        if all(lefts[m] == some for m in members):
            if len(some) + right >= length:
                yield len(some), right, members
            continue
        for left, part in prefix_intervals([lefts[m] for m in members]):
            if left + right >= length:
                yield left, right, [members[k] for k in part]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges that are covered, of all units of a task, some at a time. Rows come sorted by unit and place."""
    for rows in whole_groups(batches, "unit", BATCH_CONTEXTS):
        yield from _repeats_of(rows)


def _repeats_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    numbers = [rows.column(k).to_numpy() for k in ("unit", "doc_id", "twin", "pos")]
    new = np.append(True, np.any([x[1:] != x[:-1] for x in numbers], axis=0))  # repeated rows count once
    if not new.all():
        rows, numbers = rows.filter(pa.array(new)), [x[new] for x in numbers]
    unit = numbers[0]
    place = np.empty(len(unit), _SPAN)
    place["doc"], place["twin"] = numbers[1], numbers[2]
    pos, cut = rows.column("pos").to_pylist(), rows.column("left").to_pylist()
    edges = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(unit)).tolist()
    who, start, end = [], [], []
    context = rows.column("context")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a < 2:
            continue
        raw = context.slice(a, b - a).to_pylist()
        lefts, rights = [x[:k][::-1] for x, k in zip(raw, cut[a:b], strict=True)], [x[k:] for x, k in zip(raw, cut[a:b], strict=True)]
        if b - a == 2:
            found = [(common_prefix(*lefts), common_prefix(*rights), [0, 1])]
            found = [x for x in found if x[0] + x[1] >= LENGTH]
        else:
            found = maximal_repeats(lefts, rights)
        # A repeat inside of one found before adds nothing: intervals come children first, so for one member the bytes to
        # the right only get fewer, and just those to the left need be compared.
        reach: dict[int, int] = {}
        for left, right, members in found:
            first = min(members)  # members are numbered in the order of documents and places
            for m in members:
                if m != first and left > reach.get(m, -1):
                    reach[m] = left
                    who.append(a + m)
                    start.append(pos[a + m] - left)
                    end.append(pos[a + m] + right)
    spans = place[who]
    spans["start"], spans["end"] = start, end
    yield from _by_document(spans, np.zeros(0, _ASK), np.zeros(0, _PLACE))


def copies(scratch: Scratch, documents: DataFrame) -> DataFrame:
    """(doc_id, twin) of the documents of LENGTH bytes and more whose whole text an earlier one has.

    Only digests are shuffled; those that occur twice are a table, so that copies of one text are a hot key of a join of
    two plain shuffles.
    """
    facts = documents.where(F.octet_length("text") >= LENGTH).select("doc_id", "twin", F.unhex(F.sha2("text", 256)).alias("digest"))
    facts = scratch.keep(facts, "digests")
    first = facts.groupBy("digest").agg(F.min(F.struct("doc_id", "twin")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = scratch.keep(first.where("n > 1").select("digest", "first"), "first")
    return scratch.keep(facts.join(first, "digest").where(F.struct("doc_id", "twin") != F.col("first")).select("doc_id", "twin").distinct(), "copies")


def covered(documents: DataFrame, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """(doc_id, twin, spans, whole): covered ranges of a document, as an array of packed pairs of ints, or all of it. documents: doc_id, twin, text."""
    spark = documents.sparkSession
    scratch, n = Scratch(spark, "repeats"), tasks(spark)
    gone = copies(scratch, documents)
    documents = documents.join(gone, ["doc_id", "twin"], "left_anti")
    sent = documents.mapInArrow(trimmed(_send(n)), "bucket int, blob binary").repartitionById(n, F.col("bucket"))
    met = scratch.keep(sent.mapInArrow(trimmed(_meet(group_contexts)), _FOUND), "anchors")
    release(spark)
    asked = met.where("octet_length(asks) > 0").groupBy("doc_id", "twin").agg(F.collect_list("asks").alias("asks"))
    contexts = documents.join(asked, ["doc_id", "twin"]).mapInArrow(trimmed(_contexts), "unit long, doc_id long, twin int, pos int, left int, context binary")
    more = scratch.keep(contexts.repartition(n, "unit").sortWithinPartitions("unit", "doc_id", "twin", "pos").mapInArrow(trimmed(_repeats), _FOUND), "contexts")
    release(spark)
    spans = met.where("octet_length(spans) > 0").select("doc_id", "twin", "spans").unionAll(more.select("doc_id", "twin", "spans"))
    spans = spans.groupBy("doc_id", "twin").agg(F.collect_list("spans").alias("spans")).withColumn("whole", F.lit(False))
    spans = materialize(spans.unionAll(gone.select("doc_id", "twin", F.array().cast("array<binary>"), F.lit(True))), "repeat-spans")
    scratch.clear()
    return spans


def ranges(blobs: list[bytes], n: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the united ranges within n bytes."""
    pairs = np.concatenate([np.frombuffer(b, "<i4").reshape(-1, 2) for b in blobs])
    edges = np.zeros(n + 2, np.int32)
    np.add.at(edges, np.minimum(pairs[:, 0], n), 1)
    np.add.at(edges, np.minimum(pairs[:, 1], n), -1)
    inside = np.concatenate([[False], np.cumsum(edges)[:n] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[0::2].tolist(), turns[1::2].tolist()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x.slice(a, b - a) for x in batches for a, b in slices(x.column("text"))):
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, blobs, whole in zip(*(batch.column(k).to_pylist() for k in ("text", "spans", "whole")), strict=True):
            raw = text.encode()
            starts, ends = ([0], [len(raw)]) if whole else ranges(blobs, len(raw)) if blobs else ([], [])
            kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))
            for k, v in zip(out, (len(raw), len(raw) - len(kept), len(starts), kept), strict=True):
                out[k].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", *out])


NO_ID = -(1 << 63)


def without_repeats(documents: DataFrame, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): of every document the bytes that stay."""
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.hash("text").alias("twin"), F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.join(covered(rows, group_contexts), ["doc_id", "twin"], "left").select("doc_id", "text", "spans", "whole")
    cut = cut.mapInArrow(trimmed(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
