"""Packing of tokenised documents into sequences of fixed length by best-fit decreasing.

A document's ids are cut into full windows of LENGTH ids and one rest. Pieces are dealt by a hash of document and start
into groups of about GROUP_PIECES, whose number grows with the corpus; each group is packed alone, longest piece first,
into the open sequence with the least room that still holds it. That sequence is found by a segment tree over
the possible amounts of remaining room: every node knows whether an open sequence has an amount in its range. A group
leaves one sequence or so partly filled among some hundred.

Only facts about pieces are shuffled and stored, no texts and no ids. Dealing and packing depend on the pieces alone, so a
task that runs again gives the same sequences.

White space never becomes an id and no id spans it, nor an ASCII letter and the punctuation after it, and case does not
matter. So texts are cut into runs at such places; the ids of each different run are taken once, kept by its bytes
for the following texts of a worker within a fixed bound, and put together with numpy.

A null text is empty: its only id is END. A null doc_id is a piece like any other. Repeated rows are packed each, and dealt
by their number within the task that read them too, so that many equal rows fill no group. Other columns are ignored. An empty table gives no sequences.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import materialize, tasks, text_slices, trimmed, whole_groups

LENGTH = 4096
END = 2
GROUP_PIECES = 2000
#: Different runs whose ids a worker process keeps, and their bytes; beyond either those seen once are forgotten before the next slice of texts.
CACHE_RUNS, CACHE_BYTES = 200_000, 15_000_000
#: Runs that are tokenised at a time.
LEARN_RUNS = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LETTER = bv.byte_class((0x61, 0x7A))
#: ASCII other than letters, digits, white space and the apostrophe, which some contractions begin with.
_PUNCTUATION = bv.byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: The lowest n bytes of a word, by n.
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)], np.uint64)
_loaded: dict[str, object] = {}
_encoders: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class Encoder:
    """Ids of many texts; keeps the ids of the runs seen last."""

    def __init__(self, path: str, cache_runs: int = CACHE_RUNS, cache_bytes: int = CACHE_BYTES):
        self.tokenizer, self.cache_runs, self.cache_bytes = _tokenizer(path), cache_runs, cache_bytes
        #: Numbers of runs of 8 bytes and more; a number is never given twice.
        self.long: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Keep the runs that several slices of texts had, if they leave room."""
        keep = self.used > 1
        if keep.sum() > self.cache_runs // 2:
            keep[:] = False
        begin, n = self.begin[keep], self.count[keep]
        self.known, self.count, self.used, self.begin = self.known[keep], n, np.ones(len(n), np.int32), np.cumsum(n) - n
        self.ids = self.ids[np.repeat(begin - self.begin, n) + np.arange(int(n.sum()))]
        kept = set((self.known[self.known >> np.uint64(63) > 0] & np.uint64((1 << 63) - 1)).tolist())
        self.long = defaultdict(self.long.default_factory, {k: v for k, v in self.long.items() if v in kept})
        if sum(map(len, self.long)) > self.cache_bytes // 2:
            self.cache_runs, runs = 0, self.cache_runs
            self._forget()
            self.cache_runs = runs

    def _learn(self, new: np.ndarray, runs: list[bytes]) -> None:
        """Take the ids of runs that are not known; new: their keys."""
        ids, counts = [], []
        for lo in range(0, len(runs), LEARN_RUNS):
            got = [x.ids for x in self.tokenizer.encode_batch_fast([r.decode() for r in runs[lo : lo + LEARN_RUNS]], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(counts[-1].sum())))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        known = np.concatenate([self.known, new])
        order = np.argsort(known)
        self.begin = np.concatenate([self.begin, np.cumsum(counts) - counts + len(self.ids)])[order]
        self.known, self.count, self.ids = known[order], np.concatenate([self.count, counts])[order], np.concatenate([self.ids, ids])
        self.used = np.append(self.used, np.zeros(len(new), np.int32))[order]

    def _keys(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A number for each run that no other run has: its bytes and length if it has less than 8, else one given to its bytes."""
        padded = np.append(data, np.zeros(8, np.uint8))
        words = np.ndarray(len(data), "<u8", padded, strides=(1,))
        key = (words[starts] & _LOW_BYTES[np.minimum(sizes, 7)]) | (sizes.astype(np.uint64) << np.uint64(56))
        long = np.flatnonzero(sizes > 7)
        raw, number = data.tobytes(), self.long
        numbers = [number[raw[a:b]] for a, b in zip(starts[long].tolist(), (starts + sizes)[long].tolist(), strict=True)]
        key[long] = np.array(numbers, np.uint64) | np.uint64(1 << 63)
        return key

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, END after each, and each text's range of them."""
        data, offs = bv.buffers(arr)
        cuts = None
        if b"<|" not in data.tobytes():  # what begins a token that is matched as it stands
            data = bv.LOWER[data]
            cuts = np.flatnonzero(_LETTER[data[:-1]] & _PUNCTUATION[data[1:]]) + 1
            cuts = cuts[~np.isin(cuts, offs)] if len(cuts) else None
        starts, ends, first = bv.spans(bv.NOT_SPACE[data], offs, cuts)
        if len(starts) == 0:
            return np.full(len(offs) - 1, END, np.uint32), np.arange(len(offs))
        if len(self.known) > self.cache_runs or sum(map(len, self.long)) > self.cache_bytes:
            self._forget()
        unique, at, inverse = np.unique(self._keys(data, starts, ends - starts), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        new = self.known[place] != unique if len(self.known) else np.ones(len(unique), bool)
        if new.any():
            raw, where = data.tobytes(), at[new]
            runs = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            self._learn(unique[new], runs)
            place = np.searchsorted(self.known, unique)
        self.used[place] += 1
        begin, n = self.begin[place][inverse], self.count[place][inverse]
        total = np.cumsum(n)
        flat = self.ids[np.repeat(begin - (total - n), n) + np.arange(int(total[-1]))]
        stop = np.append(0, total)[first]
        return np.insert(flat, stop[1:], END), stop + np.arange(len(stop))


def encoder_for(path: str) -> Encoder:
    """The encoder of this worker process, with what it has learned from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(doc_ids: list, flat: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> dict[str, list]:
    """The pieces of all texts: full windows and the rest of each."""
    out: dict[str, list] = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
    raw, flat = memoryview(np.ascontiguousarray(flat, "<u4").tobytes()), None
    for doc, a, b in zip(doc_ids, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        for at in range(a, b, length):
            to = min(at + length, b)
            for k, v in zip(out, (doc, at - a, to - at, zlib.crc32(raw[4 * at : 4 * to]), b - a), strict=True):
                out[k].append(v)
    return out


def tokenised(documents: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Facts about all pieces of the documents, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = encoder_for(vocabulary), 0
        for batch in batches:
            for a, b in text_slices(batch, "text"):
                part = batch.slice(a, b - a)
                got = pieces(part.column("doc_id").to_pylist(), *encoder.encode(part.column("text")), length)
                got["nth"] = list(range(n, n + len(got["start"])))
                n += len(got["start"])
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in got.values()], list(got))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), PIECES)


class Room:
    """Open sequences by their remaining room, in a segment tree over 0 to `length`."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.some = [False] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        k = room + self.size
        while k and not self.some[k]:
            self.some[k] = True
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least `least`: (room, sequence), no longer open."""
        some, k = self.some, least + self.size
        while not some[k]:
            while k & 1:  # a right child: the next range begins above
                k >>= 1
                if k <= 1:
                    return None
            if k == 0:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if some[2 * k] else 2 * k + 1
        room = k - self.size
        sequence = self.open[room].pop()
        if not self.open[room]:
            while k and (k >= self.size or not (some[2 * k] or some[2 * k + 1])):
                some[k] = False
                k >>= 1
        return room, sequence


def best_fit(lengths: list[int], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece; lengths descend."""
    room, sequences, offsets, n = Room(length), [], [], 0
    for size in lengths:
        found = room.take(size) if n else None
        if found is None:
            found = (length, n)
            n += 1
        left, sequence = found
        sequences.append(sequence)
        offsets.append(length - left)
        if left > size:
            room.put(left - size, sequence)
    return sequences, offsets


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "grp", GROUP_PIECES):
            group = rows.column("grp").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = rows.slice(a, b - a).drop_columns(["grp", "nth"]).combine_chunks()
                sequences, offsets = best_fit(part.column("length").to_pylist(), length)
                part = part.append_column("sequence_id", pa.array(np.array(sequences, np.int64) + (int(group[a]) << 31)))
                yield from part.append_column("offset", pa.array(offsets, pa.int64())).to_batches()

    return run


def packed(facts: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Sequence and offset of every piece. `facts` is read twice: to count it, and to deal it."""
    groups = max(1, -(-facts.count() // group_pieces))
    dealt = facts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "nth"), F.lit(groups))).repartition(tasks(facts.sparkSession), "grp")
    return dealt.sortWithinPartitions("grp", F.desc("length"), "doc_id", "start", "nth").mapInArrow(trimmed(_pack(length)), PACKED)


def pack(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return packed(materialize(tokenised(documents, vocabulary or default_vocabulary()), "pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
