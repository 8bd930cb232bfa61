"""Maximal repeats of LENGTH bytes and more, each with all places where it occurs.

A repeat is a byte string that occurs at two places or more, within documents; it is maximal if its places differ in the
byte before it and in the byte after it (the border of a text differs from everything). Places may overlap, but one whose
LENGTH bytes also begin at most LEFT bytes before it is within a stretch of a short period and is no place: of the stretch
only those in its first period are. Else a text of n equal bytes would have n repeats of up to n places each.

1. Anchors (see op8_repeats) whose hash occurs twice are units. The first LENGTH bytes of a repeat hold an anchor at most
   LEFT bytes from its start, at the same distance in all of its places.
2. Of each unit the bytes before the anchors, read backwards, form a tree of common-prefix intervals. An interval of depth l
   is a node: the suffixes that begin l bytes before the anchors and agree up to there, but not all a byte before.
   Anchors amid a repeat agree for more than LEFT bytes and form none.
3. The suffixes of each node form such a tree too. An interval of LENGTH bytes and more whose suffixes differ to the left is a
   maximal repeat. Suffixes are fetched in segments: of 256 bytes first, then up to 1024, 4096 and so on, and only for those
   that agree with another so far; so no length is cut.
4. Two anchors near one start give one repeat twice: repeats are named by their first place and their length.

Trees are scanned with a stack over distinct sorted keys; equal ones are counted before they meet, so copies are no load. A node of more than
`limit` distinct keys is split first, along the way from the root to one of its keys, chosen by hash: what the others share with that
key tells the intervals on the way, and what branches off at one depth by one byte is a narrower node. Each such round halves the
nodes in expectation, however deep the tree is, and no task holds more than `limit` keys of one node.

Of texts that are equal as a whole, two go through all this; the places of the second are those of all further ones.

Names are 64 bits of XXH64 and 128 of MD5: results are exact up to their collisions. A null text is empty. Rows that agree in doc_id and
text count as one document; different texts with one doc_id are different documents, told apart by `twin`, a hash of the text. A null
doc_id is one of its own, smaller than any other. An empty table, or one without repeats, has no groups. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import Scratch, materialize, release, slices, tasks, text_slices, trimmed, whole_groups
from .op8_repeats import GROUP_CONTEXTS, LEFT, LENGTH, NO_ID, anchors, common_prefix, prefix_intervals

#: Bytes of a suffix that are looked at first; each further round looks at four times as many.
SEGMENT = 256
#: No byte of UTF-8; marks the border of a text, and differs from all bytes of texts.
END = b"\xff"
#: Bytes of keys that are sent at a time.
FLUSH_BYTES = 8_000_000
_ROW = "node long, doc_id long, twin int, start int, before int, key binary"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch, "text", 1_000_000):
            part = batch.slice(a, b - a)
            text, pos, _, gram, _ = anchors(*bv.buffers(part.column("text")))
            doc, twin = (part.column(k).to_numpy(zero_copy_only=False)[text] for k in ("doc_id", "twin"))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(doc, pa.int64()), pa.array(twin, pa.int32()), pa.array(pos, pa.int32())], ["node", "doc_id", "twin", "start"])


def backwards(raw: bytes, at: int) -> bytes:
    """LEFT + 1 bytes before `at`, last first; END after them if the text begins there."""
    key = raw[max(0, at - LEFT - 1) : at][::-1]
    return key if len(key) > LEFT else key + END


def segment(raw: bytes, begin: int, end: int) -> bytes:
    """The bytes from begin to end; END after them if the text has fewer."""
    key = raw[begin:end]
    return key if len(key) == end - begin else key + END


def within_period(raw: bytes, at: int) -> bool:
    """Whether the LENGTH bytes from `at` also begin at most LEFT bytes before."""
    return raw.find(raw[at : at + LENGTH], max(0, at - LEFT), at + LENGTH - 1) >= 0


def _keys(lo: int, hi: int):
    """Keys of the places that are asked for: segments (lo, hi) of their suffixes, or, with hi = 0, what is before them."""

    def rows(got: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*got, strict=True), kinds, strict=True)], ["node", "doc_id", "twin", "start", "before", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in (x.slice(a, b - a) for x in batches for a, b in slices(x.column("text"))):
            for i in range(batch.num_rows):
                doc, twin, text = (batch.column(k)[i].as_py() for k in ("doc_id", "twin", "text"))
                raw = text.encode()
                for ask in batch.column("asks")[i].as_py():
                    at = ask["start"]
                    if hi and not lo and within_period(raw, at):
                        continue
                    key = segment(raw, at + lo, at + hi) if hi else backwards(raw, at)
                    got.append((ask["node"], doc, twin, at, raw[at - 1] if at else -1, key))
                    held += len(key) + 100
                    if held > FLUSH_BYTES:
                        yield rows(got)
                        got, held = [], 0
        if got:
            yield rows(got)

    return run


def fetch(scratch: Scratch, documents: DataFrame, places: DataFrame, lo: int, hi: int) -> DataFrame:
    """(node, doc_id, twin, start, before, key, name): places with their keys. places: node, doc_id, twin, start."""
    asks = places.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("node", "start")).alias("asks"))
    found = documents.join(asks, ["doc_id", "twin"]).mapInArrow(trimmed(_keys(lo, hi)), _ROW)
    found = found.dropDuplicates(["node", "doc_id", "twin", "start"])  # repeated rows
    return scratch.keep(found.withColumn("name", F.unhex(F.md5("key"))), "keys")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The intervals of each node. Rows come sorted by part, then node; a node's part has at most `limit` keys."""

    def rows(got: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*got, strict=True), kinds, strict=True)], ["node", "name", "depth", "prefix"])

    for table in whole_groups(batches, "part", 10_000):
        part, node = table.column("part").to_numpy(), table.column("node").to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (node[1:] != node[:-1]))), len(part)).tolist()
        got = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            keys, names = (table.column(k).slice(a, b - a).to_pylist() for k in ("key", "name"))
            for depth, members in prefix_intervals(keys):
                prefix = hashlib.md5(keys[members[0]][:depth]).digest()
                got += [(int(node[a]), names[m], depth, prefix) for m in members]
            if len(got) > 50_000:
                yield rows(got)
                got = []
        if got:
            yield rows(got)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """depth: the bytes that a key shares with its node's pivot."""
    for batch in batches:
        depth = [common_prefix(a, b) for a, b in zip(batch.column("key").to_pylist(), batch.column("pivot").to_pylist(), strict=True)]
        yield batch.append_column("depth", pa.array(depth, pa.int32()))


def intervals(scratch: Scratch, rows: DataFrame, limit: int) -> DataFrame:
    """(node, name, depth, prefix): of each key the common-prefix intervals of its node that it is in.

    rows: node, key, name. Equal keys of a node that end with a text are an interval without that end, too.
    """
    spark, n = rows.sparkSession, tasks(rows.sparkSession)
    keys = scratch.keep(rows.groupBy("node", "name").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("n")), "distinct")
    size = F.octet_length("key")
    ended = keys.where((F.col("n") > 1) & (F.substring("key", size, F.lit(1)) == F.lit(END)))
    found = [ended.select("node", "name", (size - 1).cast("int").alias("depth"), F.unhex(F.md5(F.substring("key", F.lit(1), size - 1))).alias("prefix"))]
    parts = keys.select("node", F.col("node").alias("part"), "name", "key")
    while True:
        large = parts.groupBy("node", "part").agg(F.count(F.lit(1)).alias("n"), F.min_by("key", F.xxhash64("name")).alias("pivot"))
        large = scratch.keep(large.where(F.col("n") > limit).select("node", "part", "pivot"), "large")
        if large.isEmpty():
            break
        split = parts.join(large, ["node", "part"]).select("node", "part", "name", "key", "pivot")
        split = scratch.keep(split.mapInArrow(trimmed(_shared), "node long, part long, name binary, key binary, pivot binary, depth int"), "split")
        off = split.where(F.col("key") != F.col("pivot"))
        levels = off.groupBy("node", "part").agg(F.collect_set("depth").alias("levels"))
        on = split.join(levels, ["node", "part"]).select("node", "name", "pivot", F.explode(F.filter("levels", lambda d: d <= F.col("depth"))).alias("depth"))
        found.append(on.select("node", "name", "depth", F.unhex(F.md5(F.substring("pivot", F.lit(1), F.col("depth")))).alias("prefix")))
        narrower = off.select("node", F.xxhash64("part", "depth", F.substring("key", F.col("depth") + 1, F.lit(1))).alias("part"), "name", "key")
        parts = scratch.keep(parts.join(large, ["node", "part"], "left_anti").unionAll(narrower), "parts")
    scanned = parts.repartition(n, "node", "part").sortWithinPartitions("part", "node").mapInArrow(trimmed(_scan), "node long, name binary, depth int, prefix binary")
    for more in found:
        scanned = scanned.unionAll(more)
    made = scratch.keep(scanned.distinct(), "intervals")
    release(spark)
    return made


def _texts(scratch: Scratch, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without the third and further ones of equal texts, and these: (doc_id, twin, as_id, as_twin), with the second of their text."""
    one = F.struct("doc_id", "twin")
    facts = documents.where(F.octet_length("text") >= LENGTH).select("doc_id", "twin", F.unhex(F.sha2("text", 256)).alias("digest")).distinct()
    facts = scratch.keep(facts, "digests")
    first = facts.groupBy("digest").agg(F.min(one).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 2")
    later = scratch.keep(facts.join(first, "digest").where(one != F.col("first")).select("digest", "doc_id", "twin"), "later")
    second = scratch.keep(later.groupBy("digest").agg(F.min(one).alias("second")), "second")
    more = later.join(second, "digest").where(one != F.col("second"))
    more = scratch.keep(more.select("doc_id", "twin", F.col("second.doc_id").alias("as_id"), F.col("second.twin").alias("as_twin")), "more")
    return documents.join(more, ["doc_id", "twin"], "left_anti"), more


def repeat_groups(documents: DataFrame, limit: int = GROUP_CONTEXTS) -> DataFrame:
    """(repeat, n_bytes, n_places, doc_id, twin, start): a row for each place of each maximal repeat; bytes are counted from 0.

    `repeat` names the group by its first place, as doc_id:twin:start:n_bytes. documents: doc_id, text.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "repeat-groups")
    documents = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.hash("text").alias("twin"), F.coalesce("text", F.lit("")).alias("text"))
    documents, more = _texts(scratch, documents.where(F.octet_length("text") >= LENGTH))
    found = documents.mapInArrow(trimmed(_anchor_rows), "node long, doc_id long, twin int, start int").distinct()
    found = scratch.keep(found, "anchors")
    twice = scratch.keep(found.groupBy("node").count().where("count > 1").select("node"), "units")
    rows = fetch(scratch, documents, found.join(twice, "node", "left_semi"), 0, 0)
    nodes = rows.join(intervals(scratch, rows, limit), ["node", "name"])
    places = nodes.select(F.xxhash64("node", "depth", "prefix").alias("node"), "doc_id", "twin", (F.col("start") - F.col("depth")).alias("start"))
    places = scratch.keep(places, "suffixes")

    lo, hi, parts = 0, SEGMENT, []
    place = F.struct("doc_id", "twin", "start")
    while not places.isEmpty():
        rows = fetch(scratch, documents, places, lo, hi)
        tree = intervals(scratch, rows, limit).where(F.col("depth") + lo >= LENGTH)
        members = rows.join(tree, ["node", "name"]).select("node", "prefix", (F.col("depth") + lo).alias("n_bytes"), "doc_id", "twin", "start", "before")
        members = scratch.keep(members, "members")
        diverse = (F.min("before") < 0) | (F.min("before") < F.max("before"))
        groups = members.groupBy("node", "prefix", "n_bytes").agg(F.min(place).alias("first"), diverse.alias("diverse")).where("diverse")
        parts.append(scratch.keep(members.join(groups, ["node", "prefix", "n_bytes"]).select("first", "n_bytes", "doc_id", "twin", "start"), "groups"))
        open_ = rows.where(F.octet_length("key") == hi - lo).where(F.substring("key", F.lit(hi - lo), F.lit(1)) != F.lit(END))
        again = open_.groupBy("node", "name").count().where("count > 1").select("node", "name")
        places = open_.join(again, ["node", "name"], "left_semi").select(F.xxhash64("node", "name").alias("node"), "doc_id", "twin", "start")
        places = scratch.keep(places, "suffixes")
        lo, hi = hi, 4 * hi
    if not parts:
        parts.append(spark.createDataFrame([], "first struct<doc_id:long,twin:int,start:int>, n_bytes int, doc_id long, twin int, start int"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    copied = every.join(more.withColumnsRenamed({"doc_id": "to_id", "twin": "to_twin", "as_id": "doc_id", "as_twin": "twin"}), ["doc_id", "twin"])
    every = every.unionAll(copied.select("first", "n_bytes", F.col("to_id").alias("doc_id"), F.col("to_twin").alias("twin"), "start"))
    every = scratch.keep(every.distinct(), "places")
    counts = every.groupBy("first", "n_bytes").agg(F.count(F.lit(1)).alias("n_places"))
    told = F.concat_ws(":", *(F.when(F.col("first")[k] != NO_ID, F.col("first")[k]).otherwise(F.lit("")).cast("string") if k == "doc_id" else F.col("first")[k].cast("string") for k in ("doc_id", "twin", "start")), F.col("n_bytes").cast("string"))
    out = every.join(counts, ["first", "n_bytes"]).select(told.alias("repeat"), "n_bytes", "n_places", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "twin", "start")
    out = materialize(out, "repeat-places")
    scratch.clear()
    return out


def repeat_strings(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """(repeat, n_bytes, n_places, string): the bytes of each group of repeat_groups(documents), a row for each group."""
    one = groups.groupBy("repeat", "n_bytes", "n_places").agg(F.min(F.struct("doc_id", "twin", "start")).alias("first"))
    one = one.select("repeat", "n_bytes", "n_places", F.col("first.doc_id").alias("doc_id"), F.col("first.twin").alias("twin"), F.col("first.start").alias("start"))
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.hash("text").alias("of"), "text").dropDuplicates(["id", "of"])
    joined = one.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("twin") == F.col("of")))
    return joined.select("repeat", "n_bytes", "n_places", F.substring(F.encode("text", "UTF-8"), F.col("start") + 1, F.col("n_bytes")).alias("string"))
