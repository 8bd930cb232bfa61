"""WARC records in seekable Zstandard bundles.

A bundle is a byte string: WARC records, grouped into frames that are compressed each on its own, and at the end a
skippable frame with the seek table (compressed and uncompressed size of every frame, then the number of frames, a
descriptor byte and the magic number of seekable archives). Any Zstandard tool reads the bundle as a whole;
the index maps each record id to its bundle, frame, and the record's offset and length within the decompressed frame.

Bundles are rows of a Parquet table in the shared folder, so that Spark's commit protocol guards them
against lost and repeated tasks on any file system, and no executor writes local files. A bundle ends at `bundle_bytes`
of records or with its partition.

Of equal payloads of at least MIN_REVISIT bytes the record with the smallest id holds the payload, the others revisit it.
Equal means equal SHA-256 and length. A null payload is empty. Repeated ids (rows repeated whole) are written each;
of those with the smallest id all are responses. Null urls become empty headers. An empty table gives no bundles.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, trimmed

MIN_REVISIT = 100
FRAME_BYTES = 256_000
BUNDLE_BYTES = 8_000_000
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, frame int, offset long, length long"
BUNDLE = f"bundle_id string, archive binary, records array<struct<{INDEX.replace(' ', ':').replace(',:', ',')}>>"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record with the payload, or a revisit record without it."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + "".join((url or "").split()))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head += [f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the content block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record has the wrong length")
    return fields, rest[:n]


class BundleWriter:
    """Collects records into frames, and frames into a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame_bytes = frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()
        self.index: list[tuple[int | None, int, int, int]] = []
        self.total = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self._close_frame()
        self.index.append((page_id, len(self.frames), len(self.open), len(record)))
        self.open += record
        self.total += len(record)

    def _close_frame(self) -> None:
        packed = self.compressor.compress(bytes(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), len(self.open)))
        self.open = bytearray()

    def finish(self) -> bytes:
        if self.open:
            self._close_frame()
        table = b"".join(struct.pack("<II", a, b) for a, b in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


class BundleReader:
    """Frames of a bundle by number; the last frame read is kept."""

    def __init__(self, archive: bytes):
        n, _, magic = struct.unpack_from("<IBI", archive, len(archive) - 9)
        at = len(archive) - 9 - 8 * n
        if magic != SEEKABLE_MAGIC or struct.unpack_from("<II", archive, at - 8) != (SKIPPABLE_MAGIC, 8 * n + 9):
            raise ValueError("not a seekable bundle")
        self.archive, self.starts, self.sizes = archive, [0], []
        for k in range(n):
            packed, size = struct.unpack_from("<II", archive, at + 8 * k)
            self.starts.append(self.starts[-1] + packed)
            self.sizes.append(size)
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self.archive[self.starts[k] : self.starts[k + 1]], max_output_size=self.sizes[k])
            self.last = (k, raw)
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def _bundles(bundle_bytes: int, frame_bytes: int):
    kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))

    def row(w: BundleWriter) -> pa.RecordBatch:
        archive = w.finish()
        index = [dict(zip(("page_id", "frame", "offset", "length"), x, strict=True)) for x in w.index]
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(archive).hexdigest()[:32]]), pa.array([archive], pa.binary()), pa.array([index], kind)], ["bundle_id", "archive", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = BundleWriter(frame_bytes)
        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                w.add(page_id, warc_record(page_id, url, (html or "").encode(), digest, refers))
                if w.total >= bundle_bytes:
                    yield row(w)
                    w = BundleWriter(frame_bytes)
        if w.index:
            yield row(w)

    return run


def _payload(column: str = "html"):
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def write_archives(pages: DataFrame, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write a record for every page (page_id, url, html); returns the table of bundles (bundle_id, archive, records).

    Which payloads occur twice is found from ids, digests and lengths alone: a table of the digests that repeat (written
    to the shared folder) is joined to the pages. Copies of one payload are a hot key of that join on the side of
    the pages, which adaptive execution splits, as both sides are plain shuffles.
    """
    spark = pages.sparkSession
    payload = _payload()
    facts = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    repeated = facts.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    repeated = materialize(repeated, "warc-repeated")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest")).join(repeated, "digest", "left")
    rows = rows.select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))
    return materialize(rows.mapInArrow(trimmed(_bundles(bundle_bytes, frame_bytes)), BUNDLE), "warc-bundles")


def index(bundles: DataFrame) -> DataFrame:
    """(page_id, bundle_id, frame, offset, length) of every record."""
    return bundles.select("bundle_id", F.explode("records").alias("r")).select("r.page_id", "bundle_id", "r.frame", "r.offset", "r.length")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            reader = BundleReader(batch.column("archive")[k].as_py())
            out: dict[str, list] = {"page_id": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": []}
            for r in batch.column("records")[k].as_py():
                fields, block = parse_record(reader.record(r["frame"], r["offset"], r["length"]))
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"payload of page {r['page_id']} does not have its digest")
                if fields["warc-record-id"] != record_id(r["page_id"]):
                    raise ValueError(f"the index leads to another record than that of page {r['page_id']}")
                refers = fields.get("x-refers-to-page-id")
                out["page_id"].append(r["page_id"])
                out["payload_bytes"].append(int(fields["x-payload-length"]))
                out["payload_digest"].append(digest)
                out["record_type"].append(fields["warc-type"])
                out["refers_to"].append(int(refers) if refers else None)
            yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), pa.array(out["payload_bytes"], pa.int64()), pa.array(out["payload_digest"], pa.string()), pa.array(out["record_type"], pa.string()), pa.array(out["refers_to"], pa.int64())], list(out))


def read_archives(bundles: DataFrame) -> DataFrame:
    """Every record of every bundle, read back through its index entry and held against its digest."""
    return bundles.select("archive", "records").mapInArrow(trimmed(_read), READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages.select(F.col("page_id").cast("long"), "url", "html")))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (d)
"""
