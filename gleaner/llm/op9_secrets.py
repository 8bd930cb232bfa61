"""Secret scans over an incremental ledger of blobs.

A blob is a text, addressed by the SHA-256 of its UTF-8 bytes; a path is a row that holds it. A scan looks only at
(blob, rule version) pairs that the ledger lacks, once for each blob however many rows hold it, appends what it found
(an empty list too) to the ledger, and findings are joined back to all rows by the address.

Where there is a ledger, addresses alone are held against it first, and only the texts of those it lacks are fetched: if these are few,
no text is shuffled at all. Equal texts are reduced within each task before they are shuffled by address, so that copies of one text (even a third
of all rows) reach the scanning task as one row for each sending task at most. Text goes through the shuffle once at most.

A null text counts as the empty one, which has no findings. Repeated rows each get the findings. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shared_dir, tasks, trimmed

#: The kinds in their order, with their patterns and the least length of the measured group.
BASE_RULES = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 24),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
)
RULE_VERSION = "r1"
KINDS = tuple(k for k, *_ in BASE_RULES + MORE_RULES)
_COMPILED = [(k, re.compile(p), g, n) for k, p, g, n in BASE_RULES + MORE_RULES]
#: What a text must hold for a rule to be tried at all. Runs of 24 and more hex digits are what `hex` keeps.
_HINTS = {"access": "AKIA", "private_key": "-----BEGIN ", "slack": "xox", "jwt": "eyJ", "google": "AIza", "github": "gh", "stripe": "k_"}
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_LEDGER = "rule_version string, blob binary, findings array<struct<kind:string,start:int,end:int>>"


def find(text: str) -> list[tuple[str, int, int]]:
    """All findings by start, then kind: (kind, start, end) in code points, end exclusive."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(_COMPILED):
        if kind == "hex":
            out += [(m.start(), rank, m.end()) for m in _LONG_HEX.finditer(text)]
        elif kind == "assign":
            if ":" in text or "=" in text:
                out += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        elif _HINTS[kind] in text:
            out += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(KINDS[rank], a, b) for a, rank, b in sorted(out)]


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop rows whose blob this task has passed on already."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, b in enumerate(batch.column("blob").to_pylist()):
            if b not in seen:
                seen.add(b)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int32()))


def _scan(version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unique(batches):
            blobs = batch.column("blob")
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t or "")] for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(found)), blobs, pa.array(found, kind)], ["rule_version", "blob", "findings"])

    return run


def address(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(versions: DataFrame, ledger_path: str, version: str = RULE_VERSION) -> DataFrame:
    """Bring the ledger at ledger_path up to date with all texts of `versions`; returns the ledger of this rule version."""
    spark = versions.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    texts = versions.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    scratch = Scratch(spark, "secrets-unseen")
    if there:
        done = spark.read.schema(_LEDGER).parquet(ledger_path).where(F.col("rule_version") == version).select("blob")
        unseen = scratch.keep(texts.select("blob").distinct().join(done, "blob", "left_anti"), "blobs")
        texts = texts.join(unseen, "blob", "left_semi")
    texts = texts.mapInArrow(trimmed(_unique), "blob binary, text string").repartition(tasks(spark), "blob")
    texts.mapInArrow(trimmed(_scan(version)), _LEDGER).write.mode("append").parquet(ledger_path)
    scratch.clear()
    return spark.read.schema(_LEDGER).parquet(ledger_path).where(F.col("rule_version") == version)


def findings(documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, findings) of every row: an empty list where its blob has none.

    Only blobs with findings are joined. Rows are joined by blob; copies of one text make a hot key on the side of the
    documents, whose rows hold no text here and which the skew join of adaptive execution splits. Two scans at once may
    both append a pair; it counts once.
    """
    paths = documents.select(F.col("doc_id").cast("long").alias("doc_id"), address(F.col("text")).alias("blob"))
    hits = ledger.where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return paths.join(hits, "blob", "left").select("doc_id", F.coalesce("findings", empty).alias("findings"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = scan(documents, f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}")
    rows = findings(documents, ledger)
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    told = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"].isin("assign", "access", "hex"))
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("findings")).alias("spans"),
    )
