"""Source divergence audit: how far the words of one source are from those of the other sources of its language.

A group is a (lang, source) that occurs; each gives every term of its language's vocabulary a share in parts of 10**9, smoothed by one. The
divergence of group g from h is the sum of f(p, q) = floor((p - q)**2 / q) over all terms, p the share in g and q that in h.

Dense rows of terms are never made. A group's share of a term depends on the term's count alone, and most counts are zero, so
with z for the share of a count of zero the sum is taken by inclusion and exclusion over the supports:

    V * f(zg, zh)                                                          every term as if both counts were zero
    + sum over the counts of g of (f(p, zh) - f(zg, zh))                   by g's histogram of counts
    + sum over the counts of h of (f(zg, q) - f(zg, zh))                   by h's histogram
    + sum over common terms of (f(p, q) - f(p, zh) - f(zg, q) + f(zg, zh)) by a join of the postings

The join of postings meets only terms that two sources have, and its rows are summed by pair before they are shuffled. All
is exact: shares by division in three steps, so that counts may reach 9 * 10**15, and sums in two parts.

Words are counted in numpy, some megabytes of text at a time; what is shuffled is a row for each group and different term of such a slice, which
Spark sums again within the task, so a hot source or a word that all have is no hot key.

A null text, lang or source is the empty string. Every row is a document, repeated rows too. A language without a kept term (V = 0) has pairs of value 0 and
no terms. A language with one source has no pairs. Null or repeated doc_ids and other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import Scratch, materialize, release, text_slices, trimmed

#: Parts of a share, and a third of its digits.
UNIT, STEP = 1_000_000_000, 1000
MIN_DOCS = 3
TOP = 200
SLICE = 4_000_000
#: Bytes of terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+ after A-Z became a-z
LETTERS = bv.byte_class((0x61, 0x7A), (0x80, 0xFF))
_COUNTED = "lang string, source string, term string, n long, docs long"


def count_terms(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(row, term, n, docs) for each group and different term: a row of the group, its occurrences, and the texts that have it."""
    codes = [x.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources)]
    _, first_row, group = np.unique(codes[0] * (codes[1].max() + 1) + codes[1], return_index=True, return_inverse=True)
    data, offs = bv.buffers(texts)
    data = bv.LOWER[data]
    inside = LETTERS[data]
    starts, ends, first = bv.spans(inside, offs)
    if len(starts) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[inside])).dictionary_encode()
    n_words = len(words.dictionary)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    in_doc, times = np.unique(doc * n_words + words.indices.to_numpy(), return_counts=True)
    key = group[in_doc // n_words] * n_words + in_doc % n_words
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    terms = words.dictionary.take(pa.array(key[head] % n_words)).cast(pa.string())
    return first_row[key[head] // n_words], terms, np.add.reduceat(times[order], head), np.diff(np.append(head, len(key)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of each slice by group; a row without a term for each group that the task meets."""
    met: set[tuple[str, str]] = set()
    for batch in batches:
        for a, b in text_slices(batch, "text", SLICE):
            part = batch.slice(a, b - a)
            langs, sources = (part.column(c).fill_null("") for c in ("lang", "source"))
            row, terms, n, docs = count_terms(langs, sources, part.column("text"))
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(row)), sources.take(pa.array(row)), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])
            new = set(zip(langs.to_pylist(), sources.to_pylist(), strict=True)) - met
            if new:
                met |= new
                none, zero = pa.nulls(len(new), pa.string()), pa.array([0] * len(new), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.string()), pa.array([x for _, x in new], pa.string()), none, zero, zero], ["lang", "source", "term", "n", "docs"])


def div(a: Column, b: Column) -> Column:
    """The quotient of whole numbers; the fraction goes."""
    return F.call_function("div", a, b)


def share(count: Column, mass: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / mass), without a product beyond 1000 * mass. mass >= count + 1."""
    whole, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        whole, rest = whole * STEP + div(rest * STEP, mass), rest * STEP % mass
    return whole + 1


def apart(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


class Counts:
    """The tables of one audit, in a Scratch: groups, and the postings of kept terms with their shares."""

    def __init__(self, scratch: Scratch, documents: DataFrame, min_docs: int = MIN_DOCS):
        rows = documents.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]).mapInArrow(trimmed(_count), _COUNTED)
        counts = scratch.keep(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
        release(documents.sparkSession)
        terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        terms = scratch.keep(terms.where(F.col("docs") >= min_docs).select("lang", "term", "total"), "terms")
        postings = scratch.keep(counts.where("term IS NOT NULL").join(terms, ["lang", "term"]).select("lang", "term", "source", "n", "total"), "postings")
        langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
        sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        v = F.coalesce("v", F.lit(0)).cast("long")
        mass = F.coalesce("group_n", F.lit(0)).cast("long") + v
        zero = share(F.lit(0).cast("long"), F.greatest(mass, F.lit(1)))
        #: (lang, source, v, mass, lang_mass, z): z is the share of a term that the group lacks.
        self.groups = scratch.keep(groups.select("lang", "source", v.alias("v"), mass.alias("mass"), (F.coalesce("lang_n", F.lit(0)).cast("long") + v).alias("lang_mass"), zero.alias("z")), "groups")
        priced = postings.join(self.groups, ["lang", "source"])
        #: (lang, term, source, p, q, z): the shares of the group and of the language.
        self.postings = scratch.keep(priced.select("lang", "term", "source", share(F.col("n"), F.col("mass")).alias("p"), share(F.col("total"), F.col("lang_mass")).alias("q"), "z"), "priced")

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms that a group has more of than its language, the furthest first."""
        found = self.postings.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
        return ranked(found).where(F.col("rank") <= top)

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): the divergence of each source from each other one of its language."""
        own = self.groups.select("lang", "source", "z", "v")
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
        both = own.join(other, "lang").where("source <> item")
        zeros = both.select("lang", "source", "item", *parts(apart(F.col("z"), F.col("y")), F.col("v")))
        bins = self.postings.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("k"))
        sided = bins.join(other, "lang").where("source <> item")
        ahead = sided.select("lang", "source", "item", *parts(apart(F.col("p"), F.col("y")) - apart(F.col("z"), F.col("y")), F.col("k")))
        behind = sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), *parts(apart(F.col("y"), F.col("p")) - apart(F.col("y"), F.col("z")), F.col("k")))
        p, z, q, y = (F.col(c) for c in "pzqy")
        mine = self.postings.select("lang", "term", "source", "p", "z")
        theirs = self.postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("z").alias("y"))
        common = mine.join(theirs, ["lang", "term"]).where("source <> item")
        common = common.select("lang", "source", "item", *parts(apart(p, q) - apart(p, y) - apart(z, q) + apart(z, y), F.lit(1)))
        sums = [x.groupBy("lang", "source", "item").agg(F.sum("high").alias("high"), F.sum("low").alias("low")) for x in (ahead, behind, common)]
        total = zeros.unionAll(sums[0]).unionAll(sums[1]).unionAll(sums[2]).groupBy("lang", "source", "item").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
        value = F.col("high").cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)") + F.col("low").cast("decimal(20,0)")
        return ranked(total.select("lang", "source", "item", value.cast("long").alias("value")))


def parts(value: Column, times: Column) -> list[Column]:
    """value * times as a multiple of UNIT and a rest, neither of which can leave a long."""
    unit = F.lit(UNIT).cast("long")
    return [(div(value, unit) * times).alias("high"), (value % unit * times).alias("low")]


def ranked(rows: DataFrame) -> DataFrame:
    """With the rank within the group: the largest value first, then the smallest item by its bytes."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources of each language, and the `top` terms of each group."""
    scratch = Scratch(documents.sparkSession, "divergence")
    counts = Counts(scratch, documents, min_docs)
    found = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", counts.pairs()), ("term", counts.terms(top)))]
    found = materialize(found[0].unionAll(found[1]), "divergence")
    scratch.clear()
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, v.term, v.total, coalesce(n.n, 0) AS n FROM g JOIN v ON g.lang = v.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = v.term),
s AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER k + count(*) OVER k) AS p,
  1 + 1000000000::HUGEINT * (total + 1) // (sum(total) OVER k + count(*) OVER k) AS q FROM c WINDOW k AS (PARTITION BY lang, source)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM y)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
