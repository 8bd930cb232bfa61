import hashlib
import random
import re
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from gleaner.llm import op5_lines as q5
from gleaner.llm import op6_decontaminate as q6
from gleaner.llm import op8_repeats as q8
from gleaner.llm import op10_simhash as q10
from gleaner.llm.common import Scratch
from gleaner.llm.components import Forest, components

SF = "/root/testdata/sf0.001"


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2080)] + [(7, 7)]
    name = (lambda x: x) if kind == "long" else (lambda x: f"n{x:05}")
    want = Union()
    for a, b in edges:
        want.link(name(a), name(b))
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"u {kind}, v {kind}").repartition(7)
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: want.root(x) for x in want.up if want.root(x) != x}
    assert components(df.limit(0)).count() == 0


def test_forest():
    f = Forest(6)
    f.link(np.array([5, 1, 3]), np.array([4, 0, 5]))
    assert f.flatten().tolist() == [0, 0, 2, 3, 3, 3]


# lines


def plain_shingles(line):
    line = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return frozenset(line[i : i + 7] for i in range(max(1, len(line) - 6)))


def plain_lines(docs):
    """Lines that go, by document: (place, doc_id and place of the first line of the component)."""
    lines = [(d, i, x) for d, t in sorted(docs) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\f\r")]
    sets = [plain_shingles(x) for *_, x in lines]
    union, seen = Union(), {}
    for n, s in enumerate(sets):
        union.root(n)
        if s in seen and lines[seen[s]][2].encode().lower() == lines[n][2].encode().lower():
            union.link(seen[s], n)
            continue
        seen.setdefault(s, n)
        for m in range(n):
            if 5 * len(s & sets[m]) >= 4 * len(s | sets[m]):
                union.link(m, n)
    gone = defaultdict(list)
    for n, (d, i, _) in enumerate(lines):
        if union.root(n) != n:
            gone[d].append((i, *lines[union.root(n)][:2]))
    return {d: gone[d] for d, _ in docs}


def noisy(rng, line):
    line = list(line)
    line[rng.randrange(len(line))] = "#"
    return "".join(line)


@pytest.mark.parametrize("limit", [500, 2])
def test_lines_equal_brute_force(spark, tables, limit):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghié") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(14, 30))) for _ in range(12)] + ["short", "", "  ", "x"]
    docs = []
    for d in range(60):
        ls = []
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(base)
            ls.append(noisy(rng, x) if len(x) > 60 and rng.random() < 0.5 else x.upper() if rng.random() < 0.2 else x)
        docs.append((d, "\n".join(ls)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = plain_lines(docs)
    assert {r.d.doc_id: [tuple(x) for x in r.removed] for r in q5.marked(df, limit).collect()} == want
    if limit == 500:
        got = {r.doc_id: r for r in q5.query(spark, tables(documents=df)).collect()}
        for d, t in docs:
            gone = [i for i, *_ in want[d]]
            kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
            assert got[d].first_lines == ",".join(f"{a}:{b}" for _, a, b in want[d])
            assert got[d].removed == ",".join(map(str, gone)) and got[d].n_removed == len(gone) and got[d].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_lines_odd_rows(spark, odd, tables):
    assert q5.query(spark, tables(documents=odd)).count() == 12
    rows = q5.deduplicated(odd)
    assert rows.columns == odd.columns
    got = sorted(((r.doc_id or 0), r.text) for r in rows.collect() if r.text is not None)
    assert [t for d, t in got if d == 9] == ["a\nb\n"] and [t for d, t in got if d == 6] == [""] and len([t for d, t in got if d == 1 and t]) == 2
    assert q5.query(spark, tables(documents=odd.limit(0))).count() == 0


# decontamination


def test_decontamination_matches_sql(spark, odd, tables):
    import duckdb

    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)] + ["É", "x-y", "Zz"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for k in range(12)] + [(99, None), (3, "same id w1"), (100, "...")]
    texts = []
    for d in range(150):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))]
        if rng.random() < 0.5:
            w = (rng.choice(items)[1] or "").upper().split()
            i = rng.randrange(len(w) + 1)
            parts.append("_".join(w[i : i + rng.randint(5, 20)]))
        texts.append((d, ", ".join(parts)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionAll(odd.select("doc_id", "text")).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    folder = tables(documents=docs, benchmark=bench)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    cols = sorted(q6.query(spark, folder).columns)
    want = sorted(map(str, c.sql(f"SELECT {', '.join(cols)} FROM ({q6.ORACLE_SQL})").fetchall()))
    for block in (q6.BLOCK_BYTES, 60):
        assert sorted(str(tuple(r)) for r in q6.query(spark, folder, block).select(*cols).collect()) == want
    clean = q6.decontaminated(odd, bench)
    assert clean.columns == odd.columns
    assert q6.query(spark, tables(documents=odd.limit(0), benchmark=bench)).count() == 0
    assert not any(r.contaminated for r in q6.query(spark, tables(documents=docs, benchmark=bench.limit(0))).collect())


def test_patterns_of_large_benchmarks_fit_a_worker():
    """Tables of 20 MB of items, and their search, in less than 1 GB."""
    code = """
import random, resource
import pyarrow as pa
from gleaner.llm import op6_decontaminate as q6
rng = random.Random(1)
words = [''.join(rng.choice('abcdefghij') for _ in range(rng.randint(2, 9))) for _ in range(30000)]
items = [(k, ' '.join(rng.choices(words, k=300))) for k in range(10500)]
assert sum(len(t) for _, t in items) > 20_000_000
p = q6.Patterns(items)
w = q6.Words.of(pa.array(['x ' + items[77][1][5:400].upper() + ' y', 'nothing at all']))
begin, end, found = p.occurrences(w)
assert len(begin) and found[0] == [77] and q6.hit_words(w.first[1], begin, end).sum() >= len(begin) + 9
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_000_000, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


# repeats


def plain_repeats(docs):
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            gone[i : i + 100] |= w in seen
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        turns = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[d] = (len(raw), int(gone.sum()), int((turns == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limit", [2000, 2])
def test_repeats_equal_brute_force(spark, tables, limit):
    rng = random.Random(7)
    para = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(n))
    shared = [para(rng.choice([10, 20, 40])) for _ in range(10)]
    docs = []
    for d in range(120):
        t = " ".join(rng.choice(shared) if rng.random() < 0.6 else para(12) for _ in range(rng.randint(1, 6)))
        t = t + t if rng.random() < 0.2 else t
        docs.append((3 * d - 50, t[rng.randint(0, 40) :]))
    docs += [(1000, None), (1001, ""), (1002, "a" * 350), (1003, "ab" * 300), (1004, "a" * 120), (1005, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = plain_repeats(docs)
    got = {r[0]: tuple(r)[1:] for r in q8.without_repeats(df, limit).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()}
    assert got == want
    if limit == 2000:
        rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q8.query(spark, tables(documents=df)).collect()}
        assert rows == want


def test_interval_tree():
    strings = [b"abcx", b"abcy", b"abz", b"q", b"abcx"]
    got = sorted((n, sorted(m)) for n, m in q8.prefix_intervals(strings))
    assert got == [(0, [0, 1, 2, 3, 4]), (2, [0, 1, 2, 4]), (3, [0, 1, 4]), (4, [0, 4])]
    assert list(q8.prefix_intervals([b"one"])) == [] and list(q8.prefix_intervals([])) == []
    found = list(q8.maximal_repeats([b"ba", b"bc", b"ba"], [b"xyz" * 40, b"xyz" * 40, b"xyz" * 40], 100))
    assert (1, 120, [0, 2, 1]) in [(a, b, m) for a, b, m in found] or any(a == 1 and sorted(m) == [0, 1, 2] for a, _, m in found)
    assert any(a == 2 and sorted(m) == [0, 2] for a, _, m in found)


def test_repeats_odd_rows(spark, odd, tables):
    rows = q8.query(spark, tables(documents=odd)).collect()
    assert len(rows) == 12
    assert {r.n_removed for r in rows if r.doc_id == 6} == {15000} and len({tuple(r) for r in rows if r.doc_id == 1}) == 1
    assert q8.query(spark, tables(documents=odd.limit(0))).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_rows_count_as_one_document(spark, parts):
    rng = random.Random(11)
    para = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(n))
    shared = para(40)
    docs = [(d, para(60)) for d in range(6)] + [(10, para(30) + shared), (11, para(30) + shared), (12, "ab" * 300)]
    rows = [docs[k] for k in (0, 3, 6, 7, 7, 8)] + docs
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = [tuple(r) for r in q8.without_repeats(df).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()]
    want = plain_repeats(docs)
    assert sorted(got) == sorted((d, *want[d]) for d, _ in rows) and want[0][1] == 0 and want[11][1] > 0


# simhash


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    """Component of each number by comparing all pairs."""
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    label = np.arange(len(fps))
    while True:
        low = np.array([label[row].min() for row in near])
        if (low == label).all():
            return label
        label = low


def clustered(n=60):
    rng = np.random.default_rng(8)
    fps = list(rng.integers(0, 2**64, n, dtype=np.uint64))
    for b in fps[: n // 3]:
        for _ in range(6):
            for _ in range(int(rng.integers(1, 4))):
                b = b ^ np.uint64(1 << int(rng.integers(0, 64)))
            fps.append(b)
    return np.unique(np.array(fps, np.uint64))


@pytest.mark.parametrize("limit", [4000, 2])
def test_links_equal_brute_force(spark, limit):
    fps = clustered()
    label = plain_groups(fps)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components(q10.links(Scratch(spark, "t"), nodes, limit)).collect()}
    root = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
    groups = lambda names: {frozenset(np.flatnonzero(np.array(names) == k).tolist()) for k in set(names)}
    assert groups(root) == groups(label.tolist()) and len(set(root)) < len(fps)


def test_large_shards_are_split(spark):
    """Fingerprints that differ in few places: all of some shards, yet units stay small and no link is lost."""
    rng = np.random.default_rng(3)
    places = rng.permutation(36)[:20]
    fps = np.unique(np.array([0x5A5A << 40 ^ sum(1 << int(p) for p in places[rng.random(20) < 0.5]) for _ in range(1500)], np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    scratch = Scratch(spark, "t")
    rows = q10.in_shards(scratch, nodes, 100)
    sizes = [r["count"] for r in rows.groupBy("unit").count().collect()]
    assert max(sizes) < 400 and sum(sizes) > 16 * len(fps) and rows.select("fp").distinct().count() == len(fps)
    label = plain_groups(fps)
    found = {r.node: r.root for r in components(q10.links(scratch, nodes, 100)).collect()}
    root = np.array([found.get(int(x), int(x)) for x in fps.view(np.int64)])
    assert len(set(zip(root.tolist(), label.tolist()))) == len(set(root.tolist())) == len(set(label.tolist())) > 1
    assert all(sum(q10.blocks(m)) == m for m in (1, 7, 0b1011, (1 << 64) - 1)) and {q10._free(k).bit_count() for k in range(16)} == {36}


def test_one_tree_finds_all_pairs():
    fps = clustered(200)
    got = {(a, b) for x, y in q10.Trees(np.zeros(len(fps), np.int64), fps).links() for a, b in zip(x.tolist(), y.tolist())}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    assert got == {(a, b) for a, b in np.argwhere(near).tolist() if a != b}


def test_simhash(spark, odd, tables):
    rng = random.Random(9)
    texts = [(k, " ".join(rng.choice(["alpha", "Beta", "γ", "de", "x1"]) for _ in range(rng.choice([0, 1, 2, 3, 40, 200])))) for k in range(100)]
    texts += [(200 + k, texts[k][1].upper()) for k in range(0, 40, 2)] + [(300, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = sorted(q10.query(spark, tables(documents=df)).collect())
    fps = np.array([plain_fingerprint(t) for _, t in sorted(texts)], np.uint64)
    assert [r.fingerprint for r in rows] == [f"{int(x):016x}" for x in fps]
    ids = [d for d, _ in sorted(texts)]
    assert [r.component_id for r in rows] == [ids[k] for k in plain_groups(fps)]
    assert q10.query(spark, tables(documents=odd)).count() == 12
    assert q10.query(spark, tables(documents=odd.limit(0))).count() == 0
    kept = q10.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()).count(1) == 1 and 6 not in [r.doc_id for r in kept.collect()]


def test_simhash_one_row_of_each_component(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(3))
    near = lambda t, k: (t + f" x{k}").replace("w", "W", k)
    docs = [(5, a), (5, b), (5, b), (3, near(b, 1)), (None, c), (None, near(c, 1)), (None, near(c, 2)), (None, near(a, 1)), (7, None), (None, "")]
    fps = np.array([plain_fingerprint(t) for _, t in docs], np.uint64)
    label = plain_groups(fps).tolist()
    assert len(set(label)) == 4 and label[1] == label[3] and label[4] == label[5] == label[6] and label[0] == label[7]
    df = spark.createDataFrame([(*r, k) for r, k in zip(docs, label)], "doc_id long, text string, label int").repartition(3)
    got = sorted(((r.label, r.doc_id) for r in q10.deduplicated(df).collect()), key=str)
    assert got == sorted([(label[0], 5), (label[3], 3), (label[4], None), (label[8], 7)], key=str)
