import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import op11_embeddings as q11
from gleaner.llm import op12_centroids as q12
from gleaner.llm import op13_divergence as q13
from gleaner.llm.components import Forest

E = "vec_id long, embedding array<double>"


def same_as_sql(spark, run, sql, folder, table):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = run(spark, folder)
    cols = sorted(got.columns)
    assert sorted(str(tuple(r)) for r in got.select(*cols).collect()) == sorted(map(str, c.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()))


# embeddings


def plain_links(rows):
    """(links, component) of every row: all pairs."""
    n = len(rows)
    fine = [x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x) for _, x in rows]
    unit = [np.array(x) / max(map(abs, x)) if ok else None for (_, x), ok in zip(rows, fine)]
    unit = [x / np.linalg.norm(x) if ok else None for x, ok in zip(unit, fine)]
    count, forest = np.zeros(n, int), Forest(n)
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                count[i] += 1
                count[j] += 1
                forest.link(np.array([i]), np.array([j]))
    root = forest.flatten()
    least = {}
    for (v, _), r in zip(rows, root.tolist()):
        least.setdefault(r, []).append(v)
    component = [min((v for v in least[r] if v is not None), default=None) for r in root.tolist()]
    return [(v, int(k), c) for (v, _), k, c in zip(rows, count, component)]


def groups(rng, n, dim, sizes, noise):
    """n random vectors, and around some of them groups of near copies."""
    base = rng.standard_normal((n, dim))
    parts = [base] + [base[k] + noise * rng.standard_normal((size, dim)) for k, size in enumerate(sizes)]
    x = np.concatenate(parts)
    return x * rng.uniform(0.01, 100, (len(x), 1))


@pytest.mark.parametrize("probes, part_rows, noise", [(q11.PROBES, 20_000, 0.1), (q11.PROBES, 7, 0.1), (q11.PROBES, 20_000, 0.33), (1000, 20, 0.33)])
def test_embeddings_equal_brute_force(spark, probes, part_rows, noise):
    rng = np.random.default_rng(1)
    x = groups(rng, 500, 16, [150, 30, 30, 2, 1], noise)
    rows = [(int(k), x[k].tolist()) for k in rng.permutation(len(x))]
    rows += [(5000 + k, rows[k][1]) for k in range(20)] * 2
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in q11.linked(spark.createDataFrame(rows, E).repartition(5), probes, part_rows).collect())
    want = sorted(plain_links(rows))
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    found, there = (sum(r[1] for r in y) for y in (got, want))
    assert found >= 0.97 * there > 1000
    if noise == 0.1 or probes == 1000:  # all lists that matter are visited
        assert got == want


def test_embeddings_core_and_parts(spark):
    """A third of all rows around one direction: its pairs are counted without being compared, in one part or in many."""
    rng = np.random.default_rng(2)
    x = groups(rng, 400, 16, [200], 0.03)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    want = sorted(plain_links(rows))
    index = q11.Indexes([np.asarray(v).tobytes() for v in x], len(x))[16]
    near = index.near(q11.units(x), 2)
    assert len(set(near[400:, 0].tolist())) == 1  # one list has the group
    for part_rows in (20_000, 16):
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in q11.linked(spark.createDataFrame(rows, E), q11.PROBES, part_rows).collect()) == want


def test_embeddings_index_of_a_sample(spark):
    """The index is fitted on some rows only, and still has all of them; recall at the threshold itself."""
    rng = np.random.default_rng(3)
    a = q11.units(rng.standard_normal((3000, 32)))
    b = rng.standard_normal((3000, 32))
    b = q11.units(b - (a * b).sum(1)[:, None] * a)
    c = rng.uniform(0.9, 0.93, 3000)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    got = q11.linked(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], E), sample=1000).toPandas().set_index("vec_id")
    there = sum(int(((x[k : k + 1000] @ x.T) >= 0.9).sum()) for k in range(0, 6000, 1000)) - 6000
    assert 0.97 * there <= got.n_links.sum() <= there and there >= 6000


def test_product_codes_lose_nothing():
    """What the look-up rules out is no link: the distance of a code is corrected by its own error."""
    rng = np.random.default_rng(4)
    x = q11.units(groups(rng, 300, 20, [100], 0.3))
    index = q11.Index.fitted(x, 10)
    near = index.near(x, 1)[:, 0]
    codes, err = index.encode(x - index.centroids[near])
    coded = index.centroids[near] + index.decode(codes)
    assert np.allclose(np.linalg.norm(x - coded, axis=1), err)
    tables = index.tables(x)
    look = x @ index.centroids[near].T + sum(t[:, codes[:, m]] for m, t in enumerate(tables))
    assert np.allclose(look, x @ coded.T, atol=1e-5)
    bound = (1 + (coded**2).sum(1) - (q11.REACH + err) ** 2) / 2
    linked = x @ x.T >= 0.9
    assert (look[linked] >= np.broadcast_to(bound, look.shape)[linked]).all()
    assert (look < bound).mean() > 0.3  # and much is ruled out


def test_embeddings_odd_rows(spark, tables):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [2.0, -0.0]), (None, [1.0, 0.1]), (None, [0.0, -1.0]), (10, [1e300, 0.0]), (11, [1e-310, 0.0])]
    df = spark.createDataFrame([(*r, "x", None) for r in rows], E + ", weight string, list int").withColumn("id", F.lit("y"))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in q11.linked(df).collect()), key=str)
    assert got == sorted(plain_links([(v, x if x is None or None not in x and all(map(math.isfinite, x)) else [None]) for v, x in rows]), key=str)
    assert [r for r in got if r[0] is None] == [(None, 0, None), (None, 5, 1)]
    shown = q11.query(spark, tables(embeddings=df))
    assert shown.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(r.vec_id for r in shown.collect() if r.kept and r.vec_id) == [1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert q11.query(spark, tables(embeddings=df.limit(0))).count() == 0
    floats = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert q11.query(spark, tables(embeddings=floats)).count() == len(rows)


# centroids


def test_centroids_match_sql(spark, tables):
    rng = np.random.default_rng(5)
    x = groups(rng, 150, 64, [60, 40, 1], 0.2).astype(np.float32)
    rows = [(k - 20, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [None] + [1.0] * 63), (904, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    same_as_sql(spark, q12.query, q12.ORACLE_SQL, tables(embeddings=df), "embeddings")
    few = df.where("vec_id < 0")  # fewer vectors than centroids
    same_as_sql(spark, q12.query, q12.ORACLE_SQL, tables(embeddings=few), "embeddings")


def test_screen_changes_nothing():
    rng = np.random.default_rng(6)
    for scale, spread in ((50, 1), (1, 1), (50, 300), (q12.BOUND, 1)):
        centers = rng.integers(-scale, scale + 1, (30, 64)) * spread
        q = np.clip(centers[rng.integers(0, 30, 500)] + rng.integers(-20, 21, (500, 64)), -q12.BOUND, q12.BOUND)
        centers[7] = centers[3]  # a tie
        got, least, exact = q12.nearest(q, q12.segment_norms(q), centers)
        d = ((q[:, None, :].astype(object) - centers[None].astype(object)) ** 2).sum(axis=2)
        assert got.tolist() == [min(range(30), key=lambda k, r=r: (r[k], k)) for r in d] and least.tolist() == [min(r) for r in d.tolist()]
        if spread > 1:
            assert exact < 5 * len(q)  # of 30 for each


def test_centroids_odd_rows(spark, tables):
    rows = [(1, [0.5] * 64), (1, [0.5] * 64), (None, [-0.001] * 64), (2, [1e30] * 64), (3, [-1e30] * 64), (4, [])]
    df = spark.createDataFrame(rows, E).withColumns({"cluster": F.lit("x"), "q": F.lit("x"), "norms": F.lit(None)})
    got = q12.query(spark, tables(embeddings=df)).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 0)]
    assert {r.inertia for r in got} == {0}
    digest = hashlib.sha256(",".join(["-1"] * 64).encode()).hexdigest()
    assert [r.centroid_sha256 for r in got if r.vec_id is None] == [digest]
    assert q12.query(spark, tables(embeddings=df.limit(0))).count() == 0 and q12.query(spark, tables(embeddings=df.where("vec_id = 4"))).count() == 0


# divergence


def plain_audit(rows, min_docs=3, top=200):
    """Dense rows of counts, all in Python's whole numbers."""
    import re
    from collections import Counter

    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for *_, w in mine for t in set(w))
        kept = sorted(t for t in seen if seen[t] >= min_docs)
        whole = Counter(t for *_, w in mine for t in w)
        price = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        counts = {s: Counter(t for _, source, w in mine if source == s for t in w) for s in {d[1] for d in mine}}
        prices, q = {s: price(c) for s, c in counts.items()}, price(whole)
        far = lambda a, b: (a - b) ** 2 // b
        for s, p in prices.items():
            found = {"pair": [(o, sum(far(p[t], y[t]) for t in kept)) for o, y in prices.items() if o != s], "term": [(t, far(p[t], q[t])) for t in kept if counts[s][t] and p[t] > q[t]]}
            for part, items in found.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_divergence_equals_plain(spark, tables, odd):
    rng = np.random.default_rng(7)
    words = ["the", "and", "Éa", "éa", "été", "x", "zz-top", "w9w", "日本", "a_b"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(lang, source, " ".join(rng.choice(words, rng.integers(0, 40)))) for lang in ("en", None, "de") for source in ("a", "b", None, "d") for _ in range(rng.integers(1, 6))]
    rows += [("fr", "a", "one two"), ("fr", "b", "one"), ("it", "a", None), ("es", "a", "x x"), ("es", "b", ""), ("es", "b", "x"), ("es", "c", "x"), ("en", "hot", "the " * 5000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("t"), "n": F.lit("n"), "z": F.lit(1), "doc_id": F.lit(None)}).repartition(4)
    got = sorted(tuple(r) for r in q13.audit(df).collect())
    assert got == plain_audit(rows)
    assert sorted(tuple(r) for r in q13.audit(df, 1, 3).collect()) == plain_audit(rows, 1, 3)
    same_as_sql(spark, q13.query, q13.ORACLE_SQL, tables(documents=df), "documents")
    same_as_sql(spark, q13.query, q13.ORACLE_SQL, tables(documents=odd), "documents")
    assert q13.query(spark, tables(documents=df.limit(0))).count() == 0


def test_shares_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(0, 1), (0, 9 * 10**15), (9 * 10**15 - 1, 9 * 10**15), (4 * 10**15, 9 * 10**15 - 7), (1, 3)] + [(int(rng.integers(0, m)), m) for m in rng.integers(1, 9 * 10**15, 50).tolist()]
    got = [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c long, m long").orderBy("k").select(q13.share(F.col("c"), F.col("m"))).collect()]
    assert got == [1 + 10**9 * (c + 1) // m for c, m in rows]
    values = [(v, k) for v in (0, 1, -1, 4 * 10**18, -4 * 10**18, 10**9, 1 - 10**9) for k in (1, 3, 10**8)]
    parts = spark.createDataFrame(values, "v long, k long").select(*q13.parts(F.col("v"), F.col("k")), "v", "k").collect()
    assert all(r.high * 10**9 + r.low == r.v * r.k for r in parts)
