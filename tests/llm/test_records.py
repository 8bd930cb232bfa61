import hashlib
import random
import re
import zlib

import duckdb
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from gleaner.llm import op2_warc as q2
from gleaner.llm import op3_rules as q3
from gleaner.llm import op7_packing as q7
from gleaner.llm import op9_secrets as q9

SF = "/root/testdata/sf0.001"


def same(spark, run, sql, folder, names):
    c = duckdb.connect()
    for t in names:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}')")
    got = run(spark, folder)
    cols = sorted(got.columns)
    assert cols == sorted(c.sql(sql).columns)
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(got.select(*cols).collect()) == key(c.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())


def test_warc_matches_sql(spark, tables):
    same(spark, q2.query, q2.ORACLE_SQL, SF, ["pages"])
    big, small = "<p>" + "x" * 200, "<p>é"
    rows = [(5, "u", big), (3, None, big), (9, "u v", big), (1, "u", small), (2, "u", small), (7, "u", None), (8, "u", ""), (10, "u", "y" * 100), (11, "u", "y" * 100), (12, "u", "y" * 99), (13, "u", "y" * 99)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = tables(pages=pages)
    same(spark, q2.query, q2.ORACLE_SQL, folder, ["pages"])
    assert q2.query(spark, tables(pages=pages.limit(0))).count() == 0


def test_bundles_are_zstandard_and_seekable(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    bundles = q2.write_archives(pages, bundle_bytes=60_000, frame_bytes=10_000)
    table = bundles.collect()
    assert len(table) > 2
    where = {r.page_id: r for r in q2.index(bundles).collect()}
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    archives = {b.bundle_id: bytes(b.archive) for b in table}
    for k, r in where.items():  # each record alone
        fields, block = q2.parse_record(q2.BundleReader(archives[r.bundle_id]).record(r.frame, r.offset, r.length))
        assert fields["x-page-id"] == str(k) and block in (html[k], b"")
    a = table[0]
    reader = zstandard.ZstdDecompressor().stream_reader(bytes(a.archive), read_across_frames=True)
    assert reader.read().count(b"WARC/1.1") == len(a.records)  # other tools read the whole


def test_rules_match_sql(spark, odd, tables):
    same(spark, q3.query, q3.ORACLE_SQL, SF, ["documents"])
    same(spark, q3.query, q3.ORACLE_SQL, tables(documents=odd), ["documents"])
    assert q3.query(spark, tables(documents=odd.limit(0))).count() == 0


def test_rules_repeats_by_hand(spark):
    rows = [(1, "a b c d e x a b c d e"), (2, "z " * 7), (3, "a b c d e f"), (4, "p q r s t p q r s t p q r s t")]
    got = {r.doc_id: r.n_repeat_words for r in q3.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 10, 2: 7, 3: 0, 4: 15}


def test_rules_plan_is_native(spark):
    plan = q3.query(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("== Physical Plan ==")[1])


def test_ablations(spark):
    rows = q3.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    policy = q3.POLICIES["v2"]
    got = {r.rule: r for r in q3.ablations(rows, policy).collect()}
    masks = [r.failed & policy.mask for r in rows.collect()]
    for rule in policy.rules:
        bit = 1 << q3.RULES.index(rule)
        assert (got[rule].failing, got[rule].kept_without, got[rule].decided_alone) == (sum(bool(m & bit) for m in masks), sum(not m & ~bit for m in masks), sum(m == bit for m in masks))


def plain_findings(text):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    out = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(x for *_, x in sorted(out))


def test_secrets(spark, odd, tables):
    rng = random.Random(1)
    bits = ["password", "Token: ", "api_key='", "APIKEY = ", "aBc123", "=", "AKIA", "AKIA" + "Q7" * 8, "0123456789abcdef" * 2, "deadbeef", "é", " ", "secret:x", "ghp_" + "a1B2" * 9, "paſſword=abcdefgh", "eyJ", "passwd\":\"hunter22"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1000 + i, texts[5]) for i in range(50)], "doc_id long, text string").repartition(6)
    rows = {r.doc_id: r for r in q9.query(spark, tables(documents=docs)).collect()}
    assert len(rows) == 450
    for i, t in enumerate(texts):
        want = plain_findings(t)
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        base = [s for s in rows[i].spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert ",".join(base) == want and rows[i].n_hex == sum(s.startswith("hex") for s in base)
    assert any("github" in r.spans for r in rows.values())
    assert q9.query(spark, tables(documents=odd)).count() == 12
    assert q9.query(spark, tables(documents=odd.limit(0))).count() == 0


def test_ledger_scans_each_blob_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    a = spark.createDataFrame([(1, "token=abcdefgh"), (2, "x"), (3, "x")], "doc_id long, text string")
    b = a.unionAll(spark.createDataFrame([(4, "secret: zzzzzzz"), (5, "token=abcdefgh")], "doc_id long, text string"))
    assert q9.scan(a, path).count() == 2
    ledger = q9.scan(b, path)
    assert ledger.count() == 3 and q9.scan(b, path).count() == 3
    assert q9.scan(b, path, "r2").count() == 3 and spark.read.parquet(path).count() == 6
    assert {r.doc_id: len(r.findings) for r in q9.findings(b, ledger).collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 1}


def plain_best_fit(lengths, room):
    bins = []
    for x in lengths:
        fits = [(room - b, i) for i, b in enumerate(bins) if room - b >= x]
        if fits:
            bins[min(fits)[1]] += x
        else:
            bins.append(x)
    return sorted(bins)


def test_best_fit_equals_plain():
    rng = random.Random(2)
    for _ in range(60):
        room = rng.choice([7, 64, 100, 4096])
        lengths = sorted((rng.randint(1, room) for _ in range(rng.choice([0, 1, 5, 200]))), reverse=True)
        sequences, offsets = q7.best_fit(lengths, room)
        fill = {}
        for s, o, x in sorted(zip(sequences, offsets, lengths)):
            assert fill.get(s, 0) == o
            fill[s] = o + x
        assert sorted(fill.values()) == plain_best_fit(lengths, room)


def tokens(text):
    return q7._tokenizer(q7.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [q7.END]


def test_encoder_equals_tokenizer():
    rng = random.Random(3)
    bits = ["a", "B", "'", "s", "'S", ",", ".", "|", "<", "<|", "é", "É", "1", "2", " ", "\n", "日", "́", "=", "Σ", "İ", "_", "\x00", "’", "'re", "<|endoftext|>", "\xa0"]
    texts = [None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for part in (texts, [t.replace("<|", "<") for t in texts[2:]]):
        flat, offs = q7.Encoder(q7.default_vocabulary(), 300).encode(pa.array(part))
        assert [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [tokens(t) for t in part]


def test_runs_that_polynomials_confuse():
    """A Thue-Morse text and its complement have one hash by any polynomial modulo 2**64 with an odd multiplier."""
    encoder = q7.Encoder(q7.default_vocabulary())
    for n in (1024, 2048, 4096):
        bits = [bin(k).count("1") % 2 for k in range(n)]
        texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
        flat, offs = encoder.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [tokens(t) for t in texts]


def test_encoder_forgets_within_its_bounds():
    encoder = q7.Encoder(q7.default_vocabulary(), 50, 400)
    for k in range(30):
        texts = [f"w{j}x{k} é{j}" for j in range(k, k + 20)]
        flat, offs = encoder.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [tokens(t) for t in texts]
        assert len(encoder.known) <= 90


def test_equal_rows_fill_no_group(spark):
    rows = spark.createDataFrame([(None, None)] * 6000 + [(k % 3, "one two") for k in range(3000)], "doc_id long, text string").repartition(3)
    got = q7.packed(q7.tokenised(rows, q7.default_vocabulary()), group_pieces=1000).groupBy((F.col("sequence_id") / 2**31).cast("int").alias("g")).count().collect()
    assert len(got) == 9 and max(r["count"] for r in got) < 1300


def check_packing(rows, docs):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for d, parts in by_doc.items():
        ids, at = tokens(docs[d]), 0
        for r in sorted(parts, key=lambda r: r.start):
            piece = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= q7.LENGTH
    return sum(r.length for r in rows) / (len(by_sequence) * q7.LENGTH)


def test_packing(spark, odd, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert check_packing(q7.query(spark, "/root/testdata/sf0.01").collect(), docs) > 0.98
    folder = tables(documents=odd.where("doc_id > 1"))
    check_packing(q7.query(spark, folder).collect(), {r.doc_id: r.text for r in odd.where("doc_id > 1").collect()})
    assert q7.query(spark, tables(documents=odd)).agg({"doc_tokens": "min"}).first()[0] == 1
    assert q7.query(spark, tables(documents=odd.limit(0))).count() == 0
