import corpus_pipeline as P
from gleaner.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage keeps the columns, and its decisions are those of its operator on what came before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        if k < len(P.STAGES) - 1:
            assert docs.dtypes == before.dtypes and docs.columns == columns
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontaminate", "packing"]
    before, after = seen["line_dedup"]
    assert before.count() == after.count() and after.selectExpr("sum(n_chars) = sum(length(text))").first()[0]
    from gleaner.llm import op6_decontaminate, op10_simhash

    before, after = seen["simhash_dedup"]
    keep = {r.doc_id for r in op10_simhash.grouped(before).where("doc_id = component_id").collect()}
    assert keep == {r.doc_id for r in after.collect()} and after.count() == len(keep)
    before, after = seen["decontaminate"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = {r.doc_id for r in op6_decontaminate.searched(before, bench).where("size(items) = 0").select("d.doc_id").collect()}
    assert clean == {r.doc_id for r in after.collect()}
    before, after = seen["packing"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}
    want = sorted(map(str, after.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert sorted(map(str, P.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == want


def test_odd_rows(spark, odd, tables):
    bench = spark.createDataFrame([(1, "word word word")], "item_id long, text string")
    folder = tables(documents=odd, benchmark=bench)
    rows = P.run(spark, folder).collect()
    assert {r.doc_id for r in rows} <= {None, 1, 6, 7, 9} and 5 not in {r.doc_id for r in rows}
    assert P.run(spark, tables(documents=odd.limit(0), benchmark=bench)).count() == 0


def plain_windows(text, n=10):
    """Windows of ten words, or the whole of fewer."""
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set(), w


def test_pipeline_equals_plain_stages(spark):
    """What the language stage keeps goes through plain versions of the other stages, one after the other."""
    import numpy as np
    from test_duplicates import plain_fingerprint, plain_groups, plain_lines
    from test_records import check_packing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in P.STAGES[0][1](spark, docs, SF).collect())
    gone = plain_lines(docs)
    docs = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in {g[0] for g in gone[d]})) for d, t in docs]
    component = plain_groups(np.array([plain_fingerprint(t) for _, t in docs], np.uint64))
    first = {}
    for (d, _), c in zip(docs, list(component), strict=True):
        first[c] = min(d, first.get(c, d))
    docs = [(d, t) for (d, t), c in zip(docs, list(component), strict=True) if d == first[c]]
    patterns = set().union(*(plain_windows(r.text)[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    sizes = {len(p) for p in patterns}

    def clean(text):
        w = plain_windows(text)[1]
        return not any(tuple(w[i : i + n]) in patterns for n in sizes for i in range(len(w) - n + 1))

    kept = {d: t for d, t in docs if clean(t)}
    assert 50 < len(kept) < len(docs)
    rows = P.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(kept)
    check_packing(rows, kept)
