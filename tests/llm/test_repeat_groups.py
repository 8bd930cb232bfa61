import random

import pytest

from gleaner.llm import op8_groups as q8

SCHEMA = "doc_id long, text string"


def plain_groups(docs, length=100):
    """{(string's length, places)} of all maximal repeats. Any has two places that differ on both sides, so pairs tell all strings."""
    texts = {d: (t or "").encode() for d, t in docs}
    at = {}
    for d, raw in texts.items():
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if not any(raw[j : j + length] == w for j in range(max(0, i - 50), i)):  # else within a stretch of a short period
                at.setdefault(w, []).append((d, i))
    strings = set()
    for places in at.values():
        for k, (d, i) in enumerate(places):
            for e, j in places[:k]:
                a, b = texts[d], texts[e]
                if i and j and a[i - 1] == b[j - 1]:
                    continue
                n = length
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                strings.add(a[i : i + n])
    return {s: {(d, i) for d, i in at[s[:length]] if texts[d].startswith(s, i)} for s in strings}


def test_keys():
    raw = b"x" * 10 + b"0123456789" * 20
    assert q8.backwards(raw, 10) == b"x" * 10 + q8.END and len(q8.backwards(raw, 60)) == 51 and q8.segment(raw, 200, 300) == b"0123456789" + q8.END
    assert [q8.within_period(raw, k) for k in (0, 10, 11, 19, 20, 21, 110)] == [False, False, False, False, True, True, True]


def found_groups(docs, df, limit=1000):
    rows = q8.repeat_groups(df, limit).collect()
    texts = {d: (t or "").encode() for d, t in docs}
    got, names = {}, {}
    for r in rows:
        names.setdefault(texts[r.doc_id][r.start : r.start + r.n_bytes], set()).add(r.repeat)
        got.setdefault(r.repeat, []).append((r.doc_id, r.start, r.n_places))
    assert all(len(v) == 1 for v in names.values())
    out = {}
    for s, (name,) in names.items():
        places = [p[:2] for p in got[name]]
        assert len(places) == len(set(places)) == got[name][0][2]
        out[s] = set(places)
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    para = lambda k: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(k))
    shared = [para(rng.choice([20, 40, 300])) for _ in range(8)]
    docs = []
    for d in range(n):
        t = " ".join(rng.choice(shared) if rng.random() < 0.6 else para(12) for _ in range(rng.randint(1, 5)))
        docs.append((3 * d - 50, t[rng.randint(0, 40) :]))
    docs += [(1000, None), (1001, ""), (1003, "ab" * 130), (1004, "a" * 120), *((1100 + k, docs[3][1]) for k in range(5)), (1200, "x" + docs[3][1] + "y")]
    return docs


@pytest.mark.parametrize("limit", [1000, 4])
def test_groups_equal_brute_force(spark, limit):
    docs = corpus(5)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    want = plain_groups(docs)
    assert max(map(len, want)) > 1024 + 256 and max(map(len, want.values())) > 5  # longer than two segments
    assert found_groups(docs, df, limit) == want


def test_strings_and_odd_rows(spark, odd, tables):
    long = "word " * 3000
    groups = q8.repeat_groups(odd)
    rows = {(r.n_bytes, r.n_places, r.doc_id, r.start) for r in groups.collect()}
    assert (len(long), 2, 5, 0) in rows and (len(long), 2, 6, 0) in rows
    assert all(r[2] in (1, 5, 6) for r in rows)
    strings = q8.repeat_strings(odd, groups).collect()
    assert len(strings) == groups.select("repeat").distinct().count() and {bytes(r.string) for r in strings if r.n_bytes == len(long)} == {long.encode()}
    assert all(len(r.string) == r.n_bytes for r in strings)
    assert q8.repeat_groups(odd.limit(0)).count() == 0


def test_truncated_texts_of_a_long_passage(spark):
    """A deep tree: each text is another beginning of one passage, so that every node is a chain of as many intervals."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(900))
    docs = [(d, passage[: 200 + 17 * d]) for d in range(40)]
    assert found_groups(docs, spark.createDataFrame(docs, SCHEMA).repartition(3), limit=4) == plain_groups(docs)
