import os
import re
import threading
import time
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner import spec as S
from gleaner.functions import regex as R
from gleaner.functions import text as X
from gleaner.operators import match as M
from gleaner.operators import results
from gleaner.plans import export
from gleaner.plans.cache import EntryCache
from gleaner.plans.search import Search
from gleaner.sources import writers as samples
from gleaner.sources.listing import extension_of
from gleaner.sources.monitor import Monitor
from gleaner.spec import Keyword, SearchSpec
from gleaner.streaming import watch


def test_extension_lists():
    assert S.parse_extensions(".csv, xml;JSON  csv") == [".csv", ".xml", ".json"] and S.parse_extensions(" ;,") == []
    assert SearchSpec(include_all=True).included() == [] and SearchSpec(include_all=True).accepts(".zip")
    spec = SearchSpec(excel=False, word=False, powerpoint=False, pdf=False, custom_enabled=True, custom_extensions="md txt", exclude_enabled=True, exclude_extensions="txt")
    assert spec.included() == [".txt", ".md"] and not spec.accepts(".txt") and spec.accepts(".MD")
    assert extension_of(".gitignore") == ".gitignore" and extension_of("a.tar.GZ") == ".gz" and extension_of("x") == ""


def test_folders():
    assert S.normalize_folders("ex; EX ;/abs/x/;", "/base") == ["/base/ex/", "/abs/x/"]


def test_keywords_and_guards():
    spec = SearchSpec(keywords=(Keyword(" a "), Keyword("  "), Keyword("b", False)))
    assert spec.active() == [" a "]
    assert spec.nothing_to_do() and not replace(spec, target="/x").nothing_to_do()
    assert SearchSpec().validate_form() == ["target folder", "keyword"]


def test_settings_round_trip(tmp_path):
    spec = SearchSpec.of("a", "ü", target="/t", regex=True)
    path = str(tmp_path / "s.json")
    assert S.save(spec, path) and S.load(path) == spec
    (tmp_path / "broken").write_text("{")
    assert S.load(str(tmp_path / "broken"), "/home").target == "/home"
    assert not S.save(spec, "/nowhere/s.json")


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f("v")).collect()]


def test_escapes(spark):
    values = ["a\\b", "\r\n\t", "\\n", "end\\", "\\\\n", "\\\\\\", "", "plain", "\\\n", "x\\\\\tn"]
    escaped = column(spark, values, X.escape_line)
    assert not any(re.search("[\r\n\t]", e) for e in escaped)
    assert column(spark, escaped, X.unescape_line) == values
    assert column(spark, ["\\x\\"], X.unescape_line) == ["\\x\\"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("\\rnt\r\n\tab", max_size=12), min_size=20, max_size=40))
def test_escape_is_inverse(spark, values):
    assert column(spark, column(spark, values, X.escape_line), X.unescape_line) == values


def test_not_blank(spark):
    assert column(spark, [" ", "\xa0", "　", "\x85", "\x1c", "​", "x", ""], X.not_blank) == [False, False, False, False, True, True, True, False]


def test_location(spark):
    rows = [("S", "A1", "O", 1), ("S", "A1", "", 1), ("S", "", "O", 1), ("S", None, None, 7), (None, "A1", "O", 1), ("", "", "", 7)]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, sheet_name string, cell_address string, object_name string, line_number int").orderBy("i").select(X.location()).collect()]
    assert got == ["[S] A1 O", "[S] A1", "[S] O", "[S] 7 Row", "[Object] O", "7 Row"]


def hits(spark, values, pattern, case=False, timeout=None):
    return column(spark, values, lambda c: R.regex_match(spark, F.col(c), pattern, case, timeout))


def test_regex_dialect(spark):
    assert hits(spark, ["CAFÉ", "cafe"], "café") == [True, False]
    assert hits(spark, ["１２", "12", "x"], r"\d\d") == [True, True, False]
    assert hits(spark, ["a\rb"], "a.b") == [True]
    assert hits(spark, ["x\r"], "x$") == [False]
    assert hits(spark, ["aa", "ab"], r"(?<a_b>a)\k<a_b>") == [True, False]
    assert hits(spark, ["xy", None], "x", True, 5.0) == [True, None]
    assert hits(spark, ["ab", "b"], "(a)?(?(1)b|c)") == [True, False]  # conditionals go to the other engine
    with pytest.raises(S.SpecError):
        R.validate(spark, ["(", "a"], False)
    R.validate(spark, ["a|b"], True)


class Late:
    pattern = "late"

    def search(self, text, timeout):
        raise TimeoutError


def test_regex_limit(spark, caplog):
    assert all(R.quick(p) for p in ("abc", "a.c|d?", r"\d+x", "[a-z]{3}", "(a|b)?", "a{2,}", "(?:x)y", "(?<n>x)", "(a|b)*", "(ab)*c", r"\w+@\w+\.com", "a*b*", ".*x", "(x+y)+"))
    assert not any(R.quick(p) for p in (r"(.)\1", "(a+)+", "(?=a)", "(?(1)b|c)", ".{0,100}.{0,100}", "(?i:a)", r"\k<n>", "a?" * 24 + "a" * 24 + "b", ".{0,16}" * 5 + "#", ".*a.*b", "(a|ab)*c", "(a?)*b", "(a*)*b", "x*x*y"))
    assert R.quick("a*A") and not R.quick("(a|A)*b", False) and R.quick("(a|A)*b")  # cases are one if they are ignored
    began = time.time()
    assert hits(spark, ["a" * 41, "x"], r"(.*)*\1y") == [False, False] and time.time() - began < 30
    with caplog.at_level("WARNING", logger="gleaner.regex"):
        assert R.search_within(R._module_pattern("a", False), "bab", 5.0) and not R.search_within(Late(), "x", 0.1)
    assert "counts as no match" in caplog.text
    assert R.java_pattern(r"[(?<a_b>]\\(?<a_b>x)\k<a_b>", True).startswith(r"(?dU)[(?<a_b>]\\(?<g")


@pytest.mark.parametrize("pattern, text", [("a?" * 24 + "a" * 24 + "b", "a" * 40), (".{0,16}" * 5 + "#", "x" * 100), (".{0,16}" * 6 + "#", "x" * 60), ("(a|aa)+$", "a" * 60 + "b")])
def test_dear_patterns_end_in_time(spark, pattern, text):
    """Whatever the engine makes of it, a call ends within the limit; Java's engine, which has none, is not asked."""
    began = time.time()
    assert hits(spark, [text, "none"], pattern, timeout=None) == [False, False]
    assert time.time() - began < 2 * R.TIMEOUT_S + 10


class Steps:
    """Matches a tree as a backtracking engine does, and counts what it tries."""

    def __init__(self, text):
        self.text, self.n = text, 0

    def run(self, node, at, then):
        self.n += 1
        if self.n > 300_000:
            raise OverflowError
        if node.kind == "set":
            ok = at < len(self.text) and self.text[at] in node.chars.ascii
            return ok and then(at + 1)
        if node.kind == "empty":
            return then(at)
        if node.kind == "cat":
            step = then
            for p in reversed(node.parts):
                step = (lambda p, step: lambda k: self.run(p, k, step))(p, step)
            return step(at)
        if node.kind == "alt":
            return any(self.run(p, at, then) for p in node.parts)

        def again(done, k):
            if (node.high is None or done < node.high) and self.run(node.parts[0], k, lambda m: m > k and again(done + 1, m)):
                return True
            return done >= node.low and then(k)

        return again(0, at)

    def search(self, node):
        return any(self.run(node, k, lambda _: True) for k in range(len(self.text) + 1))


_patterns = st.recursive(
    st.sampled_from(["a", "b", "[ab]", "c", "ab"]),
    lambda x: st.one_of(st.tuples(x, st.sampled_from(["*", "+", "?", "{0,3}", "{2,}", "{1,9}"])).map(lambda p: f"({p[0]}){p[1]}"), st.lists(x, min_size=2, max_size=4).map("".join), st.lists(x, min_size=2, max_size=3).map(lambda p: "(" + "|".join(p) + ")")),
    max_leaves=9,
)


@settings(max_examples=400, deadline=None)
@given(_patterns, st.text("ab", min_size=1, max_size=4))
def test_quick_patterns_try_little(pattern, unit):
    """What counts as quick takes no more than about the square of the length, on texts that nearly match."""
    from gleaner.functions import patterns as P

    tree = P.parse(pattern)
    assert tree is not None
    if not P.quick(pattern):
        return
    counts = []
    for n in (16, 32):
        s = Steps((unit * n)[:n] + "#")
        s.search(tree)
        counts.append(s.n)
    assert counts[0] <= 20 * P.WAYS * len(pattern) * 16 and counts[1] <= 9 * counts[0] + 2000


@settings(max_examples=300, deadline=None)
@given(_patterns, st.text("abcABC", max_size=12), st.booleans())
def test_required_literals_are_held(pattern, text, case):
    from gleaner.functions import patterns as P

    if re.search(pattern, text, 0 if case else re.IGNORECASE):
        held = text if case else text.lower()
        assert all(any(x in held for x in c) for c in P.required(pattern, case))


def test_required_literals():
    from gleaner.functions import patterns as P

    assert P.required(r"foo(bar|bazz)+\d") == [("foo",), ("bar", "bazz")] and P.required("x?yz") == [("yz",)] and P.required("a|b") == [] and P.required(r"(?=foo)foo") == []
    assert P.required("Desk", False) == [("de",)] and P.required("Desk") == [("Desk",)] and P.required("caf\u00e9 on", False) == [("caf",), (" on",)]
    assert M.needed(SearchSpec.of("ab+cd", "x.", regex=True)) == ((("cd",),),) and M.needed(SearchSpec.of("ab+cd", "x.", regex=True, match_all=False)) == ()


def test_patterns_are_filtered_below_the_split(spark):
    from gleaner import queries as Q

    d = "/root/testdata/sf0.001"
    spec = SearchSpec.of("the .*er ", "a(nd|t)", regex=True)
    plan = Q.search_lines(spec)(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Filter.*Contains\(lower\(text|Filter.*contains\(lower\(text", plan)
    a, b = (sorted(map(tuple, Q.search_lines(spec, p)(spark, d).collect())) for p in (True, False))
    assert a == b and a


def test_search_is_one_pass(spark, tree):
    plan = lambda spec: Search(spark, spec).results()._jdf.queryExecution().executedPlan().toString()
    spec = SearchSpec.of("one", "needle", target=tree)
    for more in ({}, {"regex": True}, {"match_all": False}, {"excel": False}):
        p = plan(replace(spec, **more))
        assert "Window" not in p and "collect_list" not in p
        assert p.count("MapInArrow") == p.count("FileScan") == p.count("Exchange ") == 1  # files are dealt to tasks, and read once


def test_targets_may_be_uris(spark, tree):
    assert S.absolute("b", "s3a://x/y") == "s3a://x/y/b" and S.absolute("hdfs://n/a", "/z") == "hdfs://n/a" and S.absolute("file:///a/b", "/z") == "/a/b" and S.absolute("c", "file:/a") == "/a/c"
    from gleaner.sources import listing

    # a URI that is no local path: tasks list and read it by Arrow's file systems
    found = sorted(x[0] for x in listing.walk("mock://" + tree, [])) if listing.store("mock://" + tree) else []
    assert found == [] or len(found) == 12
    assert listing.content(f"{tree}/a.txt").startswith(b"needle")
    flat = sorted(x[0] for x in listing.walk(tree, [f"{tree}/ex/"]))
    assert f"{tree}/ex2/y.TXT" in flat and f"{tree}/ex/x.txt" not in flat and len(flat) == 11


def test_readers_of_a_session_reach_tasks(spark, tree):
    from gleaner.sources import readers
    from gleaner.sources.formats.base import Piece

    known = dict(readers.READERS)
    readers.register(".md", lambda raw, o: iter([Piece("read by own reader")]))
    try:
        found = Search(spark, SearchSpec.of("own", target=tree, custom_enabled=True, custom_extensions="md")).results().collect()
    finally:
        readers.READERS.clear()
        readers.READERS.update(known)
    assert [r.content for r in found] == ["read by own reader"]


def test_cache_of_one_target(spark, tree, tmp_path):
    cache = str(tmp_path / "shared")
    a, b = SearchSpec.of("needle", target=tree, cache=cache), SearchSpec.of("needle", target=tree + "/ex2", cache=cache)
    for spec in (a, b):
        Search(spark, spec).results().count()
    (tmp_path / "shared" / "foreign").write_text("mine")
    EntryCache(spark, cache, a.root()).clear()
    assert {r.target for r in EntryCache(spark, cache, "").rows().select("target").collect()} <= {b.root()}
    assert (tmp_path / "shared" / "foreign").exists()
    # a file that changes after the listing is read again by the next search
    search = Search(spark, a)
    files = EntryCache(spark, cache, a.root()).listed(search.files(), False)
    os.utime(f"{tree}/a.txt", (5, 5))
    assert files.where(F.endswith("file_path", F.lit("/a.txt"))).first().modified.timestamp() > 5
    from gleaner.schema import LABELS_JA

    assert len(Search(spark, a).results().collect()) == 7
    assert Search(spark, a, LABELS_JA).extracted().where("error IS NULL").count() > 7  # other labels: nothing is a hit


E = "file_path string, file_ord long, entry_ord int, line_number int, sheet_name string, cell_address string, object_name string, content string"


def test_row_and(spark):
    cell = lambda n, line, a, c, o=None, f="b.xlsx": (f, 0, n, line, "S", a, o, c)
    rows = [
        cell(0, 1, "A1", "foo bar"), cell(1, 2, "A2", "foo"), cell(2, 2, "B2", "bar"), cell(3, 2, "C2", "other"), cell(4, 3, "A3", "foo"), cell(5, 4, "A4", "bar"),
        cell(6, 0, None, "foo", "Shape1"), cell(7, 0, "A9", "foo and bar", "Comment"), cell(8, 5, "A5", "foo\nbar"), cell(0, 2, None, "foo", None, "t.txt"), cell(1, 2, None, "bar", None, "t.txt"),
    ]
    df = spark.createDataFrame(rows, E)
    keys = lambda spec: sorted((r.file_path, r.entry_ord) for r in M.row_match(spark, df, spec).collect())
    want = [("b.xlsx", k) for k in (0, 1, 2, 7, 8)]
    assert keys(SearchSpec.of("foo", "bar")) == want
    assert keys(SearchSpec.of("foo", "b.r", regex=True)) == want
    assert keys(SearchSpec.of("foo", r"foo\nbar", regex=True)) == [("b.xlsx", 1), ("b.xlsx", 8)]  # row 2 matches across cells, and its first cell holds a keyword
    assert keys(SearchSpec.of(r"foo\nbar", regex=True)) == [("b.xlsx", 8)]  # a row that matches only across cells gives nothing
    assert keys(SearchSpec.of("foo", "bar", match_all=False)) == [("b.xlsx", k) for k in (0, 1, 2, 4, 5, 6, 7, 8)] + [("t.txt", 0), ("t.txt", 1)]
    assert keys(SearchSpec.of("foo bar", remove_line_breaks=True)) == [("b.xlsx", 0)]
    shown = results.displayed(df.where("entry_ord = 8"), SearchSpec.of("x", remove_line_breaks=True)).first()
    assert shown.content == "foo bar" and shown.location == "[S] A5" and shown.file_name == "b.xlsx"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name, raw in {
        "a.txt": b"needle one\nother\nNEEDLE two", ".hidden.txt": b"needle hidden", "_u.txt": b"needle under", ".git/c.txt": b"needle git", "ex/x.txt": b"needle ex", "ex2/y.TXT": b"needle ex2",
        "w.xlsx": samples.xlsx(), "d.docx": samples.docx(), "p.pdf": samples.pdf(), "bad.xlsx": b"junk", "readme": b"needle none", "z.md": b"needle md",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    return str(root)


def names(df, tree):
    return sorted({os.path.relpath(r.file_path, tree) for r in df.collect()})


def test_folder_search(spark, tree):
    spec = SearchSpec.of("needle", target=tree)
    assert names(Search(spark, spec).results(), tree) == [".git/c.txt", ".hidden.txt", "_u.txt", "a.txt", "ex/x.txt", "ex2/y.TXT"]
    assert names(Search(spark, replace(spec, exclude_folders_enabled=True, exclude_folders="EX;.git")).results(), tree) == [".hidden.txt", "_u.txt", "a.txt", "ex2/y.TXT"]
    assert names(Search(spark, replace(spec, include_all=True, exclude_enabled=True, exclude_extensions="txt")).results(), tree) == ["readme", "z.md"]
    assert names(Search(spark, replace(spec, text=False, custom_enabled=True, custom_extensions="md")).results(), tree) == ["z.md"]
    assert Search(spark, replace(spec, case_sensitive=True, keywords=(Keyword("NEEDLE"),))).results().select("line_number").collect()[0][0] == 3
    shared = Search(spark, replace(spec, keywords=(Keyword("shared"), Keyword("inline")))).results()
    assert sorted(r.location for r in shared.collect()) == ["[First] A1", "[First] B1"]
    assert names(Search(spark, spec).errors(), tree) == ["bad.xlsx"]
    assert Search(spark, replace(spec, target="")).results().count() == 0
    with pytest.raises(Exception, match="cannot be listed"):
        Search(spark, replace(spec, target=tree + "/none")).results().collect()


def test_cache(spark, tree, tmp_path):
    cache = str(tmp_path / "cache")
    spec = SearchSpec.of("needle", target=tree, cache=cache)
    cold = Search(spark, replace(spec, cache=None)).results().drop("file_ord")
    want = sorted(map(tuple, cold.collect()), key=str)
    first = Search(spark, spec)
    assert sorted(map(tuple, first.results().drop("file_ord").collect()), key=str) == want
    again = Search(spark, spec)
    assert sorted(map(tuple, again.results().drop("file_ord").collect()), key=str) == want
    assert names(again.errors(), tree) == ["bad.xlsx"] and again.extracted().where("error IS NULL").count() == 0  # only what failed is read again
    store, files = EntryCache(spark, cache), again.files()
    assert names(store.misses(store.listed(files, True)), tree) == ["bad.xlsx", "w.xlsx"]  # the mode of formulas concerns spreadsheets alone
    with open(f"{tree}/a.txt", "w") as f:
        f.write("changed needle")
    os.utime(f"{tree}/a.txt", (1, 1))
    changed = Search(spark, spec).results().where(F.endswith("file_path", F.lit("a.txt")))
    assert [r.content for r in changed.collect()] == ["changed needle"]
    rebuilt = Search(spark, replace(spec, rebuild_cache=True))
    assert len(names(rebuilt.results(), tree)) == 6 and not rebuilt.after().rebuild_cache


def test_export(spark, tree, tmp_path):
    spec = SearchSpec.of("needle", target=tree, export_conditions=True)
    found = Search(spark, spec).results()
    export.export_results(found, str(tmp_path / "r"), spec, single=True)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r")).collect()]
    at = lines.index("\t".join(export.COLUMNS))
    assert "Keyword1\tneedle" in lines[:at] and len(lines) - at - 1 == 7
    assert lines[at + 1].split("\t")[1:] == [".hidden.txt", "1 Row", "needle hidden"]
    export.export_files(found, str(tmp_path / "f"), replace(spec, export_conditions=False), single=True)
    assert [os.path.basename(r[0]) for r in spark.read.text(str(tmp_path / "f")).collect()][:3] == [".hidden.txt", "_u.txt", "a.txt"]
    counted = results.counts(found).first()
    assert (counted.results, counted.files) == (7, 6)


def test_matched_files_ignore_case(spark):
    rows = [("/A/x.txt", 1, 0), ("/a/X.txt", 0, 4), ("/b", 2, 0)]
    got = {r.file_path: r.hits for r in results.matched_files(spark.createDataFrame(rows, "file_path string, file_ord long, entry_ord int")).collect()}
    assert got == {"/a/X.txt": 2, "/b": 1}


def test_watch(spark, tree, tmp_path):
    """Hidden files are seen, read files not again, changed and new ones are."""
    spec, seen = SearchSpec.of("needle", target=tree), []
    run = lambda: watch.watch(spark, spec, lambda df, n: seen.extend(r.content for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    run()
    assert sorted(seen) == ["NEEDLE two", "needle ex", "needle ex2", "needle git", "needle hidden", "needle one", "needle under"]
    seen.clear()
    run()
    assert seen == []
    with open(f"{tree}/a.txt", "w") as f:
        f.write("needle changed")
    os.makedirs(f"{tree}/new/deep")
    with open(f"{tree}/new/deep/.n.txt", "w") as f:
        f.write("needle new")
    run()
    assert sorted(seen) == ["needle changed", "needle new"]
    assert len(list(watch.live(Search(spark, spec).results()))) == 7


def slow_tree(tmp_path, n):
    for k in range(n):
        (tmp_path / "slow" / f"{k % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "slow" / f"{k % 3}" / f"{k}.slow").write_text(f"needle {k}")
    return str(tmp_path / "slow")


def slow_search(spark, target, log, monitor, wait):
    """A search whose reader takes its time and writes down what it opened."""
    from gleaner.sources import readers
    from gleaner.sources.formats.base import Piece

    def slow(raw, options):
        with open(f"{log}/{raw.decode()}", "w"):
            time.sleep(wait)
        yield Piece(raw.decode(), 1)

    known = dict(readers.READERS)
    readers.register(".slow", slow)
    try:
        return Search(spark, SearchSpec.of("needle", target=target, custom_enabled=True, custom_extensions="slow"), monitor=monitor).results()
    finally:
        readers.READERS.clear()
        readers.READERS.update(known)


def test_progress_rises_while_a_search_runs(spark, tmp_path):
    (tmp_path / "log").mkdir()
    monitor, seen = Monitor(spark), []
    found = slow_search(spark, slow_tree(tmp_path, 24), tmp_path / "log", monitor, 0.1)
    action = threading.Thread(target=lambda: seen.append(found.count()))
    action.start()
    rising = []
    while action.is_alive():
        rising.append(monitor.files)
        time.sleep(0.02)
    action.join()
    assert seen == [24] and monitor.files == 24
    assert rising == sorted(rising) and any(0 < n < 24 for n in rising)


def test_no_file_is_opened_after_a_cancellation(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    monitor = Monitor(spark)
    found = slow_search(spark, slow_tree(tmp_path, 40), log, monitor, 0.3)
    failed = []
    cancel = watch.Cancellable(spark, "slow", monitor)

    def action():
        with cancel:
            try:
                found.count()
            except Exception as e:  # noqa: BLE001
                failed.append(e)
            time.sleep(1.5)  # the marker stays while tasks may still look for it

    t = threading.Thread(target=action)
    t.start()
    while len(os.listdir(log)) < 3:
        time.sleep(0.02)
    cancel.cancel()
    time.sleep(0.4)
    opened = len(os.listdir(log))
    t.join()
    assert opened < 40 and len(os.listdir(log)) == opened and failed
    assert not monitor.stopped()  # cleared at the end


def text_rows(df):
    return sorted((r.file_path, r.line_number, r.content) for r in df.collect())


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp932", "utf-16", "utf-16-be", "utf-32"])
def test_large_texts_are_read_by_ranges(spark, tmp_path, encoding):
    """Ranges of a few bytes cut lines, characters and line ends at every place; rows are those of the reader of whole files."""
    import codecs
    import random

    from gleaner.sources import readers
    from gleaner.sources.formats.base import Options

    rng = random.Random(encoding)
    ends = ["\n", "\r\n", "\r", "\n\n", "\r\r\n", "\n\r"]
    rows = []
    for k in range(6):
        # the first bytes tell the encoding for certain; ਊ and ഍ hold the bytes of line ends in UTF-16
        head = "日Å" if encoding == "utf-8" else "日本語ありがとう"
        text = head + "".join("".join(rng.choice("aé日ਊ഍ \t" if encoding != "cp932" else "aｱ日表\t") for _ in range(rng.choice([0, 1, 3, 40]))) + rng.choice(ends) for _ in range(60))
        raw = (codecs.BOM_UTF16_BE if encoding == "utf-16-be" else b"") + (text + ("end" if k % 2 else "")).encode(encoding) + (b"\xff" if k == 3 else b"")
        (tmp_path / f"{k}.txt").write_bytes(raw)
        rows.append((f"{tmp_path}/{k}.txt", ".txt", k, len(raw)))
    files = spark.createDataFrame(rows, "file_path string, ext string, file_ord long, length long")
    want = text_rows(readers.entries(readers.extract(files.drop("length"))))
    assert len(want) > 100
    for size in (4, 64, 500):
        extracted = readers.extract(files, Options(range_bytes=size))
        assert text_rows(readers.entries(extracted)) == want and extracted.where("error IS NOT NULL").isEmpty()
    orders = sorted((r.file_ord, r.entry_ord, r.line_number) for r in extracted.collect())
    assert [o[::2] for o in orders] == sorted(o[::2] for o in orders)


def test_large_text_takes_many_tasks_and_little_memory(spark, tmp_path):
    """A file of 200 MB in ranges of 4 MB: rows as in the file, and a worker that never held it."""
    from gleaner.sources import readers
    from gleaner.sources.formats.base import Options

    line = "line {:09d} " + "x" * 180 + "\n"
    with open(tmp_path / "big.log", "w") as f:
        for k in range(0, 1_000_000, 10_000):
            f.write("".join(line.format(j) for j in range(k, k + 10_000)))
    size = os.path.getsize(tmp_path / "big.log")
    files = spark.createDataFrame([(f"{tmp_path}/big.log", ".log", 0, size)], "file_path string, ext string, file_ord long, length long")
    rows = readers.entries(readers.extract(files, Options(range_bytes=4 << 20)))
    rows = rows.select(F.spark_partition_id().alias("task"), (F.substring("content", 6, 9).cast("int") + 1 == F.col("line_number")).alias("right"))
    found = rows.agg(F.count("*").alias("n"), F.count_if("right").alias("right"), F.count_distinct("task").alias("tasks")).first()
    assert (found.n, found.right) == (1_000_000, 1_000_000) and found.tasks > 2
    os.unlink(tmp_path / "big.log")


def test_ranges_of_a_search(spark, tree):
    spec = SearchSpec.of("needle", target=tree)
    want = text_rows(Search(spark, spec).results())
    assert text_rows(Search(spark, spec, range_bytes=4).results()) == want
    assert text_rows(Search(spark, replace(spec, cache=tree + "/.c"), range_bytes=4).results()) == want
    gone = Search(spark, spec, range_bytes=4)
    os.unlink(f"{tree}/a.txt") if gone.files() else None
    assert names(gone.errors(), tree) == ["a.txt", "bad.xlsx"]


def test_listing_in_rounds(spark, tmp_path):
    """One chain of folders, dealt to more than one task; the order is that of the walk."""
    from gleaner.sources import listing

    top = tmp_path / "chain"
    at = top
    for k in range(60):
        at = at / f"d{k:02}"
        at.mkdir(parents=True)
        for n in range(20):
            (at / f"{n:02}.txt").touch()
        (at / "side").mkdir()
        (at / "side" / ".hidden.txt").touch()
    spec = SearchSpec.of("x", target=str(top), exclude_folders_enabled=True, exclude_folders="d00/d01/side")
    found = listing.rounds(spark, spec, str(tmp_path / "rounds"), limit=7)
    got = [r.file_path for r in found.orderBy("file_ord").collect()]
    assert got == [p for p, *_ in listing.walk(str(top), spec.skipped_folders())] and len(got) == 60 * 21 - 1
    assert len([n for n in os.listdir(tmp_path / "rounds") if n.startswith("round=")]) > 5
    assert text_rows_of(found) == text_rows_of(listing.files(spark, spec))


def text_rows_of(df):
    return sorted((r.file_path, r.ext, r.modified, r.length) for r in df.collect())


def test_cache_holds_one_state(spark, tree, tmp_path):
    """After many searches with changes each file has one manifest row, and what is dead is gone."""
    cache = str(tmp_path / "cache")
    spec = SearchSpec.of("needle", target=tree, cache=cache)
    for k in range(11):
        with open(f"{tree}/a.txt", "w") as f:
            f.write(f"needle {k}")
        os.utime(f"{tree}/a.txt", (1000 + 10 * k, 1000 + 10 * k))
        search = Search(spark, spec)
        found = [r.content for r in search.results().where(F.endswith("file_path", F.lit("/a.txt"))).collect()]
        assert found == [f"needle {k}"]
        search.close()
    store = EntryCache(spark, cache, spec.root())
    rows = store.rows().collect()
    files = [r.file_path for r in rows]
    assert len(files) == len(set(files)) > 5
    store.compact()
    store.vacuum()
    state = store.state()
    assert len(os.listdir(f"{cache}/entries")) == len(state.batches) <= 8 and len(os.listdir(f"{cache}/manifest")) == 1 and os.listdir(f"{cache}/listing") == []
    assert sum(state.batches.values()) < 2 * len(files) + 8
    plan = store.rows().join(store.rows().select("file_path").hint("merge"), "file_path")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning" not in plan.split("ReadSchema")[0]
    from gleaner.plans.cache import Conflict

    other = EntryCache(spark, cache, spec.root())
    other.base = state
    store.commit(state, store.rows(), state.batches)
    with pytest.raises(Conflict):
        other.commit(state, other.rows(), state.batches)
    again = Search(spark, spec)
    assert sorted(r.content for r in again.results().collect()) == sorted(r.content for r in Search(spark, replace(spec, cache=None)).results().collect())


@pytest.mark.parametrize("both", [True, False])
def test_prefilter_changes_nothing(spark, both):
    from gleaner import queries as Q

    spec = SearchSpec.of("the", "er ", match_all=both)
    d = "/root/testdata/sf0.001"
    a, b = (sorted(map(tuple, Q.search_lines(spec, p)(spark, d).collect())) for p in (True, False))
    assert a == b and a


def test_queries_match_sql(spark):
    import duckdb

    from gleaner import queries as Q

    c = duckdb.connect()
    for t in ("documents", "pages", "part", "events", "conversations", "supplier"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    from gleaner import file_queries

    for name, (run, sql) in (Q.QUERIES | file_queries.QUERIES).items():
        got, want = run(spark, "/root/testdata/sf0.001"), c.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        assert sorted(map(str, (tuple(r[k] for k in cols) for r in got.collect()))) == sorted(map(str, c.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())), name


def test_rows_are_dealt_to_tasks_by_number(spark):
    """A small table in one file keeps all cores busy, and tasks grow with its rows."""
    from gleaner import file_queries as Q

    rows = Q.part(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert Q.dealt(spark.range(30 * Q.TASK_ROWS).toDF("key")).rdd.getNumPartitions() == 30
    assert Q.made(rows, "xlsx").rdd.getNumPartitions() > 1


def test_rows_of_sheets_are_matched_in_one_pass(spark):
    from gleaner import file_queries as Q

    for regex in (False, True):
        plan = Q.sheet_rows(regex)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 2 and "Window" not in plan and plan.count("Exchange ") == 1


def test_rounds_of_a_listing_go_by_depth(spark, tmp_path):
    """Of many chains of folders each goes on in each round."""
    from gleaner.sources import listing

    counts = []
    for chains in (20, 80):
        top = tmp_path / f"chains{chains}"
        for k in range(chains):
            at = top / str(k) / "b" / "c" / "d" / "e" / "f"
            at.mkdir(parents=True)
            (at / "x.txt").touch()
        found = listing.rounds(spark, SearchSpec.of("x", target=str(top)), str(tmp_path / f"rounds{chains}"), limit=2)
        assert found.count() == chains
        counts.append(len([n for n in os.listdir(tmp_path / f"rounds{chains}") if n.startswith("round=")]))
    assert counts[1] <= counts[0] + 3


def test_forms_of_a_batch_share_a_folder(monkeypatch):
    from gleaner import file_queries as Q

    made, new = [], Q.tempfile.TemporaryDirectory
    monkeypatch.setattr(Q.tempfile, "TemporaryDirectory", lambda: made.append(1) or new())
    rows = Q.form_rows(list(range(30)))
    assert len(made) == 1 and rows["same"] == [True] * 30 and rows["nothing"][7] and rows["missing"][4] == "" and rows["target"][4] == "/base/y"


def test_trees_are_emptied_by_tasks(spark, tmp_path):
    """All files and folders go, whatever their names; links go, what they lead to stays."""
    from gleaner.sources import listing

    top, other = tmp_path / "it's a tree", tmp_path / "kept.txt"
    other.touch()
    for k in range(30):
        at = top / f"{k % 3}" / ".deep" / str(k)
        at.mkdir(parents=True)
        for n in range(5):
            (at / f".{n} x").touch()
    (top / "link").symlink_to(other)
    (top / "links").symlink_to(tmp_path)
    assert listing.emptied(spark, str(top), str(tmp_path / "gone"), limit=4) == 0
    assert os.listdir(top) == [] and other.exists()


def test_flat_folders_are_emptied(spark, tmp_path):
    """A folder that holds files alone, and one that holds nothing."""
    from gleaner.sources import listing

    top = tmp_path / "flat"
    top.mkdir()
    for k in range(3):
        (top / f"{k}.txt").touch()
    for turn in range(2):
        assert listing.emptied(spark, str(top), str(tmp_path / f"gone{turn}")) == 0
        assert os.listdir(top) == []


def test_text_ranges_of_odd_tables(spark, tmp_path):
    """No documents, none with a text, one without an id, ids beyond what doubles hold, and a text of many ranges."""
    import duckdb

    from gleaner import file_queries

    run, sql = file_queries.QUERIES["text_ranges"]
    tables = [[], [(1, None)], [(None, "a\nb"), (3, "c")], [(2**60 // 200 * 200 - 1, "d"), (2**60 // 200 * 200, "e"), (-1, "f"), (2**63 - 1, "g")], [(k, "x \n\ny" * 5000) for k in range(3)]]
    for n, rows in enumerate(tables):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        c = duckdb.connect()
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{n}/documents.parquet/*.parquet'")
        got = run(spark, f"{tmp_path}/{n}").select("file_name", "line_number", "content")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, c.sql(f"SELECT file_name, line_number, content FROM ({sql})").fetchall())), rows[:4]


def test_large_folders_are_listed_by_several_tasks(tmp_path):
    """A task that has listed a large folder leaves the next one to others."""
    import pyarrow as pa

    from gleaner.sources import listing

    sizes = {"/a": 5000, "/b": 5000, "/c": 20}
    look = lambda top: ([], [(f"{top}/{n}", ".txt", None, 0) for n in range(sizes[top])])
    out = pa.Table.from_batches(listing._round(look, 100)(iter([pa.RecordBatch.from_pydict({"folder": list(sizes)})]))).to_pylist()
    assert sum(not r["todo"] for r in out) == 5000 and [r["folder"] for r in out if r["todo"]] == ["/b", "/c"]


def test_index_lines_are_split_once(spark):
    from gleaner import file_queries as Q

    plan = Q.index_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(CASE") == 1 and plan.count("split(") == 2  # the other takes contents apart, and only those with a code


def test_index_contents_without_codes_stay(spark):
    rows = spark.createDataFrame([("p\t1\t\t\t\ta\\\\n\\tb",), ("p\tx\ts\t\to\tplain",), ("p\t1\t2\t3\t4",)], "line string")
    got = [r.e for r in rows.select(X.parse_index_line("line").alias("e")).collect()]
    assert [e and (e.line_number, e.sheet_name, e.object_name, e.content) for e in got] == [(1, None, None, "a\\n\tb"), (0, "s", "o", "plain"), None]


def test_local_files_are_written_without_arrow(monkeypatch, tmp_path):
    from gleaner import file_queries as Q

    tops = set()
    Q.put(f"file://{tmp_path}/c/3.txt", b"xxx", tops, True)
    monkeypatch.setattr(Q, "pafs", None)
    for n, old in ((1, False), (2, True)):
        Q.put(f"{tmp_path}/a/b/{n}.txt", b"x" * n, tops, old)
    found = {p.name: (p.stat().st_size, p.stat().st_mtime == 1) for p in tmp_path.rglob("*.txt")}
    assert found == {"1.txt": (1, False), "2.txt": (2, True), "3.txt": (3, True)} and tops == {f"{tmp_path}/a/b", f"{tmp_path}/c"}
