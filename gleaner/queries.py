"""Search operators as queries over tables, each with the SQL that gives the same rows.

Texts stand for files (doc_id is the path, lines are entries), wide tables for sheets (a row key, a column for each cell).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import entries as E
from .operators import match as M
from .operators import results
from .plans.cache import valid
from .sources import listing
from .spec import FAMILIES, SearchSpec

BOTH = SearchSpec.of("the", "and")
ACCENTS = SearchSpec.of("ción", "über", match_all=False)
ROW = SearchSpec.of("ring", "Brand#1")
REGEX = r"(^|[^a-z])th[ae]n?[^a-z]"
REGEX_MANY = (r"[0-9]{3}", r"[.:]$")
INCLUDE, EXCLUDE = ".com, html;HTM .php", ".php"
LINK = r'href="([^"]*)"'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    return E.lines(table(spark, sf_dir, "documents"), "text", ["doc_id"], where)


def search_lines(spec: SearchSpec, prefiltered: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """Lines of documents that match; the texts are filtered before they are split."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = M.prefilter(F.col("text"), spec) if prefiltered else None
        return doc_lines(spark, sf_dir, first).where(M.entry_match(spark, F.col("content"), spec))

    return run


def regex_lines(patterns: tuple[str, ...], match_all: bool) -> Callable[[SparkSession, str], DataFrame]:
    return search_lines(SearchSpec.of(*patterns, regex=True, match_all=match_all))


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cells(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


def row_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that hold a keyword, of rows that hold all."""
    order = F.when(F.col("column_name") == "p_name", 0).when(F.col("column_name") == "p_brand", 1).otherwise(2)
    sheet = part_cells(spark, sf_dir).select(
        F.lit("part.xlsx").alias("file_path"), F.lit(0).cast("long").alias("file_ord"), order.cast("int").alias("entry_ord"), F.col("p_partkey").cast("int").alias("line_number"),
        F.lit("part").alias("sheet_name"), F.col("column_name").alias("cell_address"), F.lit(None).cast("string").alias("object_name"), "content",
    )
    found = M.row_match(spark, sheet, ROW)
    return found.select(F.col("line_number").cast("long").alias("p_partkey"), F.col("cell_address").alias("column_name"), "content")


def hyperlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    return E.numbered_values(table(spark, sf_dir, "pages"), ["page_id"], links, "Hyperlink")


def tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.tsv_clean("text").alias("line"))


def index_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.escape_line("text").alias("line"))


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.unescape_line(X.escape_line("text")).alias("text"))


def matched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with matches, the first line and the number of matches of each."""
    found = search_lines(BOTH)(spark, sf_dir)
    entries = found.select(F.col("doc_id").cast("string").alias("file_path"), F.col("line_number").cast("long").alias("file_ord"), F.lit(0).alias("entry_ord"))
    return results.matched_files(entries).select(F.col("file_path").cast("long").alias("doc_id"), F.col("file_ord").cast("int").alias("first_line"), "hits")


def location_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    value = lambda n, name: F.when(k % n == 0, F.lit(None)).when(k % n == 1, F.lit("")).otherwise(name)
    rows = e.select("event_id", value(3, F.col("event_type")).alias("sheet"), value(5, F.concat(F.lit("A"), k.cast("string"))).alias("cell"), value(4, F.lit("Shape1")).alias("obj"), (k % 100).cast("int").alias("line"))
    return rows.select("event_id", X.location("sheet", "cell", "obj", "line").alias("location"))


def url_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.extension("url").alias("ext"))


def ext_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("url", F.element_at(F.array(*[F.lit(x) for x in (".html", ".php", ".txt")]), (F.col("page_id") % 3 + 1).cast("int")))
    found = table(spark, sf_dir, "pages").select("page_id", "url", name.alias("file_path"), X.extension(name).alias("ext"))
    spec = SearchSpec(excel=False, word=False, powerpoint=False, pdf=False, text=False, custom_enabled=True, custom_extensions=INCLUDE, exclude_enabled=True, exclude_extensions=EXCLUDE)
    return listing.filtered(found, spec).select("page_id", "url", "ext")


def exclude_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths not below a folder, whatever their case; a folder whose name only begins alike stays."""
    folder = F.element_at(F.array(*[F.lit(x) for x in ("/data/ex/", "/data/EX/sub/", "/data/ex2/", "/data/")]), (F.col("page_id") % 4 + 1).cast("int"))
    paths = table(spark, sf_dir, "pages").select("page_id", F.concat(folder, F.col("page_id").cast("string"), F.lit(".txt")).alias("file_path"), F.lit(".txt").alias("ext"))
    spec = SearchSpec(target="/data", exclude_folders_enabled=True, exclude_folders="EX;/none")
    return listing.filtered(paths, spec).select("page_id", F.col("file_path").alias("path"))


def formula_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    formula = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("=A"), F.col("p_size").cast("string"), F.lit("*2"))).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", formula.alias("content")).where(F.startswith("content", F.lit("=")))


def excel_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks go after the match: a keyword that spans one never matches."""
    docs = table(spark, sf_dir, "documents").where(M.entry_match(spark, F.col("text"), SearchSpec.of("the", ".\n")))
    return docs.select("doc_id", X.without_breaks("text").alias("content"))


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as files, and a manifest: some entries are old, some were read in the other mode, some are missing."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("modified"))
    shift = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, 999_999).otherwise(1_000_000)
    stored = e.where(F.col("event_id") % 7 != 0).select("event_id", F.timestamp_micros(F.unix_micros("modified") + shift).alias("modified"), (F.col("event_id") % 2 == 0).alias("formulas"))
    return e, stored


def _cache_join(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, m = _cached(spark, sf_dir)
        path = F.col("event_id").cast("string").alias("file_path")
        files = e.select("event_id", path, F.lit(".xlsx").alias("ext"), "modified")
        manifest = m.select(path, "modified", "formulas", F.lit("en").alias("labels"), F.lit(None).cast("string").alias("error"))
        return files.join(manifest, valid(files, manifest, True, "en"), kind).select("event_id")

    return run


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SearchSpec.of("the", "an")
    rows = E.lines(table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn", "role"], M.prefilter(F.col("text"), spec))
    return rows.where(M.entry_match(spark, F.col("content"), spec))


def props_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("props").alias("content")).where(M.entry_match(spark, F.col("content"), SearchSpec.of("1", "7")))


def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.lines(table(spark, sf_dir, "documents"), "text", ["doc_id", "lang"])
    hit = [M.plain_match(F.col("content"), k, False) for k in ("the", "que")]
    return rows.groupBy("lang").agg(F.count_if(hit[0]).alias("n_the"), F.count_if(hit[1]).alias("n_que"), F.count(F.lit(1)).alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


def encoding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters beyond ASCII by language: what the choice of an encoding rests on."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.octet_length(t) - F.length(t)).alias("more_bytes"), F.sum(F.length(t)).alias("characters"))


def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.header_footer(F.concat(F.lit("&L"), F.col("p_name"), F.lit("&C page &P of &N &d"))).alias("content"))


def keyword_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five slots, of which blank and disabled ones do not count."""
    from .spec import Keyword

    spec = SearchSpec(keywords=(Keyword("the"), Keyword("  "), Keyword("zzz", False), Keyword(""), Keyword("th ")))
    return search_lines(spec)(spark, sf_dir)


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which family of readers a file belongs to."""
    names = F.element_at(F.array(*[F.lit(x) for x in (".xlsx", ".XLS", ".docm", ".pptx", ".pdf", ".txt", ".md", "")]), (F.col("page_id") % 8 + 1).cast("int"))
    ext = X.extension(F.concat(F.lit("/d/f"), F.col("page_id").cast("string"), names))
    family = reduce(lambda a, f: a.when(ext.isin(*FAMILIES[f]), F.lit(f)), FAMILIES, F.when(F.lit(False), F.lit(""))).otherwise(F.lit("text"))
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), family.alias("family"))


_LINES = """lines AS (SELECT doc_id, lang, i::INTEGER AS line_number, parts[i] AS content FROM
 (SELECT doc_id, lang, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, lang, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS parts FROM documents))
 WHERE length(trim(parts[i], ' ' || chr(9) || chr(11) || chr(12))) > 0)"""


def _lines_sql(where: str, columns: str = "doc_id, line_number, content") -> str:
    return f"WITH {_LINES} SELECT {columns} FROM lines WHERE {where}"


_CACHE = """WITH e AS (SELECT event_id, ts::TIMESTAMP AS modified FROM events),
m AS (SELECT event_id, epoch_us(modified) + CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 999999 ELSE 1000000 END AS us, event_id % 2 = 0 AS formulas FROM e WHERE event_id % 7 <> 0)
SELECT event_id FROM e WHERE {} EXISTS (SELECT 1 FROM m WHERE m.event_id = e.event_id AND abs(epoch_us(e.modified) - m.us) < 1000000 AND m.formulas)"""
_CELLS = "cells AS (SELECT * FROM (UNPIVOT (SELECT p_partkey, p_name, p_brand, p_type FROM part) ON p_name, p_brand, p_type INTO NAME column_name VALUE content) WHERE length(trim(content)) > 0)"
_AND = "contains(lower(content), 'the') AND contains(lower(content), 'and')"
_LINKS = r"""WITH v AS (SELECT page_id, trim(unnest(found)) AS content, unnest(range(1, len(found) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS found FROM pages)),
f AS (SELECT page_id, content, min(pos) AS pos FROM v WHERE content <> '' GROUP BY ALL)
SELECT page_id, content, 'Hyperlink' || row_number() OVER (PARTITION BY page_id ORDER BY pos) AS object_name FROM f"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "scan_lines": (doc_lines, _lines_sql("true")),
    "and_ci": (search_lines(BOTH, False), _lines_sql(_AND)),
    "prefilter_and": (search_lines(BOTH), _lines_sql(_AND)),
    "or_ci": (search_lines(ACCENTS), _lines_sql("contains(lower(content), 'ción') OR contains(lower(content), 'über')")),
    "case_sensitive": (search_lines(SearchSpec.of("The", case_sensitive=True)), _lines_sql("contains(content, 'The')")),
    "keyword_slots": (keyword_slots, _lines_sql("contains(lower(content), 'the') AND contains(lower(content), 'th ')")),
    "regex_ci": (regex_lines((REGEX,), True), _lines_sql(f"regexp_matches(content, '{REGEX}', 'i')")),
    "regex_literals": (search_lines(SearchSpec.of("th[ae]n? [a-z]*(ing|ed) ", "(and|und|et) ", regex=True)), _lines_sql("regexp_matches(content, 'th[ae]n? [a-z]*(ing|ed) ', 'i') AND regexp_matches(content, '(and|und|et) ', 'i')")),
    "regex_multi": (regex_lines(REGEX_MANY, True), _lines_sql(" AND ".join(f"regexp_matches(content, '{p}', 'i')" for p in REGEX_MANY))),
    "or_regex": (regex_lines(REGEX_MANY, False), _lines_sql(" OR ".join(f"regexp_matches(content, '{p}', 'i')" for p in REGEX_MANY))),
    "cells": (part_cells, f"WITH {_CELLS} SELECT * FROM cells"),
    "row_and": (
        row_and,
        f"""WITH {_CELLS}, r AS (SELECT p_partkey FROM cells GROUP BY p_partkey HAVING bool_or(contains(lower(content), 'ring')) AND bool_or(contains(lower(content), 'brand#1')))
SELECT p_partkey, column_name, content FROM cells SEMI JOIN r USING (p_partkey) WHERE contains(lower(content), 'ring') OR contains(lower(content), 'brand#1')""",
    ),
    "hyperlinks": (hyperlinks, _LINKS),
    "distinct_numbering": (lambda s, d: hyperlinks(s, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("object_name").alias("last")), f"SELECT page_id, count(*) AS n, max(object_name) AS last FROM ({_LINKS}) GROUP BY page_id"),
    "tsv_clean": (tsv, "SELECT doc_id, regexp_replace(text, '\\r\\n|\\r|\\n|\\t', ' ', 'g') AS line FROM documents"),
    "index_escape": (index_escape, "SELECT doc_id, replace(replace(replace(replace(text, '\\', '\\\\'), chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t') AS line FROM documents"),
    "index_roundtrip": (index_roundtrip, "SELECT doc_id, text FROM documents"),
    "matched_files": (matched_files, f"WITH {_LINES} SELECT doc_id, min(line_number) AS first_line, count(*) AS hits FROM lines WHERE {_AND} GROUP BY doc_id"),
    "location_text": (
        location_text,
        """WITH r AS (SELECT event_id, nullif(CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END, '') AS s, nullif(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'A' || event_id END, '') AS c,
  nullif(CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Shape1' END, '') AS o, (event_id % 100)::VARCHAR AS n FROM events)
SELECT event_id, CASE WHEN s IS NOT NULL AND c IS NOT NULL AND o IS NOT NULL THEN '[' || s || '] ' || c || ' ' || o WHEN s IS NOT NULL AND c IS NOT NULL THEN '[' || s || '] ' || c
  WHEN s IS NOT NULL AND o IS NOT NULL THEN '[' || s || '] ' || o WHEN s IS NOT NULL THEN '[' || s || '] ' || n || ' Row' WHEN o IS NOT NULL THEN '[Object] ' || o ELSE n || ' Row' END AS location FROM r""",
    ),
    "url_extension": (url_extension, r"SELECT page_id, lower(regexp_extract(url, '(\.[^./\\]+)$', 1)) AS ext FROM pages"),
    "ext_include_exclude": (
        ext_include_exclude,
        r"SELECT * FROM (SELECT page_id, url, lower(regexp_extract(url || (['.html', '.php', '.txt'])[(page_id % 3 + 1)::INT], '(\.[^./\\]+)$', 1)) AS ext FROM pages) WHERE ext NOT IN ('.php') AND ext IN ('.com', '.html', '.htm', '.php')",
    ),
    "exclude_folders": (
        exclude_folders,
        "SELECT * FROM (SELECT page_id, (['/data/ex/', '/data/EX/sub/', '/data/ex2/', '/data/'])[(page_id % 4 + 1)::INT] || page_id || '.txt' AS path FROM pages) WHERE NOT starts_with(lower(path), '/data/ex/')",
    ),
    "families": (
        families,
        r"""SELECT page_id, ext, CASE WHEN ext IN ('.xlsx', '.xlsm', '.xls') THEN 'excel' WHEN ext IN ('.docx', '.docm', '.doc') THEN 'word' WHEN ext IN ('.pptx', '.pptm', '.ppt') THEN 'powerpoint' WHEN ext = '.pdf' THEN 'pdf' ELSE 'text' END AS family
FROM (SELECT page_id, lower(regexp_extract('/d/f' || page_id || (['.xlsx', '.XLS', '.docm', '.pptx', '.pdf', '.txt', '.md', ''])[(page_id % 8 + 1)::INT], '(\.[^./\\]+)$', 1)) AS ext FROM pages)""",
    ),
    "formula_cells": (formula_cells, "SELECT * FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '=A' || p_size || '*2' ELSE p_size::VARCHAR END AS content FROM part) WHERE starts_with(content, '=')"),
    "excel_breaks": (excel_breaks, "SELECT doc_id, regexp_replace(text, '\\r\\n|\\r|\\n', ' ', 'g') AS content FROM documents WHERE contains(lower(text), 'the') AND contains(text, '.' || chr(10))"),
    "cache_hits": (_cache_join("left_semi"), _CACHE.format("")),
    "cache_misses": (_cache_join("left_anti"), _CACHE.format("NOT")),
    "conversation_search": (
        conversation_search,
        """SELECT conv_id, turn, role, i::INTEGER AS line_number, parts[i] AS content FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT conv_id, turn, role, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS parts FROM conversations))
WHERE contains(lower(parts[i]), 'the') AND contains(lower(parts[i]), 'an') AND length(trim(parts[i])) > 0""",
    ),
    "props_search": (props_search, "SELECT event_id, props AS content FROM events WHERE contains(props, '1') AND contains(props, '7')"),
    "result_counts": (
        result_counts,
        f"WITH {_LINES} SELECT lang, count(*) FILTER (contains(lower(content), 'the')) AS n_the, count(*) FILTER (contains(lower(content), 'que')) AS n_que, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY lang",
    ),
    "encoding_counts": (encoding_counts, "SELECT lang, sum(strlen(coalesce(text, '')) - length(coalesce(text, '')))::BIGINT AS more_bytes, sum(length(coalesce(text, '')))::BIGINT AS characters FROM documents GROUP BY lang"),
    "header_footer": (header_footer, "SELECT p_partkey, trim(regexp_replace('&L' || p_name || '&C page &P of &N &d', '(?i)&[LCRPNDTFA]', ' ', 'g')) AS content FROM part"),
}
