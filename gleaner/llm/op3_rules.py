"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once for each document: the ledger holds the measurements and one long whose bit b is set where
rule b fails. A policy is a version, a set of rules and the number of failures it tolerates; applying one, or
asking how many documents each rule alone decides, needs only the ledger and bitwise operators, not the texts.

Words are runs of bytes other than the six ASCII white-space characters. A null text has no words and no lines.
All measurements are taken within the row, by array functions: no explode and no shuffle, so that no key can be hot.
A text of n words costs O(n log n). Repeated rows give repeated ledger rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

SPACE = " \t\n\x0b\f\r"
WINDOW = 5
#: Fixed order of the bits; new rules are appended, and a bit is never given to another rule.
RULES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "shouting", "tables", "upper_case")


@dataclass(frozen=True)
class Policy:
    """The rules that a version applies, and how many of them a kept document may fail."""

    version: str
    rules: tuple[str, ...]
    tolerated: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_words", "symbols", "duplicate_lines")),
    "v2": Policy("v2", ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "shouting", "tables", "upper_case")),
}
CURRENT = "v2"


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text has twice or more, the first one included.

    A 64-bit hash of the words comes first. Where all hashes of a text differ (the usual case) nothing else is done;
    else (hash, words, position) are sorted, neighbours of equal words give the positions of repeated windows, and the
    words they cover are counted from the gaps between successive positions.
    """
    hashes = F.when(
        F.size(words) > WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.slice(words, i + 1, WINDOW).alias("w"), i.alias("p"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["w"].eqNullSafe(x["w"])) | (F.get(s, j + 1)["w"].eqNullSafe(x["w"])))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def count(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return bind(bind(ordered, positions), count)

    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measurements(text: Column) -> Column:
    """Struct of all measurements of a text."""

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)

        def rest(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                without(t, SPACE).cast("long").alias("word_chars"),
                (F.length(t) - without(t, "#*$%&|<>")).cast("long").alias("n_symbols"),
                bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                bind(lines, F.size).cast("long").alias("n_lines"),
                repeated_words(w).alias("n_repeat_words"),
                (F.length(t) - without(t, "!?")).cast("long").alias("n_exclaims"),
                (F.length(t) - without(t, "|")).cast("long").alias("n_bars"),
                (F.length(t) - without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
            )

        return bind(words, rest)

    return bind(F.coalesce(text, F.lit("")), of)


def failures(m: Column) -> Column:
    """The bits of the rules that the measurements fail, in the order of RULES."""
    n, chars = m["n_words"], m["word_chars"]
    failed = {
        "few_words": n < 10,
        "repeated_words": 100 * m["n_repeat_words"] > 20 * n,
        "symbols": 100 * m["n_symbols"] > 8 * chars,
        "duplicate_lines": 100 * m["n_dup_lines"] > 30 * m["n_lines"],
        "short_words": chars < 2 * n,
        "long_words": chars > 25 * n,
        "shouting": 100 * m["n_exclaims"] > 10 * n,
        "tables": 100 * m["n_bars"] > 20 * n,
        "upper_case": 100 * m["n_upper"] > 40 * chars,
    }
    bits = F.lit(0).cast("long")
    for b, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed[rule], F.lit(1 << b)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(documents: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): one row for each document, no texts."""
    rows = documents.select("doc_id", measurements(F.col("text")).alias("m"))
    return rows.select("doc_id", "m.*", failures(F.col("m")).alias("failed"))


def verdict(failed: Column, policy: Policy) -> Column:
    """Whether the policy keeps a document with these bits."""
    return F.bit_count(failed.bitwiseAND(F.lit(policy.mask).cast("long"))) <= policy.tolerated


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, those that it alone drops, and those kept without it.

    One pass over the ledger; counts by failure mask come first (as many rows as masks occur), so no group is large.
    """
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    each = masks.select("mask", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules])).alias("r"))
    hit = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    left = F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not(F.col("r.bit")))) <= policy.tolerated
    return each.groupBy("r.rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(left & (F.bit_count("mask") > policy.tolerated), F.col("n")).otherwise(0)).alias("decided_alone"),
        F.sum(F.when(left, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def ablation_report(rows: DataFrame, policy: Policy) -> str:
    """The ablations in the order of the rules, as rule:failing:decided_alone:kept_without, joined by commas. A row for each rule comes to the driver."""
    found = {r["rule"]: r for r in ablations(rows, policy).collect()}
    none = {"failing": 0, "decided_alone": 0, "kept_without": 0}
    return ",".join(":".join([rule, *(str(found.get(rule, none)[c]) for c in none)]) for rule in RULES if rule in policy.rules)


def sole_rule(failed: Column, policy: Policy) -> Column:
    """The rule that alone drops a document under the policy: the name of the one bit beyond what is tolerated, else null."""
    bits = failed.bitwiseAND(F.lit(policy.mask).cast("long"))
    names = [F.when(bits == (1 << RULES.index(r)), F.lit(r)) for r in policy.rules]
    return F.when(F.bit_count(bits) == policy.tolerated + 1, F.coalesce(*names)) if policy.tolerated == 0 else F.lit(None).cast("string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is written once; all policies, the rule that alone decides, and the ablations of each version are read off its bits."""
    rows = materialize(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "rules-ledger")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        F.col("doc_id").cast("long"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & verdict(F.col("failed"), POLICIES[CURRENT])).alias("kept"), F.col("failed").alias("failed_rules"),
        *[verdict(F.col("failed"), p).alias(f"kept_{v}") for v, p in POLICIES.items()], sole_rule(F.col("failed"), POLICIES[CURRENT]).alias("sole_rule"),
        *[F.lit(ablation_report(rows, p)).alias(f"ablation_{v}") for v, p in POLICIES.items()],
    )


#: The same rows by DuckDB. POLICIES[CURRENT] in full, on the same measurements.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) > 0) AS lines FROM d),
x AS (SELECT rid, i, words[i:i+4] AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 4)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM x) WHERE n > 1),
c AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_rep FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
  length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_ex, length(t) - length(regexp_replace(t, '[|]', '', 'g')) AS n_bars,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_up FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 8 * word_chars)::BIGINT
  + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 25 * n_words)::BIGINT
  + 64 * (100 * n_ex > 10 * n_words)::BIGINT + 128 * (100 * n_bars > 20 * n_words)::BIGINT + 256 * (100 * n_up > 40 * word_chars)::BIGINT AS failed_rules FROM m),
q(b, rule) AS (VALUES (1, 'few_words'), (2, 'repeated_words'), (4, 'symbols'), (8, 'duplicate_lines'), (16, 'short_words'), (32, 'long_words'), (64, 'shouting'), (128, 'tables'), (256, 'upper_case')),
a AS (SELECT p, string_agg(concat_ws(':', rule, failing, alone, kept), ',' ORDER BY b) AS told FROM
  (SELECT p, b, rule, count(*) FILTER (failed_rules & b <> 0) AS failing, count(*) FILTER (failed_rules & p = b) AS alone, count(*) FILTER (failed_rules & p & ~b = 0) AS kept
   FROM (VALUES (15), (495)) v(p) JOIN q ON p & b <> 0 LEFT JOIN f ON true GROUP BY p, b, rule) GROUP BY p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (failed_rules & 495) = 0 AS kept, failed_rules, (failed_rules & 15) = 0 AS kept_v1, (failed_rules & 495) = 0 AS kept_v2,
  CASE failed_rules & 495 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 32 THEN 'long_words'
    WHEN 64 THEN 'shouting' WHEN 128 THEN 'tables' WHEN 256 THEN 'upper_case' END AS sole_rule,
  (SELECT told FROM a WHERE p = 15) AS ablation_v1, (SELECT told FROM a WHERE p = 495) AS ablation_v2 FROM f
"""
