"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes each result as Parquet to
the shared folder and reads it again as the next stage's docs. The last stage returns the pieces of packed sequences.
A stage's table, and what its operator left in the shared folder, go when the next stage's result is written.

Defined cases: a null text, an empty one and one without a letter end at the first stage. A null doc_id is carried through like any
other; rows without one are told apart by their texts. Rows that agree in doc_id and text are one document for the line and the
near-duplicate stages (one of them stays). Ties fall to the smallest doc_id, then to the smallest digest of the text. Very long
texts are worked on whole. Columns beyond those named, whatever their names, pass through as they are until packing; n_chars
follows the text. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import op4_language, op5_lines, op6_decontaminate, op7_packing, op10_simhash
from gleaner.llm.common import leftovers, materialize, remove


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, and those of no likely language, go."""
    return op4_language.identified(docs, op4_language.fit(docs))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with one line left of each group of similar lines."""
    return op5_lines.deduplicated(docs)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id."""
    return op10_simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return op6_decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return op7_packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("simhash_dedup", deduplicate_documents),
    ("decontaminate", decontaminate),
    ("packing", pack),
]

#: Trained, hashed and iterative stages have no SQL; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with leftovers() as made:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = materialize(docs, name)
                last = made.pop()
                remove(spark, made)
                made.append(last)
    return docs
