import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and repeated rows, and columns whose names clash with those used inside."""
    from pyspark.sql import functions as F

    long = "word " * 3000
    rows = [(1, "The one text of some words that is here, and nothing else at all. " * 3), (1, "The one text of some words that is here, and nothing else at all. " * 3), (2, None), (3, ""), (None, "no id here at all"), (None, None), (4, " \n\t\n "), (5, long), (6, long), (7, "Ünïcödé 日本 ñ"), (8, "12 ... 34"), (9, "a\nb\na\n\nb")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("unit", "score", "failed", "count", "spans", "removed", "ranges", "fp", "root", "d", "key", "band", "__row", "__removed", "__id", "row_key", "place", "id", "bucket", "Removed", "a.b"):
        df = df.withColumn(c, F.lit("x"))
    return df.withColumns({"tags": F.create_map(F.lit("k"), F.col("lang")), "list": F.array("lang", "source"), "pair": F.struct("lang", F.array(F.lit(1)).alias("row"))})


@pytest.fixture
def tables(tmp_path):
    """Writes tables of given rows and returns their folder."""

    def write(**dfs):
        for name, df in dfs.items():
            df.write.mode("overwrite").parquet(os.path.join(str(tmp_path), f"{name}.parquet"))
        return str(tmp_path)

    return write
