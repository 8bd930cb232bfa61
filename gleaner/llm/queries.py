"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_quality, op2_warc, op3_rules, op4_language, op5_lines, op6_decontaminate, op7_packing, op8_repeats, op9_secrets, op10_simhash, op11_embeddings, op12_centroids, op13_divergence


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality.query,
        "op3_rules": op3_rules.query,
        "op9_secrets": op9_secrets.query,
        "op4_language": op4_language.query,
        "op2_warc": op2_warc.query,
        "op10_simhash": op10_simhash.query,
        "op6_decontaminate": op6_decontaminate.query,
        "op7_packing": op7_packing.query,
        "op5_lines": op5_lines.query,
        "op8_repeats": op8_repeats.query,
        "op11_embeddings": op11_embeddings.query,
        "op12_centroids": op12_centroids.query,
        "op13_divergence": op13_divergence.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_rules": op3_rules.ORACLE_SQL,
        "op2_warc": op2_warc.ORACLE_SQL,
        "op6_decontaminate": op6_decontaminate.ORACLE_SQL,
        "op12_centroids": op12_centroids.ORACLE_SQL,
        "op13_divergence": op13_divergence.ORACLE_SQL,
    }
