"""The queries of this subpackage: one thin function for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprints, langid, licenses, line_dedup, ngram_join, sharding, suffix_dedup, token_counts
from .common import ship, table


def _over(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(table(spark, sf_dir, name))

    return query


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": _over("documents", line_dedup.digests),
        "op2_decontaminate": decontamination,
        "op3_bpe": _over("documents", bpe.digests),
        "op4_fingerprints": _over("documents", fingerprints.digests),
        "op5_license_scan": _over("documents", licenses.report),
        "op6_suffix_dedup": _over("documents", suffix_dedup.digests),
        "op7_language_id": _over("documents", langid.predictions),
        "op8_sharding": _over("documents", sharding.digests),
        "op9_token_counts": _over("documents", token_counts.report),
        "op10_ngram_jaccard_join": _over("documents", ngram_join.digests),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op10_ngram_jaccard_join": ngram_join.SQL}
