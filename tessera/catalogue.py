"""Names of all queries, their callables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import chain_queries, format_queries, retrieval_queries, store_queries, text_queries, writer_queries  # noqa: F401 - they register their queries
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rrf_fusion"](spark, sf_dir)
