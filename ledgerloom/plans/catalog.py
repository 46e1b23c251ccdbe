"""Every core query by name, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import analytics, archive, ingest, retrieval  # noqa: F401  (they register their queries)
from ledgerloom.plans.registry import ORACLE, QUERIES  # noqa: F401


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.search_all_words(spark, folder)
