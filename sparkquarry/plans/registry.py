"""All queries of the library outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkquarry.plans import corpus, rows, search, stored

FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return corpus.QUERIES | search.QUERIES | rows.QUERIES | stored.QUERIES


def oracle_sql() -> dict[str, str]:
    return corpus.ORACLE | search.ORACLE | rows.ORACLE | stored.ORACLE
