"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans import block_queries, edit_queries, more_queries, work_queries  # noqa: F401  they register their queries
from paperloom.plans import queries as bound

flagship = bound.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(bound.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(bound.SQL)
