"""Tables dealt out by a key in shares of a bounded number of rows, however large the table is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a share, about.
ROWS = 100_000


def shares(rows: DataFrame, size: int | None = None, each: Column | None = None) -> int:
    """How many shares of about ``size`` rows there are, at least one for each core. The rows are counted, which costs nothing for a Parquet table.

    ``each``: how many rows each row is to become, if they are counted as these.
    """
    count = rows.count() if each is None else rows.agg(F.sum(each)).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // (size or ROWS)))


def shared_out(rows: DataFrame, *by: Column | str, size: int | None = None, each: Column | None = None) -> DataFrame:
    """``rows`` dealt out by ``by`` in shares of about ``size`` rows, at least one for each core.

    Groups and windows over these columns and more stay within a share, and joins over exactly these, if both sides have as
    many shares; so what a task sorts and holds follows from ``size``. Joins over more columns are dealt out anew.
    The adaptive planner merges shuffled parts by their compressed bytes, which narrow rows exceed thirty times in a sort.
    Rows that are cut into many afterwards are moved whole, and dealt out by what they become, if ``each`` tells how many.
    """
    return rows.repartition(shares(rows, size, each), *by)
