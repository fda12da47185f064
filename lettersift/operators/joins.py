"""Broadcasting behind a bound that the caller vouches for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of headers, keys or rules: some ten megabytes at most.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Mark a table for broadcasting if it has at most ``rows`` rows by construction and those are few.

    Nothing is counted: without a bound the join is left to Spark, which broadcasts by size in bytes.
    """
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df
