"""Keeping costly columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns as the output of a generator.

    The optimiser moves filters below projections by copying the expressions of the columns they use.
    For columns built from many rule terms over several steps such copies multiply. Filters on
    generated columns stay where they are.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))
