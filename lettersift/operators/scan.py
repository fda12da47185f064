"""Folder scans, newest-first limits and late reading of bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import INBOX
from ..schemas import HEADER_COLUMNS, KEY
from .filters import select_messages
from .joins import bounded


def newest(df: DataFrame, by: Sequence[str], n: int, order: str = "uid") -> DataFrame:
    """The ``n`` rows of each group with the highest ``order`` value.

    Spark cuts each group in every task before the shuffle, for limits up to its
    ``windowGroupLimitThreshold``, which ``session`` sets high enough for all limits used here.
    """
    ranked = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n).drop("_rank")


def scan_folder(df: DataFrame, folder: str = INBOX, limit: int | None = 100, unread_only: bool = False,
                days: int | Column | None = None, as_of: Column | None = None,
                start: str | None = None, end: str | None = None) -> DataFrame:
    """Messages of one folder that meet the criteria: the newest ``limit`` by uid, in uid order."""
    found = select_messages(df.where(F.col("source_folder") == folder), unread_only, days, as_of, start, end)
    if limit is None:
        return found
    return found.orderBy(F.desc("uid")).limit(limit).orderBy("uid")


def headers(df: DataFrame) -> DataFrame:
    """Header columns only: the reader skips the bodies."""
    return df.select(*[c for c in HEADER_COLUMNS if c in df.columns])


def scan_headers(df: DataFrame, folder: str = INBOX, **criteria) -> DataFrame:
    return scan_folder(headers(df), folder, **criteria)


def fetch_bodies(survivors: DataFrame, bodies: DataFrame, key: Sequence[str] = KEY, most: int | None = None) -> DataFrame:
    """Join the bodies to headers that survived filtering.

    ``most`` says how many survivors there can be; few are broadcast, so that the bodies are not shuffled.
    """
    wide = [c for c in bodies.columns if c in key or c not in survivors.columns]
    return bounded(survivors, most).join(bodies.select(*wide), list(key))


def list_folders(df: DataFrame) -> DataFrame:
    return df.select("source_folder").distinct()


def first_nonempty(df: DataFrame, names: Sequence[str], by: Sequence[str] = ("mailbox",)) -> DataFrame:
    """Rows of the first folder of ``names`` that has any, per mailbox.

    The folders a mailbox has are found by a grouping whose rows are few; they are joined back on the mailbox and
    folder, so that rows meet only one row each.
    """
    order = F.array(*[F.lit(n) for n in names])
    present = df.where(F.col("source_folder").isin(list(names))).groupBy(*by, "source_folder").agg(F.lit(1).alias("_any"))
    first = present.groupBy(*by).agg(F.min_by("source_folder", F.array_position(order, F.col("source_folder"))).alias("source_folder"))
    return df.join(first, [*by, "source_folder"], "left_semi")
