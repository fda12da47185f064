"""Message filters. Conditions compare plain columns so that the reader can push them down."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import whole_days
from ..functions.text import or_empty, strip
from ..rules import MAX_DAYS_LATE, SEEN, SKIPPED_FOLDER_PARTS


def midnight(day: str) -> Column:
    return F.lit(dt.datetime.strptime(day, "%Y-%m-%d").date()).cast("timestamp")


def unread(df: DataFrame) -> DataFrame:
    """Messages without the seen flag; one without any flags is unread."""
    return df.where(~F.coalesce(F.array_contains("flags", SEEN), F.lit(False)))


def arrival(df: DataFrame) -> Column:
    """When a message came in: by the server if it says so, else by the date header."""
    return F.coalesce("arrived_at", "received_at") if "arrived_at" in df.columns else F.col("received_at")


def arrived(df: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Messages that arrived from ``start`` and before ``end``. Those of unknown arrival are kept.

    The condition of :func:`arrival` is spelled out on plain columns, which the reader can use.
    """
    def inside(at: Column) -> Column:
        bounds = [at >= start] * (start is not None) + [at < end] * (end is not None)
        return bounds[0] & bounds[-1]

    received = F.col("received_at")
    kept = inside(received) | received.isNull()
    if "arrived_at" in df.columns:
        server = F.col("arrived_at")
        kept = inside(server) | (server.isNull() & kept)
    return df.where(kept)


def date_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Whole days from ``start`` up to but not including ``end``. Both must be given to have an effect."""
    if not (start and end):
        return df
    return arrived(df, midnight(start), midnight(end))


def since_days(df: DataFrame, days: int | Column | None, as_of: Column) -> DataFrame:
    """Messages of the last ``days`` calendar days; 0 or None keeps all."""
    if days is None or (isinstance(days, int) and days == 0):
        return df
    first_day = F.date_sub(F.to_date(as_of), days if isinstance(days, Column) else F.lit(days))
    return arrived(df, first_day.cast("timestamp"))


def select_messages(df: DataFrame, unread_only: bool = False, days: int | Column | None = None,
                    as_of: Column | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Search criteria together; a complete date range wins over the look-back. Without criteria all match."""
    if unread_only:
        df = unread(df)
    if start and end:
        return date_range(df, start, end)
    return since_days(df, days, as_of)


def kept_folders(df: DataFrame, column: str = "source_folder") -> DataFrame:
    """Leave out folders whose name contains one of the skipped parts, as spelled."""
    for part in SKIPPED_FOLDER_PARTS:
        df = df.where(~F.contains(or_empty(F.col(column)), F.lit(part)))
    return df


def is_late(received_at: Column, watermark: Column) -> Column:
    """More than two whole days before the watermark; never without a date or a watermark."""
    return F.coalesce(whole_days(watermark, received_at) > MAX_DAYS_LATE, F.lit(False))


def drop_late(df: DataFrame, watermark: DataFrame) -> DataFrame:
    """Leave out messages far behind the watermark of their mailbox; undated ones are kept."""
    marks = watermark.select("mailbox", F.col("received_at").alias("_mark"))
    return df.join(marks, "mailbox", "left").where(~is_late(F.col("received_at"), F.col("_mark"))).drop("_mark")


def in_categories(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    return df.where(F.col("category").isin(list(categories)))


def empty_fields(df: DataFrame) -> DataFrame:
    """Data-quality flags ``empty_sender`` and ``empty_body``."""
    return df.withColumns({
        "empty_sender": strip(or_empty(F.col("from_email"))) == "",
        "empty_body": strip(or_empty(F.col("body_text"))) == "",
    })


def quality_counts(df: DataFrame) -> DataFrame:
    """Messages, empty senders and bodies, and parse failures in one pass."""
    return empty_fields(df).agg(
        F.count("*").alias("total"),
        F.count_if("empty_sender").alias("empty_senders"),
        F.count_if("empty_body").alias("empty_bodies"),
        F.count_if(F.col("parse_error").isNotNull()).alias("parse_failures"),
    )
