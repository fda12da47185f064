"""Finding messages by sender, subject, date and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_preview, or_empty
from ..schemas import KEY
from .filters import arrived, midnight
from .scan import fetch_bodies, newest


def matching(df: DataFrame, sender: str | None = None, subject: str | None = None, from_date: str | None = None,
             to_date: str | None = None, folder: str | None = None) -> DataFrame:
    """Rows that meet all given criteria. Text criteria ignore case; each date bound works on its own."""
    if folder:
        df = df.where(F.col("source_folder") == folder)
    if from_date or to_date:
        df = arrived(df, midnight(from_date) if from_date else None, midnight(to_date) if to_date else None)
    for column, text in (("from_raw", sender), ("subject", subject)):
        if text:
            df = df.where(F.contains(F.lower(or_empty(F.col(column))), F.lit(text.lower())))
    return df


def search_messages(df: DataFrame, limit: int = 10, with_body: bool = False, **criteria) -> DataFrame:
    """The newest ``limit`` matches of each folder, with a short body preview on request."""
    columns = [*KEY, "subject", "from_raw", "date", "flags"]
    found = newest(matching(df, **criteria).select(*columns), KEY[:2], limit)
    if not with_body:
        return found
    bodies = df.select(*KEY, body_preview(F.col("body_text")).alias("preview"))
    return fetch_bodies(found, bodies)


def search_counts(df: DataFrame, **criteria) -> DataFrame:
    """Matches per folder; folders without any do not appear."""
    return matching(df, **criteria).groupBy("source_folder").agg(F.count("*").alias("matches"))
