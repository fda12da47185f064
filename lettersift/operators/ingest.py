"""Taking in new messages: criteria, limit, repeats, late ones, then bodies."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import message_hash, whole_days
from ..functions.text import or_empty
from ..rules import INBOX
from .filters import arrival, drop_late, is_late, unread
from .scan import fetch_bodies, headers, newest


# Key of messages without an id.
NO_ID = hashlib.md5(b"").hexdigest()


def remembered(recent: DataFrame, marks: DataFrame) -> DataFrame:
    """Keys that count as processed: the recent ones and the newest message of a mailbox."""
    return recent.select("mailbox", "hash").union(marks.select("mailbox", "hash")).distinct()


def new_messages(df: DataFrame, recent: DataFrame, marks: DataFrame, null_id: str = "drop") -> DataFrame:
    """Messages that were not processed before.

    Messages without an id share one key, so one remembered hides all of them; ``null_id="keep"``
    lets them pass instead.
    """
    done = remembered(recent, marks)
    if null_id == "keep":
        done = done.where(F.col("hash") != NO_ID)
    return df.join(done, ["mailbox", "hash"], "left_anti")


def first_of_each(df: DataFrame, null_id: str = "drop") -> DataFrame:
    """The message with the lowest uid of each key; with ``null_id="keep"`` all messages without an id."""
    rank = F.row_number().over(Window.partitionBy("mailbox", "hash").orderBy("uid"))
    first = F.col("_rank") == 1
    if null_id == "keep":
        first = first | (F.col("hash") == NO_ID)
    return df.withColumn("_rank", rank).where(first).drop("_rank")


def look_back(watermark_at: Column, as_of: Column, default: int = 7) -> Column:
    """Days to search back: to the watermark and one more, else the default."""
    return F.coalesce(whole_days(as_of, watermark_at) + 1, F.lit(default))


def candidates(header_rows: DataFrame, marks: DataFrame, as_of: Column, limit: int = 100, unread_only: bool = True,
               days: int = 7, folder: str = INBOX) -> DataFrame:
    """Header rows the search returns, the newest ``limit`` of each mailbox, with their key."""
    found = headers(header_rows).where(F.col("source_folder") == folder)
    if unread_only:
        found = unread(found)
    starts = marks.select("mailbox", look_back(F.col("received_at"), as_of, days).alias("_days"))
    found = found.join(starts, "mailbox", "left")
    # A look-back of 0 days (a watermark in the future) means no limit.
    span = F.coalesce("_days", F.lit(days))
    came = arrival(found)
    recent = came.isNull() | (came >= F.date_sub(F.to_date(as_of), span).cast("timestamp"))
    found = found.where((span == 0) | recent).drop("_days")
    return newest(found, ["mailbox"], limit).withColumn("hash", message_hash(F.col("message_id")))


def ingest_new(header_rows: DataFrame, bodies: DataFrame, recent: DataFrame, marks: DataFrame, as_of: Column,
               limit: int = 100, unread_only: bool = True, days: int = 7, folder: str = INBOX,
               null_id: str = "drop", dedup_within_batch: bool = False, mailboxes: int | None = None) -> DataFrame:
    """New messages of each mailbox with bodies. Bodies are only joined for messages that are left.

    ``mailboxes`` tells how many there are at most, which bounds the messages that are left.
    """
    found = candidates(header_rows, marks, as_of, limit, unread_only, days, folder)
    fresh = drop_late(new_messages(found, recent, marks, null_id), marks)
    if dedup_within_batch:
        fresh = first_of_each(fresh, null_id)
    return fetch_bodies(fresh, bodies, most=mailboxes and mailboxes * limit)


def ingest_counters(header_rows: DataFrame, recent: DataFrame, marks: DataFrame, as_of: Column, **criteria) -> DataFrame:
    """Per mailbox: found, already processed, late and new messages, in one pass over the headers."""
    found = candidates(header_rows, marks, as_of, **criteria)
    done = remembered(recent, marks).withColumn("_done", F.lit(True))
    dates = marks.select("mailbox", F.col("received_at").alias("_mark"))
    flagged = found.join(done, ["mailbox", "hash"], "left").join(dates, "mailbox", "left").withColumns({
        "_done": F.coalesce("_done", F.lit(False)),
        "_late": is_late(F.col("received_at"), F.col("_mark")),
    })
    return flagged.groupBy("mailbox").agg(
        F.count("*").alias("fetched"),
        F.count_if("_done").alias("already_processed"),
        F.count_if(~F.col("_done") & F.col("_late")).alias("late"),
        F.count_if(~F.col("_done") & ~F.col("_late")).alias("new"),
    )


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("hash", message_hash(or_empty(F.col("message_id"))))
