"""Building a labelled training set from inbox, all mail and trash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import label_index
from ..functions.text import first_chars, or_empty, sanitize
from ..rules import ALL_MAIL_NAMES, CATEGORIES, INBOX, TRASH_NAMES
from ..schemas import KEY
from .classify import classify_rules
from .scan import fetch_bodies, first_nonempty, headers, newest
from .triage import with_fallback_body

TRAIN_SHARE = 0.8
_BUCKETS = 10_000


def exclude_inbox(df: DataFrame, inbox: DataFrame) -> DataFrame:
    """Messages whose id is not in the inbox. An id that is empty counts like any other."""
    return df.join(inbox.select("mailbox", "message_id").distinct(), ["mailbox", "message_id"], "left_anti")


def training_folders(df: DataFrame, n: int = 3000) -> DataFrame:
    """Newest ``n`` header rows of inbox, all mail without the inbox, and trash, as one table.

    All mail is read twice as deep and cut to ``n`` after the inbox messages are taken out. Of several
    spellings of a folder the first that yields messages is used. ``part`` names the origin.
    """
    rows = headers(df)
    by = ["mailbox", "source_folder"]
    inbox = newest(rows.where(F.col("source_folder") == INBOX), by, n)
    all_mail = newest(rows.where(F.col("source_folder").isin(ALL_MAIL_NAMES)), by, 2 * n)
    others = newest(exclude_inbox(all_mail, inbox), by, n)
    trash = newest(rows.where(F.col("source_folder").isin(TRASH_NAMES)), by, n)
    parts = [
        (inbox, "INBOX"), (first_nonempty(others, ALL_MAIL_NAMES), "All Mail"), (first_nonempty(trash, TRASH_NAMES), "Trash"),
    ]
    union = None
    for part, name in parts:
        named = part.select(*rows.columns).withColumn("part", F.lit(name))
        union = named if union is None else union.unionByName(named)
    return union


def label_messages(chosen: DataFrame, bodies: DataFrame) -> DataFrame:
    """Chosen header rows with bodies and rule labels."""
    key = ["mailbox", "source_folder", "uid"]
    return classify_rules(with_fallback_body(fetch_bodies(chosen, bodies, key)))


def training_rows(labelled: DataFrame, sanitised: bool = True) -> DataFrame:
    """Columns of the training set. The body is cut to 2000 characters; the CSV form is sanitised after that."""
    def text(c):
        return sanitize(c) if sanitised else or_empty(c)

    return labelled.select(
        F.col("id"), or_empty(F.col("date")).alias("date"),
        text(F.col("from_email")).alias("sender_email"), text(F.col("from_name")).alias("sender_name"),
        text(F.col("subject")).alias("subject"), text(first_chars(or_empty(F.col("body_text")), 2000)).alias("body_text"),
        F.col("category").alias("label"), F.col("confidence"),
        F.coalesce("source_folder", F.lit("unknown")).alias("source_folder"),
    )


def build_training_set(df: DataFrame, n: int = 3000) -> DataFrame:
    return training_rows(label_messages(training_folders(df, n), df))


def training_summary(labelled: DataFrame) -> DataFrame:
    """One row: messages in total, by origin and by label."""
    parts = {"by_folder_inbox": "INBOX", "by_folder_all_mail": "All Mail", "by_folder_trash": "Trash"}
    return labelled.agg(
        F.count("*").alias("total_emails"),
        *[F.count_if(F.col("part") == part).alias(name) for name, part in parts.items()],
        *[F.count_if(F.col("category") == c).alias(f"by_label_{c}") for c in CATEGORIES],
    )


def label_counts(df: DataFrame) -> DataFrame:
    """Rows per label; rows without a label are left out."""
    return df.where(or_empty(F.col("label")) != "").groupBy("label").agg(F.count("*").alias("n"))


def split_bucket(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % _BUCKETS


def train_val_split(df: DataFrame, key: Sequence[str] = KEY, train_share: float = TRAIN_SHARE) -> DataFrame:
    """Add ``split`` (train or val) from a hash of the key: repeatable, without shuffling or counting."""
    return df.withColumn(
        "split", F.when(split_bucket(F.concat_ws("/", *key)) < int(_BUCKETS * train_share), "train").otherwise("val")
    )


def with_label_index(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("label_index", label_index(F.col(label)))


def calibration_sample(df: DataFrame, n: int = 100, order: str = "uid") -> DataFrame:
    """The first ``n`` rows, for calibrating a model."""
    return df.orderBy(order).limit(n)
