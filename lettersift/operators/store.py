"""The store of judged messages: log rows, states, statistics, retention and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_chars, or_empty, sanitize


ATTACHMENTS = "array<struct<filename:string,size:bigint,content_type:string,hash:string>>"


def message_records(df: DataFrame, saved_at: Column, state: str = "new") -> DataFrame:
    """Stored form of messages; fields a message lacks take their defaults, and a missing key its id."""
    def given(name, kind, default):
        column = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        return F.coalesce(column, default.cast(kind)).alias(name)

    texts = ["message_id", "subject", "from_raw", "from_email", "from_name", "to_raw", "date", "body_text", "body_html"]
    return df.select(
        "id", given("hash", "string", F.col("id")), *[given(name, "string", F.lit("")) for name in texts],
        given("size", "bigint", F.lit(0)), given("has_attachments", "boolean", F.lit(False)),
        given("attachment_count", "int", F.lit(0)), given("attachments", ATTACHMENTS, F.array()),
        F.lit(state).alias("processing_state"), saved_at.alias("saved_at"),
    )


def classified_log_rows(df: DataFrame, saved_at: Column, state: str = "classified", keep: tuple[str, ...] = ()) -> DataFrame:
    """Log columns of classified messages, after those to ``keep``.

    The body is cut to 5000 characters before it is sanitised.
    """
    return df.select(
        *keep,
        or_empty(F.col("id")).alias("id"), or_empty(F.col("date")).alias("date"),
        sanitize(F.col("from_email")).alias("sender_email"), sanitize(F.col("from_name")).alias("sender_name"),
        sanitize(F.col("subject")).alias("subject"),
        sanitize(first_chars(or_empty(F.col("body_text")), 5000)).alias("body_text"),
        sanitize(F.col("category")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        sanitize(F.col("source_folder")).alias("source_folder"),
        F.lit(state or "unknown").alias("processing_state"), saved_at.alias("saved_at"),
    )


def audit_log_rows(df: DataFrame, logged_at: Column) -> DataFrame:
    """Audit columns of classified messages."""
    return df.select(
        logged_at.alias("timestamp"), F.col("input_text").alias("input_string"), "category", "confidence", "method"
    )


def processing_state(df: DataFrame) -> DataFrame:
    """Add ``processing_state``: new, then classified, then actioned once its plan has been handled."""
    return df.withColumn(
        "processing_state",
        F.when(F.col("planned_action").isNotNull(), "actioned").when(F.col("category").isNotNull(), "classified").otherwise("new"),
    )


def in_state(df: DataFrame, state: str) -> DataFrame:
    return df.where(F.col("processing_state") == state)


def by_state(df: DataFrame) -> DataFrame:
    return df.groupBy("processing_state").agg(F.count("*").alias("n"))


def store_stats(df: DataFrame) -> DataFrame:
    """Messages per state with total size and how many have attachments."""
    return df.groupBy("processing_state").agg(
        F.count("*").alias("total_emails"), F.sum("size").alias("total_size"),
        F.count_if(F.col("attachment_count") > 0).alias("with_attachments"),
    )


def retention(df: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Rows saved within the last ``days``; on a table partitioned by day whole partitions are skipped."""
    kept = df
    if "saved_date" in df.columns:
        kept = kept.where(F.col("saved_date") >= F.date_sub(F.to_date(as_of), days))
    return kept.where(F.col("saved_at") >= as_of - F.make_dt_interval(F.lit(days)))


def lookup(df: DataFrame, hash_value: str) -> DataFrame:
    return df.where(F.col("hash") == hash_value)
