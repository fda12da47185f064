"""Live triage: classify, match topics and senders, decide and plan, and the run records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import body_fallback
from ..rules import CATEGORIES, Settings
from .classify import classify_rules
from .decide import decide, plan_actions
from .senders import sender_status, sender_status_joined
from .topics import match_topics

Scorer = Callable[[DataFrame], DataFrame]


def with_fallback_body(df: DataFrame) -> DataFrame:
    return df.withColumn("body_text", body_fallback(F.col("body_text"), F.col("body_html"))).drop("body_html")


def with_sender_status(df: DataFrame, settings: Settings, sender_rules: DataFrame | None = None) -> DataFrame:
    """Sender status by the lists of the settings, or by a table ``(list, pattern)`` of any size instead."""
    if sender_rules is not None:
        return sender_status_joined(df, sender_rules)
    return sender_status(df, settings.allow, settings.deny)


def triage(df: DataFrame, settings: Settings, classify: Scorer = classify_rules, sender_rules: DataFrame | None = None) -> DataFrame:
    """All judgements on each message. Works row by row; only a table of sender rules needs shuffling."""
    judged = classify(with_fallback_body(df))
    judged = match_topics(judged, settings.topics)
    judged = with_sender_status(judged, settings, sender_rules)
    return plan_actions(decide(judged, settings), settings)


def category_counts() -> list[Column]:
    return [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]


def run_stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Messages in total and per category. Messages that failed have no category but are in the total.

    Without ``by`` there is one row even for an empty run.
    """
    columns = [F.count("*").alias("total_emails"), *category_counts()]
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def run_record(df: DataFrame, started: Column, ended: Column) -> DataFrame:
    """One row for the run log."""
    seconds = F.round((F.unix_micros(ended) - F.unix_micros(started)) / F.lit(1e6), 2)
    return run_stats(df).select(
        started.alias("timestamp"), seconds.alias("duration_seconds"), "total_emails", *CATEGORIES
    )


def run_stats_windowed(df: DataFrame, time: str, minutes: int = 15) -> DataFrame:
    """Run statistics per schedule interval of an event time."""
    window = F.window(F.col(time), f"{minutes} minutes").alias("_window")
    counted = df.groupBy(window).agg(F.count("*").alias("total_emails"), *category_counts())
    return counted.select(F.col("_window.start").alias("timestamp"), "total_emails", *CATEGORIES)
