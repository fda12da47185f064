"""Relabelling a date range of every folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import HISTORICAL_LABEL, Settings
from .classify import classify_rules
from .filters import date_range, kept_folders
from .scan import fetch_bodies, headers, newest
from .topics import match_topics
from .triage import Scorer, with_fallback_body, with_sender_status


def process_historical(df: DataFrame, start: str, end: str, targets: Sequence[str], settings: Settings,
                       limit: int = 500, classify: Scorer = classify_rules, label: str = HISTORICAL_LABEL,
                       sender_rules: DataFrame | None = None) -> DataFrame:
    """Judge the newest ``limit`` messages of each folder in a date range and label target categories.

    Deciding plays no part. All folders are one job: the messages are chosen on headers alone and only
    then joined with their bodies. A message in several folders is treated in each of them.
    """
    in_range = date_range(kept_folders(headers(df)), start, end)
    chosen = newest(in_range, ["mailbox", "source_folder"], limit)
    judged = classify(with_fallback_body(fetch_bodies(chosen, df)))
    judged = with_sender_status(match_topics(judged, settings.topics), settings, sender_rules)
    targeted = F.col("category").isin(list(targets))
    return judged.withColumn("new_label", F.when(targeted, F.lit(label)))


def historical_counts(judged: DataFrame) -> DataFrame:
    """Messages processed and labelled; a dry run counts the same."""
    return judged.agg(F.count("*").alias("processed"), F.count("new_label").alias("labeled"))
