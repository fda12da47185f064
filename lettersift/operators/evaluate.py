"""Metrics of predictions and the audit of logged ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import parse_model_input
from ..rules import CATEGORIES
from .classify import classify_rules
from .triage import Scorer


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     labels: Sequence = CATEGORIES) -> DataFrame:
    """Counts with one row per actual and one column per predicted label, whether it occurs or not; others are left out.

    All cells are counted in one pass, and only they leave the tasks.
    """
    cell = lambda a, p: F.count_if((F.col(actual) == a) & (F.col(predicted) == p))
    cells = df.agg(*[cell(a, p).alias(f"{i}_{j}") for i, a in enumerate(labels) for j, p in enumerate(labels)])
    rows = [F.struct(F.lit(a).alias(actual), *[F.col(f"{i}_{j}").alias(str(p)) for j, p in enumerate(labels)]) for i, a in enumerate(labels)]
    return cells.select(F.inline(F.array(*rows)))


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def weighted_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; a zero division counts as 0.

    Everything after the first grouping works on one row per pair of labels.
    """
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    # Each pair counts towards its actual label (support) and its predicted label (claimed).
    sides = F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"),
                 F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"),
                 F.lit(0).cast("long").alias("hits")),
    )
    per_label = pairs.select(F.inline(sides)).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits")
    ).withColumns({"precision": _ratio(F.col("hits"), F.col("claimed")), "recall": _ratio(F.col("hits"), F.col("support"))})
    per_label = per_label.withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    total = F.sum("support")
    return per_label.agg(
        _ratio(F.sum("hits"), total).alias("accuracy"),
        *[_ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in ("precision", "recall", "f1")],
    )


def replay(log: DataFrame, classify: Scorer = classify_rules) -> DataFrame:
    """Classify logged input texts again; adds ``replayed_category`` and ``is_match``.

    A log row that cannot be taken apart stays without a category and does not match.
    """
    parts = parse_model_input(F.col("input_string"))
    logged = log.select(
        F.col("input_string"), F.col("category").alias("_logged"), F.col("confidence").alias("_confidence"),
        parts.alias("_parts"),
    ).select("*", "_parts.*")
    again = classify(logged)
    replayed = F.when(F.col("_parts").isNotNull(), F.col("category"))
    return again.select(
        "input_string", F.col("_logged").alias("category"), replayed.alias("replayed_category"),
        F.col("_confidence").alias("logged_confidence"), F.col("confidence").alias("replayed_confidence"),
        F.coalesce(replayed == F.col("_logged"), F.lit(False)).alias("is_match"),
    )


def consistency_audit(log: DataFrame, classify: Scorer = classify_rules) -> DataFrame:
    """Logged predictions, how many come out the same again, and the share."""
    return replay(log, classify).agg(
        F.count("*").alias("total"), F.count_if("is_match").alias("matches"),
        _ratio(F.count_if("is_match"), F.count("*")).alias("match_rate"),
    )
