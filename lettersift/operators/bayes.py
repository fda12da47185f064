"""Multinomial naive Bayes on words: counts and smoothed logarithms, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KEY

_DIGITS = 6


@dataclass(frozen=True)
class BayesModel:
    """``priors (label, prior, words)`` and ``counts (word, label, n)``; ``words`` is a label's total."""

    priors: DataFrame
    counts: DataFrame
    vocabulary: DataFrame


def _words(df: DataFrame) -> DataFrame:
    """Word counts per row: ``(KEY..., label, word, k)``."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return df.select(*KEY, "label", F.explode(tokens).alias("word")).groupBy(*KEY, "label", "word").agg(F.count("*").alias("k"))


def fit(train: DataFrame) -> BayesModel:
    """Fit on rows ``KEY, text, label``. Every step is an aggregation with partial sums before its shuffle."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    counts = train.select("label", F.explode(tokens).alias("word")).groupBy("word", "label").agg(F.count("*").alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("words"))
    rows = train.groupBy("label").agg(F.count("*").alias("rows"))
    everything = rows.agg(F.sum("rows").alias("all"))
    priors = rows.join(totals, "label").join(F.broadcast(everything)).select(
        "label", F.log(F.col("rows") / F.col("all")).alias("prior"), "words")
    return BayesModel(priors, counts, counts.agg(F.countDistinct("word").alias("v")))


def predict(df: DataFrame, model: BayesModel) -> DataFrame:
    """Add ``predicted`` to rows ``KEY, text, label``; of equal scores the label first in the alphabet wins.

    A word's counts for all labels come as one row, so a word of a text meets one row whatever the labels.
    Words unknown from training are ignored; a text without known words gets the likeliest label.
    """
    known = model.counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by_label"))
    # As many rows as labels.
    labels = F.broadcast(model.priors.join(F.broadcast(model.vocabulary)).agg(F.collect_list(F.struct("label", "prior", "words", "v")).alias("labels")))
    met = _words(df).join(known, "word").join(labels)
    parts = met.select(*KEY, "k", "by_label", F.inline("labels"))
    logs = F.col("k") * F.log((F.coalesce(F.element_at("by_label", F.col("label")), F.lit(0)) + 1) / (F.col("words") + F.col("v")))
    sums = parts.groupBy(*KEY, F.col("label").alias("_label")).agg(F.sum(logs).alias("_sum"))
    # Keys only: texts are not copied for every label.
    each = df.select(*KEY, "label").join(labels).select(*KEY, "label", F.explode("labels").alias("_of")).withColumn("_label", F.col("_of.label"))
    scored = each.join(sums, [*KEY, "_label"], "left")
    score = F.round(F.col("_of.prior") + F.coalesce("_sum", F.lit(0.0)), _DIGITS)
    best = F.min_by("_label", F.struct(-score, F.col("_label"))).alias("predicted")
    return scored.groupBy(*KEY, "label").agg(best)
