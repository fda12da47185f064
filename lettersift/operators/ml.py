"""Training, choosing and applying a text classifier with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import argmax, label_name, model_input
from ..rules import CATEGORIES
from .classify import classify_rules
from .dataset import train_val_split, with_label_index
from .evaluate import weighted_metrics
from .triage import Scorer

FEATURES = 1 << 16
PATIENCE = 2


def features_pipeline(features: int = FEATURES) -> Pipeline:
    """Hashed word counts: fixed size, no vocabulary to collect."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"[\p{L}\p{N}_]+", gaps=False),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features", minDocFreq=1),
    ])


def linear_model(reg_param: float = 0.01, max_iter: int = 20) -> LogisticRegression:
    return LogisticRegression(featuresCol="_features", labelCol="label_index", probabilityCol="_probability",
                              rawPredictionCol="_raw", predictionCol="_prediction",
                              regParam=reg_param, maxIter=max_iter, family="multinomial")


def pipeline(reg_param: float = 0.01, max_iter: int = 20, features: int = FEATURES) -> Pipeline:
    """Hashed word counts and a multinomial linear model."""
    return Pipeline(stages=[*features_pipeline(features).getStages(), linear_model(reg_param, max_iter)])


def _training(train: DataFrame) -> DataFrame:
    """Rows ``text, label_index`` in one partition per core.

    In every iteration each partition sends its gradient, one number per feature and class: more partitions than
    can run at once only send more.
    """
    labelled = with_label_index(train).where(F.col("label_index").isNotNull())
    rows = labelled.select("text", F.col("label_index").cast("double").alias("label_index"))
    return rows.coalesce(train.sparkSession.sparkContext.defaultParallelism)


def train_classifier(train: DataFrame, reg_param: float = 0.01, max_iter: int = 20) -> PipelineModel:
    """Fit on rows ``text, label``; rows with an unknown label are left out. The rows are read some times: store costly ones first."""
    return pipeline(reg_param, max_iter).fit(_training(train))


def model_scores(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``probabilities`` (one per category, in class order) from the ``text`` column."""
    scored = model.transform(df).withColumn("probabilities", vector_to_array("_probability"))
    # A class missing from training has probability 0.
    padded = F.slice(F.concat("probabilities", F.array_repeat(F.lit(0.0), len(CATEGORIES))), 1, len(CATEGORIES))
    return scored.withColumn("probabilities", padded).drop("_tokens", "_counts", "_features", "_raw", "_probability", "_prediction")


def classify_model(df: DataFrame, model: PipelineModel | None = None, scorer: Scorer | None = None,
                   method: str = "model") -> DataFrame:
    """Classify with a model; rows it cannot score fall back to the keyword rules.

    ``scorer`` may be any function that adds ``probabilities`` to rows with a ``text`` column.
    """
    if scorer is None and model is None:
        return classify_rules(df)
    score = scorer or (lambda rows: model_scores(rows, model))
    ruled = classify_rules(df)
    inputs = ruled.withColumn(
        "text", model_input(F.col("subject"), F.col("from_name"), F.col("from_email"), F.col("body_text"))
    )
    scored = score(inputs)
    best = F.array_max("probabilities")
    usable = F.coalesce(best >= 0, F.lit(False)) & ~F.isnan(F.coalesce(best, F.lit(0.0)))
    return scored.withColumns({
        "category": F.when(usable, label_name(argmax(F.col("probabilities")))).otherwise(F.col("category")),
        "confidence": F.when(usable, best).otherwise(F.col("confidence")),
        "method": F.when(usable, F.lit(method)).otherwise(F.col("method")),
        "input_text": F.when(usable, F.col("text")).otherwise(F.col("input_text")),
    }).drop("text")


def predictions(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Rows with ``actual`` and ``predicted`` labels for the metrics."""
    scored = model_scores(df, model)
    return scored.select(F.col("label").alias("actual"), label_name(argmax(F.col("probabilities"))).alias("predicted"))


def select_classifier(rows: DataFrame, reg_params: Sequence[float] = (0.001, 0.01, 0.1)) -> tuple[PipelineModel, DataFrame]:
    """Train candidates on the training split and keep the one with the best F1 on the rest.

    Stops once ``PATIENCE`` candidates in a row are no better. Returns the model and its metrics. The rows are read
    for each candidate: store costly ones first.
    """
    split = train_val_split(rows)
    train, val = _training(split.where(F.col("split") == "train")), split.where(F.col("split") == "val")
    # The features are the same for all candidates.
    features = features_pipeline().fit(train)
    best, best_row, worse = None, None, 0
    for reg_param in reg_params:
        model = PipelineModel([*features.stages, linear_model(reg_param).fit(features.transform(train))])
        row = weighted_metrics(predictions(val, model)).first()
        if best_row is None or row["f1"] > best_row[1]["f1"]:
            best, best_row, worse = model, (reg_param, row), 0
        else:
            worse += 1
            if worse >= PATIENCE:
                break
    metrics = rows.sparkSession.createDataFrame(
        [(best_row[0], *best_row[1])], "reg_param double, accuracy double, precision double, recall double, f1 double"
    )
    return best, metrics
