"""A linear text classifier trained by mini-batch gradient steps, that keeps its best epoch.

Every step is one pass over a mini-batch where it lies: tasks add up their gradients, groups of tasks theirs, and the
driver the few that are left. Weights have a fixed size, whatever the number of rows and words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import label_name
from ..functions.text import or_empty, words
from ..rules import CATEGORIES
from ..schemas import KEY
from ..session import shared_dir
from .dataset import split_bucket, train_val_split, with_label_index
from .evaluate import weighted_metrics
from .scoring import safe_scorer
from .triage import Scorer

FEATURES, BATCHES, EPOCHS, PATIENCE = 1 << 12, 4, 10, 2
RATE, DECAY = 2.0, 1e-4
# Groups that the gradients of the tasks are added up in before they go to the driver.
_GROUPS = 8


@dataclass
class Trained:
    """Weights of the best epoch, ``(classes, features + 1)`` with the bias last, and the F1 after every epoch."""

    weights: np.ndarray
    best: int
    f1: list[float] = field(default_factory=list)


def text_features(df: DataFrame, features: int = FEATURES) -> DataFrame:
    """Add ``_places``: the hashed places of a text's different words. Nothing is counted or collected."""
    hashed = F.transform(words(F.lower(or_empty(F.col("text")))), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    return df.withColumn("_places", F.array_sort(F.array_distinct(hashed)))


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, place and value of each word of a batch; the values of a row have length 1."""
    lists = batch.column(0)
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, lists.flatten().to_numpy(), (1 / np.sqrt(np.maximum(sizes, 1)))[rows]


def _probabilities(weights: np.ndarray, rows: np.ndarray, places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    logits = np.stack([np.bincount(rows, weights=w[places] * values, minlength=n) + w[-1] for w in weights])
    logits = np.exp(logits - logits.max(axis=0))
    return logits / logits.sum(axis=0)


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of the gradients of the logistic loss over rows ``_places, label_index``, and their number."""
    shape = weights.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(shape), 0
        for batch in batches:
            number, places, values = _parts(batch)
            errors = _probabilities(weights, number, places, values, batch.num_rows)
            errors[batch.column(1).to_numpy(), np.arange(batch.num_rows)] -= 1
            for own, error in zip(total, errors, strict=True):
                own[:-1] += np.bincount(places, weights=error[number] * values, minlength=shape[1] - 1)
                own[-1] += error.sum()
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "total"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(t) for t in frame["total"]], axis=0)
        return pd.DataFrame({"n": [int(frame["n"].sum())], "total": [total.tobytes()]})

    partials = rows.select("_places", "label_index").mapInArrow(partial, "n long, total binary")
    grouped = partials.groupBy(F.pmod(F.spark_partition_id(), F.lit(_GROUPS)).alias("_group")).applyInPandas(add, "n long, total binary")
    found = grouped.collect()  # at most as many rows as groups
    total = np.sum([np.zeros(shape), *(np.frombuffer(r.total).reshape(shape) for r in found)], axis=0)
    return total, sum(r.n for r in found)


def scorer(weights: np.ndarray) -> Scorer:
    """Adds ``probabilities`` to rows with a ``text``."""
    def load():
        def score(frame: pd.DataFrame) -> list:
            lists = pa.array(frame["_places"].tolist(), pa.list_(pa.int32()))
            batch = pa.RecordBatch.from_arrays([lists], ["_places"])
            return _probabilities(weights, *_parts(batch), batch.num_rows).T.tolist()

        return score

    return lambda df: safe_scorer(load, ("_places",))(text_features(df, weights.shape[1] - 1)).drop("_places")


def train(rows: DataFrame, val: DataFrame, epochs: int = EPOCHS, batches: int = BATCHES, patience: int = PATIENCE,
          rate: float = RATE, features: int = FEATURES, folder: str | None = None) -> Trained:
    """Train on rows ``(*KEY, text, label)`` and keep the epoch with the best F1 on ``val``.

    An epoch takes a step on each mini-batch; a row's mini-batch follows from its key, so a run can be repeated. It ends
    after ``patience`` epochs in a row without a better F1. Rows with an unknown label are left out. The weights of every
    epoch are written below ``folder``.
    """
    spark = rows.sparkSession
    folder = folder or shared_dir(spark, "epochs")
    labelled = text_features(with_label_index(rows), features).where(F.col("label_index").isNotNull())
    batch = F.pmod(split_bucket(F.concat_ws("/", F.lit("batch"), *KEY)), F.lit(batches)).cast("int")
    labelled.select("_places", "label_index", batch.alias("batch")).write.partitionBy("batch").parquet(f"{folder}/features")
    prepared = spark.read.schema("_places array<int>, label_index int, batch int").parquet(f"{folder}/features")
    weights = np.zeros((len(CATEGORIES), features + 1))
    trained = Trained(weights, -1)
    for epoch in range(epochs):
        for number in range(batches):
            total, n = gradient(prepared.where(F.col("batch") == number), weights)
            if n:
                weights = weights - rate * (total / n + DECAY * weights)
        spark.createDataFrame([(epoch, weights.ravel().tolist())], "epoch int, weights array<double>").write.mode("overwrite").parquet(
            f"{folder}/weights/epoch={epoch}")
        f1 = weighted_metrics(predictions(val, weights)).first()["f1"]
        trained.f1.append(f1)
        if trained.best < 0 or f1 > trained.f1[trained.best]:
            trained.weights, trained.best = weights, epoch
        elif epoch - trained.best >= patience:
            break
    return trained


def predictions(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """Rows with ``actual`` and ``predicted`` labels for the metrics."""
    best = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return scorer(weights)(rows).select(F.col("label").alias("actual"), label_name(best.cast("int")).alias("predicted"))


def select_epoch(rows: DataFrame, **settings) -> Trained:
    """Train on the training split of ``rows`` and choose the epoch on the rest."""
    split = train_val_split(rows)
    return train(split.where(F.col("split") == "train"), split.where(F.col("split") == "val"), **settings)
