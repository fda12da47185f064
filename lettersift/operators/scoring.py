"""Scorers that may fail: a model loaded once in a worker, and rows it can't score left to the rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .triage import Scorer

# A model scores a frame of columns: one list of class probabilities per row.
Model = Callable[[pd.DataFrame], Sequence[Sequence[float]]]
_loaded: dict[str, Model | None] = {}


def score_rows(model: Model, rows: pd.DataFrame) -> list:
    """Probabilities per row; where the model throws, the batch is halved until only the rows at fault are left without."""
    if not len(rows):
        return []
    try:
        scores = [None if s is None else [float(x) for x in s] for s in model(rows)]
        if len(scores) != len(rows):
            raise ValueError(f"{len(scores)} scores for {len(rows)} rows")
        return scores
    except Exception:
        if len(rows) == 1:
            return [None]
        half = len(rows) // 2
        return score_rows(model, rows.iloc[:half]) + score_rows(model, rows.iloc[half:])


def safe_scorer(load: Callable[[], Model], columns: Sequence[str] = ("text",)) -> Scorer:
    """A scorer for ``classify_model`` from a function that loads a model.

    Workers load it once and keep it over their tasks. A row that makes it throw has no probabilities, so
    ``classify_model`` takes the rules for this row and no other; a model that can't be loaded scores no row.
    """
    name, names = uuid.uuid4().hex, list(columns)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        if name not in _loaded:
            try:
                _loaded[name] = load()
            except Exception:
                _loaded[name] = None
        model = _loaded[name]
        for rows in batches:
            rows.columns = names
            yield pd.Series([None] * len(rows) if model is None else score_rows(model, rows), dtype="object")

    # Kept where it is: the optimiser would copy it into what looks at the probabilities.
    udf = score.asNondeterministic()

    def add(df: DataFrame) -> DataFrame:
        return df.withColumn("probabilities", udf(F.struct(*names)))

    return add
