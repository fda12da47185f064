"""The epoch trainer against NumPy, and scorers that fail."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lettersift import rules as R
from lettersift.operators import classify, epochs, ml, scoring
from lettersift.plans import training
from lettersift.rules import CATEGORIES

KEY = "mailbox string, source_folder string, uid long, text string, label string"


def rows_of(spark, n, seed):
    rng = random.Random(seed)
    own = {c: [f"{c[:3]}{i}" for i in range(6)] for c in R.CATEGORIES}
    rows = []
    for i in range(n):
        label = rng.choice(R.CATEGORIES)
        words = rng.choices(own[label], k=rng.randrange(5)) + rng.choices([f"w{j}" for j in range(30)], k=rng.randrange(8))
        rows.append(("m", "f", i, " ".join(words), label if i % 11 else rng.choice([None, "other"])))
    rows.append(("m", "f", n, None, R.CATEGORIES[0]))
    return spark.createDataFrame(rows, KEY).repartition(3)


def dense(features, n):
    x = np.zeros((len(features), n + 1))
    for row, places in zip(x, features, strict=True):
        row[places] = 1 / np.sqrt(max(len(places), 1))
        row[-1] = 1
    return x


def f1_of(actual, predicted):
    total = 0.0
    for c in set(actual):
        hits = sum(a == p == c for a, p in zip(actual, predicted, strict=True))
        precision, recall = hits / max(1, predicted.count(c)), hits / actual.count(c)
        total += actual.count(c) * (2 * precision * recall / (precision + recall) if hits else 0)
    return total / len(actual)


def test_training_equals_numpy(spark):
    n, batches, count = 64, 3, 4
    rows, val = rows_of(spark, 150, 1), rows_of(spark, 60, 2).where(F.col("label").isin(list(R.CATEGORIES)))
    got = epochs.train(rows, val, epochs=count, batches=batches, patience=9, features=n)
    with_batch = epochs.text_features(rows, n).withColumn(
        "batch", F.pmod(epochs.split_bucket(F.concat_ws("/", F.lit("batch"), "mailbox", "source_folder", "uid")), F.lit(batches)))
    table = [r for r in with_batch.collect() if r.label in R.CATEGORIES]
    held = epochs.text_features(val, n).collect()
    weights, f1 = np.zeros((4, n + 1)), []
    states = []
    for _ in range(count):
        for b in range(batches):
            own = [r for r in table if r.batch == b]
            x = dense([r["_places"] for r in own], n)
            logits = x @ weights.T
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), [R.CATEGORIES.index(r.label) for r in own]] -= 1
            weights = weights - epochs.RATE * (p.T @ x / len(own) + epochs.DECAY * weights)
        states.append(weights)
        best = (dense([r["_places"] for r in held], n) @ weights.T).argmax(axis=1)
        f1.append(f1_of([r.label for r in held], [R.CATEGORIES[i] for i in best]))
    assert np.allclose(got.f1, f1, atol=1e-9) and got.best == int(np.argmax(f1))
    assert np.allclose(got.weights, states[got.best], atol=1e-9)
    assert f1[got.best] > 0.6


def test_training_stops_and_keeps_the_best(spark, monkeypatch):
    scores = iter([0.5, 0.7, 0.6, 0.7, 0.9])
    frame = lambda: spark.createDataFrame([(next(scores),)], "f1 double")
    monkeypatch.setattr(epochs, "weighted_metrics", lambda _: frame())
    rows = rows_of(spark, 12, 3)
    got = epochs.train(rows, rows, epochs=5, batches=1, patience=2, features=8)
    assert got.best == 1 and got.f1 == [0.5, 0.7, 0.6, 0.7]


def test_rows_at_fault_are_found():
    calls = []

    def model(frame):
        calls.append(len(frame))
        if (frame["x"] % 10 == 3).any():
            raise RuntimeError("cannot score")
        return [[float(x), 1.0] for x in frame["x"]]

    got = scoring.score_rows(model, pd.DataFrame({"x": range(64)}))
    assert [s is None for s in got] == [x % 10 == 3 for x in range(64)]
    assert all(s == [float(x), 1.0] for x, s in enumerate(got) if s)
    assert scoring.score_rows(lambda f: [[1.0]], pd.DataFrame({"x": [1, 2]})) == [[1.0], [1.0]]
    assert scoring.score_rows(model, pd.DataFrame({"x": []})) == []


def test_failing_scorer_leaves_rules_for_its_rows(spark):
    mails = spark.createDataFrame(
        [(i, f"Sale {i}", "Buy now", "a@b", "N") for i in range(40)], "uid long, subject string, body_text string, from_email string, from_name string")

    def load():
        def model(frame):
            if any("Sale 7 " in t or "Sale 22 " in t for t in frame["text"]):
                raise ValueError("no")
            return [[0.1, 0.7, 0.1, 0.1]] * len(frame)

        return model

    def broken():
        raise OSError("no model")

    ruled = {r.uid: r.category for r in classify.classify_rules(mails).collect()}
    got = {r.uid: (r.category, r.method) for r in ml.classify_model(mails, scorer=scoring.safe_scorer(load)).collect()}
    assert got == {i: (ruled[i], "rules") if i in (7, 22) else (R.CATEGORIES[1], "model") for i in range(40)}
    none = {r.uid: (r.category, r.method) for r in ml.classify_model(mails, scorer=scoring.safe_scorer(broken)).collect()}
    assert none == {i: (c, "rules") for i, c in ruled.items()}


def test_gradients_come_from_one_partition_a_core(spark):
    rows = spark.createDataFrame([(f"w{i % 7} x", CATEGORIES[i % 4]) for i in range(200)], "text string, label string").repartition(64)
    training = ml._training(rows)
    assert training.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and training.count() == 200


@pytest.mark.parametrize("name", ["train_classifier", "evaluate_classifier", "train_linear", "select_linear", "classify_linear"])
def test_training_texts_are_judged_once(spark, sf, monkeypatch, name):
    """The rules judged every message again for each time that a fit read the texts."""
    judged = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(category):
        judged.add(1)
        return category

    def texts(spark, sf):
        rows = spark.range(80).select(F.lit("m").alias("mailbox"), F.lit("INBOX").alias("source_folder"), F.col("id").alias("uid"))
        label = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("uid") % 4).cast("int"))
        return rows.select("*", F.concat(F.lit("w"), F.col("uid") % 4).alias("text"), count.asNondeterministic()(label).alias("label"))

    monkeypatch.setattr(training, "_training_texts", texts)
    assert queries()[name](spark, sf).collect()
    assert judged.value == 80
