"""Quality by naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their smoothed counts in the two classes; a linear model is then
fitted to them with squared hinge loss by dual coordinate descent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .samples import LABELLED_PER_CLASS, held_out, labelled_sample

# Every document whose CRC32 leaves this rest is for testing.
MODULUS, REST = 3, 1
THRESHOLD = 0.5
SPACE = 1 << 18  # hashed n-grams
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 20

_letters = re.compile(r"[^\W\d_]+")
_digits = re.compile(r"[0-9]+")
_repeats = re.compile(r"([^\w\s])\1+")


def shape(word: str) -> str:
    """Outline of a word: runs of letters by case, numbers, and its other characters, repeated ones once and marked."""
    outline = _letters.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a", word)
    return _repeats.sub(r"\1+", _digits.sub("0", outline))


class Grams:
    """Hashed n-grams of texts: words, and one to three outlines in a row, where a repeated word has its own."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[str, tuple[int, int]] = {}
        self.limit = limit

    def _look(self, word: str) -> tuple[int, int]:
        from xxhash import xxh3_64_intdigest

        pair = self.known[word] = (xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")),
                                   xxh3_64_intdigest(shape(word).encode("utf-8", "surrogatepass"), 1))
        return pair

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int64)
        if len(self.known) > self.limit:
            self.known.clear()
        known, look = self.known, self._look
        pairs = np.array([known.get(w) or look(w) for w in words], np.uint64)
        own, outline = pairs[:, 0], pairs[:, 1].copy()
        outline[1:][own[1:] == own[:-1]] = np.uint64(7)
        one = outline * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] + outline[1:] * np.uint64(0xBF58476D1CE4E5B9)
        three = two[:-1] + outline[2:] * np.uint64(0x94D049BB133111EB)
        grams = np.concatenate([own, one, two, three])
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((grams >> np.uint64(46)).astype(np.int64))


def descend(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS,
            seed: int = 7) -> np.ndarray:
    """Weights of the scaled indicators, the last one of a constant, by dual coordinate descent.

    Minimises ``|w|^2 / 2 + sum of cost * weight * max(0, 1 - y w.x)^2``; both classes weigh the same.
    """
    n, w = len(rows), np.zeros(len(scale) + 1)
    values = [np.append(scale[r], 1.0) for r in rows]
    places = [np.append(r, len(scale)) for r in rows]
    positive = max(1, int((signs > 0).sum()))
    share = np.where(signs > 0, n / (2 * positive), n / (2 * max(1, n - positive)))
    soft = 1 / (2 * cost * share)
    norm = np.array([v @ v for v in values]) + soft
    alpha, order = np.zeros(n), np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(n):
            gradient = signs[i] * (w[places[i]] @ values[i]) - 1 + soft[i] * alpha[i]
            if alpha[i] == 0 and gradient >= 0:
                continue
            updated = max(alpha[i] - gradient / norm[i], 0.0)
            w[places[i]] += (updated - alpha[i]) * signs[i] * values[i]
            alpha[i] = updated
            largest = max(largest, abs(gradient))
        if largest < 1e-3:
            break
    return w


def fit(rows: list[np.ndarray], labels: np.ndarray, space: int = SPACE) -> np.ndarray:
    """Weights of plain indicators and, last, of the constant."""
    count = [np.full(space, SMOOTHING), np.full(space, SMOOTHING)]
    for row, y in zip(rows, labels, strict=True):
        count[y][row] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[(count[0] + count[1]) < 2 * SMOOTHING + 2] = 0.0  # seen once: nothing to learn
    w = descend(rows, np.where(labels == 1, 1.0, -1.0), ratio)
    return np.append(w[:-1] * ratio, w[-1])


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED_PER_CLASS) -> DataFrame:
    """Score every document: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher: good) and ``predicted``.

    The model is fitted on at most ``per_class`` labelled rows of each class that are not held out, in one task; ids,
    languages, sources and labels are no inputs of a score. Scores are the logistic function of the margin.

    One row per input row. Missing and empty texts get the score of a text without n-grams. If a class has no labels,
    all scores are those of the other one. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample, counts = labelled_sample(docs, labels, "quality", MODULUS, REST, per_class)

    def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [grams(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column(1)], ["grams", "y"])

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat([pd.DataFrame({"grams": [], "y": []}), *parts])
        w = fit([np.asarray(g, np.int64) for g in part["grams"]], part["y"].to_numpy(np.int64))
        used = np.flatnonzero(w)
        yield pd.DataFrame({"i": used, "w": w[used]})

    weights = np.zeros(SPACE + 1)
    if counts.get(0) and counts.get(1):
        rows = saved(sample.select("text", "y").mapInArrow(gram_rows, "grams array<long>, y int"), "grams")
        learned = rows.coalesce(1).mapInPandas(learn, "i long, w double").toPandas()  # at most SPACE + 1 rows
        weights[learned["i"].to_numpy()] = learned["w"].to_numpy()
    elif counts:
        weights[-1] = 3.0 if counts.get(1) else -3.0
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, w = Grams(), shared.value
        for batch in batches:
            margin = np.array([w[grams(t.as_py())].sum() + w[-1] for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], ["doc_id", "score"])

    scored = docs.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
