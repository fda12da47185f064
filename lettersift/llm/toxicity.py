"""Toxicity by weak supervision.

Voters are terms (words and word beginnings) that the labelled training rows connect with toxicity, a fixed lexicon and
text patterns. A generative model, a mixture of two classes in which voters fire with class-specific rates, is fitted
by expectation maximisation to the vote patterns of all documents; voters that fire together more often than the
classes explain share their weight. A linear classifier is then trained on the model's posterior labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches
from .samples import LABELLED_PER_CLASS, held_out, labelled_sample

# Every document whose CRC32 leaves this rest is for testing.
MODULUS, REST = 4, 2
THRESHOLD = 0.3
# Fixed lexicon: insults that need no training rows.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash clown clowns pathetic worthless disgusting "
    "fool imbecile retard bastard bitch asshole jerk".split())
PATTERNS = (
    re.compile(r"\b(?:you|he|she|they)(?:'re| are|'s| is) (?:an? )?(?:such |so )?[a-z]+!"),
    re.compile(r"[A-Z]{3,}(?:\W+[A-Z]{3,}){5}"),
    re.compile(r"[a-z][*@#]{2,}[a-z]"),
)
BEGINNINGS = (4, 5, 6)
LEVELS = 3
MAX_TERMS = 44  # voters fit a 64-bit pattern with the lexicon and the text patterns
MIN_SUPPORT = 5
ROUNDS = 8
FEATURES = 4096
FIT_DOCUMENTS = 20_000

_words = re.compile(r"[^\W\d_]+").findall


def terms(text: str | None) -> set[str]:
    """Distinct words and word beginnings of a text.

    A beginning carries a star; two or three if that many distinct words have it.
    """
    words = set(_words((text or "").lower()))
    begun = Counter(w[:n] for w in words for n in BEGINNINGS if len(w) > n)
    return words.union(*({b + "*" * k for b, count in begun.items() if count >= k} for k in range(1, LEVELS + 1)))


class TermFinder:
    """Finds which of some terms a text has; remembers words, up to a bound."""

    def __init__(self, wanted: Iterable[str], limit: int = 300_000):
        self.index = {term: i for i, term in enumerate(wanted)}
        self.beginnings = {term.rstrip("*") for term in self.index if term.endswith("*")}
        self.known: dict[str, tuple[int, list[str]]] = {}
        self.limit = limit

    def _look(self, word: str) -> tuple[int, list[str]] | None:
        begun = [word[:n] for n in BEGINNINGS if len(word) > n and word[:n] in self.beginnings]
        place = self.index.get(word, -1)
        return (place, begun) if begun or place >= 0 else None

    def __call__(self, text: str | None) -> set[int]:
        return self.among(set(_words((text or "").lower())))

    def among(self, words: set[str]) -> set[int]:
        known, found, begun = self.known, set(), []
        if len(known) > self.limit:
            known.clear()
        for word in words:
            if word in known:
                hit = known[word]
            else:
                hit = known[word] = self._look(word)
            if hit is not None:
                found.add(hit[0])
                begun += hit[1]
        for beginning, count in Counter(begun).items():
            for k in range(1, min(count, LEVELS) + 1):
                found.add(self.index.get(beginning + "*" * k, -1))
        found.discard(-1)
        return found


def voter_mask(text: str | None, finder: TermFinder) -> int:
    """Bits of the voters that fire: terms first, then the lexicon, then the patterns."""
    text = text or ""
    words = set(_words(text.lower()))
    mask = 0
    for i in finder.among(words):
        mask |= 1 << i
    n = len(finder.index)
    if not LEXICON.isdisjoint(words):
        mask |= 1 << n
    for i, pattern in enumerate(PATTERNS):
        if pattern.search(text):
            mask |= 1 << (n + 1 + i)
    return mask


def weighted_terms(rows: DataFrame) -> DataFrame:
    """``(term, pos, neg)``: weights of the documents ``(text, p)`` with the term, ``p`` for and ``1 - p`` against."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, neg = Counter(), Counter()
            for text, p in zip(batch.column(0), batch.column(1), strict=True):
                found, p = terms(text.as_py()), p.as_py()
                for table, weight in ((pos, p), (neg, 1 - p)):
                    if weight > 0:
                        for t in found:
                            table[t] += weight
            names = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([float(c[t]) for t in names]) for c in (pos, neg))], ["term", "pos", "neg"])

    counted = rows.select("text", F.col("p").cast("double").alias("p")).mapInArrow(count, "term string, pos double, neg double")
    return counted.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _deviance(counts: DataFrame, n_pos: float, n_neg: float) -> DataFrame:
    """Adds ``gain``: signed log-likelihood ratio of a term's rate in the two classes."""
    pos, neg = F.col("pos"), F.col("neg")
    share = (pos + neg) / (n_pos + n_neg)

    def part(seen, total):
        rate = F.least(F.greatest(seen / total, F.lit(1e-12)), F.lit(1 - 1e-12))
        base = F.least(F.greatest(share, F.lit(1e-12)), F.lit(1 - 1e-12))
        return seen * F.log(rate / base) + (total - seen) * F.log((1 - rate) / (1 - base))

    gain = 2 * (part(pos, n_pos) + part(neg, n_neg))
    return counts.withColumn("gain", F.when(pos / n_pos >= neg / n_neg, gain).otherwise(-gain))


def choose_terms(ranked: Iterable[tuple[str, float]], most: int = MAX_TERMS) -> list[str]:
    """The first terms, without those that nest in a chosen one and occur as often."""
    chosen: list[tuple[str, float]] = []
    for term, pos in ranked:
        stem = term.rstrip("*")
        if not any((stem.startswith(c.rstrip("*")) or c.rstrip("*").startswith(stem)) and abs(pos - n) <= 0.1 * n for c, n in chosen):
            chosen.append((term, pos))
        if len(chosen) == most:
            break
    return [term for term, _ in chosen]


def _per_document(docs: DataFrame, name: str, kind: str, value: Callable[[], Callable[[str | None], object]]) -> DataFrame:
    """Replace ``text`` by a value of it; ``value`` makes the function once a task."""
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others), f"{name} {kind}"])
    arrow = {"long": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}[kind]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = value()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            values = pa.array([of(t.as_py()) for t in texts], arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), values], [*others, name])

    return docs.mapInArrow(apply, schema)


class LabelModel:
    """Two classes; voter ``i`` fires with rate ``fire[1, i]`` in the toxic and ``fire[0, i]`` in the other one."""

    def __init__(self, prior: float, fire: np.ndarray, shared: np.ndarray | None = None):
        self.prior, self.fire = float(np.clip(prior, 1e-4, 0.5)), np.clip(fire, 1e-5, 1 - 1e-5)
        self.shared = np.zeros((fire.shape[1],) * 2) if shared is None else shared

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """Voters that fire share the evidence with the correlated ones that do, silent ones with all correlated ones."""
        votes = (masks[:, None] >> np.arange(self.fire.shape[1])) & 1
        fired = votes * np.log(self.fire[1] / self.fire[0]) / (1 + votes @ self.shared)
        silent = (1 - votes) * np.log((1 - self.fire[1]) / (1 - self.fire[0])) / (1 + self.shared.sum(axis=0))
        odds = np.log(self.prior / (1 - self.prior)) + fired.sum(axis=1) + silent.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def moments(self, patterns: DataFrame) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Documents, expected toxic ones, expected toxic and all co-firings of each two voters."""
        model, n = self, self.fire.shape[1]

        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                masks, count = part["mask"].to_numpy(np.int64), part["n"].to_numpy(float)
                p = model.posterior(masks)
                votes = ((masks[:, None] >> np.arange(n)) & 1).astype(float)
                toxic, both = (votes * (count * p)[:, None]).T @ votes, (votes * count[:, None]).T @ votes
                values = np.concatenate([[count.sum(), (count * p).sum()], toxic.ravel(), both.ravel()])
                yield pd.DataFrame({"i": np.arange(len(values)), "value": values})

        rows = patterns.mapInPandas(sums, "i int, value double").groupBy("i").agg(F.sum("value").alias("v")).collect()
        flat = np.zeros(2 + 2 * n * n)
        for r in rows:
            flat[r.i] = r.v
        return flat[0], flat[1], flat[2:2 + n * n].reshape(n, n), flat[2 + n * n:].reshape(n, n)

    def correlations(self, total: float, both: np.ndarray) -> np.ndarray:
        """How much more often two voters fire together than the classes explain, from 0 to 1."""
        expected = self.prior * np.outer(self.fire[1], self.fire[1]) + (1 - self.prior) * np.outer(self.fire[0], self.fire[0])
        rate = np.clip(np.diag(both) / max(total, 1), 1e-9, 1 - 1e-9)
        spread = np.sqrt(np.outer(rate * (1 - rate), rate * (1 - rate)))
        excess = np.clip((both / max(total, 1) - expected) / spread, 0, 1)
        np.fill_diagonal(excess, 0)
        return np.where(excess > 0.05, excess, 0)


def fit_label_model(patterns: DataFrame, prior: float, fire: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation from given rates, which also count as half of all evidence.

    ``patterns`` holds ``(mask, n)``. Each round is one aggregation to sums for each two voters.
    """
    start, model = LabelModel(prior, fire), LabelModel(prior, fire)
    for _ in range(rounds):
        total, toxic, toxic_both, both = model.moments(patterns)
        if not total:
            break
        fired = np.stack([np.diag(both) - np.diag(toxic_both), np.diag(toxic_both)])
        mass = np.array([[total - toxic], [toxic]])
        prior_mass = mass / max(total, 1) * total
        rates = (fired + prior_mass * start.fire) / np.maximum(mass + prior_mass, 1e-9)
        updated = LabelModel((toxic / total + start.prior) / 2, rates)
        updated.shared = updated.correlations(total, both)
        moved = np.abs(updated.fire - model.fire).max()
        model = updated
        if moved < 1e-4:
            break
    return model


def fit_linear(indexes: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 150, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on indicators with soft targets; both classes weigh the same. Full-batch Adam."""
    lengths = np.array([len(i) for i in indexes])
    row, col = np.repeat(np.arange(len(indexes)), lengths), np.concatenate([*indexes, np.empty(0, np.int64)]).astype(np.int64)
    weight = np.where(target >= 0.5, 0.5 / max(target.sum(), 1e-9), 0.5 / max((1 - target).sum(), 1e-9))
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(indexes)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        gradient = np.append(np.bincount(col, error[row], size) + decay * w / max(size, 1), error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit_sample(docs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` different rows that are not held out: those with the smallest hashes of id and text.

    Rows without id are left out, unless no row has one.
    """
    hashed = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    named = hashed.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), MODULUS, REST))
    for rows in (named, hashed.where("doc_id is null")):
        bound = rows.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
        if bound is not None:
            return rows.where(F.col("h") <= bound).dropDuplicates(["h"]).drop("h")
    return docs.limit(0)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED_PER_CLASS, fit_documents: int = FIT_DOCUMENTS,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every document: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher: toxic) and ``predicted``.

    Labels are read only of rows that are not held out, at most ``per_class`` of each class; they choose the
    voters and start the label model, which is then fitted to the vote patterns of all documents. The classifier is
    trained on posteriors of at most ``fit_documents`` documents, chosen by hash, that are not held out. Ids, languages,
    sources and labels are no inputs of a score.

    One row per input row. Missing and empty texts get the score of a text without any term. Without labels of both
    classes the lexicon and patterns vote alone. An empty table gives no rows. Columns named in ``carry`` are returned too.
    """
    small_batches(docs.sparkSession)
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    docs = rows_in.select("doc_id", "text")
    sample, counts = labelled_sample(docs, labels, "toxic", MODULUS, REST, per_class)
    n_class = {y: min(counts.get(y, 0), per_class) for y in (0, 1)}
    names: list[str] = []
    if all(n_class.values()):
        sample = saved(sample, "labelled")
        ranked = _deviance(weighted_terms(sample.withColumn("p", F.col("y").cast("double"))), n_class[1], n_class[0])
        best = ranked.where((F.col("pos") >= MIN_SUPPORT) & (F.col("gain") > 10.8)).orderBy(F.desc("gain"), "term").limit(8 * MAX_TERMS)
        names = choose_terms([(r.term, r.pos) for r in best.collect()])
    n = len(names) + 1 + len(PATTERNS)

    def voter():
        finder = TermFinder(names)
        return lambda text: voter_mask(text, finder)

    fire = np.stack([np.full(n, 0.01), np.full(n, 0.3)])
    prior = 0.1
    if names:
        marked = _per_document(sample.select("y", "text"), "mask", "long", voter).groupBy("y", "mask").agg(F.count("*").alias("n"))
        bits = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0)).alias(f"v{i}") for i in range(n)]
        for r in marked.groupBy("y").agg(F.sum("n").alias("all"), *bits).collect():
            fire[r.y] = (np.array([r[f"v{i}"] for i in range(n)]) + 0.5) / (r["all"] + 1)
        prior = counts[1] / (counts[0] + counts[1])
    patterns = saved(_per_document(docs.select("text"), "mask", "long", voter).groupBy("mask").agg(F.count("*").alias("n")), "votes")
    model = fit_label_model(patterns, prior, fire)

    chosen = fit_sample(docs, fit_documents)

    def posterior():
        finder = TermFinder(names)
        return lambda text: float(model.posterior(np.array([voter_mask(text, finder)], np.int64))[0])

    fitted = saved(_per_document(chosen.select("doc_id", "text", F.col("text").alias("raw")), "p", "double", posterior).select(
        F.col("raw").alias("text"), "p"), "posteriors")
    mass = fitted.agg(F.sum("p").alias("pos"), F.sum(1 - F.col("p")).alias("neg")).first()
    weights, bias, useful = np.empty(0), -2.0, []
    if mass.pos and mass.neg and mass.pos > 1e-6:
        ranked = _deviance(weighted_terms(fitted), mass.pos, mass.neg)
        useful = [r.term for r in ranked.where(F.abs("gain") > 10.8).orderBy(F.desc(F.abs("gain")), "term").limit(FEATURES).select("term").collect()]

        def feature_indexes():
            finder = TermFinder(useful)
            return lambda text: sorted(finder(text))

        rows = _per_document(fitted, "features", "array<int>", feature_indexes)

        def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = pd.concat([pd.DataFrame({"p": [], "features": []}), *parts])
            w, b = fit_linear([np.asarray(f, np.int64) for f in part["features"]], part["p"].to_numpy(float), len(useful))
            yield pd.DataFrame({"i": np.arange(len(w) + 1), "w": np.append(w, b)})

        learned = {r.i: r.w for r in rows.coalesce(1).mapInPandas(fit, "i int, w double").collect()}
        weights, bias = np.array([learned[i] for i in range(len(useful))]), learned[len(useful)]

    def scorer():
        finder = TermFinder(useful)
        return lambda text: float(1 / (1 + np.exp(-np.clip(bias + sum(weights[i] for i in finder(text)), -30, 30))))

    scored = _per_document(rows_in, "score", "double", scorer)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *carry)
