"""Document fingerprints by consistent weighted sampling.

Terms are pairs of consecutive words, weighted by how often they occur. For each of a fingerprint's samples every
term draws two gamma variables and a uniform one from its hash; they turn its weight into a sample value, and the
term with the smallest value, with its weight step, is the sample. Two documents share a sample with a probability
that equals their generalised Jaccard similarity: summed minima of weights over summed maxima.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts
from .near import _mix, word_hashes

SAMPLES = 64
WIDTH = 2
# Terms that are evaluated together: 64 samples of them take some 50 MB.
BLOCK = 32_768
_PART = 1024
_U = np.uint64


def weighted_terms(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's terms, sorted, and their weights; fewer words than ``width`` are one term."""
    words = word_hashes(text)
    if not len(words):
        return words, np.empty(0, np.int64)
    take = min(width, len(words))
    total = np.full(len(words) - take + 1, take, _U)
    for i in range(take):
        total = _mix(total + words[i:i + len(total)])
    return np.unique(total, return_counts=True)


def _unit(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of the upper 23 of 32 bits, which a single-precision number holds exactly."""
    return ((bits >> np.uint32(9)).view(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)


def draw(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of each term's value and its weight step, by term and sample, in single precision."""
    seeds = terms[:, None] + (np.arange(1, samples + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))[None, :]
    first = _mix(seeds)
    second = first * _U(0xD1342543DE82EF95)
    second ^= second >> _U(29)
    one, two = (x.view(np.uint32).reshape(*x.shape, 2) for x in (first, second))
    scale = -np.log(_unit(one[..., 1]) * _unit(one[..., 0]))  # gamma with shape 2
    level = np.log(-np.log(_unit(two[..., 1]) * _unit(two[..., 0])))  # logarithm of another
    # The bits that the others left.
    low = ((one[..., 1] & np.uint32(511)) << np.uint32(9)) | (one[..., 0] & np.uint32(511))
    shift = (low.view(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-18)
    step = np.zeros(first.shape, np.float32)  # that of weight 1
    many = np.flatnonzero(weights > 1)
    if len(many):
        step[many] = np.floor(np.log(weights[many]).astype(np.float32)[:, None] / scale[many] + shift[many])
    return level - scale * (step - shift + np.float32(1)), step


def _ranked(values: np.ndarray, first: int) -> np.ndarray:
    """Values as whole numbers of the same order, with the row in the lower half: the least names its row."""
    bits = values.view(np.uint32)
    order = bits ^ ((bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(1 << 31))
    return (order.astype(_U) << _U(32)) | np.arange(first, first + len(values), dtype=_U)[:, None]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], samples: int = SAMPLES) -> np.ndarray:
    """Fingerprints of weighted term sets, a row of 32-bit numbers each; 0 for those without terms.

    Equal terms of equal weight are evaluated once. Sets of any size pass in blocks.
    """
    sizes = [len(t) for t, _ in bags]
    if not sum(sizes):
        return np.zeros((len(bags), samples), np.uint32)
    terms, weights = np.concatenate([t for t, _ in bags]), np.concatenate([w for _, w in bags])
    _, first, place = np.unique(_mix(terms + _mix(weights.astype(_U))), return_index=True, return_inverse=True)
    terms, weights = terms[first], weights[first]
    ends, each = np.cumsum(sizes), np.arange(samples)
    best = np.full((len(bags), samples), ~_U(0))
    steps = np.zeros((len(bags), samples), np.float32)
    for low in range(0, len(first), BLOCK):
        high = min(low + BLOCK, len(first))
        ranked, step = np.empty((high - low, samples), _U), np.empty((high - low, samples), np.float32)
        for part in range(low, high, _PART):  # stays in the cache
            rows = slice(part, min(part + _PART, high))
            value, step[rows.start - low:rows.stop - low] = draw(terms[rows], weights[rows], samples)
            ranked[rows.start - low:rows.stop - low] = _ranked(value, part)
        for i, (end, size) in enumerate(zip(ends, sizes, strict=True)):
            own = place[end - size:end]
            if len(first) > BLOCK:
                own = own[(own >= low) & (own < high)]
            if not len(own):
                continue
            least = ranked[own - low].min(axis=0)
            better = least < best[i]
            best[i][better] = least[better]
            winner = (least & _U(0xFFFFFFFF)).astype(np.intp) - low
            steps[i][better] = step[winner, each][better]
    filled = np.array(sizes) > 0
    result = np.zeros((len(bags), samples), np.uint32)
    winners = terms[(best[filled] & _U(0xFFFFFFFF)).astype(np.intp)]
    result[filled] = _mix(winners + _mix(steps[filled].astype(np.int64).view(_U))) >> _U(32)
    return result


def as_text(signature: np.ndarray, n_terms: int) -> str:
    """Hexadecimal text of a fingerprint; empty for a document without terms."""
    return signature.astype(">u4").tobytes().hex() if n_terms else ""


def likeness(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Share of equal samples; two documents without terms are alike, one is unlike all others."""
    return float((a == b).mean()) if n_a and n_b else float(n_a == n_b)


def fingerprint(docs: DataFrame, samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fingerprint)`` of each row of ``docs``; the text of ``samples`` 32-bit numbers.

    Equal texts have equal fingerprints. Missing, empty and blank texts have an empty one.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in _portions(weighted_terms(t.as_py(), width) for t in batch.column(1)):
                found += [as_text(s, len(t)) for s, (t, _) in zip(signatures(part, samples), part, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        make, "doc_id long, fingerprint string")


def _portions(bags: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    part, size = [], 0
    for bag in bags:
        part.append(bag)
        size += len(bag[0])
        if size >= BLOCK // 2:
            yield part
            part, size = [], 0
    if part:
        yield part


def _with_next(docs: DataFrame) -> DataFrame:
    """Documents dealt into ranges of descending ``doc_id``, each followed by a ghost: the first row of the next range.

    Rows come in order within each partition, so each row's successor is the next row. Only ids are gathered: the
    limits of the ranges and the first id of each, as many as there are ranges.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    # Rows without id come last.
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63))))
    shares = [i / (4 * parts) for i in range(1, 4 * parts)]
    found = keyed.agg(F.percentile_approx("_key", shares, 100_000).alias("p")).first().p
    limits = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(len(limits) - np.searchsorted(limits, key.to_numpy(np.int64), side="right")).astype("int32")

    heads = keyed.select("_key").withColumn("_range", range_of("_key")).groupBy("_range").agg(F.max("_key").alias("_key")).collect()
    heads = sorted((r["_range"], r["_key"]) for r in heads)
    before = [(heads[i][0], heads[(i + 1) % len(heads)][1]) for i in range(len(heads))]
    ghosts = spark.createDataFrame(before, "_range int, _key long")
    rows = keyed.select("doc_id", "text", "_key", range_of("_key").alias("_range"), F.lit(0).alias("_ghost"))
    copies = keyed.select("doc_id", "text", "_key").join(F.broadcast(ghosts), "_key").select(
        "doc_id", "text", "_key", "_range", F.lit(1).alias("_ghost"))
    ordered = rows.union(copies).repartition(parts, "_range").sortWithinPartitions("_range", "_ghost", F.desc("_key"), "text")
    return ordered.select("doc_id", "text", "_ghost")


def edited_text(text: str, following: str) -> str:
    """A text whose last half is replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they and the next document's are.

    The next document is that of the next smaller ``doc_id``, after the smallest the largest; rows of one id follow
    each other by text, rows without id come last. Returns ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    One row per input row; missing texts are empty. A single document is its own next one. An empty table gives no rows.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def result(rows: list[tuple[int | None, str, int]]) -> pa.RecordBatch:
        """Rows of ``(doc_id, text, ghost)`` but the last, which only follows."""
        own = [weighted_terms(text, width) for _, text, _ in rows]
        edits = [edited_text(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False)]
        changed = [weighted_terms(text, width) for text in edits]
        marks = signatures(own + changed, samples)
        mine, theirs = marks[:len(rows)], marks[len(rows):]
        columns = [[] for _ in names]
        for i, (doc, text, ghost) in enumerate(rows[:-1]):
            if ghost:
                continue
            n, n_edit, n_next = len(own[i][0]), len(changed[i][0]), len(own[i + 1][0])
            for column, value in zip(columns, (
                doc, len(text), hashlib.sha256(edits[i].encode("utf-8", "surrogatepass")).hexdigest(), as_text(mine[i], n),
                as_text(theirs[i], n_edit), likeness(mine[i], theirs[i], n, n_edit), likeness(mine[i], mine[i + 1], n, n_next),
            ), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for doc, text, ghost in zip(*(batch.column(i) for i in range(3)), strict=True):
                rows.append((doc.as_py(), text.as_py() or "", ghost.as_py()))
                size += len(rows[-1][1])
                if size >= 8 * BLOCK and len(rows) > 1:
                    yield result(rows)
                    rows, size = rows[-1:], len(rows[-1][1])
        if len(rows) > 1:
            yield result(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ("long", "long", "string", "string", "string", "double", "double")
    return _with_next(texts).mapInArrow(make, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
