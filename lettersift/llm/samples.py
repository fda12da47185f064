"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled rows that a model is fitted on, at most, of each class.
LABELLED_PER_CLASS = 6000


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether a document's label is kept for testing: by CRC32 of its id as text. Rows without id are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int,
                    per_class: int = LABELLED_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """``(doc_id, text, y)`` of at most ``per_class`` training rows of each class, and all training rows by class.

    Rows are chosen by hash of their id, so the choice doesn't depend on order. Of several labels of a document the
    largest counts, of several texts the one with the smallest hash. Missing ids and labels are left out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), modulus, rest))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("row"))
    return found.select("doc_id", "row.text", "y"), counts
