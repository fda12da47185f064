"""Exact duplicates by progressive refinement: length, then a prefix, then the whole text. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, saved, with_row_id

# Code points whose hash tells texts of equal length apart before they are read as a whole.
PREFIX = 256
# Rows of 64 bits in the filter that is broadcast: 2^24 bits at most, whatever the size of the input.
FILTER_WORDS = 1 << 18

ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def _place(key: Column) -> tuple[Column, Column]:
    """The row and the bit of a key in the filter."""
    word = F.pmod(F.shiftrightunsigned(key, 6), F.lit(FILTER_WORDS))
    return word, F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))


def _repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """``(_word, _bits)``: a filter that lets pass every row whose values in ``columns`` stand in another row, too."""
    again = rows.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1")
    word, bit = _place(F.xxhash64(*columns))
    return again.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _passing(rows: DataFrame, accepted: DataFrame, *columns: str) -> DataFrame:
    """The rows with ``_again``: whether the filter lets them pass. Rows stay in place."""
    word, bit = _place(F.xxhash64(*columns))
    rows = rows.withColumn("_word", word).join(F.broadcast(accepted), "_word", "left")
    return rows.withColumn("_again", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def exact_duplicates(docs: DataFrame, carry: tuple[str, ...] | list[str] = ("doc_id",), id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """The group of equal texts of each row: the columns ``carry``, ``keep_id``, ``group_size`` and ``kept``.

    Three steps, each on the rows that the step before could not tell apart: the number of bytes, the hash of the
    first 256 characters, the SHA-256 of the whole text. A text that is alone in its length or its prefix is not read
    further. What is left after a step travels as a bit filter of at most 2^24 bits, so that texts never leave their
    row; a bit shared by accident only makes one more text be read. Groups are formed by the last hash alone.

    One row per input row, repeated rows included. A missing text counts as empty; all empty texts are one group.
    The row with the largest id stays; among rows that share it, one; rows without id stay only in a group without
    any id, and then one does (``keep_id`` is null there). Other columns are ignored. ``carry`` may not name
    ``keep_id``, ``group_size`` or ``kept``. An empty table gives no rows. Large groups are not collected:
    they are counted in the tasks first, and their few results are broadcast.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("_row"), F.col(id).alias("_id"), body.alias("_text"))
    keys = [F.octet_length("_text").alias("_length"), F.xxhash64(F.left("_text", F.lit(PREFIX))).alias("_prefix")]
    known = saved(rows.select(*keys), "lengths")
    by_length = _passing(known, _repeated(known, "_length"), "_length").where("_again")
    by_prefix = _repeated(by_length, "_length", "_prefix")
    rows = _passing(rows.select("_row", "_id", "_text", *keys), by_prefix, "_length", "_prefix")
    digest = F.when(F.col("_again"), F.unhex(F.sha2("_text", 256)))
    # Written once: both sides of the join read the same numbers of the rows.
    rows = saved(with_row_id(rows.select("_row", "_id", digest.alias("_digest")), "_rid"), "digests")
    alone = rows.where("_digest IS NULL").select(
        "_row.*", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    read = rows.where("_digest IS NOT NULL")
    groups = read.groupBy("_digest").agg(F.count("*").alias("_n"), F.max(F.struct("_id", "_rid")).alias("_keep"))
    joined = join_groups(read, groups, ["_digest"], "_n", rows.count())
    return alone.unionByName(joined.select(
        "_row.*", F.col("_keep._id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_rid") == F.col("_keep._rid")).alias("kept")))


def drop_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns; which one, ``exact_duplicates`` says."""
    return exact_duplicates(docs, docs.columns, id, text).where("kept").select(*docs.columns)
