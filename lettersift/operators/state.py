"""Processing state per mailbox: the newest message and the last remembered message keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules import RECENT_HASHES


def can_advance(df: DataFrame) -> DataFrame:
    """Messages whose processing is remembered.

    A message with an unreadable date is not, and is processed again by the next run.
    """
    return df.where((F.coalesce("date", F.lit("")) == "") | F.col("received_at").isNotNull())


def watermark(df: DataFrame, seq: str = "uid") -> DataFrame:
    """Newest message of each mailbox; the one processed first wins a tie, before all one without ``seq``."""
    newest = F.max_by(
        F.struct("hash", "date", "subject", "received_at"),
        F.struct(F.col("received_at"), F.col(seq).isNull().alias("_kept"), (-F.col(seq)).alias("_order"), F.col("hash")),
    )
    dated = df.where(F.col("received_at").isNotNull())
    return dated.groupBy("mailbox").agg(newest.alias("_newest")).select("mailbox", "_newest.*")


def recent_hashes(df: DataFrame, keep: int = RECENT_HASHES) -> DataFrame:
    """The last ``keep`` distinct keys of each mailbox in order of first sight.

    Input and output rows are ``mailbox, hash, batch_id, seq``. Seeing a key again does not move it.
    """
    first = df.groupBy("mailbox", "hash").agg(F.min(F.struct("batch_id", "seq")).alias("_at"))
    latest = Window.partitionBy("mailbox").orderBy(F.desc("_at"))
    return (
        first.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= keep)
        .select("mailbox", "hash", "_at.batch_id", "_at.seq")
    )


def hash_rows(df: DataFrame, batch_id: int, seq: str = "uid") -> DataFrame:
    return df.select("mailbox", "hash", F.lit(batch_id).cast("long").alias("batch_id"), F.col(seq).alias("seq"))


def advance_state(processed: DataFrame, batch_id: int, marks: DataFrame | None = None,
                  recent: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Watermark and recent keys after a batch of successfully processed messages."""
    done = can_advance(processed)
    columns = ["mailbox", "hash", "date", "subject", "received_at"]
    dated = done.select(*columns, F.col("uid").alias("_seq"))
    keys = hash_rows(done, batch_id)
    if marks is not None:
        # The mark so far was set first, so it wins ties.
        dated = dated.unionByName(marks.select(*columns, F.lit(None).cast("long").alias("_seq")))
    if recent is not None:
        keys = keys.unionByName(recent.select("mailbox", "hash", "batch_id", "seq"))
    return watermark(dated, "_seq"), recent_hashes(keys)
