"""Run statistics per schedule interval on a stream, late messages counted apart.

Every batch adds its counts per interval, aggregated before they are shuffled, as a version of its own; reading sums the
versions. The mark, the newest time of all earlier batches, is part of a version's manifest: a message is late
if its interval had closed before the batch, so the result depends on the batches alone, not on when they ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.triage import run_stats
from ..rules import CATEGORIES
from ..sources import manifests
from ..sources.tables import is_snapshot, write_version
from .jobs import claim_folder

_COUNTS = ["total_emails", *CATEGORIES, "late_emails"]
_SCHEMA = "timestamp timestamp, " + ", ".join(f"{c} long" for c in _COUNTS)
_MANIFEST = "version bigint, mark timestamp, parts array<bigint>"


def _before(spark: SparkSession, out: str, version: int):
    """The manifest of the version before; none for the first. A missing one is an error."""
    if version == 0:
        return None
    found = manifests.manifest(spark, out, version - 1, _MANIFEST)
    if found is None:
        raise ValueError(f"interval version {version - 1} is missing in {out}")
    return found.first()


def _summed(spark: SparkSession, out: str, parts: list[int]) -> DataFrame:
    rows = spark.read.schema(_SCHEMA).parquet(*[f"{out}/version={v}" for v in parts])
    return rows.groupBy("timestamp").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def interval_batch(batch: DataFrame, batch_id: int, out: str, time: str = "received_at", minutes: int = 15, delay: str = "3 days") -> None:
    """Add the counts of one batch of classified messages. Running a batch again replaces its counts.

    Undated messages belong to no interval and are not counted. Messages without a category failed: they are in the
    total only. Late ones are in ``late_emails`` only. With every snapshot the versions so far become one.
    """
    spark = batch.sparkSession
    before = _before(spark, out, batch_id)
    mark = before.mark if before else None
    window = F.window(F.col(time), f"{minutes} minutes")
    dated = batch.where(F.col(time).isNotNull()).select("category", F.col(time).alias("_at"), window.alias("_window"))
    closed = F.col("_window.end") + F.expr(f"INTERVAL {delay}") <= F.lit(mark)
    late = F.coalesce(closed, F.lit(False)) if mark is not None else F.lit(False)
    rows = dated.withColumn("_late", late).withColumn("timestamp", F.col("_window.start"))
    on_time = run_stats(rows.where(~F.col("_late")), ["timestamp"]).withColumn("late_emails", F.lit(0).cast("long"))
    zeros = [F.lit(0).cast("long").alias(c) for c in _COUNTS[:-1]]
    behind = rows.where("_late").groupBy("timestamp").agg(F.count("*").alias("late_emails")).select("timestamp", *zeros, "late_emails")
    counts = on_time.unionByName(behind).groupBy("timestamp").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    manifests.withdraw(spark, out, batch_id)
    parts = [*(before.parts if before else []), batch_id]
    if before and is_snapshot(batch_id):
        counts = counts.unionByName(_summed(spark, out, before.parts)).groupBy("timestamp").agg(*[F.sum(c).alias(c) for c in _COUNTS])
        parts = [batch_id]
    write_version(counts, out, batch_id)
    newest = dated.agg(F.max("_at")).first()[0]
    mark = max((m for m in (mark, newest) if m is not None), default=None)
    manifests.commit(spark.createDataFrame([(batch_id, mark, parts)], _MANIFEST), out, batch_id)
    if is_snapshot(batch_id):
        needed = {*parts, *(before.parts if before else [])}
        for old in manifests.versions(spark, out):
            if old < batch_id - 1:
                manifests.withdraw(spark, out, old)
        for name in manifests.names(spark, out):
            if name.startswith("version=") and int(name.removeprefix("version=")) not in needed:
                manifests.remove(spark, f"{out}/{name}")


def interval_stream(classified: DataFrame, out: str, checkpoint: str, every: str | None = None, **settings) -> StreamingQuery:
    """Start counting on a stream; without ``every`` it counts what is there and ends."""
    claim_folder(classified.sparkSession, out, checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        classified.writeStream.foreachBatch(lambda batch, batch_id: interval_batch(batch, batch_id, out, **settings))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def read_intervals(spark: SparkSession, out: str) -> DataFrame:
    """``timestamp`` (start of the interval), counts and ``late_emails`` after the last batch."""
    known = manifests.versions(spark, out)
    if not known:
        return spark.createDataFrame([], _SCHEMA)
    return _summed(spark, out, manifests.manifest(spark, out, known[-1], _MANIFEST).first().parts)
