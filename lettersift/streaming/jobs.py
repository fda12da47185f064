"""Streaming triage, repeat removal and run statistics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import drop_late
from ..operators.ingest import NO_ID, ingest_new, new_messages, with_hash
from ..operators.state import advance_state
from ..operators.store import audit_log_rows, classified_log_rows
from ..operators.triage import Scorer, classify_rules, run_record, triage
from ..rules import Settings
from ..sources.tables import is_snapshot, marks_of, read_state, recent_of, state_rows, write_log, write_state, write_version

_STATE_COLUMNS = ["mailbox", "uid", "hash", "date", "subject", "received_at"]


def finish_batch(fresh: DataFrame, state: DataFrame, batch_id: int, settings: Settings, out: str, started: Column | None = None,
                 ended: Column | None = None, classify: Scorer = classify_rules) -> None:
    """Judge new messages and write the batch's tables: messages, logs, run record, and state last.

    Messages are judged and written once; the others are read from what was written. Every table has a version
    for the batch, which running the batch again replaces, and state is the last, so a batch that failed starts
    again from the same state. Between snapshots only mailboxes that occur in the batch get a new state row.
    """
    spark = fresh.sparkSession
    started = F.current_timestamp() if started is None else started
    began = spark.range(1).select(started.alias("t")).first().t
    write_version(triage(fresh, settings, classify), f"{out}/messages", batch_id)

    written = spark.read.parquet(f"{out}/messages/version={batch_id}")
    judged = written.where(F.col("category").isNotNull())
    at = F.lit(began)
    log = classified_log_rows(judged, at, keep=("mailbox",))
    write_log(log, f"{out}/classified_log", batch_id)
    write_version(audit_log_rows(judged, at), f"{out}/audit_log", batch_id)
    ended = F.current_timestamp() if ended is None else ended
    write_version(run_record(written, at, ended), f"{out}/run_stats", batch_id)
    done = judged.select(*_STATE_COLUMNS)
    touched = state if is_snapshot(batch_id) else state.join(done.select("mailbox").distinct(), "mailbox", "left_semi")
    new_marks, new_recent = advance_state(done, batch_id, marks_of(touched), recent_of(touched))
    write_state(state_rows(new_marks, new_recent), f"{out}/state", batch_id)


def run_once(header_rows: DataFrame, bodies: DataFrame, settings: Settings, out: str, batch_id: int, as_of: Column,
             started: Column | None = None, ended: Column | None = None, classify: Scorer = classify_rules, **criteria) -> None:
    """One batch run: take in new messages, judge, log and remember them. An empty run leaves a record too."""
    state = read_state(header_rows.sparkSession, f"{out}/state", before=batch_id).persist()
    try:
        fresh = ingest_new(header_rows, bodies, recent_of(state), marks_of(state), as_of, **criteria)
        finish_batch(fresh, state, batch_id, settings, out, started, ended, classify)
    finally:
        state.unpersist()


def triage_batch(batch: DataFrame, batch_id: int, settings: Settings, out: str, classify: Scorer = classify_rules,
                 null_id: str = "drop") -> None:
    """Process one micro-batch: messages that are new and not late go through :func:`finish_batch`."""
    state = read_state(batch.sparkSession, f"{out}/state", before=batch_id).persist()
    try:
        marks = marks_of(state)
        fresh = drop_late(new_messages(with_hash(batch), recent_of(state), marks, null_id), marks)
        finish_batch(fresh, state, batch_id, settings, out, classify=classify)
    finally:
        state.unpersist()


def triage_stream(messages: DataFrame, settings: Settings, out: str, checkpoint: str,
                  every: str | None = None, classify: Scorer = classify_rules, null_id: str = "drop") -> StreamingQuery:
    """Start triage on a stream of messages; without ``every`` it handles what is there and ends.

    ``out`` remembers the checkpoint it was written with: with another one, batches would start at 0 again and
    mix with those of the old run.
    """
    claim_folder(messages.sparkSession, out, checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        messages.writeStream
        .foreachBatch(lambda batch, batch_id: triage_batch(batch, batch_id, settings, out, classify, null_id))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def claim_folder(spark: SparkSession, out: str, checkpoint: str) -> None:
    """Note the checkpoint of a run in its output folder, or fail if another one is noted there."""
    try:
        noted = spark.read.schema("checkpoint string").json(f"{out}/run").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([(checkpoint,)], "checkpoint string").coalesce(1).write.json(f"{out}/run")
    else:
        if noted and noted.checkpoint != checkpoint:
            raise ValueError(f"{out} belongs to the run with checkpoint {noted.checkpoint}")


def dedup_stream(messages: DataFrame, delay: str = "3 days", null_id: str = "drop") -> DataFrame:
    """First message of each key per mailbox on a stream.

    State is kept for ``delay`` of event time, so it is bounded by the stream's rate. Messages behind
    the watermark are dropped from the batch after it moved on; :func:`drop_late` is the exact form. Undated messages
    have no place in event time and pass; so do, with ``null_id="keep"``, messages without an id.
    """
    rows = with_hash(messages)
    passing = F.col("received_at").isNull() | ((F.col("hash") == NO_ID) & F.lit(null_id == "keep"))
    first = rows.where(~passing).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["mailbox", "hash"])
    return first.unionByName(rows.where(passing))


def windowed_stats_stream(classified: DataFrame, minutes: int = 15, delay: str = "3 days") -> DataFrame:
    """Run statistics per schedule interval on a stream of classified messages.

    Undated messages belong to no interval; take them from the batch tables.
    """
    from ..operators.triage import run_stats_windowed

    return run_stats_windowed(classified.withWatermark("received_at", delay), "received_at", minutes)
