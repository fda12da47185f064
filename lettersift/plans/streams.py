"""Queries that run a stream over the supplied tables to its end."""

from pyspark.sql import functions as F

from ..functions.headers import as_utc
from ..rules import CATEGORIES
from ..session import shared_dir
from ..sources import corpus
from ..streaming import intervals, jobs, remembered
from . import sql
from .judging import _EVENT_CATEGORY
from .registry import query


def message_stream(spark, sf):
    """The documents as a stream of messages, joined with the pages as a static table."""
    schema = corpus.table(spark, sf, "documents").schema
    documents = spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*")
    return corpus.message_rows(documents, corpus.table(spark, sf, "pages"))


@query(f"""{sql.DECIDED} SELECT uid, category, confidence, array_to_string(topics, ',') AS topics, sender_status, planned_action FROM p""")
def stream_triage(spark, sf):
    """Triage as a stream that starts without state."""
    out = shared_dir(spark, "triage")
    run = jobs.triage_stream(message_stream(spark, sf), corpus.SETTINGS, f"{out}/tables", f"{out}/checkpoint")
    run.awaitTermination()
    return spark.read.parquet(f"{out}/tables/messages").select(
        "uid", "category", "confidence", F.array_join("topics", ",").alias("topics"), "sender_status", "planned_action")


@query(f"""{sql.HEADERS} SELECT DISTINCT mailbox, hash FROM h WHERE received_at IS NOT NULL
    UNION ALL SELECT mailbox, hash FROM h WHERE received_at IS NULL""")
def stream_dedup(spark, sf):
    """The first message of each key, removed from repeats by a stream; undated ones pass."""
    out = shared_dir(spark, "dedup")
    rows = jobs.dedup_stream(message_stream(spark, sf).drop("body_text", "body_html"))
    run = (
        rows.select("mailbox", "hash", "uid").writeStream.format("parquet").outputMode("append")
        .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema("mailbox string, hash string, uid long").parquet(f"{out}/rows").select("mailbox", "hash")


@query(f"""{sql.HEADERS}{sql.STATE} SELECT mailbox, source_folder, uid, hash FROM h WHERE uid < (SELECT max(doc_id) FROM documents) / 2
    UNION ALL SELECT mailbox, source_folder, uid, hash FROM h
    WHERE uid >= (SELECT max(doc_id) FROM documents) / 2 AND (mailbox, hash) NOT IN (SELECT mailbox, hash FROM seen)""")
def stream_remembered(spark, sf):
    """New messages by 200 keys a mailbox in the stream's own state: the older half, a restart, then the newer half."""
    out = shared_dir(spark, "remembered")
    rows = corpus.headers(spark, sf)
    newer = F.col("uid") >= corpus.table(spark, sf, "documents").select(F.max("doc_id") / 2).scalar()
    for part, chosen in enumerate((~newer, newer)):
        rows.where(chosen).write.parquet(f"{out}/in/part={part}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{out}/in/*")
        with remembered.list_state(spark):
            run = (
                remembered.remembered_stream(stream).writeStream.format("parquet").outputMode("append")
                .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
                .trigger(availableNow=True).start()
            )
        run.awaitTermination()
    return spark.read.schema("mailbox string, source_folder string, uid long, hash string").parquet(f"{out}/rows")


@query(f"""WITH mark AS (SELECT max(ts) AS newest FROM events WHERE event_id % 3 <> 0),
    e AS (SELECT ts, {_EVENT_CATEGORY} AS category, event_id % 3 = 0 AND
      time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE + INTERVAL 3 DAY <= (SELECT newest FROM mark) AS late FROM events)
    SELECT epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) // 1000000 AS started, count(*) FILTER (NOT late) AS total_emails,
    {", ".join(f"count(*) FILTER (category = '{c}' AND NOT late) AS {c}" for c in CATEGORIES)},
    count(*) FILTER (late) AS late_emails FROM e GROUP BY 1""")
def stream_run_stats(spark, sf):
    """Events as classified messages, counted per interval by a stream: two parts with a restart between, the second late."""
    out = shared_dir(spark, "intervals")
    events = corpus.table(spark, sf, "events").select(
        "event_id", as_utc(F.col("ts")).alias("received_at"), F.expr(_EVENT_CATEGORY).alias("category"))
    for part, chosen in enumerate((F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0)):
        events.where(chosen).write.parquet(f"{out}/in/part={part}")
        stream = spark.readStream.schema(events.schema).parquet(f"{out}/in/*")
        intervals.interval_stream(stream, f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    counted = intervals.read_intervals(spark, f"{out}/counts")
    return counted.select(F.unix_timestamp("timestamp").alias("started"), "total_emails", *CATEGORIES, "late_emails")
