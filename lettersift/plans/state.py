"""Processing state, ingest and the incremental look-back."""

from pyspark.sql import functions as F

from ..operators import ingest, state
from ..operators.dataset import exclude_inbox as without_inbox
from ..rules import INBOX
from ..session import shared_dir
from ..sources import corpus, tables
from . import sql
from .registry import query


def processed_earlier(spark, sf):
    """The older half of the messages by arrival number, as an earlier run left them."""
    return corpus.headers(spark, sf).where(F.col("uid") < _middle(spark, sf))


def _middle(spark, sf):
    return corpus.table(spark, sf, "documents").select(F.max("doc_id") / 2).scalar()


def earlier_state(spark, sf):
    return state.advance_state(processed_earlier(spark, sf), batch_id=0)


_MARKS_SQL = f"{sql.HEADERS}{sql.STATE} SELECT mailbox, hash, subject, epoch_us(received_at) // 1000000 AS received FROM marks"


def _marks(marks):
    return marks.select("mailbox", "hash", "subject", F.unix_timestamp("received_at").alias("received"))


@query(_MARKS_SQL)
def watermark(spark, sf):
    return _marks(state.watermark(state.can_advance(processed_earlier(spark, sf))))


@query(f"{sql.HEADERS}{sql.STATE} SELECT mailbox, hash, seq FROM recent")
def recent_hashes(spark, sf):
    rows = state.hash_rows(state.can_advance(processed_earlier(spark, sf)), batch_id=0)
    return state.recent_hashes(rows).select("mailbox", "hash", "seq")


_SECOND_RUN = """,
done2 AS (SELECT * FROM h WHERE uid >= (SELECT max(doc_id) FROM documents) / 2 AND received_at IS NOT NULL
  AND (mailbox, hash) NOT IN (SELECT mailbox, hash FROM seen)),
marks2 AS (
  SELECT mailbox, hash FROM (
    SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY received_at DESC, seq) AS r
    FROM (SELECT mailbox, hash, received_at, -1 AS seq FROM marks UNION ALL SELECT mailbox, hash, received_at, uid FROM done2)) WHERE r = 1),
recent2 AS (
  SELECT mailbox, hash FROM (
    SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY seq DESC) AS r
    FROM (SELECT mailbox, hash, min(seq) AS seq FROM (
      SELECT mailbox, hash, seq FROM recent UNION ALL SELECT mailbox, hash, uid FROM done2) GROUP BY ALL)) WHERE r <= 200)"""


@query(f"""{sql.HEADERS}{sql.STATE}{_SECOND_RUN} SELECT 'watermark' AS kind, mailbox, hash FROM marks2
    UNION ALL SELECT 'recent', mailbox, hash FROM recent2""")
def advance_state(spark, sf):
    """A second run over all newer messages that the first one did not see."""
    marks, recent = earlier_state(spark, sf)
    newer = corpus.headers(spark, sf).where(F.col("uid") >= _middle(spark, sf))
    marks, recent = state.advance_state(ingest.new_messages(newer, recent, marks), 1, marks, recent)
    return marks.select(F.lit("watermark").alias("kind"), "mailbox", "hash").union(
        recent.select(F.lit("recent"), "mailbox", "hash"))


@query(f"{_MARKS_SQL}")
def read_state(spark, sf):
    """State written as a versioned table and read back."""
    marks, recent = earlier_state(spark, sf)
    path = shared_dir(spark, "state")
    tables.write_state(tables.state_rows(marks, recent), path, 0)
    return _marks(tables.marks_of(tables.read_state(spark, path)))


@query(f"{sql.HEADERS}{sql.STATE} SELECT uid FROM h WHERE (mailbox, hash) NOT IN (SELECT mailbox, hash FROM seen)")
def new_messages(spark, sf):
    marks, recent = earlier_state(spark, sf)
    return ingest.new_messages(corpus.headers(spark, sf), recent, marks).select("uid")


_FOUND = f""",
starts AS (SELECT mailbox, received_at AS mark, {sql.days_between(sql.AS_OF_SQL, 'received_at')} + 1 AS days FROM marks),
found AS (
  SELECT * FROM (
    SELECT h.*, mark, row_number() OVER (PARTITION BY h.mailbox ORDER BY uid DESC) AS r
    FROM h LEFT JOIN starts s ON s.mailbox = h.mailbox
    WHERE source_folder = 'INBOX' AND NOT list_contains(flags, '\\Seen')
      AND arrived_at >= {sql.AS_OF_SQL}::DATE - coalesce(days, 7)) WHERE r <= 100),
judged AS (
  SELECT *, (mailbox, hash) IN (SELECT mailbox, hash FROM seen) AS processed,
    coalesce({sql.days_between('mark', 'received_at')} > 2, false) AS late FROM found)"""


@query(f"""{sql.MESSAGES}{sql.STATE}{_FOUND} SELECT {sql.FOLDER_UID} AS uid, j.mailbox, j.subject, md5(m.body_text) AS body_md5
    FROM judged j JOIN m USING (uid) WHERE NOT processed AND NOT late""")
def ingest_new(spark, sf):
    from ..operators.triage import with_fallback_body

    marks, recent = earlier_state(spark, sf)
    rows, bodies = corpus.folder_uids(corpus.headers(spark, sf)), corpus.folder_uids(corpus.messages(spark, sf))
    fresh = ingest.ingest_new(rows, bodies, recent, marks, corpus.as_of(), mailboxes=2)
    return with_fallback_body(fresh).select("uid", "mailbox", "subject", F.md5("body_text").alias("body_md5"))


@query(f"""{sql.HEADERS}{sql.STATE}{_FOUND} SELECT mailbox, count(*) AS fetched, count(*) FILTER (processed) AS already_processed,
    count(*) FILTER (NOT processed AND late) AS late, count(*) FILTER (NOT processed AND NOT late) AS new FROM judged GROUP BY mailbox""")
def ingest_counters(spark, sf):
    marks, recent = earlier_state(spark, sf)
    return ingest.ingest_counters(corpus.headers(spark, sf), recent, marks, corpus.as_of())


@query(f"""{sql.HEADERS}{sql.STATE} SELECT uid, {sql.days_between(sql.AS_OF_SQL, 'x.received_at')} + 1 AS days
    FROM h JOIN marks x USING (mailbox)
    WHERE h.arrived_at >= {sql.AS_OF_SQL}::DATE - ({sql.days_between(sql.AS_OF_SQL, 'x.received_at')} + 1)""")
def incremental_since(spark, sf):
    marks, _ = earlier_state(spark, sf)
    as_of = corpus.as_of()
    starts = marks.select("mailbox", ingest.look_back(F.col("received_at"), as_of).alias("days"))
    since = F.date_sub(F.to_date(as_of), F.col("days")).cast("timestamp")
    return corpus.headers(spark, sf).join(starts, "mailbox").where(F.col("arrived_at") >= since).select("uid", "days")


@query(f"""{sql.HEADERS} SELECT uid FROM h WHERE source_folder = '[Gmail]/All Mail'
    AND (mailbox, message_id) NOT IN (SELECT mailbox, message_id FROM h WHERE source_folder = 'INBOX')""")
def exclude_inbox(spark, sf):
    rows = corpus.headers(spark, sf)
    all_mail = rows.where(F.col("source_folder") == "[Gmail]/All Mail")
    return without_inbox(all_mail, rows.where(F.col("source_folder") == INBOX)).select("uid")
