"""Messages of equal uid in several folders, messages without dates, flags or ids, and state that is damaged."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from lettersift import rules as R
from lettersift.operators import bayes, dataset, decide, filters, ingest, scan, search, state
from lettersift.schemas import KEY
from lettersift.session import shared_dir
from lettersift.sources import mime, tables
from lettersift.streaming import jobs
from test_state import NOON, empty_state, frame, header, with_bodies


def test_bodies_are_those_of_the_folder(spark):
    rows = frame(spark, [header(1), header(1, folder="All"), header(2, folder="All")])
    bodies = rows.select(*KEY, F.concat("source_folder", F.lit("-"), "uid").alias("body_text"))
    marks, recent = empty_state(spark)
    got = ingest.ingest_new(rows, bodies, recent, marks, F.lit(NOON)).collect()
    assert [(r.uid, r.body_text) for r in got] == [(1, "INBOX-1")]
    assert scan.fetch_bodies(rows, bodies, most=3).count() == 3


def test_actions_touch_one_folder_and_archived_mail_is_not_deleted(spark):
    box = spark.createDataFrame([("m", "INBOX", 1, None, None), ("m", "All", 1, ["x"], None), ("m", "INBOX", 2, [], None), ("m", "INBOX", 3, [], ["l"])],
                                "mailbox string, source_folder string, uid long, flags array<string>, labels array<string>")
    plan = spark.createDataFrame([("m", "INBOX", 1, "archive", None, True), ("m", "INBOX", 2, "apply_label", "Later", True),
                                  ("m", "INBOX", 3, "move_to_trash", None, True), ("m", "INBOX", 3, "move_to_trash", None, True)],
                                 "mailbox string, source_folder string, uid long, planned_action string, planned_label string, apply boolean")
    after = sorted((r.uid, r.source_folder, r.flags, r.labels) for r in decide.apply_actions(box, plan).collect())
    assert after == sorted([(1, R.ALL_MAIL, [R.SEEN], None), (1, "All", ["x"], None), (2, "INBOX", [], ["Later"]),
                            (3, "INBOX", [R.DELETED, R.SEEN], ["l", R.TRASH_LABEL])], key=lambda r: r[:2])
    read = decide.mark_as_read(box, plan.where("uid = 1")).collect()
    assert {(r.source_folder, tuple(r.flags or [])) for r in read if r.uid == 1} == {("INBOX", (R.SEEN,)), ("All", ("x",))}


def test_split_tells_folders_apart(spark):
    rows = spark.range(200).select(F.col("id").alias("uid"), F.lit("m").alias("mailbox"), F.lit("A").alias("source_folder"))
    both = dataset.train_val_split(rows).join(dataset.train_val_split(rows.withColumn("source_folder", F.lit("B"))).select(
        "uid", F.col("split").alias("other")), "uid")
    assert both.where("split != other").count() > 20


def test_undated_and_unflagged_messages_are_kept(spark):
    rows = frame(spark, [header(1, at=None, date="garbage"), header(2), header(3, at=NOON - dt.timedelta(days=60))]).withColumn(
        "flags", F.when(F.col("uid") != 2, F.col("flags")))
    uids = lambda df: sorted(r.uid for r in df.collect())
    assert uids(filters.unread(rows)) == [1, 2, 3]
    assert uids(filters.date_range(rows, "2024-01-09", "2024-01-11")) == [1, 2]
    assert uids(filters.since_days(rows, 5, F.lit(NOON))) == [1, 2]
    assert uids(search.matching(rows, from_date="2024-01-09")) == [1, 2]
    marks, recent = empty_state(spark)
    assert uids(ingest.ingest_new(rows, rows.select(*KEY, F.lit("b").alias("body_text")), recent, marks, F.lit(NOON))) == [1, 2]
    # The server's arrival date decides where there is one.
    arrived = rows.withColumn("arrived_at", F.when(F.col("uid") == 1, F.lit(NOON - dt.timedelta(days=90))))
    assert uids(filters.since_days(arrived, 5, F.lit(NOON))) == [2]


def test_messages_without_id_in_one_batch(spark):
    rows = frame(spark, [header(1, message_id=""), header(2, message_id=""), header(3), header(4, message_id="<3>")])
    bodies = rows.select(*KEY, F.lit("b").alias("body_text"))
    marks, recent = empty_state(spark)
    def run(**options):
        return sorted(r.uid for r in ingest.ingest_new(rows, bodies, recent, marks, F.lit(NOON), dedup_within_batch=True, **options).collect())
    assert run(null_id="keep") == [1, 2, 3] and run() == [1, 3]


def test_stream_passes_undated_messages(spark, tmp_path):
    rows = with_bodies(frame(spark, [header(1), header(2, message_id="<1>"), header(3, at=None), header(4, at=None, message_id="<3>"),
                                     header(5, message_id=""), header(6, message_id="")]))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for null_id, expected in (("drop", [1, 3, 4, 5]), ("keep", [1, 3, 4, 5, 6])):
        stream = jobs.dedup_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), null_id=null_id)
        run = (stream.select("uid").writeStream.format("parquet").option("path", str(tmp_path / f"out-{null_id}"))
               .option("checkpointLocation", str(tmp_path / f"cp-{null_id}")).trigger(availableNow=True).start())
        run.awaitTermination()
        got = sorted(r.uid for r in spark.read.parquet(str(tmp_path / f"out-{null_id}")).collect())
        assert len(got) == len(expected) and {3, 4} <= set(got)


def test_a_missing_state_version_is_an_error(spark, tmp_path):
    path = str(tmp_path / "state")
    marks, recent = None, None
    for i in range(4):
        marks, recent = state.advance_state(frame(spark, [header(i, at=NOON + dt.timedelta(days=i))]), i, marks, recent)
        tables.write_version(tables.state_rows(marks, recent), path, i)
    assert tables.marks_of(tables.read_state(spark, path, before=4)).first().subject == "s3"
    assert tables.marks_of(tables.read_state(spark, path)).first().subject == "s3"
    shutil.copytree(f"{path}/version=0", f"{path}2/version=0")
    shutil.copytree(f"{path}/version=1", f"{path}2/version=1")
    shutil.copytree(f"{path}/version=3", f"{path}2/version=3")
    with pytest.raises(ValueError, match="2"):
        tables.read_state(spark, f"{path}2", before=4)
    assert tables.marks_of(tables.read_state(spark, f"{path}2", before=2)).first().subject == "s1"
    assert tables.read_state(spark, str(tmp_path / "none"), before=4).count() == 0


def test_a_run_can_be_repeated_and_an_empty_one_leaves_a_record(spark, tmp_path):
    rows = with_bodies(frame(spark, [header(i) for i in range(5)]))
    out = str(tmp_path / "run")
    def run(batch_id):
        jobs.run_once(rows.drop("body_text", "body_html"), rows, R.Settings(), out, batch_id, F.lit(NOON), F.lit(NOON), F.lit(NOON + dt.timedelta(seconds=3)))
    run(0)
    run(0)
    assert spark.read.parquet(f"{out}/classified_log").count() == 5 and spark.read.parquet(f"{out}/audit_log").count() == 5
    run(1)
    records = {r.version: (r.total_emails, r.duration_seconds) for r in spark.read.parquet(f"{out}/run_stats").collect()}
    assert records == {0: (5, 3.0), 1: (0, 3.0)}
    assert tables.recent_of(tables.read_state(spark, f"{out}/state")).count() == 5


def test_another_checkpoint_does_not_mix_with_an_old_run(spark, tmp_path):
    jobs.claim_folder(spark, str(tmp_path / "out"), "a")
    jobs.claim_folder(spark, str(tmp_path / "out"), "a")
    with pytest.raises(ValueError):
        jobs.claim_folder(spark, str(tmp_path / "out"), "b")


def test_mail_files_are_numbered_by_arrival(spark, tmp_path):
    import os

    for i, name in enumerate(["c", "a", "b"]):
        file = tmp_path / "INBOX" / f"{name}.eml"
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(b"Subject: x\n\nbody")
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    got = {r.id: r.uid for r in mime.read_mail_files(spark, str(tmp_path), "m").collect()}
    assert got == {"c.eml": 1, "a.eml": 2, "b.eml": 3}


def test_a_body_that_fails_leaves_the_header(monkeypatch):
    class Broken:
        def parsebytes(self, raw):
            raise RuntimeError("no body")

    monkeypatch.setattr(mime, "_parser", Broken())
    got = mime.read_parts(b"Message-ID: <1>\nSubject: s\nFrom: a@b\nDate: d\n\nx")
    assert got == ("<1>", "s", "a@b", "", "d", "", "", "no body")


@pytest.mark.parametrize("raw", [
    b"Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nunclosed",
    b"Content-Type: text/plain; charset=nosuch\n\ntext", b"Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n!!!",
    b"Content-Type: multipart/mixed\n\nno boundary", b"Content-Type: ;;;\n\nx", b"Subject: =?utf-8?q?a=?=\nContent-Type: text/html\n\n<p>h</p>",
    b"broken header line\nSubject: x\n\nbody", b"\n\n\n", b"Content-Type: text/plain; charset=utf-8\n\n\xff\xfe bytes",
])
def test_damaged_mails_read_as_by_the_careful_parser(monkeypatch, raw):
    fast = mime.read_parts(raw)
    monkeypatch.setattr(mime, "_parser", mime._careful_parser)
    assert fast == mime.read_parts(raw)


def test_naive_bayes_by_hand(spark):
    rows = spark.createDataFrame([(1, "a a b", "x"), (2, "b c", "y"), (3, "c", "y")], "uid long, text string, label string")
    key = {"mailbox": F.lit("m"), "source_folder": F.lit("f")}
    model = bayes.fit(rows.withColumns(key))
    asked = spark.createDataFrame([(1, "a", None), (2, "c c", None), (3, "unknown", None), (4, "", None)], "uid long, text string, label string")
    got = {r.uid: r.predicted for r in bayes.predict(asked.withColumns(key), model).collect()}
    assert got == {1: "x", 2: "y", 3: "y", 4: "y"}


def test_no_jobs_while_building(spark, sf):
    """Building a query runs nothing, but for streams, files, fits, and values read from a table once."""
    from __spark_entry__ import LLM_QUERIES, queries

    allowed = {"stream_triage", "stream_dedup", "read_state", "read_dataset_csv", "read_dataset_json", "read_dataset_json_forms", "run_once", "run_log",
               "retention_partitioned", "train_linear", "select_linear", "classify_linear", "retention", "stream_remembered", "train_epochs", "update_mailbox", "stream_run_stats",
               "keyword_scores_large", "topic_hits_large", "sender_wildcard_large", "scan_headers_files", "late_materialize_files"}
    tracker = spark.sparkContext.statusTracker()
    for name, build in queries().items():
        if name in allowed or name in LLM_QUERIES:
            continue
        group = f"build-{name}"
        spark.sparkContext.setJobGroup(group, name)
        build(spark, sf)
        jobs_run = [j for j in tracker.getJobIdsForGroup(group)]
        # Reading the schema of a parquet table is a job of its own.
        assert len(jobs_run) <= 8, (name, len(jobs_run))
    spark.sparkContext.setJobGroup(None, None)


def test_shared_folder_of_a_local_session(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
