"""Reading raw mail and files, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lettersift import rules as R
from lettersift.sources import corpus, files, mime
from lettersift.streaming import jobs

PLAIN = (b"Message-ID: <test123@example.com>\r\nFrom: John Doe <john.doe@example.com>\r\nTo: me@x.y\r\n"
         b"Subject: =?utf-8?B?R3LDvMOfZQ==?=\r\nDate: Mon, 20 Nov 2023 10:00:00 +0000\r\n"
         b"Content-Type: text/plain; charset=utf-8\r\n\r\n  This is a test.\r\nSecond line. \r\n")
HTML = b"From: a@b.c\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\xe9 &amp; bar</p><script>x</script>"
MULTI = (b'Subject: m\r\nContent-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/html\r\n\r\n<b>h</b>\r\n'
         b"--b\r\nContent-Type: text/plain; charset=no-such\r\n\r\nt\r\n--b--\r\n")


def test_parse_mails(spark):
    raw = spark.createDataFrame([(1, bytearray(PLAIN)), (2, bytearray(HTML)), (3, bytearray(MULTI)), (4, None)], "uid long, raw binary")
    got = {r.uid: r for r in mime.parse_all(raw, F.lit("2023-11-25 09:00:00").cast("timestamp")).collect()}
    one = got[1]
    assert (one.from_name, one.from_email, one.subject, one.body_text) == ("John Doe", "john.doe@example.com", "Grüße", "This is a test.\r\nSecond line.")
    assert (str(one.received_at), one.age_days, one.size, one.parse_error) == ("2023-11-20 10:00:00", 4, len(PLAIN), None)
    assert (got[2].body_text, got[2].message_id, got[2].received_at) == ("café & bar", "", None)
    # A text part that cannot be decoded counts as empty, so the HTML is used.
    assert (got[3].body_text, got[3].body_html) == ("h", "<b>h</b>")
    assert got[4].parse_error == "no raw message" and got[4].hash is None and got[4].body_text == ""
    good, bad = mime.parse_messages(raw, F.lit("2023-11-25").cast("timestamp"))
    assert (good.count(), bad.count()) == (3, 1)


def test_header_rows_and_mail_files(spark, tmp_path):
    (tmp_path / "INBOX").mkdir()
    (tmp_path / "INBOX" / "1.eml").write_bytes(PLAIN.replace(b"To: me@x.y", b"Content-Length: 77"))
    (tmp_path / "INBOX" / "2.eml").write_bytes(HTML.replace(b"From: a@b.c\r\n", b""))
    (tmp_path / "INBOX" / "note.txt").write_bytes(b"x")
    raw = mime.read_mail_files(spark, str(tmp_path), "me")
    got = {r.id: r for r in mime.parse_headers(raw).collect()}
    assert (got["1.eml"].subject, got["1.eml"].size, got["1.eml"].source_folder, got["1.eml"].mailbox) == ("Grüße", 77, "INBOX", "me")
    assert (got["2.eml"].subject, got["2.eml"].from_raw, got["2.eml"].size, got["2.eml"].received_at) == ("No Subject", "Unknown", 0, None)
    parsed = {r.id: r for r in mime.parse_all(raw, F.lit("2023-11-25").cast("timestamp")).collect()}
    assert parsed["1.eml"].from_email == "john.doe@example.com" and len(parsed) == 2


ROW = ("1", "d", "a@b", 'He said "hi", twice', "s", "line1\nline2", "feed", 0.9, "INBOX")


def test_csv_round_trip_drops_unlabelled(spark, tmp_path):
    rows = spark.createDataFrame([ROW, ROW[:6] + ("", 0.1, "INBOX")], files.TRAINING_ROW)
    files.write_csv(rows, str(tmp_path / "csv"))
    assert [tuple(r) for r in files.read_dataset_csv(spark, str(tmp_path / "csv")).collect()] == [ROW]


@pytest.mark.parametrize("wrap", [lambda rows: rows, lambda rows: {"emails": rows, "metadata": {"total_emails": 1}}])
def test_json_documents(spark, tmp_path, wrap):
    names = [f.split()[0] for f in files.TRAINING_ROW.split(", ")]
    path = tmp_path / "d.json"
    path.write_text(json.dumps(wrap([dict(zip(names, ROW))]), indent=1))
    assert [tuple(r) for r in files.read_dataset_json(spark, str(path)).collect()] == [ROW]
    path.write_text(json.dumps({"metadata": {}}))
    assert files.read_dataset_json(spark, str(path)).count() == 0


def arrive(spark, folder, ids, name):
    rows = spark.createDataFrame([(i, f"text {i}", "en", "src1", 7) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def stream(spark, folder, files_per_batch=None):
    reader = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    return corpus.message_rows(reader.parquet(f"{folder}/in"), pages)


def run(spark, folder):
    query = jobs.triage_stream(stream(spark, folder, 1), corpus.SETTINGS, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out/messages")


def test_stream_remembers_across_batches_and_restarts(spark, tmp_path):
    folder = str(tmp_path)
    arrive(spark, folder, range(100, 120), "a")
    first = run(spark, folder)
    ids = {r.uid for r in first.collect()}
    # 111 has the key of 110 (111 % 13 = 7): repeats inside one batch stay, as state moves only afterwards.
    assert ids == set(range(100, 120))
    arrive(spark, folder, list(range(110, 120)) + list(range(200, 205)), "b")
    second = run(spark, folder)
    assert second.count() == len(ids) + 5 and {r.uid for r in second.where("version > 0").collect()} == set(range(200, 205))
    # Batches of long ago are late: the mark now stands at message 204.
    arrive(spark, folder, [10, 206], "c")
    third = run(spark, folder).where("version = 2")
    assert [r.uid for r in third.collect()] == [206]
    stats = spark.read.parquet(f"{folder}/out/run_stats").orderBy("version").collect()
    assert [r.total_emails for r in stats] == [20, 5, 1]


def test_batch_can_be_repeated(spark, tmp_path):
    documents = spark.createDataFrame([(i, "t", "en", "src1", 7) for i in range(100, 110)], "doc_id long, text string, lang string, source string, n_chars long")
    batch = corpus.message_rows(documents, spark.createDataFrame([], "page_id long, url string, html string"))
    for _ in range(2):
        jobs.triage_batch(batch, 0, corpus.SETTINGS, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/messages").count() == 10
    jobs.triage_batch(batch, 1, corpus.SETTINGS, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/messages").count() == 10


def test_snapshots_hold_every_mailbox(spark, tmp_path, monkeypatch):
    from lettersift.sources import tables

    monkeypatch.setattr(tables, "SNAPSHOT_EVERY", 2)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for batch_id, source in enumerate(["src1", "src77", "src77", "src77"]):
        documents = spark.createDataFrame([(1000 + batch_id, "t", "en", source, 7)], "doc_id long, text string, lang string, source string, n_chars long")
        jobs.triage_batch(corpus.message_rows(documents, pages), batch_id, corpus.SETTINGS, str(tmp_path))
    counts = {r.version: r.n for r in spark.read.parquet(f"{tmp_path}/state").groupBy("version").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 1, 1: 1, 2: 2, 3: 1}
    state = tables.read_state(spark, f"{tmp_path}/state", before=4)
    assert {r.mailbox: len(r.recent) for r in state.collect()} == {"personal": 1, "work": 3}


def test_stream_dedup_and_windows(spark, tmp_path):
    folder = str(tmp_path)
    arrive(spark, folder, [100, 101, 110, 111], "a")
    rows = jobs.dedup_stream(stream(spark, folder)).select("uid", "hash")
    query = rows.writeStream.format("memory").queryName("dedup").trigger(availableNow=True).option("checkpointLocation", f"{folder}/c1").start()
    query.awaitTermination()
    kept = {r.uid for r in spark.table("dedup").collect()}
    assert len(kept) == 3 and {100, 101} <= kept
    judged = stream(spark, folder).withColumn("category", F.lit(R.CATEGORIES[0]))
    stats = jobs.windowed_stats_stream(judged)
    query = stats.writeStream.outputMode("complete").format("memory").queryName("stats").trigger(availableNow=True).option("checkpointLocation", f"{folder}/c2").start()
    query.awaitTermination()
    assert sum(r.transactions for r in spark.table("stats").collect()) == 4


def test_batches_are_small_in_a_session_of_the_caller(spark, sf):
    """Only a session of build_session had small batches; others sent 10,000 raw mails to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        queries()["dq_parse_failures"](spark, sf)
        assert int(spark.conf.get(key)) <= 2000
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "16m"
    finally:
        spark.conf.set(key, before)
