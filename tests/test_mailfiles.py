"""Mail files as a source: ranges of mbox files, header-only reading, uids that stay, late bodies, streams."""

import io
import os
import random

from pyspark.sql import functions as F

from lettersift.sources import mailfiles, mime


def mail(i, body="text", subject=None):
    return (f"Message-ID: <{i}>\nSubject: {subject or f's{i}'}\nFrom: a@b.c\nTo: d@e.f\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\n{body}\n").encode()


def mbox(mails):
    quoted = (b"\n".join(b">" + line if line.lstrip(b">").startswith(b"From ") else line for line in m.split(b"\n")) for m in mails)
    return b"".join(b"From x Mon Jan  1 10:00:00 2024\n" + m + b"\n" for m in quoted)


def write(path, data, age):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as file:
        file.write(data)
    os.utime(path, (age, age))


def test_ranges_give_every_mail_once():
    rng = random.Random(1)
    bodies = ["", "a\n\nFrom here on\nb", "From start", "\n\n\n", "x" * 50, ">From quoted\n\n>>From more"]
    mails = [mail(i, rng.choice(bodies)) for i in range(30)]
    data = mbox(mails)
    for step in (1, 7, 60, 1000, len(data)):
        found = [m for first in range(0, len(data), step)
                 for m in mailfiles.mbox_mails(io.BufferedReader(io.BytesIO(data)), first, min(len(data), first + step), False)]
        assert [raw for *_, raw in found] == [m + b"\n" for m in mails], step
        assert all(data[p:p + n].startswith(b"Message-ID") for p, n, _ in found)
    heads = list(mailfiles.mbox_mails(io.BufferedReader(io.BytesIO(data)), 0, len(data), True))
    assert [raw for *_, raw in heads] == [m[: m.index(b"\n\n") + 2] for m in mails]
    assert list(mailfiles.mbox_mails(io.BufferedReader(io.BytesIO(b"")), 0, 0, False)) == []


def test_header_scan_reads_no_bodies():
    class Counting(io.BytesIO):
        taken = 0

        def readinto(self, into):
            n = super().readinto(into)
            Counting.taken += n
            return n

    data = mail(1, "b" * 5_000_000)
    head = mailfiles.eml_mail(io.BufferedReader(Counting(data), 1 << 16), len(data), True)
    assert head == data[: data.index(b"\n\n") + 2] and Counting.taken <= 1 << 16


def test_files_dealt_by_size():
    files = [("a.eml", 1, 10), ("b.eml", 2, 500), ("c.mbox", 3, 250), ("d.eml", 4, 0)]
    parts = [p.parts for p in mailfiles.deal(files, 100)]
    assert [x for p in parts for x in p] == [
        ("a.eml", 1, 0, 10), ("b.eml", 2, 0, 500), ("c.mbox", 3, 0, 100), ("c.mbox", 3, 100, 200), ("c.mbox", 3, 200, 250), ("d.eml", 4, 0, 0)]
    assert mailfiles.deal([], 100) == []


def test_uids_stay_and_bodies_come_late(spark, tmp_path):
    top, table = str(tmp_path / "mail"), str(tmp_path / "uids")
    write(f"{top}/INBOX/b.eml", mail(2, "two"), 200)
    write(f"{top}/INBOX/a.eml", mail(3, "three"), 300)
    write(f"{top}/Old/old.mbox", mbox([mail(10, "ten"), mail(11, "From eleven")]), 100)
    heads = mailfiles.mail_files(spark, top, "me", headers_only=True, partitionBytes=64)
    assert all(b"two" not in r.raw and b"ten" not in r.raw for r in heads.collect())
    rows = mime.parse_headers(mailfiles.number_mails(heads, table, 0))
    got = {(r.source_folder, r.uid): r.subject for r in rows.collect()}
    assert got == {("INBOX", 1): "s2", ("INBOX", 2): "s3", ("Old", 1): "s10", ("Old", 2): "s11"}
    # One file goes, one comes that is older than the others: the rest keep their numbers.
    os.remove(f"{top}/INBOX/b.eml")
    write(f"{top}/INBOX/c.eml", mail(1, "one"), 50)
    for _ in range(2):  # a version that is written again replaces itself
        rows = mime.parse_headers(mailfiles.number_mails(mailfiles.mail_files(spark, top, "me", True), table, 1))
        got = {(r.source_folder, r.uid): r.subject for r in rows.collect()}
        assert got == {("INBOX", 2): "s3", ("INBOX", 3): "s1", ("Old", 1): "s10", ("Old", 2): "s11"}
    chosen = mailfiles.with_raw(rows.where("uid >= 2").select("mailbox", "source_folder", "uid", "path", "position", "length"))
    bodies = mime.parse_all(chosen.withColumn("flags", F.array().cast("array<string>")), F.lit("2024-02-01").cast("timestamp"))
    assert {r.uid: r.body_text for r in bodies.where("source_folder = 'INBOX'").collect()} == {2: "three", 3: "one"}
    assert [r.body_text for r in bodies.where("source_folder = 'Old'").collect()] == ["From eleven"]


def test_stream_takes_new_files(spark, tmp_path):
    top, out = str(tmp_path / "mail"), str(tmp_path / "out")
    write(f"{top}/INBOX/a.eml", mail(1), 100)

    def run():
        query = (mailfiles.mail_file_stream(spark, top, "me", True).select("path", "position").writeStream.format("parquet")
                 .option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).start())
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(out).collect())

    assert run() == ["a.eml"]
    write(f"{top}/INBOX/b.eml", mail(2), 200)
    write(f"{top}/INBOX/c.mbox", mbox([mail(3), mail(4)]), 200)
    assert run() == ["a.eml", "b.eml", "c.mbox", "c.mbox"]
