"""State by manifests, and a mailbox that is rewritten folder by folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lettersift.operators import decide, state
from lettersift.rules import ALL_MAIL
from lettersift.sources import mailbox, manifests, tables
from lettersift.streaming import intervals

NOON = dt.datetime(2024, 1, 10, 12, tzinfo=dt.timezone.utc)
_COLUMNS = "uid long, mailbox string, hash string, date string, subject string, received_at timestamp"


def test_state_keeps_its_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SNAPSHOT_EVERY", 3)
    path = str(tmp_path / "state")
    assert tables.read_state(spark, path).count() == 0
    expected = {}
    for batch in range(11):
        before = tables.read_state(spark, path, before=batch)
        box = f"m{batch % 4}"
        rows = spark.createDataFrame([(batch, box, f"h{batch}", "d", f"s{batch}", NOON + dt.timedelta(days=batch))], _COLUMNS)
        touched = before if tables.is_snapshot(batch) else before.where(F.col("mailbox") == box)
        marks, recent = state.advance_state(rows, batch, tables.marks_of(touched), tables.recent_of(touched))
        for _ in range(2):  # a batch that runs again
            tables.write_state(tables.state_rows(marks, recent), path, batch)
        expected[box] = f"s{batch}"
        got = {r.mailbox: r.subject for r in tables.marks_of(tables.read_state(spark, path)).collect()}
        assert got == expected, batch
    assert tables.recent_of(tables.read_state(spark, path)).count() == 11
    assert manifests.versions(spark, path) == [6, 7, 8, 9, 10]
    assert sorted(n for n in manifests.names(spark, path) if n.startswith("version=")) == sorted(f"version={v}" for v in range(6, 11))
    last = manifests.manifest(spark, path, 10, tables._MANIFEST).first()
    assert (last.version, last.parent, last.snapshot) == (10, 9, False)
    assert {f.split("version=")[1].split("/")[0] for f in last.files} == {"9", "10"}


def test_half_written_and_missing_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda n: tables.state_rows(*state.advance_state(spark.createDataFrame([(n, "m", f"h{n}", "d", f"s{n}", NOON)], _COLUMNS), n))
    tables.write_state(rows(0), path, 0)
    tables.write_version(rows(1), path, 1)  # data without a manifest
    assert [r.subject for r in tables.marks_of(tables.read_state(spark, path)).collect()] == ["s0"]
    with pytest.raises(ValueError, match="version 1 is missing"):
        tables.read_state(spark, path, before=2)
    tables.write_state(rows(1), path, 1)
    assert tables.read_state(spark, path, before=2).count() == 1
    assert tables.read_state(spark, path, before=0).count() == 0


_MAIL = "uid long, mailbox string, source_folder string, flags array<string>, labels array<string>, body string"


def rows_of(df):
    return sorted((r.mailbox, r.source_folder, r.uid, tuple(r.flags or ()), tuple(r.labels or ()), r.body) for r in df.collect())


def test_update_rewrites_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "mail")
    mails = spark.createDataFrame(
        [(i, f"m{m}", folder, [], None, "b") for m in range(6) for folder in ("INBOX", ALL_MAIL, "Old/ä=1") for i in range(3)], _MAIL)
    mailbox.create_mailbox(mails, path)
    plan = spark.createDataFrame(
        [("m1", "INBOX", 0, "move_to_trash", None, True), ("m1", "INBOX", 1, "archive", None, True), ("m2", "INBOX", 0, "archive", None, False),
         ("m3", "Old/ä=1", 2, "apply_label", "L", True)],
        "mailbox string, source_folder string, uid long, planned_action string, planned_label string, apply boolean")
    for _ in range(2):  # running it again replaces it by the same
        new = mailbox.update_mailbox(spark, path, plan, 1, mails.schema)
        assert {(r.mailbox, r.source_folder) for r in new.collect()} == {("m1", "INBOX"), ("m1", ALL_MAIL), ("m3", "Old/ä=1")}
        assert rows_of(mailbox.read_mailbox(spark, path, mails.schema)) == rows_of(decide.apply_actions(mails, plan))
    assert rows_of(mailbox.read_mailbox(spark, path, mails.schema, 0)) == rows_of(mails)
    none = mailbox.update_mailbox(spark, path, plan.where("not apply"), 2, mails.schema)
    assert none.count() == 0
    assert rows_of(mailbox.read_mailbox(spark, path, mails.schema)) == rows_of(decide.apply_actions(mails, plan))
    # Everything of a folder leaves it.
    rest = spark.createDataFrame([("m0", "INBOX", i, "archive", None, True) for i in range(3)], plan.schema)
    rest = rest.withColumn("uid", F.col("uid"))
    mailbox.update_mailbox(spark, path, rest, 3, mails.schema)
    parts = {(r.mailbox, r.source_folder) for r in mailbox._parts_of(spark, path, 3).collect()}
    assert ("m0", "INBOX") not in parts and ("m0", ALL_MAIL) in parts
    assert mailbox.read_mailbox(spark, path, mails.schema).count() == mails.count()
    assert mailbox.drop_versions(spark, path, 3) == [2]
    assert mailbox.read_mailbox(spark, path, mails.schema).count() == mails.count()
    with pytest.raises(ValueError):
        mailbox.read_mailbox(spark, path, mails.schema, 1)


def test_intervals_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SNAPSHOT_EVERY", 3)
    out, start = str(tmp_path / "counts"), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    assert intervals.read_intervals(spark, out).count() == 0
    mark, totals, late = None, {}, {}
    for batch in range(8):
        ages = [batch * 20, batch * 20 + 1, max(0, batch * 20 - 70), max(0, batch * 20 - 90)]
        rows = [(start + dt.timedelta(minutes=m), "feed" if m % 2 else None) for m in ages] + [(None, "feed")]
        df = spark.createDataFrame(rows, "received_at timestamp, category string")
        for _ in range(2):  # a batch that runs again
            intervals.interval_batch(df, batch, out, delay="1 hour")
        for m in ages:
            interval = m // 15 * 15
            behind = mark is not None and interval + 15 + 60 <= mark
            (late if behind else totals)[interval] = (late if behind else totals).get(interval, 0) + 1
        mark = max([m for m in (mark, *ages) if m is not None])
        got = intervals.read_intervals(spark, out).collect()
        minute = lambda r: int((r.timestamp.replace(tzinfo=dt.timezone.utc) - start).total_seconds() // 60)
        assert {minute(r): r.total_emails for r in got if r.total_emails} == totals
        assert {minute(r): r.late_emails for r in got if r.late_emails} == late
    assert late and len([n for n in manifests.names(spark, out) if n.startswith("version=")]) <= 6
    with pytest.raises(ValueError):
        intervals.interval_batch(spark.createDataFrame([], "received_at timestamp, category string"), 20, out)


def test_a_plan_is_carried_out_once(spark, tmp_path):
    rows = spark.createDataFrame([("m", "INBOX", i, ["a"], None) for i in range(6)], "mailbox string, source_folder string, uid long, flags array<string>, labels array<string>")
    mailbox.create_mailbox(rows, str(tmp_path / "box"))
    judged = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def judge(uid):
        judged.add(1)
        return "archive" if uid % 2 else "none"

    plan = rows.select("mailbox", "source_folder", "uid", judge.asNondeterministic()("uid").alias("planned_action")).selectExpr(
        "*", "CAST(NULL AS STRING) AS planned_label", "planned_action <> 'none' AS apply")
    mailbox.update_mailbox(spark, str(tmp_path / "box"), plan, 1, rows.schema)
    assert judged.value == 6
    after = mailbox.read_mailbox(spark, str(tmp_path / "box"), rows.schema)
    assert sorted((r.uid, r.source_folder) for r in after.collect()) == [(i, "[Gmail]/All Mail" if i % 2 else "INBOX") for i in range(6)]
    assert not (tmp_path / "box" / "steps" / "version=1").exists()
