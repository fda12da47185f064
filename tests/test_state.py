"""Folders, limits, state, ingest, history, training sets and audit."""

import datetime as dt

from pyspark.sql import functions as F

from lettersift import rules as R
from lettersift.operators import classify, dataset, evaluate, filters, history, ingest, ml, scan, search, state, store
from lettersift.schemas import KEY
from lettersift.sources import tables

UTC = dt.timezone.utc
NOON = dt.datetime(2024, 1, 10, 12, tzinfo=UTC)
_COLUMNS = ("uid long, id string, mailbox string, source_folder string, message_id string, subject string, from_raw string, to_raw string, "
            "date string, received_at timestamp, size long, flags array<string>, hash string")


def header(uid, mailbox="m", folder="INBOX", message_id=None, at=NOON, date="d", flags=(), digest=None):
    return (uid, str(uid), mailbox, folder, f"<{uid}>" if message_id is None else message_id, f"s{uid}", "f", "t", date, at, 1, list(flags), digest)


def frame(spark, rows):
    df = spark.createDataFrame(rows, _COLUMNS)
    return df.withColumn("hash", F.coalesce("hash", F.md5("message_id")))


def empty_state(spark):
    return state.advance_state(frame(spark, []), 0)


def test_recent_hashes_keep_the_last_200(spark):
    rows = frame(spark, [header(i, digest=f"h{i}") for i in range(205)] + [header(300, digest="h204"), header(1, mailbox="n", digest="h0")])
    _, recent = state.advance_state(rows, 0)
    kept = {(r.mailbox, r.hash): r.seq for r in recent.collect()}
    assert {h for m, h in kept if m == "m"} == {f"h{i}" for i in range(5, 205)}
    assert kept[("m", "h204")] == 204 and ("n", "h0") in kept


def test_watermark_is_the_newest_and_first_on_ties(spark):
    later = NOON + dt.timedelta(hours=1)
    rows = [header(1, at=later), header(2, at=later), header(3), header(4, at=None, date=""), header(5, at=None, date="broken")]
    marks, recent = state.advance_state(frame(spark, rows), 0)
    assert [r.subject for r in marks.collect()] == ["s1"]
    # No date: remembered without moving the mark. Unreadable date: not remembered.
    import hashlib
    assert {r.hash for r in recent.collect()} == {hashlib.md5(f"<{i}>".encode()).hexdigest() for i in (1, 2, 3, 4)}
    again, _ = state.advance_state(frame(spark, [header(9, at=later)]), 1, marks, recent)
    assert [r.subject for r in again.collect()] == ["s1"]


def test_lateness_boundary(spark):
    marks, _ = state.advance_state(frame(spark, [header(1)]), 0)
    edge = NOON - dt.timedelta(days=3)
    rows = frame(spark, [header(1, at=edge), header(2, at=edge + dt.timedelta(seconds=1)), header(3, at=None), header(4, mailbox="n", at=edge)])
    assert sorted(r.uid for r in filters.drop_late(rows, marks).collect()) == [2, 3, 4]


def test_ingest_twice_yields_nothing_new(spark):
    rows = frame(spark, [header(i, at=NOON - dt.timedelta(minutes=i)) for i in range(30)] + [header(40, flags=["\\Seen"]), header(41, folder="Other")])
    bodies = rows.select(*KEY, F.lit("b").alias("body_text"))
    as_of = F.lit(NOON)
    marks, recent = empty_state(spark)
    first = ingest.ingest_new(rows, bodies, recent, marks, as_of, limit=20)
    assert sorted(r.uid for r in first.collect()) == list(range(10, 30))
    assert {r.body_text for r in first.collect()} == {"b"}
    marks, recent = state.advance_state(first, 1, marks, recent)
    assert ingest.ingest_new(rows, bodies, recent, marks, as_of, limit=20).count() == 0
    counters = ingest.ingest_counters(rows, recent, marks, as_of, limit=20).first()
    assert (counters.fetched, counters.already_processed, counters.late, counters.new) == (20, 20, 0, 0)


def test_messages_without_id_share_a_key(spark):
    marks, recent = state.advance_state(frame(spark, [header(1, message_id="")]), 0)
    rows = frame(spark, [header(2, message_id=""), header(3)])
    assert [r.uid for r in ingest.new_messages(rows, recent, marks).collect()] == [3]
    assert sorted(r.uid for r in ingest.new_messages(rows, recent, marks, null_id="keep").collect()) == [2, 3]


def test_state_table_round_trip_and_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert tables.read_state(spark, path).count() == 0
    marks, recent = state.advance_state(frame(spark, [header(1), header(2, mailbox="n")]), 0)
    tables.write_version(tables.state_rows(marks, recent), path, 0)
    marks, recent = state.advance_state(frame(spark, [header(3, at=NOON + dt.timedelta(days=1))]), 1, marks, recent)
    tables.write_version(tables.state_rows(marks, recent).where("mailbox = 'm'"), path, 1)
    latest = tables.read_state(spark, path)
    assert {(r.mailbox, r.subject) for r in tables.marks_of(latest).collect()} == {("m", "s3"), ("n", "s2")}
    assert tables.recent_of(latest).count() == 3
    assert {r.subject for r in tables.marks_of(tables.read_state(spark, path, before=1)).collect()} == {"s1", "s2"}
    assert tables.read_state(spark, path, before=0).count() == 0
    assert tables.recent_of(tables.read_state(spark, path, before=2)).count() == 3


def test_newest_with_large_and_small_limits(spark):
    rows = spark.range(5000).select(F.col("id").alias("uid"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("folder"))
    for n in (10, 1500):
        got = scan.newest(rows, ["folder"], n).groupBy("folder").agg(F.count("*").alias("n"), F.min("uid").alias("low")).collect()
        for r in got:
            uids = sorted((u for u in range(5000) if (u % 3 == 0) == (r.folder == "hot")), reverse=True)[:n]
            assert (r.n, r.low) == (len(uids), uids[-1])


def test_criteria(spark):
    rows = frame(spark, [header(1, at=dt.datetime(2024, 1, 5, tzinfo=UTC)), header(2, at=dt.datetime(2024, 1, 7, tzinfo=UTC)), header(3, flags=["\\Seen"])])
    uids = lambda df: sorted(r.uid for r in df.collect())
    assert uids(filters.select_messages(rows, start="2024-01-05", end="2024-01-07")) == [1]
    assert uids(filters.select_messages(rows, start="2024-01-06")) == [1, 2, 3]
    assert uids(filters.select_messages(rows, unread_only=True, days=0)) == [1, 2]
    assert uids(filters.select_messages(rows, days=3, as_of=F.lit(NOON))) == [2, 3]
    folders = spark.createDataFrame([("INBOX",), ("Binance",), ("trash",), ("My Spam",)], "source_folder string")
    assert sorted(r[0] for r in filters.kept_folders(folders).collect()) == ["INBOX", "trash"]


def test_first_nonempty(spark):
    rows = frame(spark, [header(1, folder="B"), header(2, folder="C"), header(3, mailbox="n", folder="C")])
    assert sorted(r.uid for r in scan.first_nonempty(rows, ["A", "B", "C"]).collect()) == [1, 3]


def with_bodies(df):
    return df.withColumns({"body_text": F.lit("Big sale, buy now"), "body_html": F.lit(""), "from_email": F.lit("a@b"), "from_name": F.lit("")})


def test_history_skips_trash_and_labels_targets(spark):
    rows = with_bodies(frame(spark, [header(1), header(1, folder="Promotions"), header(2, folder="[Gmail]/Trash")]))
    rows = rows.withColumn("body_text", F.when(F.col("source_folder") == "INBOX", "hello").otherwise(F.col("body_text")))
    judged = history.process_historical(rows, "2024-01-01", "2024-02-01", ["promotions"], R.Settings())
    assert {(r.source_folder, r.new_label) for r in judged.collect()} == {("INBOX", None), ("Promotions", "MarkedForDeletion")}
    assert tuple(history.historical_counts(judged).first()) == (2, 1)


def test_training_folders(spark):
    all_mail, trash = R.ALL_MAIL_NAMES[2], R.TRASH_NAMES[0]
    rows = [header(i) for i in range(10)] + [header(100 + i, folder=all_mail, message_id=f"<{i}>") for i in range(20)]
    rows += [header(200, folder=trash), header(201, folder=R.TRASH_NAMES[2])]
    chosen = dataset.training_folders(frame(spark, rows), 6).collect()
    parts = {p: sorted(r.uid for r in chosen if r.part == p) for p in ("INBOX", "All Mail", "Trash")}
    # The newest 12 of all mail are 108 to 119; 108 and 109 are among the inbox's newest 6.
    assert parts == {"INBOX": [4, 5, 6, 7, 8, 9], "All Mail": [114, 115, 116, 117, 118, 119], "Trash": [200]}


def test_log_row_golden(spark):
    row = spark.createDataFrame([("123", "d", "a@b", "N", "S", "This is a test body.\nWith newlines.", "promotions", 0.95, None)],
                                "id string, date string, from_email string, from_name string, subject string, body_text string, category string, confidence double, source_folder string")
    got = store.classified_log_rows(row, F.lit(NOON)).first()
    assert (got.id, got.label, got.confidence, got.body_text, got.source_folder, got.processing_state) == (
        "123", "promotions", 0.95, "This is a test body. With newlines.", "", "classified")


def test_message_records_take_defaults(spark):
    got = store.message_records(spark.createDataFrame([("7", "S")], "id string, subject string"), F.lit(NOON)).first()
    assert (got.id, got.hash, got.subject, got.body_text, got.size, got.has_attachments, got.attachments, got.processing_state) == (
        "7", "7", "S", "", 0, False, [], "new")


def test_retention_uses_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, NOON), (2, NOON - dt.timedelta(days=89)), (3, NOON - dt.timedelta(days=91))], "uid long, saved_at timestamp").withColumn("mailbox", F.lit("m"))
    for _ in range(2):
        tables.write_log(rows, str(tmp_path / "log"), 0)
    kept = store.retention(spark.read.parquet(str(tmp_path / "log")), 90, F.lit(NOON))
    assert sorted(r.uid for r in kept.collect()) == [1, 2]
    assert "isnotnull(saved_date" in kept._jdf.queryExecution().executedPlan().toString()


def test_metrics_against_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    pairs = [(a, p) for a in range(4) for p in range(4) for _ in range((a * 5 + p * 3) % 4)]
    df = spark.createDataFrame([(float(a), float(p)) for a, p in pairs], "actual double, predicted double")
    got = evaluate.weighted_metrics(df).first()
    for name, metric in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        value = MulticlassClassificationEvaluator(labelCol="actual", predictionCol="predicted", metricName=metric).evaluate(df)
        assert abs(got[name] - value) < 1e-9
    assert evaluate.weighted_metrics(df.limit(0)).first().accuracy == 0.0
    matrix = evaluate.confusion_matrix(df.withColumn("predicted", F.lit("feed")).withColumn("actual", F.lit("inbox")))
    assert matrix.columns == ["actual", *R.CATEGORIES] and {tuple(r) for r in matrix.collect()} == {
        (c, 0, len(pairs) if c == "inbox" else 0, 0, 0) for c in R.CATEGORIES}


def test_audit_of_own_log_matches(spark):
    rows = spark.createDataFrame([(i, f"Sale {i}", "Buy now  " * i, "a@b", "N") for i in range(20)], "uid long, subject string, body_text string, from_email string, from_name string")
    log = store.audit_log_rows(classify.classify_rules(rows), F.lit(NOON))
    got = evaluate.consistency_audit(log).first()
    assert (got.total, got.matches, got.match_rate) == (20, 20, 1.0)
    broken = evaluate.replay(log.withColumn("input_string", F.lit("nothing"))).first()
    assert broken.replayed_category is None and not broken.is_match


def test_model_falls_back_per_row(spark):
    rows = with_bodies(spark.range(4).select(F.col("id").alias("uid"), F.lit("Sale").alias("subject")))
    scorer = lambda df: df.withColumn("probabilities", F.when(F.col("uid") % 2 == 0, F.array(F.lit(0.1), F.lit(0.7), F.lit(0.1), F.lit(0.1))))
    got = {r.uid: (r.category, r.method, r.confidence) for r in ml.classify_model(rows, scorer=scorer, method="model (custom)").collect()}
    assert got[0] == ("feed", "model (custom)", 0.7) and got[1][:2] == ("promotions", "rules")
    assert {r.method for r in ml.classify_model(rows).collect()} == {"rules"}


def test_train_and_select(spark):
    words = {"transactions": "invoice payment", "feed": "digest weekly", "promotions": "sale offer", "inbox": "hello friend"}
    rows = spark.createDataFrame([(i, f"{words[c]} {i}", c) for i, c in enumerate(R.CATEGORIES * 30)], "uid long, text string, label string").withColumns({"mailbox": F.lit("m"), "source_folder": F.lit("INBOX")})
    model, metrics = ml.select_classifier(rows, reg_params=(0.01, 0.1))
    assert metrics.first().f1 > 0.95
    assert [len(r.probabilities) for r in ml.model_scores(rows.limit(2), model).collect()] == [4, 4]


def test_search(spark):
    rows = frame(spark, [header(i, folder="A" if i % 2 else "B") for i in range(30)]).withColumn("body_text", F.lit("x\r\ny"))
    got = search.search_messages(rows, limit=3, with_body=True, subject="S", from_date="2024-01-10", to_date="2024-01-11").collect()
    assert sorted(r.uid for r in got) == [24, 25, 26, 27, 28, 29] and {r.preview for r in got} == {"x y"}
    assert {r.source_folder: r.matches for r in search.search_counts(rows, sender="F", folder="A").collect()} == {"A": 15}
