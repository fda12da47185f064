"""Automatons over term tables, patterns by their rarest piece, and bounded state on a stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lettersift import rules as R
from lettersift.functions.text import is_token, words
from lettersift.operators import automaton, classify, ingest, senders, state, topics
from lettersift.sources import corpus
from lettersift.streaming import remembered


def test_found_terms_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abÉ🙂 %", k=rng.randrange(1, 5))) for _ in range(60)]
    texts = [None, "", *("".join(rng.choices("abÉ🙂 %", k=rng.randrange(40))) for _ in range(80)), "ab" * 50_000]
    terms = spark.createDataFrame([(w, i % 3) for i, w in enumerate(words)] + [("", 1), (None, 2), (words[0], 9)], "term string, kind int")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumns({"found": F.lit(1), "term": F.lit(2)})
    rows = {(t, k) for t, k in terms.collect() if t}
    for pass_bytes in (16_000_000, 40):
        got = automaton.with_found_terms(df, "text", terms, "term", ("kind",), "hits", pass_bytes)
        for r in got.collect():
            assert len(r.hits) == len(set(r.hits)) and {tuple(h) for h in r.hits} == {x for x in rows if x[0] in (texts[r.i] or "")}
    assert len(automaton.split_terms(terms, "term", ("kind",), 40)) > 3
    none = automaton.with_found_terms(df, "text", terms.where("kind > 99"), "term", ("kind",), "hits")
    assert all(r.hits == [] for r in none.collect())


def test_scanned_forms_equal_joined_forms(spark, sf):
    rows = corpus.messages(spark, sf)
    table = R.keyword_rules_table(spark)
    scanned, joined = (
        sorted(map(tuple, f(rows, table, ("uid",)).collect())) for f in (classify.keyword_scores_scanned, classify.keyword_scores_joined))
    assert scanned == joined
    terms = R.topic_terms_table(spark, corpus.SETTINGS.topics)
    assert sorted(map(tuple, topics.topic_scores_scanned(rows, terms, ("uid",)).collect())) == sorted(
        map(tuple, topics.topic_scores(rows, terms, ("uid",)).collect()))


def test_scanning_shuffles_nothing(spark, sf):
    plan = classify.keyword_scores_scanned(corpus.headers(spark, sf).withColumn("body_text", F.lit("b")), R.keyword_rules_table(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_candidates_by_the_rarest_piece_are_few(spark):
    rng = random.Random(2)
    names = [f"{rng.choice(['ann', 'bob', 'mack'])}{i}@mail{rng.randrange(5)}.{rng.choice(['com', 'org'])}" for i in range(3000)]
    patterns = [f"*{i}@*.com" for i in range(0, 20_000, 2)] + ["*com", "*mail*", "*a*k*", "none*com", "*_%*"]
    addresses = spark.createDataFrame([(n,) for n in [*names, "a_%b@mail1.com"]], "sender string")
    rules = spark.createDataFrame([("deny", p) for p in patterns], "list string, pattern string")
    matches = senders.wildcard_matches_scanned(addresses, rules)
    expected = senders.wildcard_matches(addresses, rules)
    assert sorted(map(tuple, matches.collect())) == sorted(map(tuple, expected.collect()))
    candidates = senders.wildcard_candidates(addresses, rules).count()
    assert candidates <= 5 * matches.count()


def test_bare_star_and_empty_rules(spark):
    addresses = spark.createDataFrame([("a@b.c",), ("",)], "sender string")
    rules = spark.createDataFrame([("allow", "**"), ("deny", "*@b.c"), ("deny", "x")], "list string, pattern string")
    got = sorted(map(tuple, senders.wildcard_matches_scanned(addresses, rules).collect()))
    assert got == [("allow", "", "**"), ("allow", "a@b.c", "**"), ("deny", "a@b.c", "*@b.c")]
    assert senders.wildcard_matches_scanned(addresses, rules.limit(0)).count() == 0


_COLUMNS = "uid long, mailbox string, source_folder string, message_id string, date string, received_at timestamp, subject string"


def test_bounded_state_equals_batch_state(spark, tmp_path):
    rng, start = random.Random(3), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    batches, uid = [], 0
    for _ in range(4):
        rows = []
        for _ in range(60):
            uid += 1
            kind = rng.randrange(12)
            at = None if kind < 2 else start + dt.timedelta(minutes=rng.randrange(400))
            rows.append((uid, rng.choice("mmn"), "INBOX", rng.choice(["", None]) if kind == 5 else f"<{rng.randrange(40)}>",
                         "" if kind == 0 else "d", at, "s"))
        batches.append(rows)
    for null_id in ("drop", "keep"):
        marks, recent = state.advance_state(ingest.with_hash(spark.createDataFrame([], _COLUMNS)), 0)
        before = set()
        for n, rows in enumerate(batches):
            df = spark.createDataFrame(rows, _COLUMNS)
            df.coalesce(1).write.parquet(str(tmp_path / null_id / "in" / f"n={n}"))
            fresh = ingest.new_messages(ingest.with_hash(df), recent, marks, null_id)
            expected = sorted(r.uid for r in fresh.collect())
            done = state.can_advance(fresh)
            keys = recent.unionByName(state.hash_rows(done, n + 1))
            new_marks, _ = state.advance_state(fresh, n + 1, marks, recent)
            marks, recent = (
                spark.createDataFrame(x.collect(), x.schema) for x in (new_marks, state.recent_hashes(keys, keep=15)))
            # Every batch is a run of its own: started, ended, and started again from the checkpoint.
            stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / null_id / "in" / "*"))
            with remembered.list_state(spark):
                run = (remembered.remembered_stream(stream, 15, null_id).writeStream.format("parquet")
                       .option("path", str(tmp_path / null_id / "out")).option("checkpointLocation", str(tmp_path / null_id / "checkpoint"))
                       .trigger(availableNow=True).start())
            run.awaitTermination()
            got = spark.read.schema("uid long").parquet(str(tmp_path / null_id / "out"))
            passed = {r.uid for r in got.collect()}
            assert sorted(passed - before) == expected, (null_id, n)
            before = passed


def test_sums_leave_the_worker_not_what_is_found(spark):
    """Found terms as rows of Python objects took an executor's memory."""
    rows = spark.createDataFrame([(1, "abab cab", "a@b"), (2, "", None), (3, None, "xx")], "uid long, text string, sender string")
    terms = spark.createDataFrame([("ab", 1, 5), ("ab", 2, 0), ("c", 4, 1), ("b", 0, 7), ("", 9, 9), (None, 9, 9)], "term string, x int, y int")
    for pass_bytes in (64_000_000, 4):
        got = automaton.with_sums(rows, {"text": ["x", "y"], "sender": ["y"]}, terms, pass_bytes=pass_bytes)
        assert sorted((r.uid, r._sums_text, r._sums_sender) for r in got.collect()) == [(1, [7, 13], [7]), (2, [0, 0], [0]), (3, [0, 0], [0])]
    rules = spark.createDataFrame(
        [("feed", "text", "ab", 2), ("feed", "text", "ab", 2), ("feed", "text", "ab", 1), ("promotions", "sender", "x", 3), ("other", "text", "c", 5)],
        "category string, field string, term string, weight int")
    mails = rows.select("uid", F.lit("").alias("subject"), F.col("text").alias("body_text"), F.col("sender").alias("from_email"), F.lit("").alias("from_name"))
    plan = classify.keyword_scores_scanned(mails, rules, ("uid",))
    assert sorted(map(tuple, plan.collect())) == [(1, 0, 3, 0), (2, 0, 0, 0), (3, 0, 0, 3)]
    assert "array<struct" not in plan._jdf.queryExecution().analyzed().toString()


def test_counted_terms_equal_replacing(spark):
    """Texts were searched again for every term they contain; now the one pass counts, and only where terms don't overlap."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("ab É🙂", k=rng.randrange(1, 5))) for _ in range(40)} | {"aa", "aaa", "abab"})
    texts = [("", ""), ("aaaa", "aaaaa"), *(tuple("".join(rng.choices("ab É🙂", k=rng.randrange(25))) for _ in range(2)) for _ in range(300))]
    df = spark.createDataFrame([(i, f"{s} {b}", len(s)) for i, (s, b) in enumerate(texts)] + [(-1, None, 0)], "i int, text string, n int")
    terms = spark.createDataFrame([(w, w.upper()) for w in words], "term string, name string")
    for pass_bytes in (64_000_000, 60):
        got = automaton.with_counted_terms(df, "text", F.col("n"), terms, "term", ("name",), "hits", pass_bytes)
        for r in got.collect():
            s, b = texts[r.i] if r.i >= 0 else ("", "")
            whole = f"{s} {b}" if r.i >= 0 else ""
            assert sorted(tuple(h) for h in r.hits) == sorted((w, w.upper(), s.count(w), b.count(w), whole.count(w)) for w in words if w in whole)
    plan = topics.scanned_hits(df.selectExpr("i AS uid", "text AS subject", "text AS body_text"), terms.selectExpr("name AS topic", "'phrase' AS kind", "term"), ("uid",))
    assert "replace(" not in plan._jdf.queryExecution().analyzed().toString()


def test_few_terms_move_no_texts(spark, sf):
    rows, names = corpus.headers(spark, sf).withColumn("body_text", F.col("subject")), corpus.SETTINGS.topics
    terms, most = R.topic_terms_table(spark, names), R.topic_terms_bound(names)
    assert most == terms.count()
    for hits in (topics.phrase_hits, topics.keyword_hits):
        few, joined = hits(rows, terms, most=most), hits(rows, terms)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, joined.collect())) != []
        text = few._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text.split("Subquery")[0] and "Exchange" not in text.split("Subqueries")[0].split("Subquery")[0]
    few, joined = topics.topic_scores(rows, terms, most=most), topics.topic_scores(rows, terms)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, joined.collect())) != []


def test_terms_in_a_column_as_tokens(spark):
    pairs = [("a ml b", "ml"), ("html", "ml"), ("ml", "ml"), ("x_ml", "ml"), ("ml.", "ml"), ("ml2", "ml"), ("äml", "ml"), ("c++ x", "c++"), ("", "a"), (None, "a")]
    df = spark.createDataFrame(pairs, "text string, term string")
    got = df.select(F.coalesce(is_token(F.col("text"), F.col("term")), F.lit(False)), F.array_contains(words(F.coalesce("text", F.lit(""))), F.col("term")))
    assert all(a == b for a, b in got.collect())
