"""Every query against its SQL, and the shape of the plans."""

import glob
import os
import re

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from lettersift.operators import filters, ingest
from lettersift.operators.triage import triage
from lettersift.plans.state import earlier_state
from lettersift.sources import corpus

SLOW = {"select_linear"}
# The training-data queries have tests of their own.
NAMES = sorted(n for n in queries() if n not in SLOW and n != "pipeline" and not re.match(r"op\d+_", n))


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", "10000000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    message, _, good = check.compare(spark, con, name, queries()[name], oracle_sql().get(name), sf)
    assert good, message


def test_entry(spark):
    assert entry(spark).count() == 200


def test_triage_needs_no_shuffle_and_no_python(spark, sf):
    rows = corpus.message_rows(corpus.table(spark, sf, "documents"), corpus.table(spark, sf, "pages"))
    text = plan(triage(rows, corpus.SETTINGS))
    assert "Python" not in text and "SortMergeJoin" not in text
    # The broadcast of the small pages table is the only exchange.
    assert text.count("Exchange") == text.count("BroadcastExchange") == 1


def test_filters_on_results_are_not_expanded(spark, sf):
    rows = corpus.messages(spark, sf)
    short = triage(rows, corpus.SETTINGS).where("apply or planned_action = 'archive'").select("uid")
    optimized = short._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("contains(") + optimized.count("Contains(") < 400


def test_date_filter_reaches_the_reader(spark, sf, tmp_path):
    corpus.headers(spark, sf).write.parquet(str(tmp_path / "headers"))
    stored = spark.read.parquet(str(tmp_path / "headers"))
    text = plan(filters.date_range(stored, "2024-01-05", "2024-01-20").select("uid"))
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(arrived_at" in text
    assert "ReadSchema: struct<uid:bigint,received_at:timestamp,arrived_at:timestamp>" in text


def test_known_keys_are_an_anti_join(spark, sf):
    marks, recent = earlier_state(spark, sf)
    text = plan(ingest.new_messages(corpus.headers(spark, sf), recent, marks))
    assert "LeftAnti" in text and "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["keyword_scores", "topic_keyword_hits", "topic_phrase_hits", "sender_wildcard", "sender_exact"])
def test_no_cross_joins(spark, sf, name):
    text = plan(queries()[name](spark, sf))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_groups_are_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(queries()["latest_n_per_folder"](spark, sf))
    assert "WindowGroupLimit" in plan(queries()["recent_hashes"](spark, sf))
