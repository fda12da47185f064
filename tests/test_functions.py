"""Column functions against Python's own behaviour and the golden rows."""

import datetime
import email.utils
import hashlib
import html as html_lib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lettersift.functions import headers, html, model, text

quick = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
readable = st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\0"), max_size=60)


def test_sanitize_golden(values):
    inputs = ["rain\r\n\r\nsun", "\tfog\x0bice", "hail \u2003 snow", "\n", None]
    assert values(text.sanitize, inputs) == ["rain sun", "fog ice", "hail snow", "", ""]
    assert values(lambda c: text.sanitize(c, null_as_text=True), [None]) == ["None"]
    assert values(text.sanitize, [123], "int") == ["123"]


@quick
@given(st.lists(readable | st.text("\x1c\x1f \xa0 　ab\n\t", max_size=20), min_size=20, max_size=40))
def test_sanitize_is_python_whitespace_and_idempotent(values, inputs):
    once = values(text.sanitize, inputs)
    assert once == [re.sub(r"\s+", " ", x).strip() for x in inputs]
    assert values(text.sanitize, once) == once


@quick
@given(st.lists(readable, min_size=20, max_size=40))
def test_words_and_strip(values, inputs):
    assert values(text.strip, inputs) == [x.strip() for x in inputs]
    got = values(text.words, ["Ünïcode_Word 12 a-b A", "ml html", ""])
    assert [set(g) for g in got] == [{"ünïcode_word", "12", "a", "b"}, {"ml", "html"}, set()]


@quick
@given(st.lists(st.text("ab ", max_size=12), min_size=10, max_size=20), st.text("ab", min_size=1, max_size=3))
def test_substring_count_and_word_test(values, inputs, term):
    assert values(lambda c: text.substring_count(c, F.lit(term)), inputs) == [x.count(term) for x in inputs]
    assert values(lambda c: text.has_word(c, term), inputs) == [term in re.findall(r"\w+", x) for x in inputs]


def test_word_with_punctuation_never_matches(values):
    assert values(lambda c: text.has_word(c, "c++"), ["c++ is a language"]) == [False]


reference = st.sampled_from([
    "&amp;", "&amp", "&lt;", "&copy;", "&copy", "&copyfoo;", "&notit;", "&notin;", "&nosuch;", "&#65;", "&#x41;", "&#X41",
    "&#0;", "&#128;", "&#13;", "&#1;", "&#xD800;", "&#x110000;", "&#99999999999;", "&#xFDD0;", "&#x1F600;", "&#xFFFE;",
    "&", "&;", "&#;", "&#x;", "&amp;lt;", "&am&quot;p;", "&CounterClockwiseContourIntegral;", "&fjlig;", "&nbsp;", "a", " ", "é", ";", "\n",
])


@quick
@given(st.lists(st.lists(reference, max_size=8).map("".join), min_size=30, max_size=60))
def test_unescape_equals_standard_library(values, inputs):
    assert values(html.unescape, inputs) == [html_lib.unescape(x) for x in inputs]


# Pages and the text a reader sees, written by hand.
PAGES = [
    ("<p>One</p><p>Two</p>", "One\nTwo"),
    ("a<br>b<BR />c", "a\nb\nc"),
    ("<style>p {color: red}</style>Visible<script type='x'>if (a < b) {}</script>!", "Visible!"),
    ("<div>  spaced   out  </div>", "spaced   out"),
    ("x &lt;b&gt; &amp; y&nbsp;z", "x <b> & y\xa0z"),
    ("first\n\n\n  second  \r\nthird", "first\nsecond\nthird"),
    ("<ul><li>1</li><li>2</li></ul>", "12"),
    ("<p>&eacute;t&eacute;</p>", "été"),
    ("no tags at all", "no tags at all"),
    ("<>", "<>"),
    ("a < b", "a < b"),
    ("<script>never closed", "never closed"),
    ("", ""),
]


def test_html_to_text(values):
    assert values(html.html_to_text, [page for page, _ in PAGES]) == [seen for _, seen in PAGES]


@quick
@given(st.lists(readable, min_size=20, max_size=40))
def test_html_of_escaped_text_is_the_text(values, inputs):
    pages = ["<div><p>" + html_lib.escape(x) + "</p></div>" for x in inputs]
    expected = ["\n".join(line.strip() for line in x.split("\n") if line.strip()) for x in inputs]
    assert values(html.html_to_text, pages) == expected


def test_html_with_long_blank_runs_is_linear(values):
    assert values(html.html_to_text, ["a" + " " * 50_000 + "b"]) == ["a" + " " * 50_000 + "b"]


def test_body_fallback(spark):
    rows = spark.createDataFrame([("", "<p>Hi</p>"), ("t", "<p>Hi</p>"), ("", ""), (None, None)], "t string, h string")
    assert [r[0] for r in rows.select(html.body_fallback(F.col("t"), F.col("h"))).collect()] == ["Hi", "t", "", ""]


def test_addresses_and_names(values):
    inputs = [
        "John Doe <john.doe@example.com>", "john@Example.com", '"Doe, J" <J@X.org>', "<a@b.c>", " <a@b.c>",
        " 'x@y.z' ", "nobody", "Multi\nLine <m@l.n>", None,
    ]
    assert values(headers.extract_address, inputs) == [
        "john.doe@example.com", "john@example.com", "j@x.org", "a@b.c", "a@b.c", "x@y.z", "nobody", "m@l.n", ""]
    assert values(headers.extract_name, inputs) == [
        "John Doe", "john@example.com", "Doe, J", "a@b.c", "", "x@y.z", "nobody", "m@l.n", ""]
    assert values(headers.sender_domain, ["a@B.c", "a@b@c", "none"]) == ["b.c", "b", "none"]


def test_message_hash(values):
    assert values(headers.message_hash, ["<test123@example.com>", "", None]) == [
        hashlib.md5(b"<test123@example.com>").hexdigest(),
        "d41d8cd98f00b204e9800998ecf8427e", "d41d8cd98f00b204e9800998ecf8427e"]


def test_dates_like_the_standard_library(values):
    inputs = [
        "Mon, 20 Nov 2023 10:00:00 +0000", "20 Nov 2023 10:00:00 +0530", "Mon, 20 Nov 2023 10:00 GMT",
        "Mon, 20 Nov 2023 10:00:00 +0000 (UTC)", "20 Nov 99 10:00:00 -0800", "20 Nov 23 10:00:00 EST", "Mon, 20 Nov 2023 10:00:00",
        "Mon Nov 20 10:00:00 2023", "Mon,  5 Feb 2024 1:02:03 -0000", "Tue, 20 February 2024 23:59:59 PDT", "20-Nov-2023 10:00:00 +0100",
    ]
    expected = []
    for x in inputs:
        moment = email.utils.parsedate_to_datetime(x)
        expected.append(int((moment if moment.tzinfo else moment.replace(tzinfo=datetime.timezone.utc)).timestamp()))
    assert values(lambda c: F.unix_timestamp(headers.parse_date(c)), inputs) == expected
    assert values(headers.parse_date, ["not a date", "", None, "31 Feb 2023 10:00:00 +0000"]) == [None] * 4


def test_age_rounds_down(spark):
    row = spark.sql("SELECT timestamp'2024-01-02 00:00:00' AS a, timestamp'2024-01-04 23:59:59' AS b").select(
        headers.whole_days(F.col("b"), F.col("a")), headers.whole_days(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (2, -3)


def test_times_without_zone_are_utc(spark):
    row = spark.sql("SELECT timestamp_ntz'2023-11-20 10:00:00' AS a, timestamp'2023-11-20 10:00:00+05:30' AS b, cast(null AS timestamp_ntz) AS c").select(
        *[F.date_format(headers.as_utc(F.col(x)), "HH:mm") for x in "abc"]).first()
    assert tuple(row) == ("10:00", "04:30", None)


def test_decode_header(values):
    inputs = ["=?utf-8?B?R3LDvMOfZQ==?=", "=?iso-8859-1?Q?caf=E9?= now", "plain ", "=?no-such?B?YQ==?=", None]
    assert values(headers.decode_header, inputs) == ["Grüße", "café now", "plain", "a", ""]


def test_model_input_golden(spark):
    row = spark.createDataFrame(
        [("Subject\nWith\tNewlines", "Sender\nName", "sender@example.com", "Body\r\nText\tWith Special Chars")], "s string, n string, e string, b string")
    columns = [F.col(c) for c in "sneb"]
    got = row.select(model.model_input(*columns).alias("x")).first().x
    assert got == "[SUBJECT] Subject With Newlines [SENDER] Sender Name <sender@example.com> [BODY] Body Text With Special Chars"
    parts = row.select(model.parse_model_input(model.model_input(*columns)).alias("p")).first().p
    assert tuple(parts) == ("Subject With Newlines", "Sender Name", "sender@example.com", "Body Text With Special Chars")
    assert row.select(model.parse_model_input(F.lit("no tags")).alias("p")).first().p is None


def test_body_is_cut_before_sanitising(spark):
    row = spark.createDataFrame([(" " * 999 + "ab",)], "b string")
    empty = F.lit("")
    assert row.select(model.model_input(empty, empty, empty, F.col("b"))).first()[0].endswith("[BODY] a")


def test_softmax_argmax_and_labels(spark):
    row = spark.sql("SELECT array(1000.0D, 1000.0D, 0.0D, 0.0D) AS a").select(
        model.softmax(F.col("a")).alias("p"), model.argmax(F.col("a")).alias("i"),
        model.label_index(F.lit("inbox")).alias("known"), model.label_index(F.lit("other")).alias("unknown")).first()
    assert row.p == [0.5, 0.5, 0.0, 0.0] and row.i == 0 and row.known == 3 and row.unknown is None


def test_token_window(spark):
    row = spark.range(1).select(model.token_ids(F.lit("one two " * 300), 8).alias("long"), model.token_ids(F.lit("One"), 8).alias("short")).first()
    assert len(row.long) == 8 and row.long[0] == 101 and row.long[-1] == 102
    assert row.short[0] == 101 and row.short[2:] == [102, 0, 0, 0, 0, 0]


def test_body_preview(values):
    assert values(text.body_preview, ["a\r\nb" + "x" * 300]) == ["a b" + "x" * 196]
