"""Mails and headers that are read without Python, against Python's reading of the same."""

import base64
import quopri
import random

from pyspark.sql import functions as F

from lettersift.functions import headers
from lettersift.sources import corpus, mime


def word(rng, text):
    kind = rng.randrange(8)
    if kind == 0:
        return text if text.isascii() else "plain  text "
    if kind == 1:
        return f"=?UTF-8?B?{base64.b64encode(text.encode()).decode()}?="
    if kind == 2:
        coded = "".join(chr(b) if chr(b).isalnum() and b < 128 else "_" if b == 32 else f"={b:02X}" for b in text.encode())
        return f"=?utf-8?q?{coded or 'x'}?="
    if kind == 3:
        return f"=?iso-8859-1?Q?caf=E9?= {text if text.isascii() else 'and'}"
    if kind == 4:
        return rng.choice(["=?utf-8?B?/w==?=", "=?utf-8?Q?=FF+%41?=", "=?utf-8?B?abc?=", "=?utf-8?q?a+b%20c?=", "=?utf-8?Q?a?b?=", "=?", "=?utf-8?B??="])
    if kind == 5:
        return f"=?utf-8?B?{base64.b64encode(text.encode()).decode()}?= =?utf-8?Q?b?="
    return f"{rng.choice(['Re:', 'a ', '(', 'x?= '])}=?utf-8?B?{base64.b64encode(text.encode()).decode()}?={rng.choice(['', ' tail  t', ')', '?=', '  '])}"


TEXTS = ["", "Hello", " two  words ", "Grüße aus Köln", "a_b=c?d%41+1", "🙂 é", "x" * 200]


def test_headers_equal_python(spark):
    rng = random.Random(1)
    values = [word(rng, rng.choice(TEXTS)) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, h string").select("i", headers.decode_header(F.col("h")).alias("got"), headers.plain_header(F.col("h")).alias("plain"))
    found = rows.collect()
    for r in found:
        assert r.got == headers.decode_header_text(values[r.i]), values[r.i]
    assert sum(r.plain is not None for r in found) > 150


def mail(rng):
    end = rng.choice(["\r\n", "\n"])
    lines = [f"Message-ID: <{rng.randrange(99)}>", f"Subject:{rng.choice(['', ' ', '  '])}{word(rng, rng.choice(TEXTS))}", f"From: {word(rng, 'Name')} <a@b.c>",
             "To:  d@e.f ", rng.choice(["Date: Mon, 01 Jan 2024 10:00:00 +0000", "date: never", "X-Other: 1"]), rng.choice(["Subject: second", "X: y", "X-Folded: a" + end + "  b"])]
    rng.shuffle(lines)
    body = rng.choice(["text", "", "Grüße\r\nzwei", "<b>h</b>", " \x85 é \n\n", "a" * 3000, "\n\nx"])
    kind = rng.choice(["", "Content-Type: text/plain", "Content-Type: text/html; charset=utf-8", 'content-type: Text/Plain; format=flowed; charset="UTF-8"',
                       "Content-Type: text/plain; charset=iso-8859-1", "Content-Type: text", "Content-Type: multipart/mixed; boundary=x", "Content-Type: application/json"])
    coding, data = rng.choice(["", "8bit", "base64", "quoted-printable", "x-none"]), body.encode()
    if coding == "base64":
        data = base64.encodebytes(data) if rng.random() < 0.8 else b"!!" + base64.b64encode(data) + b"="
    elif coding == "quoted-printable":
        data = quopri.encodestring(data)
    elif rng.random() < 0.1:
        data = b"\xff\xfe bad"
    lines += [x for x in (kind, f"Content-Transfer-Encoding: {coding}" if coding else "") if x]
    return end.join(lines).encode() + (end * 2).encode() + data if rng.random() < 0.95 else rng.choice([b"", b"no header", end.join(lines).encode()])


def test_simple_mails_equal_python(spark):
    rng = random.Random(2)
    mails = [mail(rng) for _ in range(1200)] + [None]
    rows = spark.createDataFrame([(i, bytearray(m) if m is not None else None) for i, m in enumerate(mails)], "i int, raw binary")
    simple = 0
    for r in rows.select("i", mime.simple_parts(F.col("raw")).alias("p")).collect():
        if r.p is not None:
            simple += 1
            assert tuple(r.p) == mime.read_parts(mails[r.i]), mails[r.i]
    assert simple > 80


def test_python_reads_under_half(spark, sf):
    raw = corpus.raw_messages(corpus.messages(spark, sf))
    counts = raw.agg(F.count("*").alias("n"), F.count_if(mime.simple_parts(F.col("raw")).isNull()).alias("python")).first()
    assert counts.python < counts.n / 2


def test_stored_halves_are_those_of_one_parse(spark, sf, tmp_path):
    raw, as_of = corpus.raw_messages(corpus.messages(spark, sf)), corpus.as_of()
    rows = lambda df: sorted((r.uid, r.message_id, r.body_text, r.parse_error) for r in df.collect())
    for stored, plain in zip(mime.parse_stored(raw, as_of, str(tmp_path / "parsed")), mime.parse_messages(raw, as_of), strict=True):
        assert stored.columns == plain.columns and rows(stored) == rows(plain)
        assert "MapInPandas" not in (plan := stored._jdf.queryExecution().executedPlan().toString()) and "ArrowEvalPython" not in plan
    good, bad = mime.parse_stored(raw.limit(0), as_of, str(tmp_path / "none"))
    assert good.count() == bad.count() == 0
