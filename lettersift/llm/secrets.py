"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

# The base patterns in the order in which spans of equal start are listed, and what a match must be.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# A run of 24 or more is a maximal run, so shorter ones need not be listed first; the same holds for 20 after AKIA.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
ASSIGN_VALUE = 6

# Candidates of the entropy scan: long tokens.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
HEX_DIGITS = "0123456789abcdefABCDEF"
WINDOW = 20
# Bits a character in a window of 20, by class. Random hex has about 3.4 and random base64 about 4.1; words have
# less than 3.6, numbers less than 3.0.
LIMITS = {"hex": 3.0, "base64": 3.8}
# Harmless parts of a token: what is left of it is scanned. A word counts with all letters and digits joined to it.
ALLOW = (
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])",  # identifiers
    r"(?<![A-Za-z0-9+])[A-Za-z0-9+]*?(?i:example|sample|placeholder|changeme|dummy|xxxxx|12345678)[A-Za-z0-9+]*+",
    r"(?<run>.)\k<run>{5,}",
)
# Ranges that look random but are harmless: paths and joined words.
ALLOW_RANGE = (r"^[/_-]?(?:[a-z0-9]{1,12}[/_-])++[a-z0-9]{0,12}$",)
MASK = "[SECRET]"
# Windows that begin in one piece of a candidate, and values that are summed up together.
_PIECE = 200
_SUMMED = 256


def _ends(lengths: Column) -> Column:
    """Running sums of an array, block by block, so that no long array is copied for each value."""
    def within(total: Column, block: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("ends"), total.alias("total"))
        return F.aggregate(block, start, lambda s, x: F.struct(
            F.array_append(s.ends, s.total + x).alias("ends"), (s.total + x).alias("total")))

    def step(s, block):
        done = within(s.total, block)
        return F.struct(F.array_append(s.blocks, done["ends"]).alias("blocks"), done["total"].alias("total"))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(lengths) / _SUMMED).cast("int")), lambda i: F.slice(lengths, i * _SUMMED + 1, _SUMMED))
    start = F.struct(F.array().cast("array<array<int>>").alias("blocks"), F.lit(0).alias("total"))
    return F.aggregate(blocks, start, step, lambda s: F.flatten(s.blocks))


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """Arrays of a pattern's matches and of what stands around them: one more, the rest, if there is a match at all."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)


def _located(found: Column, gaps: Column) -> Column:
    """``(start, end, match)`` of each match, from the lengths of matches and gaps."""
    lengths = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.length(g) + F.length(m))
    return F.zip_with(found, _ends(lengths), lambda m, end: F.struct(
        (end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))


_RANGES = "array<struct<lo:int,hi:int>>"


def _joined_ranges(ranges: Column) -> Column:
    """Ranges in order, those that touch or overlap as one."""
    def step(done, r):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.lo.alias("lo"), F.greatest(last.hi, r.hi).alias("hi"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).hi >= r.lo), grown).otherwise(F.array_append(done, r))

    return F.aggregate(ranges, F.array().cast(_RANGES), step)


def hot_ranges(candidate: Column, limits: dict[str, float] = LIMITS, window: int = WINDOW) -> Column:
    """``(lo, hi)`` of each part of an ASCII string whose windows reach the entropy limit of their class.

    A window of hex digits alone is held against the hex limit, others against that of base64. One pass over the
    string, in pieces that share a window less one: a step takes the leaving character's count down and the entering
    one's up, and updates the sum of ``c * log2 c`` by these two terms. Touching windows are one range.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    bits = {name: (math.log2(window) - limit + 1e-9) * window for name, limit in limits.items()}
    count = lambda s, c: F.octet_length(s) - F.octet_length(F.replace(s, c, F.lit("")))
    plain = lambda c: (F.instr(F.lit(HEX_DIGITS), c) == 0).cast("int")

    # Values that a step uses more than once are array elements, which are computed once.
    def place(text: Column):
        return lambda i: F.struct(
            i.alias("i"), F.substring(text, i, F.lit(1)).alias("enters"),
            F.substring(text, F.greatest(i - window, F.lit(1)), F.lit(1)).alias("leaves"),
            F.substring(text, F.greatest(i - window + 1, F.lit(1)), F.least(i - 1, F.lit(window - 1))).alias("stay"))

    def change(x):
        gone = x.i > window
        return F.struct(
            x.i.alias("i"), count(x.stay, x.enters).alias("up"), F.when(gone, count(x.stay, x.leaves)).otherwise(-1).alias("down"),
            (plain(x.enters) - F.when(gone, plain(x.leaves)).otherwise(0)).alias("others"))

    def step(s, x):
        total = (
            s.total + F.get(term, x.up + 1) - F.get(term, x.up)
            - F.when(x.down >= 0, F.get(term, x.down + 1) - F.get(term, x.down)).otherwise(0.0))
        others = s.others + x.others
        hot = (x.i >= window) & (total <= F.when(others == 0, bits["hex"]).otherwise(bits["base64"]))
        new = hot & (s.hi < x.i - window)
        return F.struct(
            total.alias("total"), others.alias("others"), F.when(new, x.i - window).otherwise(s.lo).alias("lo"),
            F.when(hot, x.i).otherwise(s.hi).alias("hi"),
            F.when(new & (s.hi >= 0), F.array_append(s.done, F.struct(s.lo.alias("lo"), s.hi.alias("hi")))).otherwise(s.done).alias("done"))

    start = F.struct(
        F.lit(0.0).alias("total"), F.lit(0).alias("others"), F.lit(0).alias("lo"), F.lit(-window).alias("hi"), F.array().cast(_RANGES).alias("done"))
    last = lambda s: F.when(s.hi > 0, F.array_append(s.done, F.struct(s.lo.alias("lo"), s.hi.alias("hi")))).otherwise(s.done)

    def scan(piece):
        places = F.transform(F.sequence(F.lit(1), F.length(piece.text)), place(piece.text))
        ranges = F.aggregate(F.transform(places, change), start, step, last)
        return F.transform(ranges, lambda r: F.struct((piece.at + r.lo).alias("lo"), (piece.at + r.hi).alias("hi")))

    offsets = F.sequence(F.lit(0), F.greatest(F.length(candidate) - window, F.lit(0)), F.lit(_PIECE))
    pieces = F.transform(offsets, lambda at: F.struct(at.alias("at"), F.substring(candidate, at + 1, F.lit(_PIECE + window - 1)).alias("text")))
    ranges = _joined_ranges(F.flatten(F.transform(pieces, scan)))
    return F.when(F.length(candidate) >= window, ranges).otherwise(F.array().cast(_RANGES))


def secret_spans(docs: DataFrame, spans: str = "spans", allow: tuple[str, ...] = ALLOW, text: str = "text") -> DataFrame:
    """Add ``spans``: ``(start, order, kind, end)`` of each secret in order; positions in code points, the end exclusive.

    Everything happens within the row, so nothing is shuffled and any input will do. Missing and empty texts have
    an empty array. Base spans are those of the patterns; entropy spans are added where they aren't inside one. ``allow``
    lists patterns of harmless parts, which end a candidate.
    """
    body, work = F.col(text).cast("string"), free_name(docs, "_work")
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    found = docs.withColumn(work, F.struct(*[
        F.when(body.rlike(pattern), F.struct(*[c.alias(n) for c, n in zip(_matches(body, pattern), ("m", "g"), strict=True)])).alias(kind)
        for kind, pattern in {**PATTERNS, "entropy": CANDIDATE}.items()]))
    as_span = lambda order, kind: lambda r: F.struct(
        r.start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), r.end.alias("end"))
    arrays = []
    for order, kind in enumerate(PATTERNS):
        hits = _located(F.col(f"{work}.{kind}.m"), F.col(f"{work}.{kind}.g"))
        if kind == "assign":
            hits = F.filter(hits, lambda r: F.length(F.regexp_extract(r.match, ASSIGN, 2)) >= ASSIGN_VALUE)
        arrays.append(F.coalesce(F.transform(hits, as_span(order, kind)), empty))
    barrier = "|".join(f"(?:{a})" for a in allow)

    def added(candidate):
        # What stands between the harmless parts of a candidate.
        marks, gaps = _matches(candidate.match, barrier)
        both = F.zip_with(gaps, F.concat(marks, F.array(F.lit(""))), lambda g, m: F.struct(g.alias("part"), (F.length(g) + F.length(m)).alias("n")))
        parts = F.zip_with(both, _ends(F.transform(both, lambda x: x.n)), lambda x, end: F.struct(
            (candidate.start + end - x.n).alias("start"), x.part.alias("part")))
        hot = F.flatten(F.transform(parts, lambda p: F.transform(hot_ranges(p.part), lambda r: F.struct(
            (p.start + r.lo).alias("start"), (p.start + r.hi).alias("end"), F.substring(p.part, r.lo + 1, r.hi - r.lo).alias("match")))))
        secret = lambda r: r.match.rlike("[0-9]") & r.match.rlike("[A-Za-z]") & ~functools.reduce(
            lambda a, b: a | b, [r.match.rlike(pattern) for pattern in ALLOW_RANGE])
        return F.transform(F.filter(hot, secret), as_span(len(PATTERNS), "entropy"))

    candidates = _located(F.col(f"{work}.entropy.m"), F.col(f"{work}.entropy.g"))
    base, extra = free_name(docs, "_base"), free_name(docs, "_extra")
    rows = found.withColumn(base, F.array_sort(F.concat(*arrays))).withColumn(
        extra, F.when(F.col(f"{work}.entropy").isNotNull(), F.flatten(F.transform(candidates, added))).otherwise(empty))
    outside = F.filter(extra, lambda e: ~F.exists(base, lambda b: (b.start <= e.start) & (b.end >= e.end)))
    return rows.withColumn(spans, F.array_sort(F.concat(base, outside))).drop(work, base, extra)


def scan_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Secrets of each document: ``doc_id`` and ``spans``, as ``secret_spans`` says. One row per input row."""
    return secret_spans(docs.select("doc_id", "text"), "spans", allow).select("doc_id", "spans")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, allow: tuple[str, ...] = ALLOW, mask: str = MASK) -> DataFrame:
    """The documents with every secret replaced by ``mask``; spans that touch or overlap become one.

    Keeps the columns and rows of ``docs``; texts without secrets stay as they are, ``n_chars``, if there, is
    counted anew where the text changed.
    """
    text = F.col("text").cast("string")

    spans = free_name(docs, "_spans")

    def cut(s, span):
        piece = F.when(span.start > s.end, F.concat(
            F.substring(text, s.end + 1, span.start - s.end), F.lit(mask))).otherwise(
            F.when((span.start == 0) & (s.end == 0), F.lit(mask)).otherwise(""))
        return F.struct(F.array_append(s.parts, piece).alias("parts"), F.greatest(s.end, span.end).alias("end"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("end"))
    clean = F.aggregate(spans, start, cut, lambda s: F.concat(F.array_join(s.parts, ""), F.substring(text, s.end + 1, F.length(text))))
    rows = secret_spans(docs, spans, allow)
    hit = F.size(spans) > 0
    rows = rows.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return rows.select(*docs.columns)
