"""Header fields: addresses, dates, message keys."""

from __future__ import annotations

from email.header import decode_header as split_encoded_words

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE_CLASS, or_empty, strip

# Zone names with their offsets, and month names; unknown zones count as UTC.
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600",
    "PST": "-0800", "PDT": "-0700",
}
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
MICROS_PER_DAY = 86_400_000_000

_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS)
_TIME = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?"
_DAY_FIRST = rf"(?i)^\s*(?:[a-z]+(?:,\s*|\s+))?(\d{{1,2}})[\s-]+({_MONTH})[\s-]+(\d{{2}}|\d{{4}})\s+{_TIME}(?:\s*([+-]\d{{4}})|\s+([a-z]+))?"
_MONTH_FIRST = rf"(?i)^\s*(?:[a-z]+(?:,\s*|\s+))?({_MONTH})\s+(\d{{1,2}}),?\s+{_TIME}\s+(\d{{4}})(?:\s*([+-]\d{{4}})|\s+([a-z]+))?"


def extract_address(c: Column) -> Column:
    """Lower-cased address: what stands in angle brackets, else the header without quotes."""
    header = or_empty(c)
    bracketed = F.regexp_extract(header, "<([^>]+)>", 1)
    plain = F.translate(strip(header), "\"'", "")
    return (
        F.when(bracketed != "", F.lower(strip(bracketed)))
        .when(F.contains(plain, F.lit("@")), F.lower(plain))
        .otherwise(F.lower(header))
    )


def extract_name(c: Column) -> Column:
    """Display name before the angle bracket without quotes, else the address."""
    header = or_empty(c)
    named = f"(?U)^([^\\n]+?){SPACE_CLASS}*<"
    name = F.translate(strip(F.regexp_extract(header, named, 1)), "\"'", "")
    return F.when(header.rlike(named), name).otherwise(extract_address(header))


def sender_domain(address: Column) -> Column:
    """The piece after the first ``@`` (up to a second one); the whole text without ``@``."""
    c = or_empty(address)
    return F.lower(F.when(F.contains(c, F.lit("@")), F.split_part(c, F.lit("@"), F.lit(2))).otherwise(c))


def message_hash(message_id: Column) -> Column:
    """Key of a message for recognising repeats. All messages without an id share one key."""
    return F.md5(or_empty(message_id))


def _zone(offset: Column, name: Column) -> Column:
    known = F.lit("+0000")
    for zone, value in ZONES.items():
        known = F.when(F.upper(name) == zone, F.lit(value)).otherwise(known)
    return F.when(offset != "", offset).otherwise(known)


def _timestamp(day: Column, month: Column, year: Column, hour: Column, minute: Column,
               second: Column, zone: Column) -> Column:
    full_year = (
        F.when(F.length(year) == 4, year)
        .when(year > "68", F.concat(F.lit("19"), year))
        .otherwise(F.concat(F.lit("20"), year))
    )
    padded = [F.lpad(part, 2, "0") for part in (day, hour, minute)]
    seconds = F.when(second == "", F.lit("00")).otherwise(F.lpad(second, 2, "0"))
    text = F.concat(
        full_year, F.lit(" "), F.initcap(F.substring(month, 1, 3)), F.lit(" "), padded[0],
        F.lit(" "), padded[1], F.lit(":"), padded[2], F.lit(":"), seconds, F.lit(" "), zone,
    )
    return F.try_to_timestamp(text, F.lit("yyyy MMM dd HH:mm:ss Z"))


def parse_date(c: Column) -> Column:
    """Timestamp of an RFC 2822 date header, NULL where it cannot be read.

    Dates without a zone are taken as UTC.
    """
    header = or_empty(c)
    a = [F.regexp_extract(header, _DAY_FIRST, i) for i in range(1, 9)]
    b = [F.regexp_extract(header, _MONTH_FIRST, i) for i in range(1, 9)]
    return F.when(
        header.rlike(_DAY_FIRST), _timestamp(a[0], a[1], a[2], a[3], a[4], a[5], _zone(a[6], a[7]))
    ).when(
        header.rlike(_MONTH_FIRST), _timestamp(b[1], b[0], b[5], b[2], b[3], b[4], _zone(b[6], b[7]))
    )


def as_utc(c: Column) -> Column:
    """Timestamps without a zone are taken as UTC (the session's time zone); others are kept."""
    return c.cast("timestamp")


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded down (negative if reversed)."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("int")


def age_days(received_at: Column, as_of: Column) -> Column:
    return whole_days(as_of, received_at)


def decode_header_text(header: str | None) -> str:
    """Decode the encoded words (RFC 2047) of one header."""
    if not header:
        return ""
    decoded = []
    for content, charset in split_encoded_words(header):
        if isinstance(content, bytes):
            try:
                content = content.decode(charset or "utf-8", errors="replace")
            except LookupError:
                content = content.decode("utf-8", errors="replace")
        decoded.append(content)
    return "".join(decoded).strip()


@F.pandas_udf(T.StringType())
def _decode_headers(headers: pd.Series) -> pd.Series:
    return headers.map(decode_header_text, na_action="ignore")


_AROUND = r"((?:(?!=\?)[\t\x20-\x7e])*+)"
_WORD_B = rf"^{_AROUND}=\?(?i:utf-8)\?[bB]\?((?:[A-Za-z0-9+/]{{4}})*+(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?)\?={_AROUND}$"
_WORD_Q = rf"^{_AROUND}=\?(?i:utf-8)\?[qQ]\?((?:[!-<>@-~]|=[0-9A-Fa-f]{{2}})++)\?={_AROUND}$"


def plain_header(c: Column) -> Column:
    """A header that needs no Python: ASCII text with at most one encoded word, in UTF-8 (B or Q). NULL for any other."""
    header = strip(c)
    # Plain letters of a Q word must not look like the escapes of a URL.
    escaped = F.replace(F.replace(F.regexp_extract(header, _WORD_Q, 2), F.lit("%"), F.lit("=25")), F.lit("+"), F.lit("=2B"))
    quoted = F.try_url_decode(F.translate(escaped, "=_", "% "))
    coded = F.unbase64(F.regexp_extract(header, _WORD_B, 2)).cast("string")
    around = lambda pattern, text: strip(F.concat(F.regexp_extract(header, pattern, 1), text, F.regexp_extract(header, pattern, 3)))
    return (
        F.when(~F.contains(header, F.lit("=?")), header)
        .when(header.rlike(_WORD_B), F.when(F.is_valid_utf8(coded), around(_WORD_B, coded)))
        .when(header.rlike(_WORD_Q), F.when(~F.contains(quoted, F.lit("\ufffd")), around(_WORD_Q, quoted)))
    )


def decode_header(c: Column) -> Column:
    """Decode encoded words. Only headers of several words, other charsets or damaged ones are sent to Python."""
    header = or_empty(c)
    plain = plain_header(header)
    return F.coalesce(plain, _decode_headers(F.when(plain.isNull(), header)))
