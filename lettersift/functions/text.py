"""Text normalisation, tokens and substring counts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space for sanitising and stripping.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex: Unicode \s lacks only the four separators \x1c-\x1f.
SPACE_CLASS = r"[\s\x1c-\x1f]"
WORD_CLASS = r"[\p{L}\p{N}_]"


def or_empty(c: Column) -> Column:
    """NULL means a missing field, which every operator treats as empty text."""
    return F.coalesce(c, F.lit(""))


def sql_string(text: str) -> str:
    """A text as a quoted literal inside an SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def sanitize(c: Column, null_as_text: bool = False) -> Column:
    """One line of text: runs of white space become one space, ends are trimmed.

    ``null_as_text`` spells a NULL out as ``None``; non-string columns are cast.
    """
    text = c.cast("string")
    text = F.coalesce(text, F.lit("None")) if null_as_text else or_empty(text)
    return F.trim(F.regexp_replace(text, f"(?U){SPACE_CLASS}+", " "))


def first_chars(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def words(c: Column) -> Column:
    """Distinct lower-cased word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"{WORD_CLASS}+"), F.lit(0)))


def is_word(term: str) -> bool:
    """Only a term made of word characters can equal a token."""
    return re.fullmatch(r"\w+", term) is not None


def has_word(text: Column, term: str) -> Column:
    """True where ``term`` is one of the tokens of the lower-cased ``text``.

    The plain substring test runs first, so the regex sees few rows.
    """
    if not is_word(term):
        return F.lit(False)
    bounded = f"(?<!{WORD_CLASS}){re.escape(term)}(?!{WORD_CLASS})"
    return F.contains(text, F.lit(term)) & text.rlike(bounded)


def is_token(text: Column, term: Column) -> Column:
    """:func:`has_word` for a column of terms: true where ``term`` is one of the :func:`words` of a lower-cased ``text``."""
    bounded = F.concat(F.lit(f"(?<!{WORD_CLASS})"), term, F.lit(f"(?!{WORD_CLASS})"))
    return F.when(term.rlike(f"^{WORD_CLASS}+$"), F.rlike(text, bounded)).otherwise(F.lit(False))


def substring_count(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of ``term`` in ``text``."""
    removed = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.contains(text, term), (removed / F.length(term)).cast("int")).otherwise(F.lit(0))


def body_preview(c: Column, n: int = 200) -> Column:
    """First ``n`` characters on one line: CR is dropped, LF becomes a space."""
    return F.translate(first_chars(or_empty(c), n), "\n\r", " ")
