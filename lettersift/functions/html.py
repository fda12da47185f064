"""HTML to plain text without leaving the JVM."""

from __future__ import annotations

import html
import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, or_empty, strip

# One reference: decimal, hexadecimal or named; a name holds at most 32 characters.
_REFERENCE = "^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
_NO_CHARACTER = 0x110000  # stands for every number above the last code point


# Frequent names, looked up before the full table.
_FREQUENT = ["&amp;", "&nbsp;", "&lt;", "&gt;", "&quot;", "&copy;", "&middot;"]
# The standard library's HTML 5 names; some also work without a semicolon.
_EXACT = {name: text for name, text in html.entities.html5.items() if name.endswith(";")}
_BARE = {name: text for name, text in html.entities.html5.items() if not name.endswith(";")}


def _table(names: dict[str, str]) -> Column:
    # One text literal; it is turned into a constant map when the query is planned.
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _bare_names() -> str:
    # Of several names the longest one that fits is taken.
    return "|".join(sorted(_BARE, key=lambda name: (-len(name), name)))


def _low_characters() -> Column:
    # Numbers below 160 have special cases (Windows-1252 remapping, control characters).
    return F.from_json(F.lit(json.dumps([html.unescape(f"&#{n};") for n in range(160)])), "array<string>")


def _code_point(reference: Column) -> Column:
    decimal = F.regexp_extract(reference, "^&#0*([0-9]+)", 1)
    hexadecimal = F.regexp_extract(reference, "^&#[xX]0*([0-9a-fA-F]+)", 1)
    return (
        F.when(hexadecimal != "", F.when(F.length(hexadecimal) > 6, F.lit(_NO_CHARACTER))
               .otherwise(F.conv(hexadecimal, 16, 10).cast("int")))
        .when(F.length(decimal) > 7, F.lit(_NO_CHARACTER))
        .otherwise(decimal.cast("int"))
    )


def _character(code: Column) -> Column:
    return (
        F.when(code < 160, F.get(_low_characters(), code))
        .when(code.between(0xD800, 0xDFFF) | (code >= _NO_CHARACTER), F.lit("\ufffd"))
        .when(code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE), F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times but computes it once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _decode_reference(reference: Column) -> Column:
    """Text of one reference: a number, a name, or a name without semicolon and what follows it."""
    named = F.when(reference.startswith("&#"), _bind(_code_point(reference), _character))
    for name in _FREQUENT:
        named = named.when(reference == name, F.lit(_EXACT[name[1:]]))

    def longest(bare):
        rest = F.substr(reference, F.length(bare) + 2)
        return F.when(bare != "", F.concat(_table(_BARE)[bare], rest)).otherwise(reference)

    other = F.coalesce(
        _table(_EXACT)[F.substr(reference, F.lit(2))],
        _bind(F.regexp_extract(reference, f"^&({_bare_names()})", 1), longest),
    )
    return named.otherwise(other)


def _decode_piece(piece: Column) -> Column:
    """Decode the reference a piece starts with; the rest of the piece holds none."""
    def decoded(reference):
        rest = F.substr(piece, F.length(reference) + 1)
        return F.when(reference == "", piece).otherwise(F.concat(_decode_reference(reference), rest))

    return F.when(piece.startswith("&"), _bind(F.regexp_extract(piece, _REFERENCE, 0), decoded)).otherwise(piece)


def unescape(c: Column) -> Column:
    """Decode character references once, left to right, taking the text apart at each ``&``."""
    def decoded(text):
        pieces = F.transform(F.split(text, "(?=&)"), _decode_piece)
        return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)

    return _bind(c, decoded)


def html_to_text(c: Column) -> Column:
    """Drop scripts, styles and tags, decode references, keep non-empty trimmed lines."""
    text = or_empty(c)
    for element in ("script", "style"):
        text = F.regexp_replace(text, f"(?isu)<{element}[^>]*>.*?</{element}>", "")
    text = F.regexp_replace(text, f"(?iuU)<br{SPACE_CLASS}*/?>", "\n")
    text = F.regexp_replace(text, "(?iu)</p>", "\n\n")
    text = unescape(F.regexp_replace(text, "<[^>]+>", ""))
    # A run of white space with a line break in it is one line end. The look-behind
    # keeps long runs without a break linear.
    return strip(F.regexp_replace(text, f"(?U)(?<!{SPACE_CLASS}){SPACE_CLASS}*\\n{SPACE_CLASS}*", "\n"))


def body_fallback(body_text: Column, body_html: Column) -> Column:
    """The text body, or the HTML body as text where there is no text body."""
    text = or_empty(body_text)
    return F.when((text == "") & (or_empty(body_html) != ""), html_to_text(body_html)).otherwise(text)
