"""Matching texts against large term tables with equi-joins.

A term can only occur in a text that holds the term's first three characters, and a word only in a
text that has it as a token. Joining on those keys gives candidates without comparing every text
with every term; the candidates are then checked against the text itself. The keys of all texts are
shuffled for that, many times the texts: a table known to be small is looked for in each row instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

_GRAM = 3
# Terms looked for one after another in each text, where the caller vouches that there are no more.
IN_ROW_TERMS = 200


def _grams(text: Column) -> Column:
    """Distinct character sequences that a term can be keyed by: of one, two and three characters."""
    sizes = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, _GRAM + 1)]
    return F.array_distinct(F.concat(*sizes))


def _candidates(texts: DataFrame, key: Sequence[str], pieces: Column, piece: str, terms: DataFrame) -> DataFrame:
    """Pairs of key and term that share a piece. Only keys and pieces are multiplied, never texts."""
    return texts.select(*key, F.explode(pieces).alias(piece)).join(terms, piece)


def substring_candidates(texts: DataFrame, key: Sequence[str], text: str, terms: DataFrame, term: str) -> DataFrame:
    """Pairs of key and term that may match; each pair once. ``terms`` must not hold empty terms."""
    keyed = terms.withColumn("_gram", F.substring(term, 1, _GRAM))
    return _candidates(texts, key, _grams(F.col(text)), "_gram", keyed).drop("_gram")


def with_contained_terms(texts: DataFrame, text: str, terms: DataFrame, term: str, out: str) -> DataFrame:
    """Add the rows of a table of few terms that a text contains, as an array in the text's own row.

    The table is read once, as a scalar, and nothing is joined: neither texts nor pieces of them are shuffled.
    """
    table = terms.where(F.col(term) != "").agg(F.collect_list(F.struct(*terms.columns))).scalar()
    rows = texts.withColumn("_table", table)
    return rows.withColumn(out, F.filter("_table", lambda t: F.contains(F.col(text), t[term]))).drop("_table")


def token_hits(texts: DataFrame, key: Sequence[str], text: str, terms: DataFrame, term: str) -> DataFrame:
    """Rows of ``texts`` with each term that is a token of the text."""
    return _candidates(texts, key, words(F.col(text)), term, terms).join(texts, list(key))


def substring_hits(texts: DataFrame, key: Sequence[str], text: str, terms: DataFrame, term: str) -> DataFrame:
    """Rows of ``texts`` with each term that the text contains."""
    found = substring_candidates(texts, key, text, terms, term).join(texts, list(key))
    return found.where(F.contains(F.col(text), F.col(term)))
