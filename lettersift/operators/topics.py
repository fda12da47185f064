"""Scoring messages against topics of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import body_fallback
from ..functions.text import has_word, is_token, or_empty, substring_count, words
from ..rules import (
    KEYWORD_ANYWHERE, KEYWORD_SUBJECT, PHRASE_BODY, PHRASE_SUBJECT, TOPIC_SCALE, Topic, build_topics,
)
from ..schemas import KEY
from .automaton import with_counted_terms
from .stage import computed
from .terms import IN_ROW_TERMS, substring_hits, token_hits, with_contained_terms


def with_topic_texts(df: DataFrame) -> DataFrame:
    """Add lower-cased subject, body (from HTML where there is no text) and both together."""
    body = body_fallback(F.col("body_text"), F.col("body_html")) if "body_html" in df.columns else or_empty(F.col("body_text"))
    texts = df.withColumns({"_subject": F.lower(or_empty(F.col("subject"))), "_body": F.lower(body)})
    return texts.withColumn("_all", F.concat("_subject", F.lit(" "), "_body"))


def _phrase_score(phrase: Column) -> Column:
    """A phrase counts in subject and body on their own; one across their border scores 0."""
    return (
        substring_count(F.col("_subject"), phrase) * F.lit(PHRASE_SUBJECT)
        + substring_count(F.col("_body"), phrase) * F.lit(PHRASE_BODY)
    )


def _keyword_score(keyword: Column) -> Column:
    """A keyword found as a token counts wherever it occurs, even inside words; the subject counts twice."""
    return (
        substring_count(F.col("_subject"), keyword) * F.lit(KEYWORD_SUBJECT)
        + substring_count(F.col("_all"), keyword) * F.lit(KEYWORD_ANYWHERE)
    )


def _sum(columns: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total


def _present(pairs: Sequence[tuple[Column, Column]], kind: str) -> Column:
    if not pairs:
        return F.array().cast(f"array<{kind}>")
    return F.array_compact(F.array(*[F.when(condition, value) for condition, value in pairs]))


def match_topics(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Add ``topic_matched, topics, topic_score, topic_matches``; topics keep their configured order.

    The terms are unrolled into expressions, so messages are not exploded or shuffled.
    """
    built = build_topics(topics)
    scored = with_topic_texts(df)
    hits = {}
    for i, topic in enumerate(built):
        for j, phrase in enumerate(topic.phrases):
            hits[f"_p{i}_{j}"] = F.contains(F.col("_all"), F.lit(phrase))
        for j, keyword in enumerate(topic.keywords):
            hits[f"_k{i}_{j}"] = has_word(F.col("_all"), keyword)
    if hits:
        scored = scored.withColumns(hits)
    scores = {f"_s{i}": _topic_score(i, topic) for i, topic in enumerate(built)}
    if scores:
        scored = computed(scored, scores)
    matched = [F.col(f"_s{i}") > 0 for i in range(len(built))]
    details = [
        F.struct(
            F.lit(topic.name).alias("topic"),
            _present([(F.col(f"_k{i}_{j}"), F.lit(k)) for j, k in enumerate(topic.keywords)], "string").alias("keywords"),
            _present([(F.col(f"_p{i}_{j}"), F.lit(p)) for j, p in enumerate(topic.phrases)], "string").alias("phrases"),
            F.col(f"_s{i}").alias("score"),
        )
        for i, topic in enumerate(built)
    ]
    names = _present([(m, F.lit(t.name)) for m, t in zip(matched, built)], "string")
    detail_type = "struct<topic:string,keywords:array<string>,phrases:array<string>,score:double>"
    total = _sum([F.col(c) for c in scores])
    return scored.withColumns({
        "topics": names,
        "topic_score": F.least(total / F.lit(TOPIC_SCALE), F.lit(1.0)),
        "topic_matches": _present(list(zip(matched, details)), detail_type),
    }).withColumn("topic_matched", F.size("topics") > 0).drop("_subject", "_body", "_all", *hits, *scores)


def _topic_score(i: int, topic: Topic) -> Column:
    parts = [
        F.when(F.col(f"_p{i}_{j}"), _phrase_score(F.lit(p))).otherwise(F.lit(0.0)) for j, p in enumerate(topic.phrases)
    ] + [
        F.when(F.col(f"_k{i}_{j}"), _keyword_score(F.lit(k))).otherwise(F.lit(0.0)) for j, k in enumerate(topic.keywords)
    ]
    return _sum(parts)


def _few(most: int | None) -> bool:
    return most is not None and most <= IN_ROW_TERMS


def few_hits(df: DataFrame, terms: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The rows of :func:`keyword_hits` and :func:`phrase_hits`, with ``kind``, for few terms: texts stay in place and are read once."""
    texts = with_topic_texts(df).select(*key, "_subject", "_body", "_all")
    found = with_contained_terms(texts, "_all", terms.select("topic", "kind", "term"), "term", "_found")
    rows = found.select("*", F.inline("_found"))
    is_phrase, term = F.col("kind") == "phrase", F.col("term")
    rows = rows.where(is_phrase | ((F.col("kind") == "keyword") & is_token(F.col("_all"), term)))
    score = F.when(is_phrase, _phrase_score(term)).otherwise(_keyword_score(term))
    return rows.select(*key, "topic", "kind", "term", score.alias("score"))


def keyword_hits(df: DataFrame, terms: DataFrame, key: Sequence[str] = KEY, most: int | None = None) -> DataFrame:
    """Rows ``key, topic, term, score`` for topic keywords that are tokens of a message.

    ``terms`` is a table ``(topic, kind, term)`` of any size, joined on the token; ``most`` says how many rows it can have,
    and few are looked for in each row.
    """
    if _few(most):
        return few_hits(df, terms.where(F.col("kind") == "keyword"), key).drop("kind")
    texts = with_topic_texts(df).select(*key, "_subject", "_all")
    keywords = terms.where(F.col("kind") == "keyword").select("topic", "term")
    found = token_hits(texts, key, "_all", keywords, "term")
    return found.select(*key, "topic", "term", _keyword_score(F.col("term")).alias("score"))


def phrase_hits(df: DataFrame, terms: DataFrame, key: Sequence[str] = KEY, most: int | None = None) -> DataFrame:
    """Rows ``key, topic, term, score`` for topic phrases contained in a message; ``most`` as for :func:`keyword_hits`."""
    if _few(most):
        return few_hits(df, terms.where(F.col("kind") == "phrase"), key).drop("kind")
    texts = with_topic_texts(df).select(*key, "_subject", "_body", "_all")
    phrases = terms.where(F.col("kind") == "phrase").select("topic", "term")
    found = substring_hits(texts, key, "_all", phrases, "term")
    return found.select(*key, "topic", "term", _phrase_score(F.col("term")).alias("score"))


def scanned_hits(df: DataFrame, terms: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The rows of :func:`keyword_hits` and :func:`phrase_hits`, with ``kind``, from one pass of an automaton over each text.

    A keyword that is found must be a token, too. Texts stay in place; only what is found leaves their rows.
    """
    texts = with_topic_texts(df).select(*key, F.length("_subject").alias("_border"), "_all")
    texts = with_counted_terms(texts, "_all", F.col("_border"), terms, "term", ("topic", "kind"), "_found")
    # Only keywords need the tokens.
    tokens = F.when(F.exists("_found", lambda hit: hit["kind"] == "keyword"), words(F.col("_all")))
    rows = texts.withColumn("_words", tokens).withColumn("_hit", F.explode("_found"))
    term, is_phrase = F.col("_hit.term"), F.col("_hit.kind") == "phrase"
    rows = rows.where(is_phrase | ((F.col("_hit.kind") == "keyword") & F.array_contains("_words", term)))
    score = F.when(is_phrase, F.col("_hit.before") * F.lit(PHRASE_SUBJECT) + F.col("_hit.after") * F.lit(PHRASE_BODY)).otherwise(
        F.col("_hit.before") * F.lit(KEYWORD_SUBJECT) + F.col("_hit.anywhere") * F.lit(KEYWORD_ANYWHERE))
    return rows.select(*key, "_hit.topic", "_hit.kind", term.alias("term"), score.alias("score"))


def topic_scores_scanned(df: DataFrame, terms: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """:func:`topic_scores` for a term table that fits an automaton's passes."""
    hits = scanned_hits(df, terms, key)
    return hits.groupBy(*key, "topic").agg(F.sum("score").alias("score")).where(F.col("score") > 0)


def topic_scores(df: DataFrame, terms: DataFrame, key: Sequence[str] = KEY, most: int | None = None) -> DataFrame:
    """Score per message and topic from a term table; only topics that score. ``most`` as for :func:`keyword_hits`."""
    hits = few_hits(df, terms, key) if _few(most) else keyword_hits(df, terms, key).unionByName(phrase_hits(df, terms, key))
    return hits.groupBy(*key, "topic").agg(F.sum("score").alias("score")).where(F.col("score") > 0)
