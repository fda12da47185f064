"""Classification by keyword rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import BODY_CHARS, tagged_text
from ..functions.text import first_chars, or_empty, sanitize, sql_string
from ..rules import (
    BASE_CONFIDENCE, CONFIDENCE_STEP, DEFAULT_CONFIDENCE, FEED_BONUS, MAX_CONFIDENCE, MIN_SCORE, OPT_OUT_TERMS,
    PROMOTION_BONUS, SCORED_CATEGORIES, KeywordRule, default_keyword_rules,
)
from ..schemas import KEY
from .automaton import with_sums
from .stage import computed
from .terms import substring_hits

# Characters of a body normalised at first, and how far past the cut they must reach.
_START_CHARS, _MARGIN = 2 * BODY_CHARS, 100


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit("")


def with_rule_texts(df: DataFrame) -> DataFrame:
    """Add the normalised texts the rules look at.

    Texts are sanitised, lower-cased and only then is the body cut. A long body is usually decided by
    its start: where the start alone yields more than is kept, the rest need not be normalised. Bodies
    whose start shrinks below that (long runs of white space) are normalised as a whole.
    """
    def lowered(name):
        return F.lower(sanitize(_column(df, name)))

    texts = df.withColumns({
        "_subject": lowered("subject"),
        "_start": F.lower(sanitize(first_chars(or_empty(_column(df, "body_text")), _START_CHARS))),
        "_sender": lowered("from_email"),
        "_name": lowered("from_name"),
    })
    enough = F.length("_start") >= BODY_CHARS + _MARGIN
    texts = texts.withColumn(
        "_body", first_chars(F.when(enough, F.col("_start")).otherwise(lowered("body_text")), BODY_CHARS)
    )
    return texts.withColumn("_text", F.concat("_subject", F.lit(" "), "_body")).drop("_start")


def _score(rules: Sequence[KeywordRule]) -> Column:
    """Sum of the weights of the rules that hit, as one expression text: cheap to build for many terms."""
    column = {"text": "_text", "sender": "_sender"}
    hits = [f"CASE WHEN contains({column[r.field]}, {sql_string(r.term)}) THEN {r.weight:d} ELSE 0 END" for r in rules]
    return F.expr(" + ".join(hits) or "0")


def keyword_scores(df: DataFrame, rules: Sequence[KeywordRule] | None = None) -> DataFrame:
    """Add one score per category: each term counts once, as a substring, with its weight.

    The terms are unrolled into one generated expression: no join, no shuffle. ``_opt_out`` tells
    whether the text holds an opt-out term.
    """
    rules = default_keyword_rules() if rules is None else rules
    texts = df if "_text" in df.columns else with_rule_texts(df)
    opted = F.lit(False)
    for term in OPT_OUT_TERMS:
        opted = opted | F.contains(F.col("_text"), F.lit(term))
    scores = {f"score_{c}": _score([r for r in rules if r.category == c]) for c in SCORED_CATEGORIES}
    return computed(texts, {**scores, "_opt_out": opted})


def keyword_scores_joined(df: DataFrame, rules: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The scores of :func:`keyword_scores` per key, for a rule table too large to unroll."""
    texts = with_rule_texts(df)
    hits = None
    for field, column in (("text", "_text"), ("sender", "_sender")):
        of_field = rules.where(F.col("field") == field).select("category", "term", "weight")
        found = substring_hits(texts.select(*key, column), key, column, of_field, "term").select(*key, "category", "weight")
        hits = found if hits is None else hits.unionByName(found)
    totals = hits.groupBy(*key).agg(*[
        F.sum(F.when(F.col("category") == category, F.col("weight")).otherwise(0)).cast("int").alias(f"score_{category}")
        for category in SCORED_CATEGORIES
    ])
    return df.select(*key).join(totals, list(key), "left").na.fill(0, [f"score_{c}" for c in SCORED_CATEGORIES])


def keyword_scores_scanned(df: DataFrame, rules: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The scores of :func:`keyword_scores_joined`, for a rule table that fits an automaton's passes.

    Each text is read once for all rules; scores are summed within the row, so nothing is shuffled.
    """
    columns = {"text": "_text", "sender": "_sender"}
    distinct = rules.select("field", "category", "term", "weight").distinct()
    names = {field: [f"{field}_{category}" for category in SCORED_CATEGORIES] for field in columns}
    weights = distinct.groupBy("term").agg(*[
        F.coalesce(F.sum(F.when((F.col("field") == field) & (F.col("category") == category), F.col("weight").cast("int"))), F.lit(0)).alias(name)
        for field in columns for category, name in zip(SCORED_CATEGORIES, names[field], strict=True)])
    texts = with_sums(with_rule_texts(df), {columns[field]: names[field] for field in columns}, weights)
    sums = F.zip_with("_sums__text", "_sums__sender", lambda a, b: a + b)
    return texts.select(*key, *[F.get(sums, F.lit(i)).cast("int").alias(f"score_{c}") for i, c in enumerate(SCORED_CATEGORIES)])


def keyword_hits(df: DataFrame, rules: Sequence[KeywordRule] | None = None) -> DataFrame:
    """How many messages each rule hits, in one pass over the messages."""
    rules = default_keyword_rules() if rules is None else rules
    source = {"text": F.col("_text"), "sender": F.col("_sender")}
    counts = with_rule_texts(df).agg(*[
        F.count_if(F.contains(source[r.field], F.lit(r.term))).alias(f"n{i}") for i, r in enumerate(rules)
    ])
    rows = F.array(*[
        F.struct(F.lit(r.category).alias("category"), F.lit(r.field).alias("field"), F.lit(r.term).alias("term"),
                 F.col(f"n{i}").alias("messages"))
        for i, r in enumerate(rules)
    ])
    return counts.select(F.inline(rows))


def with_opt_out_bonus(df: DataFrame) -> DataFrame:
    """An opt-out link speaks for a feed if anything else does, else for a promotion."""
    feed = F.col("score_feed")
    return df.withColumns({
        "score_feed": feed + F.when(F.col("_opt_out") & (feed > 0), FEED_BONUS).otherwise(0),
        "score_promotions": F.col("score_promotions") + F.when(F.col("_opt_out") & (feed <= 0), PROMOTION_BONUS).otherwise(0),
    })


def best_category(scores: dict[str, Column]) -> tuple[Column, Column]:
    """Category and confidence of a set of scores; ties go to the category listed first."""
    top = F.greatest(*scores.values())
    category = F.when(top < MIN_SCORE, "inbox")
    for name, score in scores.items():
        category = category.when(score == top, F.lit(name))
    confidence = F.when(
        top >= MIN_SCORE,
        F.least(F.lit(BASE_CONFIDENCE) + top * F.lit(CONFIDENCE_STEP), F.lit(MAX_CONFIDENCE)),
    ).otherwise(F.lit(DEFAULT_CONFIDENCE))
    return category, confidence


def classify_rules(df: DataFrame, rules: Sequence[KeywordRule] | None = None) -> DataFrame:
    """Add ``category, confidence, method, score_*`` and the ``input_text`` that was looked at."""
    scored = with_opt_out_bonus(keyword_scores(with_rule_texts(df), rules))
    category, confidence = best_category({c: F.col(f"score_{c}") for c in SCORED_CATEGORIES})
    sender = F.concat("_name", F.lit(" <"), "_sender", F.lit(">"))
    return scored.withColumns({
        "category": category,
        "confidence": confidence,
        "method": F.lit("rules"),
        "input_text": tagged_text(F.col("_subject"), sender, F.col("_body")),
    }).drop("_subject", "_body", "_sender", "_name", "_text", "_opt_out")
