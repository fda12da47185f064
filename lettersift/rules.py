"""Rules as data: categories, keyword rules, topic terms, sender patterns, settings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import strip

# Category order (also the class numbers 0 to 3) and the categories scored by rules.
CATEGORIES = ["transactions", "feed", "promotions", "inbox"]
SCORED_CATEGORIES = ["transactions", "feed", "promotions"]

# Keywords looked for in subject and body, and parts of sender addresses.
KEYWORDS = {
    "transactions": [
        "invoice", "payment", "bill", "receipt", "transaction", "charged", "refund", "stock", "trade", "dividend",
        "statement", "balance", "due", "paid", "purchase", "order", "confirmation", "shipped", "delivery",
    ],
    "feed": [
        "newsletter", "digest", "weekly", "daily", "tutorial", "launch", "announcement", "update", "blog", "article",
        "podcast", "episode", "issue", "edition",
    ],
    "promotions": [
        "sale", "discount", "offer", "deal", "limited time", "buy now", "shop", "coupon", "free shipping", "%off",
        "save", "clearance", "exclusive",
    ],
}
SENDER_PARTS = {
    "transactions": ["paypal", "stripe", "bank", "zerodha", "groww", "amazon", "flipkart", "razorpay"],
    "feed": ["substack", "medium", "beehiiv", "buttondown", "mailchimp", "convertkit"],
    "promotions": ["marketing", "promo", "offers"],
}
# Weights, opt-out terms with their bonus, and the confidence formula.
KEYWORD_WEIGHT, SENDER_WEIGHT = 1, 2
OPT_OUT_TERMS = ["unsubscribe", "opt-out"]
FEED_BONUS, PROMOTION_BONUS = 2, 3
MIN_SCORE = 2
BASE_CONFIDENCE, CONFIDENCE_STEP, MAX_CONFIDENCE, DEFAULT_CONFIDENCE = 0.5, 0.1, 0.95, 0.6
# Further spellings of some topics, and topic weights.
TOPIC_ALIASES = {
    "machine learning": ["ml", "machinelearning"],
    "artificial intelligence": ["ai", "artificialintelligence"],
    "kubernetes": ["k8s"],
}
PHRASE_SUBJECT, PHRASE_BODY, KEYWORD_SUBJECT, KEYWORD_ANYWHERE = 4.0, 2.0, 2.0, 0.5
TOPIC_SCALE = 10.0
PROTECTING_TOPIC_SCORE = 0.15
# Mailbox names, flags and labels.
INBOX, ALL_MAIL = "INBOX", "[Gmail]/All Mail"
ALL_MAIL_NAMES = ["[Gmail]/All Mail", '"[Gmail]/All Mail"', "All Mail"]
TRASH_NAMES = ["[Gmail]/Trash", '"[Gmail]/Trash"', "Trash"]
SKIPPED_FOLDER_PARTS = ["Trash", "Spam", "Bin"]
SEEN, DELETED, TRASH_LABEL = "\\Seen", "\\Deleted", "\\Trash"
LIVE_LABEL, HISTORICAL_LABEL = "MarkForDeletion", "MarkedForDeletion"
RECENT_HASHES = 200
MAX_DAYS_LATE = 2


@dataclass(frozen=True)
class KeywordRule:
    category: str
    field: str  # "text" (subject and body) or "sender" (address)
    term: str
    weight: int


def default_keyword_rules() -> list[KeywordRule]:
    rules = []
    for category in SCORED_CATEGORIES:
        rules += [KeywordRule(category, "text", term, KEYWORD_WEIGHT) for term in KEYWORDS[category]]
        rules += [KeywordRule(category, "sender", term, SENDER_WEIGHT) for term in SENDER_PARTS[category]]
    return rules


def keyword_rules_table(spark: SparkSession, rules: Iterable[KeywordRule] | None = None) -> DataFrame:
    rows = [(r.category, r.field, r.term, r.weight) for r in (rules or default_keyword_rules())]
    return spark.createDataFrame(rows, "category string, field string, term string, weight int")


@dataclass(frozen=True)
class Settings:
    """What to do with a message; missing entries take the defaults."""

    action_on_deletion: str = "move_to_trash"
    delete_promotional: bool = True
    dry_run: bool = True
    topics: Sequence[str] = field(default_factory=tuple)
    allow: Sequence[str] = field(default_factory=tuple)
    deny: Sequence[str] = field(default_factory=tuple)

    @classmethod
    def from_mapping(cls, config: dict) -> Settings:
        """Read the ``deletion`` and ``classification`` sections of a configuration."""
        deletion, classification = config.get("deletion") or {}, config.get("classification") or {}
        return cls(
            action_on_deletion=deletion.get("action_on_deletion", cls.action_on_deletion),
            delete_promotional=deletion.get("delete_promotional", cls.delete_promotional),
            dry_run=deletion.get("dry_run", cls.dry_run),
            topics=tuple(classification.get("topics_i_care_about", ())),
            allow=tuple(classification.get("whitelisted_senders", ())),
            deny=tuple(classification.get("blacklisted_senders", ())),
        )


@dataclass(frozen=True)
class Topic:
    name: str
    phrases: tuple[str, ...]
    keywords: tuple[str, ...]


def normalise_terms(items: Iterable[str]) -> list[str]:
    """Lower-cased, trimmed, non-empty entries in first-seen order."""
    return list(dict.fromkeys(t for t in (i.lower().strip() for i in items) if t))


def build_topics(names: Iterable[str]) -> list[Topic]:
    """A topic of several words is looked for as a phrase, one of a single word as a token."""
    import re

    topics = []
    for name in dict.fromkeys(n.lower().strip() for n in names):
        aliases = tuple(TOPIC_ALIASES.get(name, ()))
        if len(re.findall(r"\w+", name)) > 1:
            topics.append(Topic(name, (name,), aliases))
        else:
            topics.append(Topic(name, (), (name, *aliases)))
    return topics


def topic_terms(topics: DataFrame, column: str = "topic") -> DataFrame:
    """The table form of :func:`build_topics`: one row ``(topic, kind, term)`` per term."""
    names = topics.select(F.lower(strip(F.col(column))).alias("topic")).distinct()
    words = F.regexp_count("topic", F.lit(r"[\p{L}\p{N}_]+"))
    own = names.select("topic", F.when(words > 1, F.lit("phrase")).otherwise(F.lit("keyword")).alias("kind"),
                       F.col("topic").alias("term"))
    aliases = F.lit(None).cast("array<string>")
    for name, terms in TOPIC_ALIASES.items():
        aliases = F.when(F.col("topic") == name, F.array(*[F.lit(t) for t in terms])).otherwise(aliases)
    return own.unionByName(names.select("topic", F.lit("keyword").alias("kind"), F.explode(aliases).alias("term")))


def topic_terms_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return topic_terms(spark.createDataFrame([(n,) for n in names], "topic string"))


def topic_terms_bound(names: Sequence[str]) -> int:
    """How many rows :func:`topic_terms_table` has at most."""
    return sum(len(t.phrases) + len(t.keywords) for t in build_topics(names))


def normalise_rules(rules: DataFrame, column: str = "pattern") -> DataFrame:
    """Lower-cased, trimmed, non-empty, distinct rule rows."""
    return (
        rules.withColumn(column, F.lower(strip(F.col(column)))).where(F.col(column) != "").distinct()
    )


def sender_rules_table(spark: SparkSession, allow: Iterable[str], deny: Iterable[str]) -> DataFrame:
    rows = [("allow", p) for p in allow] + [("deny", p) for p in deny]
    return normalise_rules(spark.createDataFrame(rows, "list string, pattern string"))


def edit_rules(rules: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None,
               column: str = "pattern") -> DataFrame:
    """Rule rows after removing ``remove`` and then adding ``add``; all sides are normalised."""
    edited = normalise_rules(rules, column)
    if remove is not None:
        edited = edited.join(normalise_rules(remove, column), edited.columns, "left_anti")
    if add is not None:
        edited = edited.unionByName(normalise_rules(add, column)).distinct()
    return edited


def rules_listing(rules: DataFrame) -> DataFrame:
    """Rules of each list in order."""
    return normalise_rules(rules).orderBy("list", "pattern")
