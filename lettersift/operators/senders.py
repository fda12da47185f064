"""Matching sender addresses against allow and deny patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import sender_domain
from ..functions.text import or_empty, strip
from ..rules import normalise_terms
from ..schemas import KEY
from .automaton import with_found_terms
from .terms import substring_candidates

ALLOWED, DENIED, NEUTRAL = "whitelisted", "blacklisted", "neutral"


def address_key(address: Column) -> Column:
    return F.lower(strip(or_empty(address)))


def _like_pattern(pattern: str) -> str:
    for special in ("\\", "%", "_"):
        pattern = pattern.replace(special, "\\" + special)
    return pattern.replace("*", "%")


def listed(address: Column, patterns: Sequence[str]) -> Column:
    """True where the address is listed: exactly, by ``*@domain`` or by a pattern with ``*``.

    Exact and domain entries are hash lookups; only the remaining patterns are tried one by one.
    """
    entries = normalise_terms(patterns)
    if not entries:
        return F.lit(False)
    found = address.isin(entries) | F.concat(F.lit("*@"), sender_domain(address)).isin(entries)
    for pattern in entries:
        if "*" in pattern:
            found = found | address.like(_like_pattern(pattern))
    return found


def sender_status(df: DataFrame, allow: Sequence[str], deny: Sequence[str]) -> DataFrame:
    """Add ``sender_status``: the allow list wins over the deny list."""
    keyed = df.withColumn("_address", address_key(F.col("from_email")))
    return keyed.withColumn(
        "sender_status",
        F.when(listed(F.col("_address"), allow), ALLOWED)
        .when(listed(F.col("_address"), deny), DENIED)
        .otherwise(NEUTRAL),
    ).drop("_address")


def distinct_senders(df: DataFrame) -> DataFrame:
    """Each address once: rules are matched per sender, not per message."""
    return df.select(address_key(F.col("from_email")).alias("sender")).distinct()


def exact_matches(senders: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows ``list, sender, pattern`` for addresses that are listed as they are."""
    return senders.join(rules, F.col("sender") == F.col("pattern")).select("list", "sender", "pattern")


def wildcard_matches(senders: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows ``list, sender, pattern`` for addresses matched by a pattern with ``*``.

    ``*@domain`` is joined on the domain. Other patterns are joined on the first characters of their
    longest literal piece and then checked; a bare ``*`` matches everyone.
    """
    patterns = rules.where(F.contains(F.col("pattern"), F.lit("*")))
    by_domain = senders.withColumn("pattern", F.concat(F.lit("*@"), sender_domain(F.col("sender"))))
    domain = by_domain.join(patterns, "pattern").select("list", "sender", "pattern")

    pieces = F.split("pattern", r"\*")
    longest = F.array_sort(
        pieces, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)
    )
    anchored = patterns.withColumn("_piece", F.get(longest, F.lit(0)))
    candidates = substring_candidates(
        senders, ["sender"], "sender", anchored.where(F.col("_piece") != ""), "_piece"
    ).select("list", "sender", "pattern")
    everyone = patterns.where(F.translate("pattern", "*", "") == "")
    return domain.union(_like_matches(candidates)).union(_everyone(senders, everyone)).distinct()


def _like_matches(candidates: DataFrame) -> DataFrame:
    like = F.col("pattern")
    for special in ("\\", "%", "_"):
        like = F.replace(like, F.lit(special), F.lit("\\" + special))
    return candidates.where(F.like("sender", F.replace(like, F.lit("*"), F.lit("%"))))


def _everyone(senders: DataFrame, stars: DataFrame) -> DataFrame:
    """All senders for a list with a bare ``*``.

    At most one row per list: read as a scalar, so that senders are not joined on a constant.
    """
    rows = None
    for name in ("allow", "deny"):
        star = stars.where(F.col("list") == name).select(F.min("pattern")).scalar()
        own = senders.select(F.lit(name).alias("list"), "sender", star.alias("pattern")).where(F.col("pattern").isNotNull())
        rows = own if rows is None else rows.union(own)
    return rows


def wildcard_candidates(senders: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows ``list, sender, pattern``: for each pattern the addresses that hold the rarest of its literal pieces.

    Two passes of an automaton over the distinct addresses: the first counts in how many of them each piece stands, the
    second finds the chosen pieces. A pattern with a piece that stands nowhere matches nobody and is left out.
    ``patterns`` must hold a literal piece each.
    """
    pieces = patterns.select("list", "pattern", F.explode(F.filter(F.split("pattern", r"\*"), lambda x: x != "")).alias("piece")).distinct()
    seen = with_found_terms(senders, "sender", pieces.select("piece").distinct(), "piece", out="_pieces")
    counts = seen.select(F.explode("_pieces.piece").alias("piece")).groupBy("piece").agg(F.count("*").alias("_n"))
    counted = pieces.join(counts, "piece", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rank = F.struct("_n", -F.length("piece"), "piece")
    chosen = counted.groupBy("list", "pattern").agg(F.min_by(F.struct("piece", "_n"), rank).alias("_rarest"))
    chosen = chosen.where("_rarest._n > 0").select("list", "pattern", F.col("_rarest.piece").alias("piece"))
    held = with_found_terms(senders, "sender", chosen.select("piece").distinct(), "piece", out="_pieces")
    return held.select("sender", F.explode("_pieces.piece").alias("piece")).join(chosen, "piece").select("list", "sender", "pattern")


def wildcard_matches_scanned(senders: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of :func:`wildcard_matches`, from candidates by the rarest piece of each pattern."""
    patterns = rules.where(F.contains(F.col("pattern"), F.lit("*")))
    literal = F.translate("pattern", "*", "") != ""
    by_domain = senders.withColumn("pattern", F.concat(F.lit("*@"), sender_domain(F.col("sender"))))
    domain = by_domain.join(patterns, "pattern").select("list", "sender", "pattern")
    # A plain domain pattern is covered by the join above, but for addresses that merely end in it.
    checked = _like_matches(wildcard_candidates(senders, patterns.where(literal)))
    return domain.union(checked).union(_everyone(senders, patterns.where(~literal))).distinct()


def sender_statuses(senders: DataFrame, rules: DataFrame) -> DataFrame:
    """Status of each sender from a rule table ``(list, pattern)``; only listed senders appear."""
    matches = exact_matches(senders, rules).union(wildcard_matches(senders, rules))
    return matches.groupBy("sender").agg(
        F.when(F.bool_or(F.col("list") == "allow"), ALLOWED).otherwise(DENIED).alias("sender_status")
    )


def sender_status_joined(df: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`sender_status` for rule tables too large to unroll.

    Addresses are matched once each. Messages meet their status by key, so a sender of most messages moves only
    their keys into one place, where Spark can split them, and never their bodies.
    """
    statuses = sender_statuses(distinct_senders(df), rules)
    keys = df.select(*KEY, address_key(F.col("from_email")).alias("sender")).distinct()
    listed_keys = keys.join(statuses, "sender").select(*KEY, "sender", "sender_status")
    keyed = df.withColumn("sender", address_key(F.col("from_email")))
    return keyed.join(listed_keys, [*KEY, "sender"], "left").withColumn(
        "sender_status", F.coalesce("sender_status", F.lit(NEUTRAL))
    ).drop("sender")
