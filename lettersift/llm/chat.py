"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation as ``(turn, role, text)`` in order, equal ones by content.

    Turns without a number come first. Rows without ``conv_id`` belong to no conversation and are left out. A
    conversation is one row, so its turns must fit the memory of a task.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """``(conv_id, chosen, rejected)`` from plain conversations.

    The chosen one is the conversation itself. The rejected one is the same up to its last assistant turn, which is
    replaced by the last assistant turn of the conversation whose id differs in the lowest bit; without such a
    conversation or turn there is no rejected answer. Turns after the last assistant turn are left out of both.
    """
    turns = conversation_turns(conversations)
    answers = F.transform("turns", lambda t, i: F.when(t.role == ASSISTANT, i))
    last = F.array_max(answers)
    rows = turns.select("conv_id", "turns", last.alias("last"))
    others = rows.where("last is not null").select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.get("turns", F.col("last")).alias("answer"))
    plain = lambda turns: F.transform(turns, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    shared = F.slice("turns", 1, F.coalesce("last", F.size("turns")))
    chosen = F.slice("turns", 1, F.coalesce(F.col("last") + 1, F.size("turns")))
    answer = F.when(F.col("answer").isNotNull() & F.col("last").isNotNull(), F.array("answer")).otherwise(F.slice("turns", 1, 0))
    return rows.join(others, "conv_id", "left").select(
        "conv_id", plain(chosen).alias("chosen"), plain(F.concat(shared, answer)).alias("rejected"))


def _rendered(turn: Column) -> Column:
    """A turn in the template; what looks like a marker inside a role or text is broken by a space."""
    return F.concat(F.lit(OPEN), _safe_role(turn.role), F.lit("\n"), _safe(turn.text), F.lit(CLOSE + "\n"))


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _safe_role(role: Column) -> Column:
    """A role ends at the line's end, so line ends inside it become spaces."""
    return F.translate(_safe(role), "\r\n", "  ")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Ranges ``start:end`` of a rendered completion that are learned: assistant texts with their end marker.

    Positions are code points, the end exclusive, joined by commas.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("ranges"))

    def add(state, turn):
        begin = state.at + len(OPEN) + F.length(_safe_role(turn.role)) + 1
        end = begin + F.length(_safe(turn.text)) + len(CLOSE)
        ranges = F.when(turn.role == ASSISTANT, F.array_append(
            state.ranges, F.concat_ws(":", begin.cast("string"), end.cast("string")))).otherwise(state.ranges)
        return F.struct((end + 1).alias("at"), ranges.alias("ranges"))

    return F.aggregate(turns, start, add, lambda state: F.array_join(state.ranges, ","))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Render pairs ``(conv_id, chosen, rejected)`` of turns ``(role, text)``.

    Returns ``conv_id``, ``n_prefix`` (turns of the longest common prefix), ``prompt`` (those turns, rendered once),
    ``chosen`` and ``rejected`` (the rendered rest of each), ``chosen_mask`` and ``rejected_mask`` (``start:end`` ranges
    of the completions that are learned) and ``usable``: both completions have something to learn.

    Roles and texts are compared as they are. Missing roles and texts are empty; missing conversations have no turns.
    If one conversation is the start of the other or both are equal, a completion is empty and the pair isn't usable.
    Other columns are ignored; repeated rows give repeated rows; an empty table gives none.
    """
    clean = lambda name: F.transform(
        F.coalesce(name, F.array().cast("array<struct<role:string,text:string>>")),
        lambda t: F.struct(F.coalesce(t.role, F.lit("")).alias("role"), F.coalesce(t.text, F.lit("")).alias("text")))
    rows = pairs.select("conv_id", clean("chosen").alias("c"), clean("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & a.eqNullSafe(b))
    first = F.array_position(same, False)
    rows = rows.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(F.size("c")).cast("long"))
    rest = lambda name: F.slice(name, F.col("n_prefix").cast("int") + 1, F.size(name))
    rows = rows.select(
        "conv_id", "n_prefix", _render(F.slice("c", 1, F.col("n_prefix").cast("int"))).alias("prompt"),
        _render(rest("c")).alias("chosen"), _render(rest("r")).alias("rejected"),
        _mask(rest("c")).alias("chosen_mask"), _mask(rest("r")).alias("rejected_mask"))
    return rows.withColumn("usable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    translate(replace(coalesce(role, ''), '<|', '< |'), chr(13) || chr(10), '  ') AS shown,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT conv_id, max(p) AS p FROM t WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT t.* FROM t LEFT JOIN l USING (conv_id) WHERE l.p IS NULL OR t.p <= l.p),
r AS (
  SELECT t.* FROM t LEFT JOIN l USING (conv_id) WHERE l.p IS NULL OR t.p < l.p
  UNION ALL
  SELECT l.conv_id, o.role, o.text, o.shown, l.p FROM l JOIN l m ON m.conv_id = xor(l.conv_id, 1) JOIN t o ON o.conv_id = m.conv_id AND o.p = m.p
), ids AS (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id),
pre AS (
  SELECT ids.conv_id, coalesce(min(d.p) - 1, any_value(ids.n)) AS n_prefix
  FROM ids LEFT JOIN (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.p, r.p) AS p
    FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.p = r.p AND c.role = r.role AND c.text = r.text
    WHERE c.p IS NULL OR r.p IS NULL) d ON d.conv_id = ids.conv_id
  GROUP BY ids.conv_id
), parts AS (
  SELECT 'c' AS side, *, '<|im_start|>' || shown || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS s FROM c
  UNION ALL
  SELECT 'r', *, '<|im_start|>' || shown || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) FROM r
), placed AS (
  SELECT parts.*, n_prefix, sum(CASE WHEN parts.p > n_prefix THEN length(s) ELSE 0 END) OVER (PARTITION BY side, conv_id ORDER BY parts.p) AS e
  FROM parts JOIN pre USING (conv_id)
), g AS (
  SELECT conv_id, any_value(n_prefix) AS n_prefix,
    coalesce(string_agg(s, '' ORDER BY p) FILTER (WHERE side = 'c' AND p <= n_prefix), '') AS prompt,
    coalesce(string_agg(s, '' ORDER BY p) FILTER (WHERE side = 'c' AND p > n_prefix), '') AS chosen,
    coalesce(string_agg(s, '' ORDER BY p) FILTER (WHERE side = 'r' AND p > n_prefix), '') AS rejected,
    coalesce(string_agg((e - length(s) + 13 + length(shown)) || ':' || (e - 1), ',' ORDER BY p)
      FILTER (WHERE side = 'c' AND p > n_prefix AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((e - length(s) + 13 + length(shown)) || ':' || (e - 1), ',' ORDER BY p)
      FILTER (WHERE side = 'r' AND p > n_prefix AND role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY conv_id
)
SELECT *, chosen_mask <> '' AND rejected_mask <> '' AS usable FROM g
"""
