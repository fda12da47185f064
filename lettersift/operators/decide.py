"""Deciding, planning and applying mailbox actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import ALL_MAIL, DELETED, LIVE_LABEL, PROTECTING_TOPIC_SCORE, SEEN, TRASH_LABEL, Settings
from ..schemas import KEY
from .senders import ALLOWED, DENIED
from .stage import computed

_DECISION_COLUMNS = ["should_act", "action", "reason", "decision_confidence"]


def _quoted_list(names: Column) -> Column:
    """Names as a bracketed list of quoted strings."""
    def quoted(name):
        escaped = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        plain = F.contains(name, F.lit("'")) & ~F.contains(name, F.lit('"'))
        return F.when(plain, F.concat(F.lit('"'), F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'))).otherwise(
            F.concat(F.lit("'"), escaped, F.lit("'"))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(names, quoted), ", "), F.lit("]"))


def decide(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``should_act, action, reason, decision_confidence``.

    Needs ``category, confidence, topics, topic_score, sender_status``. The first rule that applies
    wins: allowed sender, denied sender, category, switch, strong topic, otherwise act.
    """
    sender, category = F.col("sender_status"), F.col("category")
    protected = (F.size("topics") > 0) & (F.col("topic_score") >= F.lit(PROTECTING_TOPIC_SCORE))
    act = F.lit(settings.action_on_deletion)
    keep = F.lit("none")
    promotion = category == "promotions"
    quoted_category = F.concat(F.lit('"'), category, F.lit('"'))

    def outcome(should_act, action, reason, confidence):
        return F.struct(
            F.lit(should_act).alias("should_act"), action.alias("action"),
            reason.alias("reason"), confidence.alias("decision_confidence"),
        )

    sure = F.lit(1.0)
    decision = (
        F.when(sender == ALLOWED, outcome(False, keep, F.lit("Sender is whitelisted"), sure))
        .when(sender == DENIED, outcome(True, act, F.lit("Sender is blacklisted"), sure))
        .when(~promotion, outcome(False, keep, F.concat(
            F.lit("Only promotional emails are targeted, "), quoted_category, F.lit(" emails are preserved")), sure))
    )
    if not settings.delete_promotional:
        decision = decision.otherwise(outcome(False, keep, F.lit("Promotional email action is disabled"), sure))
    else:
        decision = decision.when(protected, outcome(False, keep, F.concat(
            F.lit("Promotional but matches topics: "), _quoted_list(F.col("topics")),
            F.format_string(" (score: %.2f)", "topic_score")), sure,
        )).otherwise(outcome(True, act, F.concat(
            F.lit("Category "), quoted_category, F.lit(" email met criteria")), F.col("confidence")))
    decided = df.withColumn("_decision", decision)
    return computed(decided, {c: F.col(f"_decision.{c}") for c in _DECISION_COLUMNS}).drop("_decision")


def plan_actions(df: DataFrame, settings: Settings = Settings(), label: str = LIVE_LABEL) -> DataFrame:
    """Add ``planned_action, planned_label, apply``.

    The decided action comes first; transactions and feeds without one are archived. A dry run makes
    the same plan but applies nothing.
    """
    planned = (
        F.when(F.col("should_act"), F.col("action"))
        .when(F.col("category").isin("transactions", "feed"), "archive")
        .otherwise("none")
    )
    return df.withColumn("planned_action", planned).withColumns({
        "planned_label": F.when(F.col("planned_action") == "apply_label", F.lit(label)),
        "apply": F.lit(not settings.dry_run) & (F.col("planned_action") != "none"),
    })


def _added(values: Column, *extra: str | Column) -> Column:
    return F.array_union(F.coalesce(values, F.array().cast("array<string>")), F.array(*[F.lit(e) for e in extra]))


def label_plan(judged: DataFrame, key: tuple[str, ...] = KEY, dry_run: bool = False) -> DataFrame:
    """The labels of a bulk run (``new_label``) as a plan for :func:`apply_actions`."""
    labelled = judged.where(F.col("new_label").isNotNull())
    return labelled.select(
        *key, F.lit("apply_label").alias("planned_action"), F.col("new_label").alias("planned_label"), F.lit(not dry_run).alias("apply"))


def apply_actions(mailbox: DataFrame, plan: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """New mailbox snapshot after carrying out the applied rows of a plan.

    Trashing adds the trash label and the deleted and seen flags; archiving marks as seen and moves to the all-mail
    folder. Rows that are only labelled or not planned keep folder and flags. Of several steps for one message
    the first by name of the action counts.
    """
    step = F.min(F.struct(F.col("planned_action").alias("_action"), F.col("planned_label").alias("_label")))
    steps = plan.where("apply").groupBy(*key).agg(step.alias("_step")).select(*key, "_step.*")
    joined = mailbox.join(steps, list(key), "left")
    action, flags, labels = F.col("_action"), F.col("flags"), F.col("labels")
    return joined.withColumns({
        "source_folder": F.when(action == "archive", F.lit(ALL_MAIL)).otherwise(F.col("source_folder")),
        "flags": F.when(action == "move_to_trash", _added(flags, DELETED, SEEN)).when(
            action == "archive", _added(flags, SEEN)).otherwise(flags),
        "labels": F.when(action == "move_to_trash", _added(labels, TRASH_LABEL))
                   .when(action == "apply_label", _added(labels, F.col("_label")))
                   .otherwise(labels),
    }).drop("_action", "_label")


def mark_as_read(mailbox: DataFrame, keys: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Add the seen flag to the given messages."""
    marked = mailbox.join(keys.select(*key, F.lit(True).alias("_mark")).distinct(), list(key), "left")
    return marked.withColumn(
        "flags", F.when(F.col("_mark"), _added(F.col("flags"), SEEN)).otherwise(F.col("flags"))
    ).drop("_mark")
