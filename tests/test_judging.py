"""Golden rows for rules, topics, senders and decisions, and agreement of the two forms of each."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from lettersift import rules as R
from lettersift.operators import classify, decide, senders, topics
from lettersift.functions.text import sanitize
from lettersift.operators.triage import triage
from lettersift.sources import corpus

# Own mails; scores follow from the term tables: a point for each keyword, two for each sender part, and the bonuses.
CASES = [
    ("Half price weekend", "Everything must go, discount on all lamps, buy now.", "hello@lamps.example", (0, 0, 2), "promotions", 0.7),
    ("Receipt for order 7781", "Your payment of 12 EUR was received.", "desk@shopkeeper.example", (3, 0, 0), "transactions", 0.8),
    ("Gardening digest", "Three articles this week. Unsubscribe below.", "post@gardeners.example", (0, 4, 0), "feed", 0.9),
    ("Dinner on Sunday?", "Bring the dog, we have enough soup.", "aunt@home.example", (0, 0, 0), "inbox", 0.6),
    ("Lamp sale", "Opt-out any time.", "hello@lamps.example", (0, 0, 4), "promotions", 0.9),
]


def mail(spark, rows):
    made = spark.createDataFrame(rows, "uid long, subject string, body_text string, from_email string, from_name string")
    return made.withColumns({"mailbox": F.lit("m"), "source_folder": F.lit("INBOX")})


def test_classify_golden(spark):
    rows = [(i, s, b, e, "") for i, (s, b, e, *_) in enumerate(CASES)]
    got = {r.uid: r for r in classify.classify_rules(mail(spark, rows)).collect()}
    for i, (*_, scores, category, confidence) in enumerate(CASES):
        r = got[i]
        assert (r.score_transactions, r.score_feed, r.score_promotions) == scores, CASES[i]
        assert (r.category, r.confidence, r.method) == (category, pytest.approx(confidence), "rules")


def by_hand(subject, body, sender):
    """The rules in plain Python."""
    clean = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    text = f"{clean(subject)} {clean(body)[:1000]}"
    score = {c: sum(k in text for k in R.KEYWORDS[c]) + 2 * sum(d in clean(sender) for d in R.SENDER_PARTS[c]) for c in R.SCORED_CATEGORIES}
    if "unsubscribe" in text or "opt-out" in text:
        key, bonus = ("feed", 2) if score["feed"] > 0 else ("promotions", 3)
        score[key] += bonus
    top = max(score.values())
    category = max(score, key=score.get) if top >= 2 else "inbox"
    return tuple(score.values()), category


def random_mails(n, seed):
    rng = random.Random(seed)
    terms = [t for c in R.SCORED_CATEGORIES for t in R.KEYWORDS[c] + R.SENDER_PARTS[c]] + ["unsubscribe", "opt-out", "x", "YZ", "é"]
    space = [" ", "  ", "\n", "\t\t", " " * 700, " "]
    text = lambda k: "".join(rng.choice(terms).title() + rng.choice(space) for _ in range(rng.randint(0, k)))
    return [(i, text(4), text(120), f"{rng.choice(terms)}@{rng.choice(terms)}.com".replace(" ", ""), "") for i in range(n)]


def test_rules_on_random_mails_and_joined_form(spark):
    rows = random_mails(150, 7)
    df = mail(spark, rows)
    got = {r.uid: r for r in classify.classify_rules(df).collect()}
    for uid, subject, body, sender, _ in rows:
        r = got[uid]
        assert ((r.score_transactions, r.score_feed, r.score_promotions), r.category) == by_hand(subject, body, sender)
    plain = {tuple(r) for r in classify.keyword_scores(df).select("uid", "score_transactions", "score_feed", "score_promotions").collect()}
    joined = classify.keyword_scores_joined(df, R.keyword_rules_table(spark)).drop("mailbox", "source_folder")
    assert plain == {tuple(r) for r in joined.collect()}


def test_both_forms_count_messages_of_equal_uid_apart(spark):
    """A uid numbers the messages of one folder only."""
    rows = mail(spark, [(1, "Your invoice", "", "", ""), (1, "Big sale", "kubernetes", "", "")])
    rows = rows.withColumn("source_folder", F.when(F.col("subject") == "Big sale", "Other").otherwise("INBOX"))
    joined = {r.source_folder: (r.score_transactions, r.score_promotions) for r in classify.keyword_scores_joined(rows, R.keyword_rules_table(spark)).collect()}
    plain = {r.source_folder: (r.score_transactions, r.score_promotions) for r in classify.keyword_scores(rows).collect()}
    assert joined == plain and len(joined) == 2
    scored = topics.topic_scores(rows, R.topic_terms_table(spark, ["kubernetes", "sale"])).collect()
    assert {r.source_folder for r in scored} == {"Other"} and len(scored) == 2


def test_bodies_around_the_cut(spark):
    """Normalising the start of a long body gives what normalising all of it does."""
    rng = random.Random(11)
    pieces = ["a", "İ", "ΑΣ ", "ß", " ", "\n\t ", " " * 60, "sale", "x" * 30, "\u2003", "🙂", "ﬁ"]
    bodies = ["".join(rng.choices(pieces, k=rng.randrange(20, 700))) for _ in range(120)]
    bodies += ["y" * n + tail for n in (998, 999, 1000, 1001, 1099, 1100, 1999, 2000, 2001) for tail in ("", " sale", "Σ", " " * 2000 + "sale")]
    rows = mail(spark, [(i, "", b, "", "") for i, b in enumerate(bodies)])
    texts = classify.with_rule_texts(rows).select("uid", "_body", F.substring(F.lower(sanitize(F.col("body_text"))), 1, 1000).alias("whole"))
    assert [r.uid for r in texts.where("_body != whole").collect()] == []


def test_custom_rules_and_quotes(spark):
    rules = [R.KeywordRule("feed", "text", "it's \\ odd", 2)]
    got = classify.classify_rules(mail(spark, [(1, "IT'S \\ ODD", "", "", "")]), rules).first()
    assert (got.score_feed, got.category) == (2, "feed")


TOPICS = ["machine learning", "kubernetes", "family"]


@pytest.mark.parametrize("subject, body, names, score", [
    ("New Machine Learning Course Available", "Check out this new ML course", ["machine learning"], 0.45),
    ("K8s Update: Version 1.28 Released", "Kubernetes version 1.28 is out", ["kubernetes"], 0.30),
    ("Special Offer: 50% Off Shoes", "Get shoes", [], 0.0),
    ("Intro to machine", "learning today", [], 0.0),
    ("ml html", "", ["machine learning"], 0.5),
])
def test_topics_golden(spark, subject, body, names, score):
    df = mail(spark, [(1, subject, body, "", "")])
    got = topics.match_topics(df, TOPICS).first()
    assert got.topics == names and got.topic_score == pytest.approx(score) and got.topic_matched == bool(names)
    joined = topics.topic_scores(df, R.topic_terms_table(spark, TOPICS)).collect()
    assert sum(r.score for r in joined) == pytest.approx(score * 10)


def test_topic_shapes(spark):
    built = {t.name: t for t in R.build_topics(["C++", "Node.js", " Artificial Intelligence ", "family", "family"])}
    assert built["c++"].keywords == ("c++",) and built["node.js"].phrases == ("node.js",)
    assert built["artificial intelligence"].keywords == ("ai", "artificialintelligence") and len(built) == 4
    got = topics.match_topics(mail(spark, [(1, "c++ and node.js", "", "", "")]), list(built)).first()
    assert got.topics == ["node.js"] and got.topic_matches[0].phrases == ["node.js"]
    none = topics.match_topics(mail(spark, [(1, "c++", "", "", "")]), []).first()
    assert none.topics == [] and none.topic_score == 0.0 and not none.topic_matched


ALLOW = ["important@example.com", "*@company.com", "noreply@github.com", "*support@*.com"]
DENY = ["spam@promotions.com", "*@marketing.example.com", "a_c%d@x.y", "*under_score*"]
SENDERS = {
    "important@example.com": "whitelisted", "anyone@company.com": "whitelisted", "noreply@github.com": "whitelisted",
    "spam@promotions.com": "blacklisted", "ads@marketing.example.com": "blacklisted", "random@gmail.com": "neutral",
    "techsupport@example.com": "whitelisted", " ADS@Marketing.example.com ": "blacklisted", "a@company.com@z": "whitelisted",
    "a_c%d@x.y": "blacklisted", "abcxd@x.y": "neutral", "an-under_score@x": "blacklisted", "an-underXscore@x": "neutral", "": "neutral",
}


def test_sender_status_both_forms(spark):
    df = mail(spark, [(i, "", "", s, "") for i, s in enumerate(SENDERS)])
    for got in (senders.sender_status(df, ALLOW, DENY), senders.sender_status_joined(df, R.sender_rules_table(spark, ALLOW, DENY))):
        assert {r.from_email: r.sender_status for r in got.collect()} == SENDERS


def test_wildcards_against_globbing(spark):
    rng = random.Random(3)
    addresses = list({"".join(rng.choice("ab@.") for _ in range(rng.randint(0, 7))) for _ in range(120)})
    patterns = list({"".join(rng.choice("ab@.*") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"*", "**"})
    patterns = [p for p in patterns if "*" in p]
    df = spark.createDataFrame([(a,) for a in addresses], "sender string")
    got = {(r.sender, r.pattern) for r in senders.wildcard_matches(df, R.sender_rules_table(spark, patterns, [])).collect()}
    piece = lambda a: a.split("@")[1] if "@" in a else a
    expected = {(a, p) for a in addresses for p in patterns if fnmatch.fnmatchcase(a, p) or p == "*@" + piece(a)}
    # A pattern of stars only is reported once per list.
    star = lambda pairs: {(a, "*" if set(p) == {"*"} else p) for a, p in pairs}
    assert star(got) == star(expected)


DECISIONS = [
    ("promotions", 0.9, [], 0.0, "neutral", (True, "move_to_trash", 0.9)),
    ("promotions", 0.9, ["family"], 0.15, "neutral", (False, "none", 1.0)),
    ("promotions", 0.9, ["family"], 0.05, "neutral", (True, "move_to_trash", 0.9)),
    ("promotions", 0.9, [], 0.0, "whitelisted", (False, "none", 1.0)),
    ("inbox", 0.6, ["family"], 1.0, "blacklisted", (True, "move_to_trash", 1.0)),
    ("feed", 0.9, [], 0.0, "neutral", (False, "none", 1.0)),
]
_JUDGED = "uid long, category string, confidence double, topics array<string>, topic_score double, sender_status string"


def judged(spark):
    return spark.createDataFrame([(i, *d[:5]) for i, d in enumerate(DECISIONS)], _JUDGED)


def test_decide_golden(spark):
    got = sorted(decide.decide(judged(spark)).collect(), key=lambda r: r.uid)
    assert [(r.should_act, r.action, r.decision_confidence) for r in got] == [d[5] for d in DECISIONS]
    assert got[1].reason == "Promotional but matches topics: ['family'] (score: 0.15)"
    assert got[5].reason == 'Only promotional emails are targeted, "feed" emails are preserved'
    off = decide.decide(judged(spark), R.Settings(delete_promotional=False)).where("uid = 0").first()
    assert (off.should_act, off.reason) == (False, "Promotional email action is disabled")


def test_topic_names_are_quoted_like_a_list(spark):
    row = spark.createDataFrame([(1, "promotions", 0.9, ["it's", 'a "b"', "c\\d"], 0.5, "neutral")], _JUDGED)
    assert decide.decide(row).first().reason == f"Promotional but matches topics: {['it' + chr(39) + 's', 'a ' + chr(34) + 'b' + chr(34), 'c' + chr(92) + 'd']} (score: 0.50)"


def test_plan_and_apply(spark):
    for settings, applied in ((R.Settings(), 0), (R.Settings(dry_run=False), 4)):
        plan = decide.plan_actions(decide.decide(judged(spark), settings), settings).withColumns({"mailbox": F.lit("m"), "source_folder": F.lit("INBOX")})
        rows = {r.uid: r for r in plan.collect()}
        assert [rows[i].planned_action for i in range(6)] == ["move_to_trash", "none", "move_to_trash", "none", "move_to_trash", "archive"]
        assert sum(r.apply for r in rows.values()) == applied
    box = spark.createDataFrame([("m", i, "INBOX", ["\\Flagged"], ["x"]) for i in range(7)], "mailbox string, uid long, source_folder string, flags array<string>, labels array<string>")
    after = {r.uid: r for r in decide.apply_actions(box, plan).collect()}
    assert after[0].labels == ["x", "\\Trash"] and set(after[0].flags) == {"\\Flagged", "\\Seen", "\\Deleted"} and after[0].source_folder == "INBOX"
    assert after[5].source_folder == R.ALL_MAIL and after[5].labels == ["x"]
    assert after[1].flags == ["\\Flagged"] and after[6].flags == ["\\Flagged"]
    labelling = R.Settings(action_on_deletion="apply_label", dry_run=False)
    plan = decide.plan_actions(decide.decide(judged(spark), labelling), labelling).withColumns({"mailbox": F.lit("m"), "source_folder": F.lit("INBOX")})
    after = {r.uid: r for r in decide.apply_actions(box, plan).collect()}
    assert after[0].labels == ["x", "MarkForDeletion"] and after[0].flags == ["\\Flagged"]
    read = {r.uid: r for r in decide.mark_as_read(box, plan.where("uid = 1")).collect()}
    assert read[1].flags == ["\\Flagged", "\\Seen"] and read[2].flags == ["\\Flagged"]


def test_settings_defaults():
    assert R.Settings.from_mapping({}) == R.Settings()
    given = R.Settings.from_mapping({"deletion": {"dry_run": False}, "classification": {"topics_i_care_about": ["a"]}})
    assert (given.dry_run, given.action_on_deletion, given.topics) == (False, "move_to_trash", ("a",))


# Expected category, topic score, sender status and planned action of each variant without filler text.
VARIANTS = [
    ("transactions", 0.0, "neutral", "archive"), ("feed", 0.0, "neutral", "archive"), ("promotions", 0.0, "neutral", "move_to_trash"),
    ("inbox", 0.0, "neutral", "none"), ("promotions", 0.45, "neutral", "none"), ("promotions", 0.05, "neutral", "move_to_trash"),
    ("promotions", 0.0, "whitelisted", "none"), ("promotions", 0.0, "blacklisted", "move_to_trash"), ("transactions", 0.0, "neutral", "archive"),
    ("inbox", 0.25, "neutral", "none"),
]


def test_triage_of_the_variants(spark):
    documents = spark.createDataFrame([(i, "", "en", "src1", 0) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    got = sorted(triage(corpus.message_rows(documents, pages), corpus.SETTINGS).collect(), key=lambda r: r.uid)
    assert [(r.category, round(r.topic_score, 2), r.sender_status, r.planned_action) for r in got] == VARIANTS


def test_edit_rules(spark):
    rules = spark.createDataFrame([("allow", " A@b.c "), ("allow", "a@b.c"), ("deny", "x"), ("deny", " ")], "list string, pattern string")
    extra = spark.createDataFrame([("deny", "Y"), ("deny", "x")], "list string, pattern string")
    gone = spark.createDataFrame([("allow", "A@B.C")], "list string, pattern string")
    assert [tuple(r) for r in R.rules_listing(R.edit_rules(rules, add=extra, remove=gone)).collect()] == [("deny", "x"), ("deny", "y")]
    assert R.edit_rules(rules).count() == 2
