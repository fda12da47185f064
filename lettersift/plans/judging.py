"""Classification, topics, senders, decisions, plans and the run records."""

import hashlib

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.headers import as_utc
from ..functions.model import CATEGORIES
from ..operators import classify, decide as deciding, history, senders, store, topics, triage as judging
from ..schemas import KEY
from ..session import shared_dir
from ..sources import corpus, mailbox as stored, tables
from ..streaming import jobs
from . import sql
from .registry import ORACLES, query

_JUDGED = sql.MESSAGES + sql.classified()
_SETTINGS = corpus.SETTINGS
_SCORES = ["score_transactions", "score_feed", "score_promotions"]


def _messages(spark, sf):
    return judging.with_fallback_body(corpus.messages(spark, sf))


def _classified(spark, sf):
    return classify.classify_rules(_messages(spark, sf))


def _triaged(spark, sf, settings=_SETTINGS):
    return judging.triage(corpus.messages(spark, sf), settings)


@query(f"""{sql.DECIDED} SELECT uid, category, confidence, array_to_string(topics, ',') AS topics, topic_score, sender_status,
    should_act, action, reason, decision_confidence, planned_action FROM p""")
def triage(spark, sf):
    return _triaged(spark, sf).select(
        "uid", "category", "confidence", F.array_join("topics", ",").alias("topics"), "topic_score", "sender_status",
        "should_act", "action", "reason", "decision_confidence", "planned_action")


@query(f"{_JUDGED} SELECT uid, category, confidence, 'rules' AS method, {', '.join(_SCORES)}, input_text FROM c")
def classify_rules(spark, sf):
    return _classified(spark, sf).select("uid", "category", "confidence", "method", *_SCORES, "input_text")


@query(f"{_JUDGED} SELECT {sql.FOLDER_UID} AS uid, source_folder, k_transactions AS score_transactions, k_feed AS score_feed, k_promotions AS score_promotions FROM c")
def keyword_scores(spark, sf):
    """The join form; the unrolled form is part of classify_rules."""
    rows = corpus.folder_uids(_messages(spark, sf))
    return classify.keyword_scores_joined(rows, R.keyword_rules_table(spark)).select("uid", "source_folder", *_SCORES)


@query(f"{sql.MESSAGES}{sql.topics('m')} SELECT uid, len(topics) > 0 AS topic_matched, array_to_string(topics, ',') AS topics, topic_score FROM t")
def topic_match(spark, sf):
    matched = topics.match_topics(corpus.messages(spark, sf), _SETTINGS.topics)
    return matched.select("uid", "topic_matched", F.array_join("topics", ",").alias("topics"), "topic_score")


_TOPIC_ROWS = " UNION ALL ".join(
    f"SELECT {sql.FOLDER_UID} AS uid, source_folder, {sql.lit(t.name)} AS topic, ts{i} AS score FROM t WHERE ts{i} > 0" for i, t in enumerate(sql.TOPICS))


@query(f"{sql.MESSAGES}{sql.topics('m')} {_TOPIC_ROWS}")
def topic_scores(spark, sf):
    """From a table of terms, which the settings keep small."""
    names = _SETTINGS.topics
    scored = topics.topic_scores(
        corpus.folder_uids(corpus.messages(spark, sf)), R.topic_terms_table(spark, names), most=R.topic_terms_bound(names))
    return scored.select("uid", "source_folder", "topic", "score")


_TOPIC_NAMES = """CASE WHEN doc_id % 50 = 0 THEN ' Machine Learning' WHEN doc_id % 50 = 1 THEN 'Artificial Intelligence'
    WHEN doc_id % 50 = 2 THEN 'Kubernetes' ELSE split_part(text, chr(10), 1) END"""


@query(f"""WITH t AS (SELECT DISTINCT lower({sql.strip(_TOPIC_NAMES)}) AS topic FROM documents)
    SELECT topic, CASE WHEN len(regexp_extract_all(topic, '{sql.WORD}+')) > 1 THEN 'phrase' ELSE 'keyword' END AS kind, topic AS term FROM t
    UNION ALL SELECT topic, 'keyword', unnest(CASE topic WHEN 'machine learning' THEN ['ml', 'machinelearning']
      WHEN 'artificial intelligence' THEN ['ai', 'artificialintelligence'] WHEN 'kubernetes' THEN ['k8s'] ELSE []::VARCHAR[] END) FROM t""")
def topic_terms(spark, sf):
    """Terms for a large list of topics: the opening lines of the documents and some known ones."""
    doc = F.col("doc_id") % 50
    names = (
        F.when(doc == 0, " Machine Learning").when(doc == 1, "Artificial Intelligence").when(doc == 2, "Kubernetes")
        .otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    )
    return R.topic_terms(corpus.table(spark, sf, "documents").select(names.alias("topic")))


@query(f"{sql.HEADERS} SELECT uid, from_email, {sql.status()} AS sender_status FROM h")
def sender_status(spark, sf):
    rows = corpus.headers(spark, sf)
    return senders.sender_status(rows, _SETTINGS.allow, _SETTINGS.deny).select("uid", "from_email", "sender_status")


@query(f"""{sql.HEADERS}, q AS (SELECT DISTINCT 'deny' AS list, from_email AS pattern FROM h WHERE source_folder = '[Gmail]/Trash' AND size % 7 = 0
    UNION SELECT DISTINCT 'allow', from_email FROM h WHERE source_folder = 'INBOX' AND attachment_count = 2)
    SELECT list, from_email AS sender, count(*) AS messages FROM h JOIN q ON from_email = pattern GROUP BY ALL""")
def sender_exact(spark, sf):
    """Rules learnt from the mailbox itself, matched exactly."""
    rows = corpus.headers(spark, sf)
    deny = rows.where((F.col("source_folder") == "[Gmail]/Trash") & (F.col("size") % 7 == 0))
    allow = rows.where((F.col("source_folder") == "INBOX") & (F.col("attachment_count") == 2))
    rules = R.normalise_rules(
        deny.select(F.lit("deny").alias("list"), F.col("from_email").alias("pattern"))
        .union(allow.select(F.lit("allow"), "from_email"))
    )
    counted = rows.groupBy(senders.address_key(F.col("from_email")).alias("sender")).agg(F.count("*").alias("messages"))
    return senders.exact_matches(counted.select("sender"), rules).join(counted, "sender").select("list", "sender", "messages")


_LARGE_RULES = """large AS (
    SELECT CASE WHEN doc_id % 2 = 0 THEN 'allow' ELSE 'deny' END AS list, 'user' || doc_id || '.' || k || '@example.com' AS pattern
    FROM documents, unnest(range(0, 50)) AS t(k)
    UNION ALL SELECT 'deny', '*@' || split_part(from_email, '@', 2) FROM h WHERE size % 11 = 0
    UNION ALL SELECT 'allow', from_email FROM h WHERE size % 13 = 0)"""


@query(f"""{sql.HEADERS}, {_LARGE_RULES}, hit AS (
    SELECT from_email, list FROM h JOIN large ON pattern = from_email
    UNION SELECT from_email, list FROM h JOIN large ON pattern = '*@' || split_part(from_email, '@', 2))
    SELECT uid, CASE WHEN from_email IN (SELECT from_email FROM hit WHERE list = 'allow') THEN 'whitelisted'
      WHEN from_email IN (SELECT from_email FROM hit WHERE list = 'deny') THEN 'blacklisted' ELSE 'neutral' END AS sender_status FROM h""")
def sender_status_joined(spark, sf):
    """Fifty times as many rules as messages, some of which match."""
    rows, documents = corpus.headers(spark, sf), corpus.table(spark, sf, "documents")
    many = documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("k")).select(
        F.when(F.col("doc_id") % 2 == 0, "allow").otherwise("deny").alias("list"),
        F.concat(F.lit("user"), F.col("doc_id").cast("string"), F.lit("."), F.col("k").cast("string"), F.lit("@example.com")).alias("pattern"))
    domains = rows.where(F.col("size") % 11 == 0).select(F.lit("deny"), F.concat(F.lit("*@"), F.split_part("from_email", F.lit("@"), F.lit(2))))
    senders_too = rows.where(F.col("size") % 13 == 0).select(F.lit("allow"), "from_email")
    rules = R.normalise_rules(many.union(domains).union(senders_too))
    return senders.sender_status_joined(rows, rules).select("uid", "sender_status")


_PATTERNS = {"allow": [*_SETTINGS.allow, "*support@*.com", "*@learn.*"], "deny": [*_SETTINGS.deny, "*shop*", "deals@*", "*a*k*"]}


@query(f"{sql.HEADERS}, s AS (SELECT DISTINCT from_email AS sender FROM h) " + " UNION ALL ".join(
    f"SELECT '{name}' AS list, sender, {sql.lit(p)} AS pattern FROM s WHERE sender LIKE {sql.lit(p.replace('*', '%'))}"
    for name, patterns in _PATTERNS.items() for p in patterns if "*" in p))
def sender_wildcard(spark, sf):
    rules = R.sender_rules_table(spark, _PATTERNS["allow"], _PATTERNS["deny"])
    return senders.wildcard_matches(senders.distinct_senders(corpus.headers(spark, sf)), rules)


def _mail_rules(spark, sf):
    """Rules as users might keep them: untidy, and taken from the mailbox."""
    rows = corpus.headers(spark, sf)
    deny = rows.where(F.col("source_folder") == "[Gmail]/Trash").select(
        F.lit("deny").alias("list"), F.concat(F.lit(" *@"), F.upper(F.split_part("from_email", F.lit("@"), F.lit(2)))).alias("pattern"))
    allow = rows.where(F.col("source_folder") == "INBOX").select(
        F.lit("allow"), F.when(F.col("attachment_count") == 0, " ").otherwise(F.concat("from_email", F.lit(" "))))
    return deny.union(allow)


_MAIL_RULES = f"""{sql.HEADERS}, q AS (
    SELECT DISTINCT 'deny' AS list, '*@' || split_part(from_email, '@', 2) AS pattern FROM h WHERE source_folder = '[Gmail]/Trash'
    UNION SELECT DISTINCT 'allow', from_email FROM h WHERE source_folder = 'INBOX' AND attachment_count <> 0)"""


@query(f"{_MAIL_RULES} SELECT list, pattern FROM q ORDER BY ALL")
def sender_rules_listing(spark, sf):
    return R.rules_listing(_mail_rules(spark, sf))


@query(f"""{_MAIL_RULES}, gone AS (SELECT DISTINCT 'allow' AS list, from_email AS pattern FROM h WHERE contains(from_email, 'shop')),
    extra AS (SELECT DISTINCT 'deny' AS list, from_email AS pattern FROM h WHERE contains(from_email, 'deals'))
    (SELECT * FROM q EXCEPT SELECT * FROM gone) UNION SELECT * FROM extra""")
def edit_rules(spark, sf):
    rows = corpus.headers(spark, sf)
    gone = rows.where(F.col("from_email").contains("shop")).select(F.lit("allow").alias("list"), F.upper("from_email").alias("pattern"))
    extra = rows.where(F.col("from_email").contains("deals")).select(F.lit("deny").alias("list"), F.col("from_email").alias("pattern"))
    return R.edit_rules(_mail_rules(spark, sf), add=extra, remove=gone)


@query(f"{sql.DECIDED} SELECT uid, should_act, action, reason, decision_confidence FROM p")
def decide(spark, sf):
    return _triaged(spark, sf).select("uid", "should_act", "action", "reason", "decision_confidence")


_LABELLING = R.Settings(action_on_deletion="apply_label", dry_run=False, topics=_SETTINGS.topics, allow=_SETTINGS.allow, deny=_SETTINGS.deny)
_TRASHING = R.Settings(dry_run=False, topics=_SETTINGS.topics, allow=_SETTINGS.allow, deny=_SETTINGS.deny)


@query(f"""{sql.DECIDED} SELECT uid, CASE WHEN should_act THEN 'apply_label' ELSE planned_action END AS planned_action,
    CASE WHEN should_act THEN 'MarkForDeletion' END AS planned_label, should_act OR planned_action <> 'none' AS apply FROM p""")
def action_plan(spark, sf):
    return _triaged(spark, sf, _LABELLING).select("uid", "planned_action", "planned_label", "apply")


@query(f"""{sql.DECIDED} SELECT {sql.FOLDER_UID} AS uid, CASE WHEN planned_action = 'archive' THEN '[Gmail]/All Mail' ELSE source_folder END AS source_folder,
    array_to_string(list_sort(CASE planned_action WHEN 'none' THEN flags WHEN 'archive' THEN ['\\Seen'] ELSE ['\\Seen', '\\Deleted'] END), ',') AS flags,
    CASE WHEN planned_action = 'move_to_trash' THEN '\\Trash' ELSE '' END AS labels FROM p""")
def apply_actions(spark, sf):
    mailbox = corpus.folder_uids(corpus.headers(spark, sf)).select(
        *KEY, "flags", F.lit(None).cast("array<string>").alias("labels"))
    after = deciding.apply_actions(mailbox, corpus.folder_uids(_triaged(spark, sf, _TRASHING)))
    return after.select("uid", "source_folder", F.array_join(F.sort_array("flags"), ",").alias("flags"),
                        F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"))


@query(ORACLES["apply_actions"])
def update_mailbox(spark, sf):
    """The same change on a stored mailbox, of which only the touched folders are rewritten."""
    mails = corpus.folder_uids(corpus.headers(spark, sf)).select(*KEY, "flags", F.lit(None).cast("array<string>").alias("labels"))
    path = shared_dir(spark, "mailbox")
    stored.create_mailbox(mails, path)
    plan = corpus.folder_uids(_triaged(spark, sf, _TRASHING)).select(*KEY, "planned_action", "planned_label", "apply")
    stored.update_mailbox(spark, path, plan, 1, mails.schema)
    after = stored.read_mailbox(spark, path, mails.schema)
    return after.select("uid", "source_folder", F.array_join(F.sort_array("flags"), ",").alias("flags"),
                        F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"))


@query(f"""{_JUDGED} SELECT count(*) AS total_emails, {", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in CATEGORIES)} FROM c""")
def run_stats(spark, sf):
    return judging.run_stats(_classified(spark, sf))


_EVENT_CATEGORY = "CASE event_type WHEN 'purchase' THEN 'transactions' WHEN 'view' THEN 'feed' WHEN 'click' THEN 'promotions' WHEN 'signup' THEN 'inbox' END"


@query(f"""SELECT epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) // 1000000 AS started, count(*) AS total_emails,
    {", ".join(f"count(*) FILTER ({_EVENT_CATEGORY} = '{c}') AS {c}" for c in CATEGORIES)} FROM events GROUP BY 1""")
def run_stats_windowed(spark, sf):
    """Events as classified messages; an error is one that failed and has no category."""
    judged = corpus.table(spark, sf, "events").select(as_utc(F.col("ts")).alias("ts"), F.expr(_EVENT_CATEGORY).alias("category"))
    stats = judging.run_stats_windowed(judged, "ts")
    return stats.select(F.unix_timestamp("timestamp").alias("started"), "total_emails", *CATEGORIES)


_HISTORY = f"""{sql.HEADERS}, chosen AS (SELECT uid FROM (
    SELECT uid, row_number() OVER (PARTITION BY mailbox, source_folder ORDER BY uid DESC) AS r FROM h
    WHERE NOT contains(source_folder, 'Trash') AND arrived_at >= date '2024-01-05' AND arrived_at < date '2024-02-01') WHERE r <= 500)"""
_HISTORY_JUDGED = sql.MESSAGES + _HISTORY[len(sql.HEADERS):] + sql.classified("(SELECT * FROM m WHERE uid IN (SELECT uid FROM chosen))")


def _historical(spark, sf):
    return history.process_historical(corpus.messages(spark, sf), "2024-01-05", "2024-02-01", ["promotions"], _SETTINGS)


@query(f"""{_HISTORY_JUDGED} SELECT uid, source_folder, category, CASE WHEN category = 'promotions' THEN 'MarkedForDeletion' END AS new_label,
    {sql.status()} AS sender_status FROM c""")
def historical_label(spark, sf):
    return _historical(spark, sf).select("uid", "source_folder", "category", "new_label", "sender_status")


@query(f"""{_HISTORY_JUDGED} SELECT uid, source_folder, array_to_string(flags, ',') AS flags,
    CASE WHEN uid IN (SELECT uid FROM c WHERE category = 'promotions') THEN 'MarkedForDeletion' ELSE '' END AS labels FROM h""")
def apply_historical_labels(spark, sf):
    """The labels of a bulk run on the mailbox, in which no message had labels."""
    mailbox = corpus.headers(spark, sf).select(*KEY, "flags", F.lit(None).cast("array<string>").alias("labels"))
    after = deciding.apply_actions(mailbox, deciding.label_plan(_historical(spark, sf)))
    return after.select("uid", "source_folder", F.array_join("flags", ",").alias("flags"),
                        F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"))


@query(f"{_HISTORY_JUDGED} SELECT count(*) AS processed, count(*) FILTER (category = 'promotions') AS labeled FROM c")
def historical_counts(spark, sf):
    return history.historical_counts(_historical(spark, sf))


@query(f"""{_JUDGED} SELECT id, date, {sql.sanitize('from_email')} AS sender_email, {sql.sanitize('from_name')} AS sender_name,
    {sql.sanitize('subject')} AS subject, {sql.sanitize('substr(body_text, 1, 5000)')} AS body_text, category AS label, confidence,
    source_folder, 'classified' AS processing_state FROM c""")
def classified_log_rows(spark, sf):
    return store.classified_log_rows(_classified(spark, sf), corpus.as_of()).drop("saved_at")


@query(f"{_JUDGED} SELECT input_text AS input_string, category, confidence, 'rules' AS method FROM c")
def audit_log_rows(spark, sf):
    return store.audit_log_rows(_classified(spark, sf), corpus.as_of()).drop("timestamp")


_STORE_SQL = f"""{sql.DECIDED}, st AS (SELECT *, CASE WHEN uid >= (SELECT max(doc_id) FROM documents) / 2 THEN 'new'
    WHEN planned_action = 'none' THEN 'classified' ELSE 'actioned' END AS processing_state FROM p)"""


def _store(spark, sf):
    """The older half of the messages has been processed; of it those with an action are done."""
    middle = corpus.table(spark, sf, "documents").select(F.max("doc_id") / 2).scalar()
    done = F.col("uid") < middle
    return store.processing_state(_triaged(spark, sf).withColumns({
        "category": F.when(done, F.col("category")),
        "planned_action": F.when(done & (F.col("planned_action") != "none"), F.col("planned_action")),
    }))


@query(f"{_STORE_SQL} SELECT processing_state, count(*) AS n FROM st GROUP BY ALL")
def by_state(spark, sf):
    return store.by_state(_store(spark, sf))


@query(f"""{_STORE_SQL} SELECT processing_state, count(*) AS total_emails, sum(size)::BIGINT AS total_size,
    count(*) FILTER (attachment_count > 0) AS with_attachments FROM st GROUP BY ALL""")
def store_stats(spark, sf):
    return store.store_stats(_store(spark, sf))


@query(f"{sql.HEADERS} SELECT uid FROM h WHERE received_at >= {sql.AS_OF_SQL} - INTERVAL 50 DAY")
def retention(spark, sf):
    saved = corpus.headers(spark, sf).withColumn("saved_at", F.col("received_at"))
    return store.retention(saved, 50, corpus.as_of()).select("uid")


_HASH = hashlib.md5(b"<6@corpus.example.com>").hexdigest()


@query(f"{sql.HEADERS} SELECT uid, subject, date FROM h WHERE hash = '{_HASH}'")
def lookup_hash(spark, sf):
    return store.lookup(corpus.headers(spark, sf), _HASH).select("uid", "subject", "date")


_RUN_SQL = f"""{sql.MESSAGES}, judged0 AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY uid DESC) AS r FROM m
      WHERE source_folder = 'INBOX' AND NOT list_contains(flags, '\\Seen') AND arrived_at >= {sql.AS_OF_SQL}::DATE - 60) WHERE r <= 100)
    {sql.classified("judged0")}"""
_STARTED, _ENDED = "2024-03-01 00:00:00", "2024-03-01 00:00:12.5"


def _run(spark, sf):
    out = shared_dir(spark, "run")
    jobs.run_once(corpus.headers(spark, sf), corpus.messages(spark, sf), _SETTINGS, out, 0, corpus.as_of(),
                  F.lit(_STARTED).cast("timestamp"), F.lit(_ENDED).cast("timestamp"), days=60, mailboxes=2)
    return out


@query(f"""{_RUN_SQL} SELECT id, mailbox, category AS label, confidence, source_folder, 'classified' AS processing_state,
    epoch_us(TIMESTAMP '{_STARTED}') // 1000000 AS saved, mailbox AS folder FROM c""")
def run_once(spark, sf):
    """The log rows of a batch run without earlier state, read from its folders."""
    log = spark.read.parquet(f"{_run(spark, sf)}/classified_log")
    return log.select("id", "mailbox", "label", "confidence", "source_folder", "processing_state",
                      F.unix_timestamp("saved_at").alias("saved"), F.col("mailbox").alias("folder"))


@query(f"""{_RUN_SQL} SELECT epoch_us(TIMESTAMP '{_STARTED}') // 1000000 AS started, 12.5::DOUBLE AS duration_seconds, count(*) AS total_emails,
    {", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in CATEGORIES)} FROM c""")
def run_log(spark, sf):
    record = spark.read.parquet(f"{_run(spark, sf)}/run_stats")
    return record.select(F.unix_timestamp("timestamp").alias("started"), "duration_seconds", "total_emails", *CATEGORIES)


@query(f"{sql.HEADERS} SELECT uid FROM h WHERE received_at >= {sql.AS_OF_SQL} - INTERVAL 50 DAY")
def retention_partitioned(spark, sf):
    """Retention on a log in folders by mailbox and day."""
    path = shared_dir(spark, "log")
    saved = corpus.headers(spark, sf).select("uid", "mailbox", F.col("received_at").alias("saved_at"))
    tables.write_log(saved.repartition("mailbox", F.to_date("saved_at")), path, 0)
    return store.retention(spark.read.parquet(path), 50, corpus.as_of()).select("uid")
