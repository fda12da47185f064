"""Scans, filters, limits and search."""

from pyspark.sql import functions as F

from ..functions.headers import age_days as age
from ..operators import classify, filters, ingest, scan, search, topics
from ..rules import default_keyword_rules, topic_terms_bound, topic_terms_table
from ..schemas import KEY
from ..sources import corpus, mime
from . import sql
from .registry import query
from .state import earlier_state

_FOLDER_SQL = f"""
  source_folder = 'INBOX' AND NOT list_contains(flags, '\\Seen')
  AND arrived_at >= date '2024-01-03' AND arrived_at < date '2024-02-20'"""


@query(f"""{sql.MESSAGES} SELECT uid, subject, from_email, md5(body_text) AS body_md5 FROM m
    WHERE {_FOLDER_SQL} ORDER BY uid DESC LIMIT 100""")
def scan_folder(spark, sf):
    found = scan.scan_folder(corpus.messages(spark, sf), unread_only=True, start="2024-01-03", end="2024-02-20")
    body = F.md5(_body())
    return found.select("uid", "subject", "from_email", body.alias("body_md5"))


def _body():
    from ..functions.html import body_fallback

    return body_fallback(F.col("body_text"), F.col("body_html"))


@query(f"""{sql.HEADERS} SELECT uid, message_id, subject, from_raw, to_raw, date, size FROM h
    WHERE source_folder = '[Gmail]/All Mail' AND arrived_at >= {sql.AS_OF_SQL}::DATE - 60 ORDER BY uid DESC LIMIT 100""")
def scan_headers(spark, sf):
    found = scan.scan_headers(corpus.headers(spark, sf), "[Gmail]/All Mail", days=60, as_of=corpus.as_of())
    return found.select("uid", "message_id", "subject", "from_raw", "to_raw", "date", "size")


@query(f"""{sql.MESSAGES}{sql.STATE} SELECT {sql.FOLDER_UID} AS uid, m.source_folder, m.subject, md5(m.body_text) AS body_md5 FROM m
    WHERE NOT list_contains(flags, '\\Seen') AND (mailbox, hash) NOT IN (SELECT mailbox, hash FROM seen)""")
def late_materialize(spark, sf):
    marks, recent = earlier_state(spark, sf)
    fresh = ingest.new_messages(filters.unread(corpus.folder_uids(corpus.headers(spark, sf))), recent, marks)
    found = scan.fetch_bodies(fresh.select(*KEY), corpus.folder_uids(corpus.messages(spark, sf)))
    return found.select("uid", "source_folder", "subject", F.md5(_body()).alias("body_md5"))


@query(f"{sql.HEADERS} SELECT DISTINCT source_folder FROM h")
def list_folders(spark, sf):
    return scan.list_folders(corpus.headers(spark, sf))


@query(f"""{sql.HEADERS} SELECT mailbox, source_folder, count(*) AS n FROM h
    WHERE source_folder = '[Gmail]/Trash' GROUP BY ALL""")
def first_nonempty_source(spark, sf):
    names = ["Trash", '"[Gmail]/Trash"', "[Gmail]/Trash", "INBOX"]
    return scan.first_nonempty(corpus.headers(spark, sf), names).groupBy("mailbox", "source_folder").agg(F.count("*").alias("n"))


@query(f"{sql.HEADERS} SELECT uid FROM h WHERE NOT list_contains(flags, '\\Seen')")
def filter_unread(spark, sf):
    return filters.unread(corpus.headers(spark, sf)).select("uid")


@query(f"{sql.HEADERS} SELECT uid, source_folder FROM h")
def filter_none(spark, sf):
    """No criteria: everything is found."""
    return filters.select_messages(corpus.headers(spark, sf)).select("uid", "source_folder")


@query(f"{sql.HEADERS} SELECT uid FROM h WHERE arrived_at >= date '2024-01-05' AND arrived_at < date '2024-01-20'")
def filter_date_range(spark, sf):
    return filters.date_range(corpus.headers(spark, sf), "2024-01-05", "2024-01-20").select("uid")


@query(f"{sql.HEADERS} SELECT uid FROM h WHERE arrived_at >= {sql.AS_OF_SQL}::DATE - 45")
def filter_since_days(spark, sf):
    return filters.since_days(corpus.headers(spark, sf), 45, corpus.as_of()).select("uid")


@query(f"""{sql.HEADERS} SELECT source_folder, count(*) AS n FROM h
    WHERE NOT regexp_matches(source_folder, 'Trash|Spam|Bin') GROUP BY ALL""")
def filter_folders(spark, sf):
    return filters.kept_folders(corpus.headers(spark, sf)).groupBy("source_folder").agg(F.count("*").alias("n"))


@query(f"""{sql.HEADERS}{sql.STATE} SELECT k.uid FROM h k LEFT JOIN marks x USING (mailbox)
    WHERE coalesce({sql.days_between('x.received_at', 'k.received_at')} <= 2, true)""")
def drop_late(spark, sf):
    marks, _ = earlier_state(spark, sf)
    return filters.drop_late(corpus.headers(spark, sf), marks).select("uid")


_SEARCH_SQL = "contains(lower(subject), 'sale') AND contains(lower(from_raw), 'shop') AND arrived_at >= date '2024-01-04'"
_SEARCH = {"subject": "SALE", "sender": "Shop", "from_date": "2024-01-04"}


@query(f"""{sql.MESSAGES} SELECT uid, source_folder, subject, date, replace(replace(substr(raw_text, 1, 200), chr(13), ''), chr(10), ' ') AS preview
    FROM (SELECT *, row_number() OVER (PARTITION BY mailbox, source_folder ORDER BY uid DESC) AS r FROM m WHERE {_SEARCH_SQL}) WHERE r <= 10""")
def search_messages(spark, sf):
    found = search.search_messages(corpus.messages(spark, sf), with_body=True, **_SEARCH)
    return found.select("uid", "source_folder", "subject", "date", "preview")


@query(f"{sql.HEADERS} SELECT source_folder, count(*) AS matches FROM h WHERE {_SEARCH_SQL} GROUP BY ALL")
def search_counts(spark, sf):
    return search.search_counts(corpus.headers(spark, sf), **_SEARCH)


@query(f"""{sql.MESSAGES} SELECT count(*) AS total, count(*) FILTER ({sql.strip('from_email')} = '') AS empty_senders,
    count(*) FILTER ({sql.strip('raw_text')} = '') AS empty_bodies, 0::BIGINT AS parse_failures FROM m""")
def dq_empty_fields(spark, sf):
    return filters.quality_counts(corpus.messages(spark, sf))


@query(f"""{sql.MESSAGES} SELECT count(*) AS total, count(*) FILTER (uid % 101 = 51 OR {sql.strip('from_email')} = '') AS empty_senders,
    count(*) FILTER (uid % 101 = 51 OR {sql.strip('body_text')} = '') AS empty_bodies, count(*) FILTER (uid % 101 = 51) AS parse_failures FROM m""")
def dq_parse_failures(spark, sf):
    """The counts over raw mails, some of which cannot be parsed."""
    return filters.quality_counts(mime.parse_all(corpus.raw_messages(corpus.messages(spark, sf)), corpus.as_of()))


def _hits_sql() -> str:
    tests = []
    for r in default_keyword_rules():
        text = "(n_subject || ' ' || n_body)" if r.field == "text" else "n_sender"
        tests.append(f"SELECT '{r.category}' AS category, '{r.field}' AS field, {sql.lit(r.term)} AS term, "
                     f"count(*) FILTER (contains({text}, {sql.lit(r.term)})) AS messages FROM c_t")
    return sql.MESSAGES + sql.classified(body="raw_text") + " UNION ALL ".join(tests)


@query(_hits_sql())
def keyword_hits(spark, sf):
    return classify.keyword_hits(corpus.messages(spark, sf))


def _topic_hits_sql(kind: str) -> str:
    rows = []
    for t in sql.TOPICS:
        for term in (t.keywords if kind == "keyword" else t.phrases):
            rows.append((t.name, term))
    parts = []
    for topic, term in rows:
        if kind == "keyword":
            score = f"{sql.count_of('t_subject', term)} * 2.0::DOUBLE + {sql.count_of('t_all', term)} * 0.5::DOUBLE"
            test = f"list_contains(t_words, {sql.lit(term)})"
        else:
            score = f"{sql.count_of('t_subject', term)} * 4.0::DOUBLE + {sql.count_of('t_body', term)} * 2.0::DOUBLE"
            test = f"contains(t_all, {sql.lit(term)})"
        parts.append(f"SELECT uid, {sql.lit(topic)} AS topic, {sql.lit(term)} AS term, {score} AS score FROM t_a WHERE {test}")
    return sql.MESSAGES + sql.topics("m") + " UNION ALL ".join(parts)


@query(_topic_hits_sql("keyword"))
def topic_keyword_hits(spark, sf):
    names = corpus.SETTINGS.topics
    hits = topics.keyword_hits(corpus.messages(spark, sf), topic_terms_table(spark, names), most=topic_terms_bound(names))
    return hits.select("uid", "topic", "term", "score")


@query(_topic_hits_sql("phrase"))
def topic_phrase_hits(spark, sf):
    names = corpus.SETTINGS.topics
    hits = topics.phrase_hits(corpus.messages(spark, sf), topic_terms_table(spark, names), most=topic_terms_bound(names))
    return hits.select("uid", "topic", "term", "score")


@query(f"{sql.MESSAGES}{sql.classified()} SELECT uid, category FROM c WHERE category IN ('transactions', 'feed')")
def filter_categories(spark, sf):
    from ..operators.triage import with_fallback_body

    judged = classify.classify_rules(with_fallback_body(corpus.messages(spark, sf)))
    return filters.in_categories(judged, ["transactions", "feed"]).select("uid", "category")


@query(f"""{sql.HEADERS} SELECT uid, mailbox, source_folder FROM (
    SELECT *, row_number() OVER (PARTITION BY mailbox, source_folder ORDER BY uid DESC) AS r FROM h) WHERE r <= 25""")
def latest_n_per_folder(spark, sf):
    return scan.newest(corpus.headers(spark, sf), ["mailbox", "source_folder"], 25).select("uid", "mailbox", "source_folder")


@query(f"{sql.HEADERS} SELECT uid, {sql.days_between(sql.AS_OF_SQL, 'received_at')} AS age_days FROM h")
def age_days(spark, sf):
    return corpus.headers(spark, sf).select("uid", age(F.col("received_at"), corpus.as_of()).alias("age_days"))
