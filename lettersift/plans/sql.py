"""Building blocks of the comparison SQL (DuckDB)."""

from __future__ import annotations

from .. import rules as R
from ..functions.text import WHITESPACE
from ..sources.corpus import AS_OF, SETTINGS, VARIANTS

# White space is spelled out: \s covers only ASCII here.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip(c: str) -> str:
    return f"trim({c}, {lit(WHITESPACE)})"


def sanitize(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


def contains_any(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(t)})" for t in terms) + ")"


def count_of(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {lit(term)}, ''))) // {len(term)})"


def html_text(c: str) -> str:
    """HTML to text; the pages use four character references only."""
    for element in ("script", "style"):
        c = f"regexp_replace({c}, '<{element}[^>]*>.*?</{element}>', '', 'gis')"
    c = f"regexp_replace({c}, '<br{WS}*/?>', chr(10), 'gi')"
    c = f"regexp_replace({c}, '</p>', chr(10) || chr(10), 'gi')"
    c = f"regexp_replace({c}, '<[^>]+>', '', 'g')"
    for name, character in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        c = f"replace({c}, '&{name};', {lit(character)})"
    return strip(f"regexp_replace({c}, '{WS}*\\n{WS}*', chr(10), 'g')")


def address(c: str) -> str:
    plain = f"translate({strip(c)}, '\"''', '')"
    return (
        f"CASE WHEN regexp_matches({c}, '<[^>]+>') THEN lower({strip(f'''regexp_extract({c}, '<([^>]+)>', 1)''')}) "
        f"WHEN contains({plain}, '@') THEN lower({plain}) ELSE lower({c}) END"
    )


def name(c: str) -> str:
    pattern = f"^([^\\n]+?){WS}*<"
    return (
        f"CASE WHEN regexp_matches({c}, '{pattern}') THEN translate({strip(f'''regexp_extract({c}, '{pattern}', 1)''')}, '\"''', '') "
        f"ELSE {address(c)} END"
    )


# A uid as ``corpus.folder_uids`` numbers it.
FOLDER_UID = "(uid // 5 * 2 + uid % 5 % 2)"
_V = "(doc_id % 10 + 1)"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"

HEADERS = f"""
WITH h0 AS (
  SELECT doc_id, doc_id AS uid, doc_id::VARCHAR AS id,
    CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'personal' ELSE 'work' END AS mailbox,
    CASE WHEN doc_id % 97 = 5 THEN '' ELSE
      '<' || (CASE WHEN doc_id % 13 = 7 THEN doc_id - 1 ELSE doc_id END)::VARCHAR || '@corpus.example.com>' END AS message_id,
    CASE WHEN doc_id % 10 = 9 THEN {items(v[1] for v in VARIANTS)}[{_V}]
      ELSE {items(v[1] for v in VARIANTS)}[{_V}] || ' ' || substr(split_part(text, chr(10), 1), 1, 60) END AS subject,
    {items(v[0] for v in VARIANTS)}[{_V}] AS from_raw,
    'me@corpus.example.com' AS to_raw,
    CASE WHEN doc_id % 101 <> 50 THEN make_timestamp(
      (1704067200 + doc_id * 2220 - CASE WHEN doc_id % 11 = 3 THEN 345600 ELSE 0 END) * 1000000) END AS received_at,
    make_timestamp((1704067200 + doc_id * 2220) * 1000000) AS arrived_at,
    CASE WHEN doc_id % 5 < 2 THEN 'INBOX' WHEN doc_id % 5 < 4 THEN '[Gmail]/All Mail' ELSE '[Gmail]/Trash' END AS source_folder,
    CASE WHEN doc_id % 3 = 0 THEN ['\\Seen'] ELSE []::VARCHAR[] END AS flags,
    n_chars AS size, (n_chars % 3)::INTEGER AS attachment_count, text
  FROM documents),
h AS (
  SELECT *, coalesce(strftime(received_at, '%a, %d %b %Y %H:%M:%S') || ' +0000', 'not a date') AS date,
    md5(message_id) AS hash, {address('from_raw')} AS from_email, {name('from_raw')} AS from_name
  FROM h0)"""

MESSAGES = HEADERS + f""",
m AS (
  SELECT h.* EXCLUDE (text), coalesce(p.html, '') AS body_html,
    CASE WHEN p.html IS NOT NULL AND doc_id % 4 = 1 THEN ''
      ELSE {items(v[2] + ' ' if v[2] else '' for v in VARIANTS)}[{_V}] || text END AS raw_text,
    CASE WHEN p.html IS NOT NULL AND doc_id % 4 = 1 THEN {html_text("p.html")}
      ELSE {items(v[2] + ' ' if v[2] else '' for v in VARIANTS)}[{_V}] || text END AS body_text
  FROM h LEFT JOIN pages p ON p.page_id = h.doc_id)"""


def _score(category: str, text: str, sender: str) -> str:
    parts = [f"CASE WHEN contains({text}, {lit(t)}) THEN 1 ELSE 0 END" for t in R.KEYWORDS[category]]
    parts += [f"CASE WHEN contains({sender}, {lit(t)}) THEN 2 ELSE 0 END" for t in R.SENDER_PARTS[category]]
    return " + ".join(parts)


def classified(source: str = "m", out: str = "c", body: str = "body_text") -> str:
    """CTEs that classify the rows of ``source`` by rules."""
    return f""",
{out}_t AS (
  SELECT *, lower({sanitize('subject')}) AS n_subject, substr(lower({sanitize(body)}), 1, 1000) AS n_body,
    lower({sanitize('from_email')}) AS n_sender, lower({sanitize('from_name')}) AS n_name FROM {source}),
{out}_k AS (
  SELECT *, {", ".join(f"{_score(k, "(n_subject || ' ' || n_body)", "n_sender")} AS k_{k}" for k in R.SCORED_CATEGORIES)},
    {contains_any("(n_subject || ' ' || n_body)", R.OPT_OUT_TERMS)} AS opt_out FROM {out}_t),
{out}_s AS (
  SELECT *, k_transactions AS score_transactions,
    k_feed + CASE WHEN opt_out AND k_feed > 0 THEN 2 ELSE 0 END AS score_feed,
    k_promotions + CASE WHEN opt_out AND k_feed <= 0 THEN 3 ELSE 0 END AS score_promotions FROM {out}_k),
{out} AS (
  SELECT *, CASE WHEN greatest(score_transactions, score_feed, score_promotions) < 2 THEN 'inbox'
      WHEN score_transactions >= score_feed AND score_transactions >= score_promotions THEN 'transactions'
      WHEN score_feed >= score_promotions THEN 'feed' ELSE 'promotions' END AS category,
    CASE WHEN greatest(score_transactions, score_feed, score_promotions) < 2 THEN 0.6::DOUBLE
      ELSE least(0.5::DOUBLE + greatest(score_transactions, score_feed, score_promotions) * 0.1::DOUBLE, 0.95::DOUBLE) END AS confidence,
    '[SUBJECT] ' || n_subject || ' [SENDER] ' || n_name || ' <' || n_sender || '> [BODY] ' || n_body AS input_text
  FROM {out}_s)"""


def _topic_score(topic: R.Topic) -> str:
    parts = [
        f"CASE WHEN contains(t_all, {lit(p)}) THEN {count_of('t_subject', p)} * 4.0::DOUBLE + {count_of('t_body', p)} * 2.0::DOUBLE ELSE 0 END"
        for p in topic.phrases
    ] + [
        f"CASE WHEN list_contains(t_words, {lit(k)}) THEN {count_of('t_subject', k)} * 2.0::DOUBLE + {count_of('t_all', k)} * 0.5::DOUBLE ELSE 0 END"
        for k in topic.keywords
    ]
    return " + ".join(parts)


TOPICS = R.build_topics(SETTINGS.topics)


def topics(source: str = "c", out: str = "t") -> str:
    """CTEs that score the topics of the rows of ``source``."""
    scores = ", ".join(f"({_topic_score(t)})::DOUBLE AS ts{i}" for i, t in enumerate(TOPICS))
    names = ", ".join(f"CASE WHEN ts{i} > 0 THEN {lit(t.name)} END" for i, t in enumerate(TOPICS))
    total = " + ".join(f"ts{i}" for i in range(len(TOPICS)))
    return f""",
{out}_l AS (SELECT *, lower(subject) AS t_subject, lower(body_text) AS t_body FROM {source}),
{out}_a AS (SELECT *, t_subject || ' ' || t_body AS t_all, regexp_extract_all(t_subject || ' ' || t_body, '{WORD}+') AS t_words FROM {out}_l),
{out}_s AS (SELECT *, {scores} FROM {out}_a),
{out} AS (SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS topics,
    least(({total}) / 10.0::DOUBLE, 1.0::DOUBLE) AS topic_score FROM {out}_s)"""


def _glob(pattern: str) -> str:
    for special in ("\\", "%", "_"):
        pattern = pattern.replace(special, "\\" + special)
    return pattern.replace("*", "%")


def _listed(c: str, patterns) -> str:
    tests = [f"{c} = {lit(p)}" for p in patterns]
    tests += [f"('*@' || CASE WHEN contains({c}, '@') THEN split_part({c}, '@', 2) ELSE {c} END) = {lit(p)}" for p in patterns]
    tests += [f"{c} LIKE {lit(_glob(p))} ESCAPE '\\'" for p in patterns if "*" in p]
    return "(" + " OR ".join(tests) + ")"


def status(c: str = "from_email") -> str:
    return (f"CASE WHEN {_listed(c, SETTINGS.allow)} THEN 'whitelisted' "
            f"WHEN {_listed(c, SETTINGS.deny)} THEN 'blacklisted' ELSE 'neutral' END")


DECIDED = MESSAGES + classified() + topics() + f""",
s AS (SELECT *, {status()} AS sender_status FROM t),
d AS (
  SELECT *, CASE WHEN sender_status = 'whitelisted' THEN 'allowed' WHEN sender_status = 'blacklisted' THEN 'denied'
      WHEN category <> 'promotions' THEN 'kept'
      WHEN len(topics) > 0 AND topic_score >= 0.15::DOUBLE THEN 'topic' ELSE 'act' END AS ruling FROM s),
e AS (
  SELECT *, ruling IN ('denied', 'act') AS should_act,
    CASE WHEN ruling IN ('denied', 'act') THEN 'move_to_trash' ELSE 'none' END AS action,
    CASE ruling WHEN 'allowed' THEN 'Sender is whitelisted' WHEN 'denied' THEN 'Sender is blacklisted'
      WHEN 'kept' THEN 'Only promotional emails are targeted, "' || category || '" emails are preserved'
      WHEN 'topic' THEN 'Promotional but matches topics: [' ||
        array_to_string(list_transform(topics, lambda x: '''' || x || ''''), ', ') || '] (score: ' || printf('%.2f', topic_score) || ')'
      ELSE 'Category "' || category || '" email met criteria' END AS reason,
    CASE WHEN ruling = 'act' THEN confidence ELSE 1.0::DOUBLE END AS decision_confidence FROM d),
p AS (
  SELECT *, CASE WHEN should_act THEN action WHEN category IN ('transactions', 'feed') THEN 'archive' ELSE 'none' END AS planned_action
  FROM e)"""

# State after an earlier run over the older half of the messages, by arrival number.
STATE = """,
done AS (SELECT * FROM h WHERE uid < (SELECT max(doc_id) FROM documents) / 2 AND received_at IS NOT NULL),
marks AS (
  SELECT mailbox, hash, date, subject, received_at FROM (
    SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY received_at DESC, uid) AS r FROM done) WHERE r = 1),
recent AS (
  SELECT mailbox, hash, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY seq DESC) AS r
    FROM (SELECT mailbox, hash, min(uid) AS seq FROM done GROUP BY ALL)) WHERE r <= 200),
seen AS (SELECT mailbox, hash FROM recent UNION SELECT mailbox, hash FROM marks)"""


def days_between(later: str, earlier: str) -> str:
    return f"floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)::INTEGER"


# The text a classifier is trained on.
TRAINING_TEXT = """'[SUBJECT] ' || subject || ' [SENDER] ' ||
    CASE WHEN from_name <> '' THEN from_name || ' <' || from_email || '>' ELSE from_email END || ' [BODY] ' || substr(body_text, 1, 1000)"""
