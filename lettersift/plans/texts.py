"""Text, header and model-input functions."""

from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import html, model, text
from ..operators.triage import with_fallback_body
from ..rules import CATEGORIES
from ..sources import corpus, mime
from . import sql
from .registry import query


def _columns(**columns):
    return [c.alias(name) for name, c in columns.items()]


@query(f"{sql.HEADERS} SELECT uid, from_email FROM h")
def extract_address(spark, sf):
    return corpus.headers(spark, sf).select("uid", H.extract_address(F.col("from_raw")).alias("from_email"))


@query(f"{sql.HEADERS} SELECT uid, from_name FROM h")
def extract_name(spark, sf):
    return corpus.headers(spark, sf).select("uid", H.extract_name(F.col("from_raw")).alias("from_name"))


@query(f"{sql.HEADERS} SELECT split_part(from_email, '@', 2) AS domain, count(*) AS n FROM h GROUP BY ALL")
def sender_domain(spark, sf):
    return corpus.headers(spark, sf).groupBy(H.sender_domain(F.col("from_email")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"{sql.HEADERS} SELECT uid, epoch_us(received_at) // 1000000 AS received FROM h")
def parse_date(spark, sf):
    return corpus.headers(spark, sf).select("uid", F.unix_timestamp(H.parse_date(F.col("date"))).alias("received"))


@query(f"{sql.HEADERS} SELECT uid, hash FROM h")
def message_hash(spark, sf):
    return corpus.headers(spark, sf).select("uid", H.message_hash(F.col("message_id")).alias("hash"))


@query(f"{sql.HEADERS} SELECT uid, {sql.strip('subject')} AS subject FROM h")
def decode_header(spark, sf):
    """Subjects written as encoded words and decoded again."""
    rows = corpus.headers(spark, sf)
    return rows.select("uid", H.decode_header(corpus.encoded_word(F.col("subject"))).alias("subject"))


@query("SELECT page_id, " + sql.html_text("html") + " AS text FROM pages")
def html_to_text(spark, sf):
    return corpus.table(spark, sf, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query(f"{sql.MESSAGES} SELECT uid, md5(body_text) AS body_md5, length(body_text) AS chars FROM m")
def body_fallback(spark, sf):
    return with_fallback_body(corpus.messages(spark, sf)).select("uid", *_columns(
        body_md5=F.md5("body_text"), chars=F.length("body_text").cast("long")))


@query(f"SELECT doc_id, md5({sql.sanitize('text')}) AS text_md5, length({sql.sanitize('text')}) AS chars FROM documents")
def sanitize(spark, sf):
    clean = text.sanitize(F.col("text"))
    rows = corpus.table(spark, sf, "documents").select("doc_id", clean.alias("clean"))
    return rows.select("doc_id", *_columns(text_md5=F.md5("clean"), chars=F.length("clean").cast("long")))


@query(f"""SELECT doc_id, len(w) AS words, md5(array_to_string(list_sort(w), ' ')) AS words_md5 FROM (
    SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{sql.WORD}+')) AS w FROM documents)""")
def tokenize(spark, sf):
    rows = corpus.table(spark, sf, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return rows.select("doc_id", *_columns(
        words=F.size("w").cast("long"), words_md5=F.md5(F.array_join(F.array_sort("w"), " "))))


@query(f"SELECT doc_id, {sql.count_of('lower(text)', 'th')} AS n FROM documents")
def substring_count(spark, sf):
    counted = text.substring_count(F.lower("text"), F.lit("th")).cast("long")
    return corpus.table(spark, sf, "documents").select("doc_id", counted.alias("n"))


@query("SELECT conv_id, turn, replace(replace(substr(text, 1, 200), chr(13), ''), chr(10), ' ') AS preview FROM conversations")
def body_preview(spark, sf):
    return corpus.table(spark, sf, "conversations").select("conv_id", "turn", text.body_preview(F.col("text")).alias("preview"))


_INPUT_SQL = (
    f"'[SUBJECT] ' || {sql.sanitize('subject')} || ' [SENDER] ' || CASE WHEN {sql.sanitize('from_name')} <> '' THEN "
    f"{sql.sanitize('from_name')} || ' <' || {sql.sanitize('from_email')} || '>' ELSE {sql.sanitize('from_email')} END"
    f" || ' [BODY] ' || {sql.sanitize('substr(raw_text, 1, 1000)')}"
)


def _input_rows(spark, sf):
    fields = [F.col(c) for c in ("subject", "from_name", "from_email", "body_text")]
    return corpus.messages(spark, sf).select("uid", model.model_input(*fields).alias("input_text"))


@query(f"{sql.MESSAGES} SELECT uid, {_INPUT_SQL} AS input_text FROM m")
def model_input(spark, sf):
    return _input_rows(spark, sf)


@query(f"""{sql.MESSAGES} SELECT uid, CASE WHEN uid % 3 = 0 THEN {_INPUT_SQL} ELSE '[SUBJECT] ' || subject || ' [SENDER] ' ||
    CASE WHEN from_name <> '' THEN from_name || ' <' || from_email || '>' ELSE from_email END || ' [BODY] ' || substr(raw_text, 1, 1000) END
    AS input_text FROM m""")
def training_input(spark, sf):
    """Every third message comes with a ready input text, as from an audit log."""
    fields = [F.col(c) for c in ("subject", "from_name", "from_email", "body_text")]
    ready = F.when(F.col("uid") % 3 == 0, model.model_input(*fields))
    return corpus.messages(spark, sf).select("uid", model.training_input(*fields, input_string=ready).alias("input_text"))


@query(f"""{sql.MESSAGES}, i AS (SELECT uid, {_INPUT_SQL} AS x FROM m),
    p AS (SELECT uid, {sql.strip("split_part(split_part(x, '[SUBJECT]', 2), '[SENDER]', 1)")} AS subject,
      {sql.strip("split_part(split_part(x, '[SENDER]', 2), '[BODY]', 1)")} AS sender,
      {sql.strip("substr(x, strpos(x, '[BODY]') + 6)")} AS body_text FROM i)
    SELECT uid, subject, CASE WHEN contains(sender, '<') THEN trim(split_part(sender, '<', 1)) ELSE '' END AS from_name,
      CASE WHEN contains(sender, '<') THEN trim(split_part(sender, '<', 2), '>') ELSE sender END AS from_email, md5(body_text) AS body_md5 FROM p""")
def parse_model_input(spark, sf):
    rows = _input_rows(spark, sf).select("uid", model.parse_model_input(F.col("input_text")).alias("p")).select("uid", "p.*")
    return rows.select("uid", "subject", "from_name", "from_email", F.md5("body_text").alias("body_md5"))


_SOFTMAX_SQL = """
WITH l AS (SELECT vec_id, label, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS v FROM embeddings),
e AS (SELECT *, list_transform(v, lambda x: exp(x - list_max(v))) AS ex FROM l),
p AS (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM e)"""


@query(_SOFTMAX_SQL + "SELECT vec_id, " + ", ".join(f"round(p[{i + 1}], 6) AS p_{c}" for i, c in enumerate(CATEGORIES)) + " FROM p")
def softmax(spark, sf):
    rows = corpus.table(spark, sf, "embeddings").select("vec_id", model.softmax(F.slice("embedding", 1, 4)).alias("p"))
    return rows.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p_{c}") for i, c in enumerate(CATEGORIES)])


@query(_SOFTMAX_SQL + f"SELECT vec_id, {sql.items(CATEGORIES)}[list_position(v, list_max(v))] AS category FROM p")
def argmax_label(spark, sf):
    best = model.argmax(F.slice("embedding", 1, 4))
    return corpus.table(spark, sf, "embeddings").select("vec_id", model.label_name(best).alias("category"))


@query(f"{sql.MESSAGES}{sql.classified()} SELECT uid, (list_position({sql.items(CATEGORIES)}, category) - 1)::INTEGER AS label_index FROM c")
def label_index(spark, sf):
    from ..operators.classify import classify_rules

    judged = classify_rules(with_fallback_body(corpus.messages(spark, sf)))
    return judged.select("uid", model.label_index(F.col("category")).alias("label_index"))


@query(f"""{sql.MESSAGES}, i AS (SELECT uid, regexp_extract_all(lower({_INPUT_SQL}), '{sql.WORD}+')[1:382] AS w FROM m),
    n AS (SELECT uid, list_concat([101::BIGINT], list_transform(w, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 29522 + 1000), [102::BIGINT]) AS ids FROM i)
    SELECT uid, array_to_string(list_concat(ids, list_resize([]::BIGINT[], 384 - len(ids), 0)), ',') AS ids, len(ids) AS tokens FROM n""")
def token_window(spark, sf):
    rows = _input_rows(spark, sf).select("uid", model.token_ids(F.col("input_text")).alias("ids"))
    mask = model.attention_mask(F.col("ids"))
    total = F.aggregate(mask, F.lit(0), lambda acc, x: acc + x).cast("long")
    return rows.select("uid", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), total.alias("tokens"))


@query(f"""{sql.MESSAGES} SELECT uid,
    CASE WHEN uid % 101 <> 51 THEN message_id END AS message_id, CASE WHEN uid % 101 <> 51 THEN {sql.strip('subject')} END AS subject,
    CASE WHEN uid % 101 <> 51 THEN from_email END AS from_email, CASE WHEN uid % 101 <> 51 THEN from_name END AS from_name,
    CASE WHEN uid % 101 <> 51 THEN epoch_us(received_at) // 1000000 END AS received, CASE WHEN uid % 101 <> 51 THEN hash END AS hash,
    md5(CASE WHEN uid % 101 = 51 THEN '' ELSE {sql.strip('body_text')} END) AS body_md5, uid % 101 = 51 AS failed FROM m""")
def parse_mime(spark, sf):
    """Messages written as raw mails and parsed again; those without bytes are quarantined rows."""
    parsed = mime.parse_all(corpus.raw_messages(corpus.messages(spark, sf)), corpus.as_of())
    return parsed.select("uid", "message_id", "subject", "from_email", "from_name", "hash", *_columns(
        received=F.unix_timestamp("received_at"), body_md5=F.md5("body_text"), failed=F.col("parse_error").isNotNull()))
