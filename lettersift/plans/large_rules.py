"""Rules by the thousand: terms and patterns taken from the tables, found by an automaton in one pass over each text."""

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.text import words
from ..operators import classify, senders, topics, triage
from ..sources import corpus
from . import sql
from .registry import query

_CATEGORIES = ["transactions", "feed", "promotions"]
# Every word of the documents' opening lines is a rule; its length tells category and weight.
_WORD_RULES = f"""rule AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '{sql.WORD}+')) AS term FROM documents),
rules AS (SELECT term, {sql.items(_CATEGORIES)}[length(term) % 3 + 1] AS category, length(term) % 4 + 1 AS weight FROM rule)"""


def word_rules(spark, sf):
    opening = F.lower(F.split_part("text", F.lit("\n"), F.lit(1)))
    terms = corpus.table(spark, sf, "documents").select(F.explode(words(opening)).alias("term")).distinct()
    names = F.array(*[F.lit(c) for c in _CATEGORIES])
    return terms.select(
        F.get(names, F.length("term") % 3).alias("category"), F.explode(F.array(F.lit("text"), F.lit("sender"))).alias("field"), "term",
        (F.length("term") % 4 + 1).alias("weight"))


@query(f"""{sql.MESSAGES}{sql.classified()}, {_WORD_RULES},
    hits AS (
      SELECT uid, category, weight FROM (SELECT uid, n_subject || ' ' || n_body AS t FROM c_t) JOIN rules ON contains(t, term)
      UNION ALL SELECT uid, category, weight FROM (SELECT uid, n_sender AS t FROM c_t) JOIN rules ON contains(t, term)),
    sums AS (SELECT uid, {", ".join(f"sum(weight) FILTER (category = '{c}') AS {c}" for c in _CATEGORIES)} FROM hits GROUP BY uid)
    SELECT {sql.FOLDER_UID} AS uid, source_folder, {", ".join(f"coalesce({c}, 0)::INTEGER AS score_{c}" for c in _CATEGORIES)}
    FROM c_t LEFT JOIN sums USING (uid)""")
def keyword_scores_large(spark, sf):
    """Scores by a rule table that grows with the mail."""
    rows = corpus.folder_uids(triage.with_fallback_body(corpus.messages(spark, sf)))
    scored = classify.keyword_scores_scanned(rows, word_rules(spark, sf))
    return scored.select("uid", "source_folder", *[f"score_{c}" for c in _CATEGORIES])


def opening_topics(spark, sf):
    """A topic for every tenth document, named by the start of its opening line, and some known ones."""
    doc = F.col("doc_id") % 50
    words3 = F.array_join(F.slice(F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " "), 1, 2), " ")
    names = F.when(doc == 0, "Machine Learning").when(doc == 1, "Kubernetes").otherwise(words3)
    return R.topic_terms(corpus.table(spark, sf, "documents").where((F.col("doc_id") % 10 < 2)).select(names.alias("topic")))


_OPENING_TOPICS = f"""nt AS (
  SELECT DISTINCT lower({sql.strip("CASE WHEN doc_id % 50 = 0 THEN 'Machine Learning' WHEN doc_id % 50 = 1 THEN 'Kubernetes' "
    "ELSE array_to_string(string_split(split_part(text, chr(10), 1), ' ')[1:2], ' ') END")}) AS topic FROM documents WHERE doc_id % 10 < 2),
tt AS (
  SELECT topic, CASE WHEN len(regexp_extract_all(topic, '{sql.WORD}+')) > 1 THEN 'phrase' ELSE 'keyword' END AS kind, topic AS term FROM nt
  UNION ALL SELECT topic, 'keyword', unnest(CASE topic WHEN 'machine learning' THEN ['ml', 'machinelearning']
    WHEN 'kubernetes' THEN ['k8s'] ELSE []::VARCHAR[] END) FROM nt)"""
_N = lambda text: f"((length({text}) - length(replace({text}, term, ''))) // length(term))"


@query(f"""{sql.MESSAGES}{sql.topics('m')}, {_OPENING_TOPICS}
    SELECT {sql.FOLDER_UID} AS uid, source_folder, topic, kind, term,
      (CASE WHEN kind = 'phrase' THEN {_N('t_subject')} * 4.0::DOUBLE + {_N('t_body')} * 2.0::DOUBLE
        ELSE {_N('t_subject')} * 2.0::DOUBLE + {_N('t_all')} * 0.5::DOUBLE END)::DOUBLE AS score
    FROM t_a JOIN tt ON term <> '' AND contains(t_all, term) AND (kind = 'phrase' OR list_contains(t_words, term))""")
def topic_hits_large(spark, sf):
    """Topic phrases and keywords by a table that grows with the mail."""
    rows = corpus.folder_uids(corpus.messages(spark, sf))
    return topics.scanned_hits(rows, opening_topics(spark, sf)).select("uid", "source_folder", "topic", "kind", "term", "score")


_LARGE_PATTERNS = """pattern_rows AS (
    SELECT DISTINCT 'deny' AS list, '*user' || doc_id || '*@*.com' AS pattern FROM documents
    UNION SELECT DISTINCT 'allow', left(from_email, 3) || '*@*' || right(from_email, 6) FROM h
    UNION VALUES ('deny', '*com'), ('deny', '*mail*'), ('allow', '*a*k*'), ('deny', '*@store.com'), ('allow', '*')),
  sender_rows AS (
    SELECT DISTINCT from_email AS sender FROM h
    UNION SELECT DISTINCT 'x' || doc_id % 37 || '.user' || doc_id || '@mail.shop' || doc_id % 11 || '.com' FROM documents WHERE doc_id % 3 = 0)"""


def large_patterns(spark, sf):
    rows, documents = corpus.headers(spark, sf), corpus.table(spark, sf, "documents")
    per_user = documents.select(F.lit("deny").alias("list"), F.concat(F.lit("*user"), F.col("doc_id").cast("string"), F.lit("*@*.com")).alias("pattern"))
    shortened = rows.select(F.lit("allow"), F.concat(F.left("from_email", F.lit(3)), F.lit("*@*"), F.right("from_email", F.lit(6))))
    fixed = spark.createDataFrame(
        [("deny", "*com"), ("deny", "*mail*"), ("allow", "*a*k*"), ("deny", "*@store.com"), ("allow", "*")], "list string, pattern string")
    return per_user.union(shortened).union(fixed).distinct()


def large_senders(spark, sf):
    rows, doc = corpus.table(spark, sf, "documents").where(F.col("doc_id") % 3 == 0), F.col("doc_id")
    made = F.concat(F.lit("x"), (doc % 37).cast("string"), F.lit(".user"), doc.cast("string"), F.lit("@mail.shop"), (doc % 11).cast("string"), F.lit(".com"))
    return senders.distinct_senders(corpus.headers(spark, sf)).union(rows.select(made)).distinct()


@query(f"""{sql.HEADERS}, {_LARGE_PATTERNS} SELECT list, sender, pattern FROM sender_rows JOIN pattern_rows
    ON sender LIKE replace(replace(pattern, '_', '\\_'), '*', '%') ESCAPE '\\'""")
def sender_wildcard_large(spark, sf):
    """As many patterns as messages, some of only common pieces."""
    return senders.wildcard_matches_scanned(large_senders(spark, sf), large_patterns(spark, sf))
