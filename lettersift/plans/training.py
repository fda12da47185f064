"""Training sets, classifiers, metrics and the audit."""

from pyspark.sql import functions as F

from ..functions.model import training_input
from ..operators import bayes, classify, dataset, epochs, evaluate, ml, scoring, store
from ..operators.triage import with_fallback_body
from ..rules import CATEGORIES
from ..schemas import KEY
from ..session import shared_dir
from ..sources import corpus, files
from . import sql
from .registry import query

# Messages per folder: the default of the operator.
_PER_FOLDER = 3000


def _newest(where: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mailbox, source_folder ORDER BY uid DESC) AS r
        FROM h WHERE {where}) WHERE r <= {n}"""


_CHOSEN = f""",
inbox AS ({_newest("source_folder = 'INBOX'", _PER_FOLDER)}),
deep AS ({_newest("source_folder = '[Gmail]/All Mail'", 2 * _PER_FOLDER)}),
others AS (SELECT * FROM (SELECT uid, row_number() OVER (PARTITION BY mailbox ORDER BY uid DESC) AS r FROM deep
  WHERE (mailbox, message_id) NOT IN (SELECT mailbox, message_id FROM inbox)) WHERE r <= {_PER_FOLDER}),
trash AS ({_newest("source_folder = '[Gmail]/Trash'", _PER_FOLDER)}),
chosen AS (SELECT uid, 'INBOX' AS part FROM inbox UNION ALL SELECT uid, 'All Mail' FROM others UNION ALL SELECT uid, 'Trash' FROM trash)"""
_LABELLED = sql.MESSAGES + _CHOSEN + sql.classified("(SELECT m.*, chosen.part FROM m JOIN chosen USING (uid))")
_ROWS_SQL = f"""{_LABELLED} SELECT id, date, {sql.sanitize('from_email')} AS sender_email, {sql.sanitize('from_name')} AS sender_name,
    {sql.sanitize('subject')} AS subject, {sql.sanitize('substr(body_text, 1, 2000)')} AS body_text, category AS label, confidence, source_folder FROM c"""


def _labelled(spark, sf):
    rows = corpus.messages(spark, sf)
    return dataset.label_messages(dataset.training_folders(rows), rows)


@query(f"{sql.HEADERS}{_CHOSEN} SELECT uid, part FROM chosen")
def training_union(spark, sf):
    return dataset.training_folders(corpus.headers(spark, sf)).select("uid", "part")


@query(_ROWS_SQL)
def training_rows(spark, sf):
    return dataset.training_rows(_labelled(spark, sf))


@query(f"""{_LABELLED} SELECT count(*) AS total_emails, count(*) FILTER (part = 'INBOX') AS by_folder_inbox,
    count(*) FILTER (part = 'All Mail') AS by_folder_all_mail, count(*) FILTER (part = 'Trash') AS by_folder_trash,
    {", ".join(f"count(*) FILTER (category = '{c}') AS by_label_{c}" for c in CATEGORIES)} FROM c""")
def training_summary(spark, sf):
    return dataset.training_summary(_labelled(spark, sf))


@query(_ROWS_SQL)
def read_dataset_csv(spark, sf):
    """Training rows written as CSV and read back."""
    path = shared_dir(spark, "dataset-csv")
    files.write_csv(dataset.training_rows(_labelled(spark, sf)), path)
    return files.read_dataset_csv(spark, path)


@query(f"""{_LABELLED} SELECT id, date, from_email AS sender_email, from_name AS sender_name, subject, substr(body_text, 1, 2000) AS body_text,
    category AS label, confidence, source_folder FROM c""")
def read_dataset_json(spark, sf):
    """Training rows written as JSON lines with their summary and read back. The JSON form is not sanitised."""
    path = shared_dir(spark, "dataset-json")
    labelled = _labelled(spark, sf)
    files.write_dataset_json(dataset.training_rows(labelled, sanitised=False), dataset.training_summary(labelled), path)
    return files.read_dataset_json(spark, f"{path}/emails", lines=True)


_JSON_FORMS = f"""{_LABELLED}, r AS (SELECT id, label, confidence FROM (SELECT id, category AS label, confidence FROM c))
    SELECT form, id, label, confidence FROM r, (SELECT unnest(['list', 'object']) AS form)"""


@query(_JSON_FORMS)
def read_dataset_json_forms(spark, sf):
    """Training rows as documents that hold a list, and an object with the list, and read back."""
    rows = dataset.training_rows(_labelled(spark, sf), sanitised=False).withColumn("part", F.col("id").cast("long") % 4)
    lists = rows.groupBy("part").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "part"])).alias("emails"))
    forms = {"list": F.to_json("emails"), "object": F.to_json(F.struct("emails"))}
    found = None
    for form, text in forms.items():
        path = shared_dir(spark, f"dataset-{form}")
        # One document per file, as such files come.
        lists.select("part", text.alias("value")).repartition(4, "part").write.partitionBy("part").text(path)
        one = files.read_dataset_json(spark, f"{path}/*").select(F.lit(form).alias("form"), "id", "label", "confidence")
        found = one if found is None else found.union(one)
    return found


@query(f"{sql.MESSAGES}{sql.classified()} SELECT category AS label, count(*) AS n FROM c GROUP BY ALL")
def label_counts(spark, sf):
    return dataset.label_counts(classify.classify_rules(_messages(spark, sf)).withColumn("label", F.col("category")))


_SPLIT = "CASE WHEN ('0x' || substr(md5(mailbox || '/' || source_folder || '/' || uid), 1, 8))::BIGINT % 10000 < 8000 THEN 'train' ELSE 'val' END"


@query(f"{sql.HEADERS} SELECT uid, {_SPLIT} AS split FROM h")
def train_val_split(spark, sf):
    return dataset.train_val_split(corpus.headers(spark, sf)).select("uid", "split")


@query(f"{sql.MESSAGES} SELECT uid, subject, md5(raw_text) AS body_md5 FROM m ORDER BY uid LIMIT 100")
def calibration_sample(spark, sf):
    return dataset.calibration_sample(corpus.messages(spark, sf)).select("uid", "subject", F.md5("body_text").alias("body_md5"))


_PREDICTIONS = f"""WITH q AS (SELECT l.doc_id, {sql.items(CATEGORIES)}[quality * 2 + toxic + 1] AS actual,
    {sql.items(CATEGORIES)}[(CASE WHEN n_chars % 3 = 0 THEN n_chars % 4 ELSE quality * 2 + toxic END) + 1] AS predicted
    FROM labels l JOIN documents d USING (doc_id))"""


@query(f"""{_PREDICTIONS} SELECT label AS actual, {", ".join(f"count(*) FILTER (predicted = '{c}') AS {c}" for c in CATEGORIES)}
    FROM (SELECT unnest({sql.items(CATEGORIES)}) AS label) LEFT JOIN q ON actual = label GROUP BY label""")
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(corpus.labelled_predictions(spark, sf))


_METRICS_SQL = f"""m_l AS (SELECT unnest({sql.items(CATEGORIES)}) AS label),
    m_s AS (SELECT label, (SELECT count(*) FROM q WHERE actual = label) AS support, (SELECT count(*) FROM q WHERE predicted = label) AS claimed,
      (SELECT count(*) FROM q WHERE actual = label AND predicted = label) AS hits FROM m_l),
    m_r AS (SELECT *, CASE WHEN claimed > 0 THEN hits::DOUBLE / claimed ELSE 0 END AS prec, CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS rec FROM m_s),
    m_f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f FROM m_r)
    SELECT round(sum(hits)::DOUBLE / sum(support), 9) AS accuracy, round(sum(prec * support) / sum(support), 9) AS precision,
      round(sum(rec * support) / sum(support), 9) AS recall, round(sum(f * support) / sum(support), 9) AS f1 FROM m_f"""


@query(f"{_PREDICTIONS}, {_METRICS_SQL}")
def weighted_metrics(spark, sf):
    metrics = evaluate.weighted_metrics(corpus.labelled_predictions(spark, sf))
    return metrics.select(*[F.round(c, 9).alias(c) for c in metrics.columns])


@query(f"""{sql.MESSAGES}{sql.classified()}, g AS (SELECT CASE WHEN size % 3 = 0 THEN 'inbox' ELSE category END = category AS same FROM c)
    SELECT count(*) AS total, count(*) FILTER (same) AS matches, count(*) FILTER (same)::DOUBLE / count(*) AS match_rate FROM g""")
def consistency_audit(spark, sf):
    """A log in which some predictions were made by other rules; replaying gives the present ones."""
    judged = classify.classify_rules(_messages(spark, sf))
    old = judged.withColumn("category", F.when(F.col("size") % 3 == 0, "inbox").otherwise(F.col("category")))
    return evaluate.consistency_audit(store.audit_log_rows(old, corpus.as_of()))


def _messages(spark, sf):
    return with_fallback_body(corpus.messages(spark, sf))


def _training_texts(spark, sf):
    judged = classify.classify_rules(_messages(spark, sf))
    text = training_input(*[F.col(c) for c in ("subject", "from_name", "from_email", "body_text")])
    return judged.select(*KEY, text.alias("text"), F.col("category").alias("label"))


def _stored_texts(spark, sf):
    """The training texts, computed once and read as often as a fit needs them."""
    path, texts = shared_dir(spark, "training-texts"), _training_texts(spark, sf)
    texts.write.parquet(path)
    return spark.read.schema(texts.schema).parquet(path)


_TEXTS_SQL = f"""{sql.MESSAGES}{sql.classified()}, texts AS (
    SELECT uid, category AS label, {_SPLIT} AS split, {sql.TRAINING_TEXT} AS text FROM c)"""
# Multinomial naive Bayes: prior and smoothed word counts of each label, summed over the words of a text.
_BAYES_SQL = f"""{_TEXTS_SQL}, w AS (SELECT uid, label, split, unnest(regexp_extract_all(lower(text), '{sql.WORD}+')) AS word FROM texts),
    counts AS (SELECT label, word, count(*) AS n FROM w WHERE split = 'train' GROUP BY ALL),
    totals AS (SELECT label, sum(n) AS n FROM counts GROUP BY ALL),
    size AS (SELECT count(DISTINCT word) AS v FROM counts),
    priors AS (SELECT label, ln(count(*)::DOUBLE / (SELECT count(*) FROM texts WHERE split = 'train')) AS p FROM texts WHERE split = 'train' GROUP BY ALL),
    known AS (SELECT DISTINCT word FROM counts),
    f AS (SELECT uid, word, count(*) AS k FROM w JOIN known USING (word) WHERE split = 'val' GROUP BY ALL),
    s AS (SELECT uid, priors.label, sum(k * ln((coalesce(counts.n, 0) + 1)::DOUBLE / (totals.n + v))) AS s
      FROM f CROSS JOIN priors JOIN totals ON totals.label = priors.label CROSS JOIN size
      LEFT JOIN counts ON counts.label = priors.label AND counts.word = f.word GROUP BY ALL),
    scored AS (SELECT t.uid, t.label AS actual, priors.label, p + coalesce(s, 0) AS score
      FROM texts t CROSS JOIN priors LEFT JOIN s ON s.uid = t.uid AND s.label = priors.label WHERE split = 'val'),
    best AS (SELECT uid, actual, label AS predicted FROM (
      SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(score, 6) DESC, label) AS r FROM scored) WHERE r = 1)"""


def _bayes(spark, sf):
    split = dataset.train_val_split(_stored_texts(spark, sf))
    model = bayes.fit(split.where(F.col("split") == "train"))
    return bayes.predict(split.where(F.col("split") == "val"), model)


@query(f"{_BAYES_SQL} SELECT uid, actual, predicted FROM best")
def train_classifier(spark, sf):
    """Validation predictions of a naive Bayes model trained on rule labels."""
    return _bayes(spark, sf).select("uid", F.col("label").alias("actual"), "predicted")


@query(f"""{_BAYES_SQL}, q AS (SELECT actual, predicted FROM best), {_METRICS_SQL}""")
def evaluate_classifier(spark, sf):
    metrics = evaluate.weighted_metrics(_bayes(spark, sf).withColumnRenamed("label", "actual"))
    return metrics.select(*[F.round(c, 9).alias(c) for c in metrics.columns])


@query()
def train_linear(spark, sf):
    """Validation predictions of the linear model; checked for its rows and a floor on F1 in the tests."""
    split = dataset.train_val_split(_stored_texts(spark, sf))
    model = ml.train_classifier(split.where(F.col("split") == "train"))
    return ml.predictions(split.where(F.col("split") == "val"), model).groupBy("actual", "predicted").agg(F.count("*").alias("n"))


@query()
def select_linear(spark, sf):
    return ml.select_classifier(_stored_texts(spark, sf))[1]


def _length_scorer(rows):
    """A scorer that SQL can repeat: by the size of a message. It fails on some rows, with NULL or NaN."""
    n = F.col("size")
    share = (n % 10) / F.lit(10.0)
    scores = F.array(share / 2, (1 - share) / 2, share / 2, (1 - share) / 2)
    broken = F.array(F.lit(float("nan")), F.lit(0.1), F.lit(0.2), F.lit(0.3))
    return rows.withColumn("probabilities", F.when(n % 7 == 0, F.lit(None)).when(n % 7 == 1, broken).otherwise(scores))


@query(f"""{sql.MESSAGES}{sql.classified()}, g AS (SELECT *, (size % 10) / 10.0::DOUBLE AS share, size % 7 IN (0, 1) AS failed FROM c)
    SELECT uid, CASE WHEN failed THEN category WHEN share >= 1 - share THEN {sql.lit(CATEGORIES[0])} ELSE {sql.lit(CATEGORIES[1])} END AS category,
      CASE WHEN failed THEN confidence ELSE greatest(share, 1 - share) / 2 END AS confidence,
      CASE WHEN failed THEN 'rules' ELSE 'model' END AS method FROM g""")
def classify_model(spark, sf):
    """A model's scores, the first of equal ones, and the rules for rows it fails on."""
    return ml.classify_model(_messages(spark, sf), scorer=_length_scorer).select("uid", "category", "confidence", "method")


@query()
def classify_linear(spark, sf):
    """Predictions of the linear model for all messages."""
    split = dataset.train_val_split(_stored_texts(spark, sf))
    model = ml.train_classifier(split.where(F.col("split") == "train"))
    return ml.classify_model(_messages(spark, sf), model).select("uid", "category", "confidence", "method")


def _load_length_model():
    """A model that throws for a batch that holds a size of a multiple of 7."""
    def score(rows):
        if (rows["size"] % 7 == 0).any():
            raise ValueError("cannot score this size")
        return [[share / 2, (1 - share) / 2, share / 2, (1 - share) / 2] for share in rows["size"] % 10 / 10.0]

    return score


@query(f"""{sql.MESSAGES}{sql.classified()}, g AS (SELECT *, (size % 10) / 10.0::DOUBLE AS share, size % 7 = 0 AS failed FROM c)
    SELECT uid, CASE WHEN failed THEN category WHEN share >= 1 - share THEN {sql.lit(CATEGORIES[0])} ELSE {sql.lit(CATEGORIES[1])} END AS category,
      CASE WHEN failed THEN confidence ELSE greatest(share, 1 - share) / 2 END AS confidence,
      CASE WHEN failed THEN 'rules' ELSE 'model' END AS method FROM g""")
def classify_throwing_model(spark, sf):
    """A scorer that throws inside batches: the rules decide for the rows at fault, the model for all others."""
    scorer = scoring.safe_scorer(_load_length_model, ("size",))
    return ml.classify_model(_messages(spark, sf), scorer=scorer).select("uid", "category", "confidence", "method")


@query()
def train_epochs(spark, sf):
    """F1 after every epoch of mini-batch training and the epoch that is kept; compared with NumPy in the tests."""
    trained = epochs.select_epoch(_training_texts(spark, sf), epochs=4)
    rows = [(epoch, f1, epoch == trained.best) for epoch, f1 in enumerate(trained.f1)]
    return spark.createDataFrame(rows, "epoch int, f1 double, kept boolean")
