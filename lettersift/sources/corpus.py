"""The supplied tables as a mailbox.

``documents`` and ``pages`` hold prose, not mail. Each document becomes one message whose header and
opening words come from one of ten variants, so that every branch of the operators occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import extract_address, extract_name, message_hash
from ..rules import Settings

# From header, subject opening and body opening of the variants 0 to 9.
VARIANTS = [
    ("Amazon <no-reply@amazon.com>", "Your invoice", "Thank you for your purchase."),
    ("TechCrunch <newsletter@techcrunch.com>", "Weekly digest", "Unsubscribe anytime."),
    ("Shop Marketing <marketing@shop.com>", "50% OFF Sale", "Buy now. Unsubscribe here."),
    ("friend@gmail.com", "Re: Meeting tomorrow", ""),
    ("Courses <offers@learn.example.com>", "Exclusive deal: Machine Learning course", "ML discount."),
    ("Deals <deals@store.com>", "Exclusive discount", "All about ml."),
    ("Boss <boss@mycompany.com>", "Sale notes", "Shop coupon."),
    ("Ads <ads@marketing.example.com>", "Hello", ""),
    ("Notify <alerts@bank.example.com>", "Weekly update", ""),
    ('"Quoted, Name" <Mixed.Case@Example.COM>', "K8s\tupdate  notes", ""),
]
EXACT_SUBJECT_VARIANT = 9
# The settings that the fixtures prescribe.
SETTINGS = Settings(
    topics=("machine learning", "kubernetes", "family"),
    allow=("*@mycompany.com", "noreply@github.com"),
    deny=("spam@promotions.com", "*@marketing.example.com"),
)
AS_OF = "2024-03-01 00:00:00"
_START = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _variant(part: int) -> Column:
    return F.get(F.array(*[F.lit(v[part]) for v in VARIANTS]), (F.col("doc_id") % len(VARIANTS)).cast("int"))


def _header_columns() -> dict[str, Column]:
    doc = F.col("doc_id")
    opening = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60)
    number = F.when(doc % 13 == 7, doc - 1).otherwise(doc)
    seconds = F.lit(_START) + doc * (37 * 60) - F.when(doc % 11 == 3, 4 * 86_400).otherwise(0)
    received = F.when(doc % 101 != 50, F.timestamp_seconds(seconds))
    folder = F.when(doc % 5 < 2, "INBOX").when(doc % 5 < 4, "[Gmail]/All Mail").otherwise("[Gmail]/Trash")
    return {
        "uid": doc,
        "id": doc.cast("string"),
        "mailbox": F.when(F.col("source").rlike("^src[0-9]$"), "personal").otherwise("work"),
        "message_id": F.when(doc % 97 == 5, "").otherwise(
            F.concat(F.lit("<"), number.cast("string"), F.lit("@corpus.example.com>"))),
        "subject": F.when(doc % len(VARIANTS) == EXACT_SUBJECT_VARIANT, _variant(1)).otherwise(
            F.concat(_variant(1), F.lit(" "), opening)),
        "from_raw": _variant(0),
        "to_raw": F.lit("me@corpus.example.com"),
        "received_at": received,
        # The server's clock: always set, and not behind where the date header is.
        "arrived_at": F.timestamp_seconds(F.lit(_START) + doc * (37 * 60)),
        "date": F.coalesce(
            F.concat(F.date_format(received, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")), F.lit("not a date")),
        "source_folder": folder,
        "flags": F.when(doc % 3 == 0, F.array(F.lit("\\Seen"))).otherwise(F.array().cast("array<string>")),
        "size": F.col("n_chars"),
        "attachment_count": (F.col("n_chars") % 3).cast("int"),
    }


def _addresses(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "hash": message_hash(F.col("message_id")),
        "from_email": extract_address(F.col("from_raw")),
        "from_name": extract_name(F.col("from_raw")),
        "parse_error": F.lit(None).cast("string"),
    })


def header_rows(documents: DataFrame) -> DataFrame:
    """Messages without bodies."""
    return _addresses(documents.select(*[c.alias(n) for n, c in _header_columns().items()]))


def message_rows(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Messages with bodies; the HTML body comes from the page of the same number.

    Of those with a page every fourth has no text body.
    """
    doc = F.col("doc_id")
    joined = documents.join(pages.select(F.col("page_id").alias("doc_id"), "html"), "doc_id", "left")
    opening = _variant(2)
    text = F.when(opening == "", F.col("text")).otherwise(F.concat(opening, F.lit(" "), F.col("text")))
    bodies = {
        "body_text": F.when(F.col("html").isNotNull() & (doc % 4 == 1), "").otherwise(text),
        "body_html": F.coalesce("html", F.lit("")),
    }
    return _addresses(joined.select(*[c.alias(n) for n, c in {**_header_columns(), **bodies}.items()]))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_rows(table(spark, sf_dir, "documents"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def folder_uids(df: DataFrame) -> DataFrame:
    """Number the messages of each folder by themselves, as mail servers do: uids repeat between folders."""
    return df.withColumn("uid", F.floor(F.col("uid") / 5) * 2 + F.col("uid") % 5 % 2)


def encoded_word(c: Column) -> Column:
    """A header text as one encoded word."""
    return F.concat(F.lit("=?utf-8?B?"), F.translate(F.base64(F.encode(c, "UTF-8")), "\r\n", ""), F.lit("?="))


def raw_messages(rows: DataFrame) -> DataFrame:
    """Messages as RFC 822 bytes: plain text, base64, two alternatives or HTML only, by uid.

    A few have no bytes at all, as when fetching failed.
    """
    def b64(c):
        return F.base64(F.encode(c, "UTF-8"))

    head = F.concat(
        F.lit("Message-ID: "), F.col("message_id"), F.lit("\r\nSubject: "), encoded_word(F.col("subject")),
        F.lit("\r\nFrom: "), F.col("from_raw"), F.lit("\r\nTo: "), F.col("to_raw"),
        F.lit("\r\nDate: "), F.col("date"), F.lit("\r\nMIME-Version: 1.0\r\n"),
    )
    kind = F.when(F.col("body_text") == "", 3).otherwise((F.col("uid") % 3).cast("int"))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), F.col("body_text"))
    coded = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), b64(F.col("body_text")))
    html_part = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), b64(F.col("body_html")))
    both = F.concat(
        F.lit('Content-Type: multipart/alternative; boundary="=-part-="\r\n\r\n--=-part-=\r\n'), coded,
        F.lit("\r\n--=-part-=\r\n"), html_part, F.lit("\r\n--=-part-=--\r\n"),
    )
    body = F.when(kind == 0, plain).when(kind == 1, coded).when(kind == 2, both).otherwise(html_part)
    raw = F.when(F.col("uid") % 101 != 51, F.encode(F.concat(head, body), "UTF-8"))
    return rows.select("id", "uid", "mailbox", "source_folder", "flags", raw.alias("raw"))


def labelled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual and predicted categories: labels give the actual one, the document length the prediction."""
    from ..functions.model import label_name

    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    actual = (F.col("quality") * 2 + F.col("toxic")).cast("int")
    predicted = F.when(F.col("n_chars") % 3 == 0, (F.col("n_chars") % 4).cast("int")).otherwise(actual)
    return labels.join(documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", label_name(actual).alias("actual"), label_name(predicted).alias("predicted")
    )
