"""Model input texts, class scores and token windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import CATEGORIES
from .text import WORD_CLASS, first_chars, or_empty, sanitize, strip

# Section tags of a model input, and the special token numbers.
SUBJECT_TAG, SENDER_TAG, BODY_TAG = "[SUBJECT]", "[SENDER]", "[BODY]"
PAD_ID, CLS_ID, SEP_ID = 0, 101, 102
FIRST_WORD_ID, VOCABULARY_SIZE = 1000, 30522
MAX_TOKENS = 384
BODY_CHARS = 1000


def tagged_text(subject: Column, sender: Column, body: Column) -> Column:
    return F.concat(F.lit(f"{SUBJECT_TAG} "), subject, F.lit(f" {SENDER_TAG} "), sender, F.lit(f" {BODY_TAG} "), body)


def named_sender(name: Column, address: Column) -> Column:
    return F.when(name != "", F.concat(name, F.lit(" <"), address, F.lit(">"))).otherwise(address)


def model_input(subject: Column, name: Column, address: Column, body: Column) -> Column:
    """Classifier input. The body is cut before it is sanitised."""
    return tagged_text(
        sanitize(subject), named_sender(sanitize(name), sanitize(address)),
        sanitize(first_chars(or_empty(body), BODY_CHARS)),
    )


def training_input(subject: Column, name: Column, address: Column, body: Column,
                   input_string: Column | None = None, text: Column | None = None) -> Column:
    """Training text: a ready input string or text if the row has one, else the unsanitised fields."""
    built = tagged_text(
        or_empty(subject), named_sender(or_empty(name), or_empty(address)), first_chars(or_empty(body), BODY_CHARS)
    )
    return F.coalesce(*[c for c in (input_string, text) if c is not None], built)


def parse_model_input(c: Column) -> Column:
    """Split an input text back into ``subject, from_name, from_email, body_text``."""
    text = or_empty(c)
    subject_at, sender_at, body_at = (F.instr(text, tag) for tag in (SUBJECT_TAG, SENDER_TAG, BODY_TAG))
    subject_from = subject_at + len(SUBJECT_TAG)
    sender_from = sender_at + len(SENDER_TAG)
    subject = strip(F.substr(text, subject_from, sender_at - subject_from))
    sender = strip(F.substr(text, sender_from, body_at - sender_from))
    body = strip(F.substr(text, body_at + len(BODY_TAG)))
    bracketed = F.contains(sender, F.lit("<")) & F.contains(sender, F.lit(">"))
    name = F.when(bracketed, strip(F.split_part(sender, F.lit("<"), F.lit(1)))).otherwise(F.lit(""))
    address = F.when(bracketed, F.btrim(F.split_part(sender, F.lit("<"), F.lit(2)), F.lit(">"))).otherwise(sender)
    complete = (subject_at > 0) & (sender_at > 0) & (body_at > 0)
    return F.when(
        complete,
        F.struct(subject.alias("subject"), name.alias("from_name"), address.alias("from_email"), body.alias("body_text")),
    )


def softmax(logits: Column) -> Column:
    """Class probabilities of an array of logits, stable for large values."""
    values = logits.cast("array<double>")
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def label_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CATEGORIES]), index)


def label_index(label: Column) -> Column:
    """Class number of a label, NULL for an unknown one."""
    index = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), label)
    return F.when(index > 0, (index - 1).cast("int"))


def token_ids(c: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Fixed-length token numbers: start mark, hashed words, end mark, padding.

    Words are numbered by hash, so no vocabulary has to be built, shipped or joined.
    """
    span = VOCABULARY_SIZE - FIRST_WORD_ID
    tokens = F.slice(
        F.regexp_extract_all(F.lower(or_empty(c)), F.lit(f"{WORD_CLASS}+"), F.lit(0)), 1, max_tokens - 2
    )
    ids = F.transform(
        tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % span + FIRST_WORD_ID).cast("int")
    )
    marked = F.concat(F.array(F.lit(CLS_ID)), ids, F.array(F.lit(SEP_ID)))
    return F.slice(F.concat(marked, F.array_repeat(F.lit(PAD_ID), max_tokens)), 1, max_tokens)


def attention_mask(ids: Column) -> Column:
    """1 for a token, 0 for padding."""
    return F.transform(ids, lambda x: F.when(x == PAD_ID, F.lit(0)).otherwise(F.lit(1)))
