"""Benchmark decontamination: find, and remove, passages of test items in training documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fits, free_name, saved, small_side, with_row_id

# Fixed value: what separates words once A-Z are lower-cased. All characters above 127 belong to words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Windows broadcast at most: about 100 bytes each.
BROADCAST_WINDOWS = 500_000
BROADCAST_DOCUMENTS = 1_000_000


def word_list(text: Column) -> Column:
    """Words of a text as an array. Splitting leaves an empty string at an end that is a gap; it is cut off."""
    parts = F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), GAP)
    head = (F.get(parts, F.lit(0)) == "").cast("int")
    tail = ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return F.slice(parts, head + 1, F.size(parts) - head - tail)


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """Distinct windows ``(len, hash, window, item_ids)`` of all items; a shorter item is one window."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), word_list(F.col("text")).alias("words"))
    length = F.least(F.size("words"), F.lit(n))
    last = F.size("words") - length
    rows = words.where(F.size("words") > 0).select(
        "item_id", length.alias("len"), "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    window = F.slice("words", F.col("at") + 1, F.col("len"))
    return rows.select("item_id", "len", window.alias("_w")).select(
        "len", F.array_join("_w", " ").alias("window"), _hash(F.col("_w"), F.lit(0), n).alias("hash"), "item_id",
    ).groupBy("len", "hash", "window").agg(F.collect_set("item_id").alias("item_ids"))


def _hash(words: Column, at: Column, n: int) -> Column:
    """Hash of ``n`` words from position ``at``; positions past the end add nothing."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(n)])


def hit_rows(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """A row ``(_rid, doc_id, n_words, at, len, item_ids)`` per window occurrence, and one with nulls per document.

    The windows of the items are a hash table on every executor; the documents' windows stream past it, and a
    hit is verified on the words. Only hits are shuffled. More windows than may be broadcast are joined by shuffle.
    """
    windows = item_windows(items, n)
    lengths = sorted(r.len for r in windows.select("len").distinct().collect()) or [n]  # at most n values
    words = with_row_id(docs).select("_rid", "doc_id", word_list(F.col("text")).alias("words"))
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))
    scan = words.select("_rid", "doc_id", "words", F.size("words").alias("n_words"), F.explode(places).alias("at"))
    if len(lengths) == 1:
        scan = scan.select("*", F.lit(lengths[0]).alias("len"), _hash(F.col("words"), F.col("at"), lengths[0]).alias("hash"))
    else:
        each = F.array(*[F.struct(F.lit(k).alias("len"), _hash(F.col("words"), F.col("at"), k).alias("hash")) for k in lengths])
        scan = scan.select("*", F.inline(each))
    found = F.array_join(F.slice("words", F.col("at") + 1, scan["len"]), " ")
    if fits(windows, BROADCAST_WINDOWS):
        windows = F.broadcast(windows)
    else:
        scan, found = scan.withColumn("_found", found).drop("words"), F.col("_found")
    same = (
        (scan["hash"] == windows["hash"]) & (scan["len"] == windows["len"])
        & (F.col("at") + scan["len"] <= F.col("n_words")) & (found == F.col("window"))
    )
    first = (F.col("at") == 0) & (scan["len"] == lengths[0])
    return scan.join(windows, same, "left").where(F.col("window").isNotNull() | first).select(
        "_rid", "doc_id", "n_words", F.when(F.col("window").isNotNull(), F.col("at")).alias("at"), scan["len"], "item_ids")


def contamination(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """What of each document occurs in the items.

    Returns ``doc_id``, ``n_words``, ``n_hit`` (words inside an occurrence of a window of ``n`` item words),
    ``n_items`` and ``item_ids`` (items with such windows, sorted as strings), ``hits`` (``(at, len)`` of the
    occurrences in words, sorted) and ``contaminated``. An item of fewer words is one window.

    One row per input row, repeated rows included. Missing and empty texts have no words and are clean; items
    without words are ignored, items without an id mark words but are not counted. Without items all is clean.
    """
    rows = hit_rows(docs, items, n)
    hit = F.when(F.col("at").isNotNull(), F.struct("at", "len"))
    found = rows.groupBy("_rid", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )

    def extend(seen, hit):
        end = F.greatest(seen.end, hit.at + hit.len)
        return F.struct((seen.covered + end - F.greatest(seen.end, hit.at)).alias("covered"), end.alias("end"))

    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    covered = F.aggregate("hits", start, lambda seen, hit: F.when(hit.at + hit.len > seen.end, extend(seen, hit)).otherwise(seen))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered.covered.cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        "hits",
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """The documents without those that contain windows of the items, or (``remove="spans"``) without the hit words.

    Keeps the columns of ``docs``; clean documents are unchanged. Cases as in ``contamination``. With
    ``"spans"`` the gaps around removed words stay, and ``n_chars``, if there, is counted anew.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    # The result depends on the text alone, so repeated rows share it.
    key, hits, gone = (free_name(docs, name) for name in ("_key", "_hits", "_gone"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = contamination(keyed.select(F.col(key).alias("doc_id"), "text"), items, n).where("contaminated")
    # Written once: the join first counts it.
    dirty = saved(found.select(F.col("doc_id").alias(key), F.col("hits").alias(hits)).dropDuplicates([key]), "dirty")
    if remove == "documents":
        return keyed.join(small_side(dirty.select(key), BROADCAST_DOCUMENTS), key, "left_anti").drop(key)
    text = F.col("text").cast("string")
    # Words as in the original text, so with A-Z.
    word = "[^" + GAP[1:].replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    words, gaps = F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.split(text, word)
    joined = keyed.join(small_side(dirty, BROADCAST_WINDOWS), key, "left").withColumn(
        gone, F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h.at, h.at + h.len - 1)))))
    kept = F.transform(words, lambda w, i: F.when(F.array_contains(F.col(gone), i), "").otherwise(w))
    rest = F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    hit = F.col(hits).isNotNull()
    cleaned = joined.withColumn("text", F.when(hit, rest).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return cleaned.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS window_text
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win),
hits AS (
  SELECT rid, i, n, item_id
  FROM (SELECT rid, i, sizes.n, array_to_string(list_slice(w, i, i + sizes.n - 1), ' ') AS window_text
        FROM d, sizes, unnest(range(1, len(w) - sizes.n + 2)) AS t(i)) p
  JOIN win USING (n, window_text)
), words AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(k) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""
