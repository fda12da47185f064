"""Phrase collocations by top-order marginalisation.

Only windows of three words are counted: every word of a piece leads one, padded where the piece ends. Shorter phrases
are prefixes of windows, so a ROLLUP over the window's columns gives their counts, those of words and the number of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, saved

# Bytes of text and words that are counted together before the shuffle. Three word numbers fit one 64-bit key.
CHUNK_BYTES = 12_000_000
CHUNK_WORDS = (1 << 21) - 8
ROWS_OUT = 100_000
# Pairs of leading words fall into this many buckets; one with more than its share of windows is split.
BUCKETS = 1 << 16
HOT_BUCKETS = 1024
SPLIT = 64
# What ends a piece, and what parts words.
_ENDS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END, _GAP = 10, 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[list(_ENDS)] = _END
_LOWER[list(_GAPS)] = _GAP

MIN_COUNT, TOP = 10, 2000


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each whether the next one stands in the same piece."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    inside = (data != _END) & (data != _GAP)
    cut = np.zeros(len(data) + 1, bool)  # a text begins here
    cut[offsets - offsets[0]] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    stops = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    piece = np.cumsum((data == _END) | cut[:-1], dtype=np.int32)[starts]
    lengths = np.concatenate(([0], stops - starts)).astype(np.int32)
    words = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(np.cumsum(lengths, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return words, np.concatenate((piece[1:] == piece[:-1], [False])) if len(starts) else np.zeros(0, bool)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """``(lang, words, joined)`` for some texts of one language at a time, at most ``CHUNK_WORDS`` leading words."""
    langs, texts = batch.column(0), batch.column(1).cast(pa.string())
    for lang in pc.unique(langs).to_pylist():
        own = texts.filter(pc.equal(langs, lang))
        reach = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(own):
            done = reach[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(reach, done + CHUNK_BYTES, "right")))
            words, joined = _words(own.slice(start, stop - start))
            for at in range(0, len(words), CHUNK_WORDS):
                # Two more words, which lead no window here.
                yield lang, words.slice(at, CHUNK_WORDS + 2), joined[at : at + CHUNK_WORDS + 2]
            start = stop


def _windows(words: pa.Array, joined: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words in order behind an empty one, and the window columns as places in them; 0 is padding."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    first = place[coded.indices.to_numpy()]
    n = min(len(first), CHUNK_WORDS)
    ahead = lambda x, k: np.concatenate((x[k:], np.zeros(k, x.dtype)))[:n]
    second = np.where(joined[:n], ahead(first, 1), 0)
    third = np.where(joined[:n] & ahead(joined, 1), ahead(first, 2), 0)
    known = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.take(pa.array(order))])
    return known, first[:n], second, third


def _hashes(known: pa.Array, lang: str) -> np.ndarray:
    values = np.array([lang, *known[1:].to_pylist()], dtype=object)
    hashes = pd.util.hash_array(values, categorize=False)
    return hashes * np.uint64(0x9E3779B97F4A7C15) + hashes[0]


def _buckets(hashes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (hashes[first] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ hashes[second]
    return ((mixed * np.uint64(0x165667B19E3779F9)) >> np.uint64(48)).astype(np.int64)


def _bucket_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sizes = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for lang, words, joined in _chunks(batch):
            known, first, second, _ = _windows(words, joined)
            sizes += np.bincount(_buckets(_hashes(known, lang), first, second), minlength=BUCKETS)
    used = np.flatnonzero(sizes)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used])], ["bucket", "n"])


def _counter(hot: list[int]):
    """Count the windows of each chunk: a row per leading pair, with its third words and their counts in ``thirds``.

    ``lead`` is the two words, a part and the language; ``thirds`` is the pair's count and the words, parted by spaces, a
    word's count by a tab if it is not 1: neither stands in a word. One column, so that windows and pairs share a shuffle. Pairs of hot buckets have a row and a number for each part of third words.
    """
    is_hot = np.zeros(BUCKETS, bool)
    is_hot[hot] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, joined in _chunks(batch):
                known, first, second, third = _windows(words, joined)
                base = len(known)
                keys, counts = np.unique((first * base + second) * base + third, return_counts=True)
                pairs, third = np.divmod(keys, base)
                parts = np.zeros(len(keys), np.int64)
                if hot:
                    first, second = np.divmod(pairs, base)
                    hashes = _hashes(known, lang)
                    split = 1 + ((hashes[third] >> np.uint64(32)) % np.uint64(SPLIT)).astype(np.int64)
                    parts = np.where(is_hot[_buckets(hashes, first, second)], split, 0)
                    order = np.lexsort((parts, pairs))
                    pairs, third, parts, counts = pairs[order], third[order], parts[order], counts[order]
                tails = known.take(pa.array(third))
                more = np.flatnonzero(counts > 1)
                numbered = pc.binary_join_element_wise(tails.take(pa.array(more)), pa.array(counts[more]).cast(pa.string()), "\t")
                tails = pc.replace_with_mask(tails, pa.array(counts > 1), numbered)
                heads = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (parts[1:] != parts[:-1]))))
                bounds = np.append(heads, len(keys)).astype(np.int32)
                thirds = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), tails), " ")
                first, second = np.divmod(pairs[heads], base)
                lead = pc.binary_join_element_wise(
                    known.take(pa.array(first)), known.take(pa.array(second)), pa.array(parts[heads]).cast(pa.string()), lang, "\t")
                sizes = pa.array(np.add.reduceat(counts, heads)).cast(pa.string())
                thirds = pc.binary_join_element_wise(sizes, thirds, " ")
                for at in range(0, len(heads), ROWS_OUT):
                    yield pa.RecordBatch.from_arrays([c.slice(at, ROWS_OUT) for c in (lead, thirds)], ["lead", "thirds"])

    return count


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, size, phrase, f)``: phrases of 1 to 3 words that occur ``min_count`` times, and ``size`` 0 for all words.

    Windows are counted in the tasks and dealt by their leading two words, so that one shuffle completes windows and
    pairs. Rare ones are put with the shorter prefix, of which ROLLUP sums all parts; pairs keep what their listed windows
    don't count. A bucket of leading pairs with more than 1 in 1,024 of all windows is dealt by the third word as well, and its
    pairs stay until the sum.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sizes = texts.mapInArrow(_bucket_sizes, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    sizes = saved(sizes, "buckets")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = [r.bucket for r in sizes.where(F.col("n") * HOT_BUCKETS > total).select("bucket").collect()]  # fewer than 1,024
    rows = texts.mapInArrow(_counter(hot), "lead string, thirds string").repartition("lead")
    third = F.split("_third", "\t")
    windows = rows.select("lead", F.explode(F.slice(F.split("thirds", " "), 2, 1 << 30)).alias("_third")).select(
        "lead", third[0].alias("w2"), F.coalesce(F.try_element_at(third, F.lit(2)).cast("long"), F.lit(1)).alias("n"))
    windows = windows.groupBy("lead", "w2").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) & (F.col("w2") != ""))
    pairs = rows.groupBy("lead").agg(F.sum(F.substring_index("thirds", " ", 1).cast("long")).alias("n"))
    lead = F.split("lead", "\t", 4)
    columns = [lead[3].alias("lang"), lead[0].alias("w0"), F.nullif(lead[1], F.lit("")).alias("w1")]
    often = (F.col("n") >= min_count) | (lead[2] != "0")
    none = F.lit(None).cast("string").alias("w2")
    kept = pairs.select(*columns[:2], F.when(often, columns[2]).alias("w1"), none, "n")
    # A listed window and its pair, less the window.
    listed = windows.select(*columns, F.inline(F.array(
        F.struct("w2", "n"), F.struct(none, (-F.col("n")).alias("n")))))
    sums = kept.unionByName(listed).rollup("lang", "w0", "w1", "w2").agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # Sums over a padded column, and the sum over all languages, are no phrases.
    size = F.when(F.col("level") == 7, 0).when(F.col("level") == 3, 1).when(
        (F.col("level") == 1) & F.col("w1").isNotNull(), 2).when((F.col("level") == 0) & F.col("w2").isNotNull(), 3)
    sums = sums.select("lang", size.alias("size"), F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"), "f")
    return sums.where(F.col("size").isNotNull() & ((F.col("size") == 0) | (F.col("f") >= min_count)))


def _part_counts(cuts: DataFrame, counts: DataFrame, part: str, out: str) -> DataFrame:
    """Add the count of a part of each phrase. Common words are part of many phrases."""
    groups = cuts.groupBy("lang", F.col(part).alias("phrase")).agg(F.count("*").alias("_n")).join(counts, ["lang", "phrase"])
    groups = saved(groups.select("lang", F.col("phrase").alias(part), F.col("f").alias(out), "_n"), "parts")
    return join_groups(cuts, groups, ["lang", part], "_n", cuts.count()).drop("_n")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's best phrases: ``(lang, rank, phrase, a, l, r, n, score)``.

    Texts are lower-cased (A-Z) and cut into pieces at punctuation and line ends, pieces into words at spaces and tabs.
    A phrase of 2 or 3 words that occurs ``a >= min_count`` times is cut in two at every place; ``l`` and ``r`` are the
    counts of the parts at the cut with the least ``score = floor(1000000 * a * a / (l * r))``, the first such cut. A
    phrase goes if a longer one holds it and occurs at least half as often. The first ``top`` of a language by score, a
    (both descending) and phrase stay. ``n`` is the language's number of words. All arithmetic is exact.

    A missing language is ``und``, a missing text empty. Repeated rows count as often as they occur. Other columns
    are ignored; texts without words and empty tables give no rows. Texts may be of any length.
    """
    counts = saved(phrase_counts(docs, min_count, lang, text), "phrases")
    phrases = counts.where("size >= 2").withColumn("_w", F.split("phrase", " "))
    cut = lambda k: F.struct(
        F.lit(k).alias("k"), F.array_join(F.slice("_w", 1, k), " ").alias("_left"),
        F.array_join(F.slice("_w", k + 1, F.col("size") - k), " ").alias("_right"))
    cuts = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), F.inline(
        F.when(F.col("size") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))))
    parts = counts.where("size BETWEEN 1 AND 2").select("lang", "phrase", "f")
    cuts = saved(cuts, "cuts")
    cuts = saved(_part_counts(cuts, parts, "_left", "l"), "cuts")
    cuts = _part_counts(cuts, parts, "_right", "r")
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("_top", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a"))).withColumn("_area", exact("l") * exact("r"))
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(F.expr("_top div _area").alias("score"), "k", "l", "r")).alias("b"))
    inner = phrases.where("size = 3").select("lang", "f", F.explode(F.array(
        F.array_join(F.slice("_w", 1, 2), " "), F.array_join(F.slice("_w", 2, 2), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    rows = best.join(inner, ["lang", "phrase"], "left").where("_longer IS NULL OR 100 * _longer < 50 * a")
    rows = rows.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    by = [F.desc("score"), F.desc("a"), "phrase"]
    # First within parts of a language, then among the best of the parts.
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPLIT))
    rows = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*by)))
    rows = rows.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)))
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return rows.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")



ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i:i])) AS g FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) FROM words),
f AS MATERIALIZED (
  SELECT lang || chr(9) || array_to_string(g, ' ') AS key, any_value(lang) AS lang, any_value(g) AS g, count(*) AS f
  FROM grams GROUP BY 1),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT key, lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= {MIN_COUNT}),
k AS MATERIALIZED (
  SELECT key, a, 1 AS k, lang || chr(9) || g[1] AS first, lang || chr(9) || array_to_string(g[2:], ' ') AS rest FROM c
  UNION ALL SELECT key, a, 2, lang || chr(9) || array_to_string(g[1:2], ' '), lang || chr(9) || g[3] FROM c WHERE len(g) = 3),
s AS (
  SELECT k.key, k.a, k.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.key = k.first JOIN f y ON y.key = k.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, k) = 1),
inside AS (
  SELECT lang || chr(9) || array_to_string(g[1:2], ' ') AS key, a FROM c WHERE len(g) = 3
  UNION ALL SELECT lang || chr(9) || array_to_string(g[2:3], ' '), a FROM c WHERE len(g) = 3),
longer AS (SELECT key, max(a) AS most FROM inside GROUP BY key),
kept AS (
  SELECT c.lang, array_to_string(c.g, ' ') AS phrase, b.a, l, r, score FROM b JOIN c USING (key) LEFT JOIN longer o USING (key)
  WHERE o.most IS NULL OR 100 * o.most < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= {TOP}"""
