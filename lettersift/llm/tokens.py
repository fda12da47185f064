"""Token ids and exact token counts.

The ids are those of the byte-level BPE in ``byte_bpe_50k.json``, its added tokens included: where a text holds the
string of one, it has that token's id. Its library needs about 0.8 CPU seconds a megabyte here; the same vocabulary
is also published as ranks, which another library applies several times faster with the same result (compared on
every given text and on random strings in the tests).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts

VOCABULARY = "byte_bpe_50k.tiktoken"
# The same vocabulary with the tokens that were added to it.
ADDED = {"byte_bpe_50k.tiktoken": "byte_bpe_50k.json"}
# Fixed value: how this vocabulary cuts texts without two adjacent white-space characters. The published
# pattern differs only in how it cuts longer runs, by a look-ahead that makes matching slower.
_SINGLE_SPACES = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_BLOCK = 1024


@lru_cache(maxsize=2)
def _encoders(vocabulary: str):
    import json
    import re

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    plain, single = (
        tiktoken.Encoding(f"{vocabulary}-{i}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for i, pattern in enumerate((public_tokenizers.PATTERN, _SINGLE_SPACES))
    )
    added = {}
    if vocabulary in ADDED:
        with open(public_tokenizers.path(ADDED[vocabulary]), encoding="utf-8") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    # Longer strings first; the group keeps them in what split() returns.
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
    return plain.encode_ordinary, single.encode_ordinary, re.compile(r"\s\s").search, added, cut


def encode(text: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    """Token ids of a text; none for a missing or empty one. The string of an added token has the id of that token."""
    if not text:
        return []
    plain, single, has_run, added, cut = _encoders(vocabulary)
    ids = []
    for part in cut(text) if any(token in text for token in added) else (text,):
        if part in added:
            ids.append(added[part])
        elif part:
            ids += plain(part) if has_run(part) else single(part)
    return ids


def token_lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row ``n_tokens`` per document."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.fromiter((len(encode(t.as_py(), vocabulary)) for t in batch.column(0)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(counts)], ["n_tokens"])

    return docs.select(F.col(text).cast("string")).mapInArrow(lengths, "n_tokens long")


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(n_tokens, n_docs)``: how many documents have each encoded length. Summed in the tasks before the shuffle."""
    return token_lengths(docs, text, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """What each context limit that equals some document's length keeps and cuts.

    Columns: ``context_limit``; ``n_docs`` of just that length; ``n_longer`` documents that the limit cuts;
    ``quantile``, the share of documents not longer; ``tokens_fitting`` in those; ``tokens_kept``, the total when
    every document is cut to the limit; ``tokens_cut``. Between two neighbouring limits ``tokens_kept`` is linear
    with slope ``n_longer`` of the lower one, so the rows answer every limit (``at_limits``).

    Suffix sums run over blocks of 1,024 lengths and then over the blocks, so no task holds the whole histogram.
    An empty table gives no rows; missing and empty texts are documents of length 0.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / _BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(Window.partitionBy()).alias("all_docs"),
        F.sum("tokens").over(Window.partitionBy()).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(within), F.lit(0))
    longer_tokens = F.coalesce(F.sum(tokens).over(within), F.lit(0))
    rows = rows.select("n_tokens", "n_docs", "block", longer.alias("longer"), longer_tokens.alias("longer_tokens"))
    n_longer, beyond = F.col("longer") + F.col("docs_above"), F.col("longer_tokens") + F.col("tokens_above")
    fitting = F.col("all_tokens") - beyond
    return rows.join(F.broadcast(blocks), "block").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        n_longer.alias("n_longer"),
        (1 - n_longer / F.col("all_docs")).alias("quantile"),
        fitting.alias("tokens_fitting"),
        (fitting + n_longer * F.col("n_tokens")).alias("tokens_kept"),
        (beyond - n_longer * F.col("n_tokens")).alias("tokens_cut"),
    )


def at_limits(contexts: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, tokens_kept, n_longer)`` for any limits, from the next row below each."""
    asked = contexts.sparkSession.createDataFrame([(int(x),) for x in limits], "asked long")
    below = F.max(F.struct("context_limit", "tokens_kept", "n_longer"))
    rows = asked.join(contexts, F.col("context_limit") <= F.col("asked"), "left").groupBy("asked").agg(below.alias("b"))
    n_all = contexts.agg(F.sum("n_docs").alias("n"))
    return rows.crossJoin(F.broadcast(n_all)).select(
        F.col("asked").alias("context_limit"),
        F.coalesce(F.col("b.tokens_kept") + (F.col("asked") - F.col("b.context_limit")) * F.col("b.n_longer"),
                   F.col("asked") * F.col("n")).alias("tokens_kept"),
        F.coalesce("b.n_longer", "n").alias("n_longer"),
    )


def ranked(pieces: DataFrame, by: str, order: list[str], rank: str = "rank") -> DataFrame:
    """Number rows from 0 within each value of ``by``, without bringing one value's rows into one task.

    Rows of a value are dealt over as many parts as there are shuffle partitions; each part is numbered by
    itself and starts after the parts before it.
    """
    n = shuffle_parts(pieces.sparkSession)
    rows = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(n)))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(by, "_part").agg(F.count("*").alias("_n")).select(
        by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))
    return rows.withColumn("_own", own).join(starts, [by, "_part"]).withColumn(
        rank, F.col("_start") + F.col("_own") - 1).drop("_part", "_own", "_start")
