"""Packing documents into training sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import VOCABULARY, encode, ranked

CAPACITY = 2048
END_ID = 1


@dataclass(frozen=True)
class Placement:
    """Where pieces go: those of a length with ranks from ``rank`` on go to sequences from ``sequence`` on.

    Rows are sorted by ``(length, rank)``; each holds up to the next row's rank.
    """

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length * (1 << 44) + self.rank
        row = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
        return self.sequence[row] + rank - self.rank[row], self.offset[row]


def place(histogram: dict[int, int], capacity: int = CAPACITY) -> Placement:
    """Shortest-pack-first histogram packing.

    Lengths are placed longest first, each into the shortest packs; if not even the shortest has room, new packs
    are opened and filled. Equal packs are one pattern with a count and hold consecutive sequence numbers, so a step
    handles a whole pattern and splits at most one. The work depends on the number of lengths (at most ``capacity``)
    and patterns, not on the number of documents.
    """
    heap: list[tuple[int, int, int]] = []  # used length, first sequence, number of sequences
    rows: list[tuple[int, int, int, int]] = []
    opened = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit")
        left, rank = histogram[length], 0
        while left and heap and heap[0][0] + length <= capacity:
            used, first, count = heapq.heappop(heap)
            taken = min(count, left)
            rows.append((length, rank, first, used))
            heapq.heappush(heap, (used + length, first, taken))
            if taken < count:
                heapq.heappush(heap, (used, first + taken, count - taken))
            left, rank = left - taken, rank + taken
        fit = capacity // length
        for packs, each in ((left // fit, fit), (min(1, left % fit), left % fit)):
            if packs:
                for i in range(each):
                    rows.append((length, rank, opened, i * length))
                    rank += packs
                heapq.heappush(heap, (each * length, opened, packs))
                opened += packs
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Placement(*(np.ascontiguousarray(table[:, i]) for i in range(4)))


def pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str, keep_ids: bool) -> DataFrame:
    """Encode each document, append ``end_id`` and cut it into full pieces and a rest."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                          + [("ids", pa.binary())] * keep_ids)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py(), vocabulary), end_id], "<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity]
                    row = (doc.as_py(), start, len(part), zlib.crc32(part), len(ids))
                    rows.append((*row, part.tobytes()) if keep_ids else row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind.type) for column, kind in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return docs.mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
         keep_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: ``doc_id``, ``start`` (its document's tokens before it), ``length``, ``ids_crc32``
    (of the little-endian 32-bit ids), ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence, gapless from 0;
    with ``keep_ids`` also ``ids``. Only documents longer than a sequence are cut: into full sequences and a rest.

    Texts are encoded once; the pieces are written to the shared folder. Their length histogram, at most
    ``capacity`` rows, is packed at once; pieces find their sequence by length and rank within it.

    A missing or empty text is a document of just ``end_id``. A missing ``doc_id`` stays missing; repeated rows are
    packed as often as they occur. An empty table gives no rows. Other columns are ignored.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    cut = saved(pieces(docs.select(*columns), capacity, end_id, vocabulary, keep_ids), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placement = place(histogram, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def position(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = placement.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    numbered = ranked(cut, "length", ["doc_id", "start", "ids_crc32"])
    return numbered.withColumn("_at", position("length", "rank")).select(
        *cut.columns, "_at.sequence_id", "_at.offset")
