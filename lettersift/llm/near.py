"""N-gram Jaccard join: documents whose shingle sets are alike, and their groups.

Method. Sets are banded by size; a band's hash space is cut into more ranges than two linked sets can differ in
elements, so linked sets agree completely in at least one range: a tile is ``(band, range, its elements)``. Unlike
a shared rare or small shingle, a tile is not met by texts that only share a passage. Documents meeting in a tile form
clusters (connected components, by identifiers alone), and only clusters are compared: pairs of compatible sizes,
first by hashed bitmaps, whose differing bits bound the intersection from above, then by the sorted arrays.

Hot groups. Copies have the same set digest and count as one. Sets that share too few tiles to be alike are no
candidates, and tiles that many sets share are left out wherever a set has enough others, so that a common passage ties
nothing together. Clusters that are too large for one task are compared in blocks, and afterwards only the
documents outside the largest group so found with all others, so a group of near copies costs little more than
one pass. No pair between different groups is left uncompared, hence no group is split.

Shingles are 64-bit hashes; a wrong equality has a probability of about 2^-64 for each pair of different shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, saved, small_batches, small_side
from .graph import components

_U = np.uint64
# Documents and shingles that one task compares with each other; a tile of shingles takes 8 bytes each.
BLOCK_DOCUMENTS = 2048
BLOCK_SHINGLES = 2_000_000
BROADCAST_ROWS = 1_000_000
BITMAP_BITS = 1024
BAND = 1.4
# A tile that more sets have counts as hot. The result doesn't depend on it.
HOT_TILE = 16
SPARE = 4096
# Tile rows of 24 bytes that leave a Python worker at once, and sets that it remembers to send their tiles only once.
BATCH_TILES = 200_000
SEEN_SETS = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words between white space (space, tab to carriage return), A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), _U, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of all ``width`` consecutive words; of fewer words, of the whole sequence."""
    words = word_hashes(text)
    if not len(words):
        return words
    take = min(width, len(words))
    n = len(words) - take + 1
    total = np.full(n, take, _U)
    for i in range(take):
        total = _mix(total + words[i:i + n])
    return np.unique(total)


class Bands:
    """Size bands and how finely each cuts the hash space, for similarity ``num / den`` and more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self._known: dict[int, list[tuple[int, int, int]]] = {}

    def starts(self, upto: int) -> list[int]:
        starts = [1]
        while starts[-1] <= upto:
            starts.append(max(starts[-1] + 1, ceil(starts[-1] * BAND)))
        return starts

    def cut(self, first: int, after: int) -> tuple[int, int, int]:
        """Largest partner size, most differing elements, and number of ranges of the band ``[first, after)``."""
        partner = (after - 1) * self.den // self.num
        differ = (after - 1 + partner) * (self.den - self.num) // (self.den + self.num)
        ranges = differ + 1
        if differ:  # some ranges are empty by chance and can't tell anything
            empty = ranges * exp(-first / ranges)
            ranges += 2 + ceil(empty + 3 * sqrt(empty))
        return partner, differ, ranges

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """``(first, differ, ranges)`` of the bands a set belongs to: as the smaller or the larger partner."""
        if size not in self._known:
            starts, found = self.starts(size), []
            for first, after in zip(starts, starts[1:], strict=False):
                partner, differ, ranges = self.cut(first, after)
                if first <= size <= partner:
                    found.append((first, differ, ranges))
            self._known[size] = found
        return self._known[size]

    def tiles(self, shingles: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """``(keys, spare, first)`` of each band of a set: its tiles, and how many of them it shares at least with any
        partner in the band. Range and band are part of a key.
        """
        sums = np.concatenate(([_U(0)], np.cumsum(_mix(shingles + _U(0x9E3779B97F4A7C15)), dtype=_U)))
        found = []
        for first, differ, ranges in self.of(len(shingles)):
            own = ((shingles >> _U(32)) * _U(ranges)) >> _U(32)
            ends = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, len(own))
            begins = np.concatenate(([0], ends[:-1]))
            used, band = own[begins], _U(first * 0xA0761D6478BD642F % 2**64)
            keys = _mix(_mix(sums[ends] - sums[begins]) + used * _U(0xD6E8FEB86659FD93) + band)
            if len(used) <= differ:  # so few that the agreeing range may be an empty one
                rest = np.setdiff1d(np.arange(ranges, dtype=_U), used)
                keys = np.concatenate([keys, _mix(rest * _U(0xD6E8FEB86659FD93) + band + _U(1))])
            found.append((keys, max(0, len(used) - differ), first))
        return found


def _digest(shingles: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sizes(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, n_shingles, digest)`` and the columns behind ``text``, a row per document."""
    others = docs.columns[2:]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_digest, sets), pa.int64(), size=len(sets)),
                *batch.columns[2:],
            ], ["doc_id", "n_shingles", "digest", *others])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(measure, "doc_id long, n_shingles long, digest long" + (", " + schema if others else ""))


def tile_rows(texts: Iterable[str | None], width: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    """``(tile, digest, place)`` of texts, in batches that don't grow with those the texts came in.

    A batch ends with the set that fills it. Most copies among the texts give their rows once.
    """
    def batch() -> pa.RecordBatch:
        sizes = [len(keys) for keys, _, _ in parts]
        columns = [np.concatenate([keys for keys, _, _ in parts]).view(np.int64),
                   *(np.repeat(np.array([p[i] for p in parts], np.int64), sizes) for i in (1, 2))]
        parts[:] = []
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tile", "digest", "place"])

    seen: set[int] = set()
    parts: list[tuple[np.ndarray, int, int]] = []
    held = 0
    for text in texts:
        shingles = shingle_set(text, width)
        digest = _digest(shingles)
        if not len(shingles) or digest in seen:
            continue
        if len(seen) >= SEEN_SETS:
            seen.clear()
        seen.add(digest)
        for keys, spare, first in bands.tiles(shingles):
            parts.append((keys, digest, first * SPARE + min(spare, SPARE - 1)))
            held += len(keys)
        if held >= BATCH_TILES:
            yield batch()
            held = 0
    if parts:
        yield batch()


def _candidates(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """Links ``(a, b)`` between digests that share enough tiles.

    Linked sets share all tiles of a band but those that their differences touch: at least ``spare``. Sets that only
    have a passage in common share few. So pairs are counted within the tiles of at most ``HOT_TILE`` sets. A tile of more
    sets tells little where it holds nothing but a common passage; a set needs such tiles only if it has so many that
    they may be all it shares with a partner, as in a group of copies. There each set is tied to the tile's smallest.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tile_rows((t.as_py() for batch in batches for t in batch.column(1)), width, bands)

    rows = docs.mapInArrow(emit, "tile long, digest long, place long")
    of_tile = Window.partitionBy("tile")
    met = rows.select("*", F.min("digest").over(of_tile).alias("low"), F.max("digest").over(of_tile).alias("high"),
                      F.count("*").over(of_tile).alias("n")).where("low < high")
    # Copies in several tasks repeat rows.
    met = saved(met.select("tile", "digest", "place", (F.col("n") > HOT_TILE).alias("hot")).distinct(), "tiles")
    hot = F.sum(F.col("hot").cast("int")).over(Window.partitionBy("digest", "place"))
    spare = F.col("place") % SPARE
    met = met.withColumn("all_hot", hot)
    # Pairs of few sets: what a set shares beyond its hot tiles must be among the others.
    need = F.greatest(F.lit(1), spare - F.col("all_hot"))
    few = met.where(~F.col("hot")).groupBy("tile").agg(
        F.array_sort(F.collect_list(F.struct("digest", F.floor(F.col("place") / SPARE).alias("band"), need.alias("need")))).alias("sets"))
    pairs = F.flatten(F.transform("sets", lambda x, i: F.transform(
        F.slice("sets", i + 2, HOT_TILE), lambda y: F.struct(
            y.digest.alias("a"), x.digest.alias("b"), x.band.alias("band"), F.greatest(x.need, y.need).alias("need")))))
    counted = few.select(F.inline(pairs)).groupBy("a", "b", "band").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    alike = counted.where("n >= need").select("a", "b")
    kept = met.where(F.col("hot") & (F.col("all_hot") >= spare)).withColumn("b", F.min("digest").over(of_tile))
    return alike.union(kept.where("b != digest").select(F.col("digest").alias("a"), "b")).distinct()


def _sets(docs: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """Replace ``doc_id`` of ``placed (doc_id, digest, ...)`` by the document's ``shingles``."""
    columns = [c for c in placed.columns if c != "doc_id"]
    schema = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in columns) + ", shingles binary"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            digests = batch.column(1).to_pylist()
            # Rows may share a doc_id; only those with the wanted set count.
            rows = pa.array([i for i, (s, d) in enumerate(zip(sets, digests, strict=True)) if _digest(s) == d], pa.int64())
            kept = batch.take(rows)
            shingles = pa.array([sets[i].tobytes() for i in rows.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept.columns[1:], shingles], [*columns, "shingles"])

    texts = docs.join(small_side(placed, BROADCAST_ROWS), "doc_id").select("text", *columns)
    return texts.mapInArrow(fill, schema)


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit per hash value, toggled by each element: bits that differ between sets are elements that differ."""
    odd = np.bincount((shingles >> _U(54)).astype(np.intp), minlength=BITMAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(_U)


def link_sets(sets: list[np.ndarray], groups: np.ndarray, probes: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join groups of sets: no two sets that are alike end in different groups.

    ``groups`` numbers what is already known to be together. Only pairs with at least one of ``probes`` are compared, in
    order of size, and only while they are in different groups.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, group, probe = sizes[order], groups[order].copy(), probes[order]
    bitmaps = np.stack([_bitmap(sets[i]) for i in order])
    last = np.searchsorted(sizes, sizes * den // num, side="right")
    links = []
    for i in range(len(order)):
        partners = slice(i + 1, last[i])
        near = group[partners] != group[i]
        if not probe[i]:
            near &= probe[partners]
        j = np.flatnonzero(near) + i + 1
        if not len(j):
            continue
        differ = np.bitwise_count(bitmaps[j] ^ bitmaps[i]).sum(axis=1, dtype=np.int64)
        both = sizes[j] + sizes[i]
        for k in j[(both - differ) // 2 * (num + den) >= num * both]:
            if group[k] == group[i]:
                continue
            shared = len(np.intersect1d(sets[order[i]], sets[order[k]], assume_unique=True))
            if den * shared >= num * (sizes[i] + sizes[k] - shared):
                links.append((int(order[i]), int(order[k])))
                group[group == group[k]] = group[i]
    return links


def _compare(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links within the tiles of ``(tile, digest, cluster, known, probe, shingles)``."""
    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in tile.groupby("cluster"):
            digests = part["digest"].to_numpy()
            sets = [np.frombuffer(s, _U) for s in part["shingles"]]
            links = link_sets(sets, part["known"].to_numpy(), part["probe"].to_numpy(), num, den)
            found += [(digests[a], digests[b]) for a, b in links]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("tile").applyInPandas(compare, "a long, b long")


def _links(docs: DataFrame, members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """All links that matter between ``members (doc_id, digest, cluster, n)`` of the same cluster.

    Only identifiers and sizes are grouped to deal the members into tiles; their sets are then made from the texts
    and shuffled once.
    """
    sizes = saved(members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")), "clusters")
    total = sizes.agg(F.sum("shingles")).first()[0] or 0
    large = sizes.where((F.col("docs") > BLOCK_DOCUMENTS) | (F.col("shingles") > 2 * BLOCK_SHINGLES)).select(
        "cluster", F.greatest(
            F.ceil(F.col("docs") / (BLOCK_DOCUMENTS // 2)), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    large = saved(large, "large")
    rows = members.join(small_side(large, BROADCAST_ROWS), "cluster", "left")
    together = F.pmod(F.xxhash64("cluster"), F.lit(max(1, total // (BLOCK_SHINGLES // 2))))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    every_block = F.sequence(F.lit(0), F.col("blocks") - 1)
    # The smallest member of a large cluster is in every block and ties the blocks together.
    blocks = F.when(F.col("digest") == F.col("cluster"), every_block).otherwise(F.array(block))
    tiles = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(-1).alias("block"), together.alias("key")))).otherwise(
        F.transform(blocks, lambda b: F.struct(b.alias("block"), F.col("cluster").alias("key"))))
    first = _sets(docs, rows.select("doc_id", "digest", "cluster", "blocks"), width).select(
        F.explode(tiles).alias("tile"), "digest", "cluster", F.col("digest").alias("known"), F.lit(True).alias("probe"), "shingles")
    links = saved(_compare(first, num, den), "near")
    if not large.take(1):
        return links
    known = components(links)
    in_large = members.join(small_side(large, BROADCAST_ROWS), "cluster").join(known, members["digest"] == known["id"], "left").select(
        "doc_id", "digest", "cluster", "blocks", F.coalesce("component", "digest").alias("known"))
    in_large = saved(in_large, "members")
    groups = in_large.groupBy("cluster", "known").agg(F.count("*").alias("docs"))
    main = groups.groupBy("cluster").agg(F.max_by("known", F.struct("docs", "known")).alias("main"))
    outside = groups.join(main, "cluster").where("known != main").groupBy("cluster", "main").agg(
        F.ceil(F.sum("docs") / (BLOCK_DOCUMENTS // 2)).cast("int").alias("chunks"))
    outside = saved(outside, "outside")
    if not outside.take(1):
        return links
    # Documents outside their cluster's main group meet all documents of the cluster, block by block.
    rows = in_large.join(small_side(outside, BROADCAST_ROWS), "cluster").withColumn("outer", F.col("known") != F.col("main"))
    chunk = F.pmod(F.xxhash64("digest", F.lit(1)), F.col("chunks")).cast("int")
    place = lambda c, b, probe: F.struct(c.alias("chunk"), b.alias("block"), F.lit(probe).alias("probe"))
    met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: place(c, block, False))
    probes = F.transform(every_block, lambda b: place(chunk, b, True))
    tiles = F.when(F.col("outer"), F.concat(met, probes)).otherwise(met)
    second = _sets(docs, rows.select("doc_id", "digest", "cluster", "known", "chunks", "blocks", "outer"), width).select(
        "digest", "cluster", "known", "shingles", F.inline(tiles)).select(
        F.struct("cluster", "chunk", "block").alias("tile"), "digest", "cluster", "known", "probe", "shingles")
    return links.union(saved(_compare(second, num, den), "near")).union(
        in_large.where("digest != known").select(F.col("digest").alias("a"), F.col("known").alias("b")))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups of documents linked by likeness: ``den`` * shared shingles >= ``num`` * shingles in either set.

    Returns ``doc_id``, ``n_shingles`` (distinct ``width``-word shingles; with fewer words the whole sequence is one)
    and ``component_id``, the smallest ``doc_id`` reachable by links, itself included.

    One row per input row. Missing, empty and blank texts have no shingles and no links. Rows that share a ``doc_id``
    are one document, linked by whatever any of them links. Rows without ``doc_id`` have no ``component_id`` and link
    nothing. An empty table gives no rows; columns named in ``carry`` are returned too, others are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    named = docs.where("doc_id is not null")
    sizes = saved(_sizes(docs, width), "sizes")
    filled = sizes.where("doc_id is not null and n_shingles > 0")
    classes = saved(filled.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("n_shingles").alias("n")), "classes")
    clusters = components(_candidates(named, width, Bands(num, den))).select(F.col("id").alias("digest"), F.col("component").alias("cluster"))
    members = saved(classes.join(clusters, "digest").select("doc_id", "digest", "cluster", "n"), "clustered")
    links = _links(named, members, width, num, den)
    # Digests hang together by links and by a doc_id that several rows share.
    shared = filled.groupBy("doc_id").agg(F.min("digest").alias("b"), F.max("digest").alias("a")).where("a != b").select("doc_id", "b")
    links = links.union(filled.join(shared, "doc_id").where("digest != b").select(F.col("digest").alias("a"), "b"))
    found = components(links)
    grouped = classes.join(found, classes["digest"] == found["id"], "left").select(
        "digest", "doc_id", "rows", "component").where("rows > 1 or component is not null")
    alone = grouped.where("component is null").select("digest", F.col("doc_id").alias("component_id"))
    smallest = grouped.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named_groups = saved(alone.union(grouped.join(smallest, "component").select("digest", "component_id")), "groups")
    return sizes.join(named_groups, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(
            F.col("doc_id")).alias("component_id"), *carry)


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group stays: the one with the smallest ``doc_id``, once.

    Rows are told apart by ``doc_id`` and text, so each is judged by its own text. Of the rows of a group that have no
    ``doc_id`` one stays, too. Rows without words are in no group and stay. Keeps the columns of ``docs``.
    """
    key, nameless = free_name(docs, "_key"), F.col("_name").isNull()
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = near_duplicates(
        keyed.select(F.col(key).alias("doc_id"), "text", F.col("doc_id").cast("long").alias("_name")), width, num, den, ("_name",))
    found = saved(found.where("n_shingles > 0").select("doc_id", "component_id", "_name", nameless.alias("nameless")), "grouped")
    groups = found.groupBy("component_id", "nameless").agg(
        F.min(F.struct("_name", "doc_id")).alias("first"), F.max(F.struct("_name", "doc_id")).alias("last"))
    groups = saved(groups.where("first.doc_id != last.doc_id").select("component_id", "nameless", F.col("first.doc_id").alias("stays")), "stays")
    gone = found.join(small_side(groups, BROADCAST_ROWS), ["component_id", "nameless"]).where("doc_id != stays").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    gone, repeated = (saved(df.withColumnRenamed("doc_id", key), name) for df, name in ((gone, "gone"), (repeated, "repeated")))
    kept = keyed.join(small_side(gone, BROADCAST_ROWS), key, "left_anti")
    if repeated.take(1):
        again = kept.join(small_side(repeated, BROADCAST_ROWS), key).dropDuplicates([key])
        kept = kept.join(small_side(repeated, BROADCAST_ROWS), key, "left_anti").unionByName(again)
    return kept.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS shingle
  FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
