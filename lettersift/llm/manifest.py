"""A Merkle manifest of a data set: every row's proof against one root, by butterfly exchange.

The leaves of a source stand in order in blocks of 256. Each block hashes its own two levels. Then blocks meet round
by round: in round r, the up to 16 blocks that differ only in the r-th digit (base 16) of their number swap the roots of
the 16^r blocks each stands for, and every one of them hashes their common ancestor itself. After the last round each
block holds the root of its source and all siblings on the way to it; nothing is sent back down a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, saved, shuffle_parts, with_row_id

FANOUT = 16
BLOCK_LEVELS = 2
BLOCK = FANOUT**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left:string,right:string>"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each as ``-`` if null, else its number of UTF-8 bytes, ``:`` and its text."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _parents(nodes: Column) -> Column:
    """The hashes of every 16 consecutive nodes."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(chunks, lambda i: F.sha2(_joined(F.slice(nodes, i * FANOUT + 1, FANOUT)), 256))


def _nodes(n: Column, level: int) -> Column:
    """How many nodes ``n`` leaves have at a level."""
    return F.ceil(n / FANOUT**level)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``position`` (from 0, in the order of the other columns within ``group``) and ``n``, the size of the group.

    Rows are dealt into ranges of the whole order, so that a large group is cut into many; each range is numbered
    by itself, and starts after the ranges before it.
    """
    keys = ["group", *order]
    dealt = rows.repartitionByRange(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = saved(with_row_id(dealt, "_at"), "ordered").withColumn("_range", F.shiftrightunsigned("_at", 33))
    runs = dealt.groupBy("group", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "group", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy("group")).alias("n"))
    position = F.col("_at") - F.col("_first") + F.col("_start")
    return dealt.join(runs, ["group", "_range"]).select(*rows.columns, position.alias("position"), "n")


def _blocks(rows: DataFrame) -> DataFrame:
    """``(group, block, n, items, level0, level1, ..., node)``: the blocks with their own levels, ``node`` on top."""
    item = F.struct("position", "node", "row")
    blocks = rows.withColumn("block", F.floor(F.col("position") / BLOCK)).groupBy("group", "block").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    blocks = blocks.withColumn("level0", F.transform("items", lambda x: x.node))
    for level in range(BLOCK_LEVELS):
        below = F.col(f"level{level}")
        blocks = blocks.withColumn(f"level{level + 1}", F.when(_nodes(F.col("n"), level) > 1, _parents(below)).otherwise(below))
    return blocks.withColumn("node", F.element_at(f"level{BLOCK_LEVELS}", 1)).drop(f"level{BLOCK_LEVELS}")


def _exchange(rows: DataFrame, turn: int) -> DataFrame:
    """One round: blocks that stand for neighbouring nodes swap them and hash the parent.

    A block meets those with its own number inside their node. The last node of a group may have fewer blocks than
    its neighbours; these then send to several numbers, so that every block meets each neighbour once.
    """
    size = FANOUT**turn
    held = _nodes(F.col("n"), BLOCK_LEVELS)
    place, lane = F.floor(F.col("block") / size), F.pmod(F.col("block"), F.lit(size))
    holders = F.least(F.lit(size), held - place * size)
    lanes = F.when(F.pmod(place, F.lit(FANOUT)) > 0, F.sequence(lane, F.lit(size - 1).cast("long"), holders)).otherwise(F.array(lane))
    sent = rows.withColumn("_place", place).withColumn("_lane", F.explode(lanes))
    meeting = Window.partitionBy("group", F.floor(F.col("_place") / FANOUT), "_lane")
    met = sent.withColumn("_met", F.sort_array(F.collect_list(F.struct("_place", "node")).over(meeting)))
    met = met.where(F.col("_lane") == lane)

    def side(test) -> Column:
        return _joined(F.transform(F.filter("_met", test), lambda m: m.node))

    met = met.withColumn("_step", F.struct(
        side(lambda m: m["_place"] < F.col("_place")).alias("left"), side(lambda m: m["_place"] > F.col("_place")).alias("right")))
    more = F.ceil(held / size) > 1
    parent = F.sha2(F.concat("_step.left", "node", "_step.right"), 256)
    return met.select(
        "group", "block", "n", F.when(more, parent).otherwise(F.col("node")).alias("node"),
        F.when(more, F.array_append("proof", F.col("_step"))).otherwise(F.col("proof")).alias("proof"))


def _tree(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The blocks of ``rows (group, node, row, ...)`` and, by ``group`` and ``block``, the root and the upper proof."""
    blocks = saved(_blocks(_numbered(rows, order)), "blocks")
    tops = blocks.select("group", "block", "n", "node", F.array().cast(f"array<{_STEP}>").alias("proof"))
    largest = blocks.agg(F.max("n")).first()[0] or 0
    turn, nodes = 0, -(-largest // BLOCK)
    while nodes > 1:
        tops, turn, nodes = _exchange(tops, turn), turn + 1, -(-nodes // FANOUT)
    return blocks.drop("node"), saved(tops, "tops")


def _local_proof(at: Column, n: Column, levels: list[Column]) -> Column:
    """Siblings of the item at a place of its block, in the levels of the block that have more than one node."""
    steps = []
    for level, nodes in enumerate(levels):
        own = F.floor(at / FANOUT**level).cast("int")
        first = F.floor(own / FANOUT).cast("int") * FANOUT
        step = F.struct(
            _joined(F.slice(nodes, first + 1, own - first)).alias("left"),
            _joined(F.slice(nodes, own + 2, first + FANOUT - own - 1)).alias("right"))
        steps.append(F.when(_nodes(n, level) > 1, F.array(step)).otherwise(F.array().cast(f"array<{_STEP}>")))
    return F.concat(*steps)


def _expanded(blocks: DataFrame, tops: DataFrame) -> DataFrame:
    """A row per item with its whole proof: own levels of the block, then what the block's row in ``tops`` has."""
    levels = [f"level{i}" for i in range(BLOCK_LEVELS)]
    rows = blocks.join(tops.drop("n"), ["group", "block"]).select("*", F.explode("items").alias("_item")).drop("items")
    at = F.pmod(F.col("_item.position"), F.lit(BLOCK)).cast("int")
    proof = F.concat(_local_proof(at, F.col("n"), [F.col(c) for c in levels]), F.col("proof"))
    return rows.withColumn("proof", proof).drop(*levels)


def folded(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step.left, node, step.right), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return _joined(F.transform(proof, lambda step: F.concat(step.left, step.right)))


def manifest(docs: DataFrame, carry: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of each row with ``leaf``, ``subroot``, ``root`` and ``proof``.

    A leaf hashes doc_id, source, lang, n_chars and text. Per source, leaves stand by doc_id (null first; equal ids
    by leaf, so that repeated rows have neighbouring places) and every 16 consecutive nodes are hashed until one is left,
    the subroot; subroots by source (null first, by bytes) are hashed alike and give the root. ``proof`` lists from
    the leaf upwards what stands left and right of the node among its siblings; levels of one node have no entry.

    One row per input row. A lone leaf is its subroot, a lone subroot the root, and their proofs are empty. Missing values
    hash as ``-``, empty ones as ``0:``. Other columns are ignored; an empty table gives no rows. A block row holds
    256 leaves; a source of any size is cut into ranges of rows, then into blocks. Proofs are made last
    and not stored.
    """
    rows = docs.select(
        F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("group"),
        F.col("doc_id").alias("_id"), leaf_hash(*[F.col(c) for c in FIELDS]).alias("node"),
        F.struct(*[F.col(c) for c in carry]).alias("row"))
    # Hashed and numbered once; the number only splits equal rows.
    rows = saved(with_row_id(rows, "_tie"), "leaves")
    blocks, tops = _tree(rows, ["_id", "node", "_tie"])
    sources = tops.where("block = 0").select(
        F.lit("").alias("group"), F.col("group").alias("_source"), "node", F.struct(F.col("group").alias("source"), "n").alias("row"))
    above = _expanded(*_tree(sources, ["_source"])).select(
        F.col("_item.row.source").alias("group"), _nodes(F.col("_item.row.n"), BLOCK_LEVELS).alias("_blocks"),
        F.col("node").alias("root"), F.col("proof").alias("_above"))
    above = saved(above, "sources")
    held = join_groups(tops, above, ["group"], "_blocks", tops.count())
    held = held.select(
        "group", "block", "n", F.col("node").alias("subroot"), "root", F.concat("proof", "_above").alias("proof"))
    return _expanded(blocks, held).select("_item.row.*", F.col("_item.node").alias("leaf"), "subroot", "root", "proof")



# Levels that the SQL spells out: enough for 16^6 leaves a source.
_SQL_LEVELS = 6
# CRC-32 of a text of digits: for each byte, one step that mixes it in and eight that shift.
_SQL_CRC = """xor(list_reduce(
    list_prepend(4294967295, flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(doc_id::VARCHAR, '')])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""


def _sql_part(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"


def _sql_tree(rows: str, out: str) -> str:
    """CTEs over ``rows (grp, pos, h)``: ``out`` gives the root of each group and, by position, the siblings of each level."""
    ctes = [f"{out}0 AS (SELECT grp, pos, h, count(*) OVER (PARTITION BY grp) AS c FROM {rows})"]
    for k in range(_SQL_LEVELS):
        ctes.append(
            f"{out}{k + 1} AS (SELECT grp, pos, h, count(*) OVER (PARTITION BY grp) AS c FROM ("
            f"SELECT grp, pos // 16 AS pos, CASE WHEN max(c) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h "
            f"FROM {out}{k} GROUP BY grp, pos // 16))")
        ctes.append(
            f"{out}_s{k} AS (SELECT a.grp, a.pos, max(a.c) > 1 AS more, "
            f"coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, "
            f"coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r "
            f"FROM {out}{k} a JOIN {out}{k} b ON a.grp = b.grp AND a.pos // 16 = b.pos // 16 GROUP BY a.grp, a.pos)")
    return ",\n".join(ctes)


def _sql_steps(start: str, out: str, side: str, other: list[str]) -> str:
    """Walk up the levels of a tree: concatenates siblings in ``proof`` and folds ``f``."""
    ctes, before = [], start
    for k in range(_SQL_LEVELS):
        name = f"{out}_w{k}"
        ctes.append(
            f"{name} AS (SELECT {', '.join('w.' + c for c in other)}, w.pos // 16 AS pos, w.grp, "
            f"w.proof || CASE WHEN s.more THEN s.l || s.r ELSE '' END AS proof, "
            f"CASE WHEN s.more THEN sha256(s.l || w.f || s.r) ELSE w.f END AS f "
            f"FROM {before} w JOIN {side}_s{k} s ON s.grp = w.grp AND s.pos = w.pos)")
        before = name
    return ",\n".join(ctes)


_KEEP = ["doc_id", "leaf", "source_key"]
ORACLE = f"""
WITH d AS (
  SELECT *, coalesce('1' || source, '0') AS source_key, {_SQL_CRC} % 5 = 0 AS tamper,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
e AS (
  SELECT *, sha256({" || ".join(_sql_part(c) for c in FIELDS)}) AS leaf,
    sha256({" || ".join(_sql_part(c) for c in (*FIELDS[:-1], "low"))}) AS other FROM d),
leaves AS (
  SELECT doc_id, source_key, leaf, CASE WHEN tamper THEN other ELSE leaf END AS f, source_key AS grp, leaf AS h, '' AS proof,
    row_number() OVER (PARTITION BY source_key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM e),
{_sql_tree("leaves", "a")},
{_sql_steps("leaves", "a", "a", _KEEP)},
tops AS (SELECT '' AS grp, grp AS source_key, h, row_number() OVER (ORDER BY grp) - 1 AS pos FROM a{_SQL_LEVELS}),
{_sql_tree("tops", "b")},
upper AS (
  SELECT w.doc_id, w.leaf, w.source_key, t.h AS subroot, w.proof, w.f, t.grp, t.pos
  FROM a_w{_SQL_LEVELS - 1} w JOIN tops t USING (source_key)),
{_sql_steps("upper", "b", "b", [*_KEEP, "subroot"])}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
FROM b_w{_SQL_LEVELS - 1} JOIN b{_SQL_LEVELS} r USING (grp)"""
