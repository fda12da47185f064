"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MAX_ROUNDS = 100
# Links that one task contracts at once, and the least number of tasks.
TASK_LINKS = 100_000
LEAST_TASKS = 4
HELD_LINKS = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest one it is connected with by these links, itself left out."""
    nodes, places = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = places[: len(u)], places[len(u):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        # The labels themselves are led down, too, so that whole trees move at once.
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(after, ends, least)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    led = label != np.arange(len(nodes))
    return nodes[led], nodes[label[led]]


def _contracted(edges: DataFrame, rows: int) -> DataFrame:
    """The links of each task as stars: the components stay, and no two links of a task say the same."""
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def star() -> pa.RecordBatch:
            u, v = forest(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held[:] = []
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(u) for u, _ in held) >= HELD_LINKS:
                yield star()
        if held:
            yield star()

    return edges.coalesce(max(LEAST_TASKS, rows // TASK_LINKS)).mapInArrow(contract, "u long, v long")


def _is_star(edges: DataFrame) -> bool:
    """Whether each node has one link and what it leads to has none."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")),
        F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root")))))
    ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return not ends.where("up > 1 or up > 0 and root > 0").take(1)


def components(links: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id that each id of ``links (a, b)`` reaches.

    Every task first replaces the links it holds by stars. Then two steps alternate: each node hands its larger neighbours
    to its smallest one, then its smaller neighbours; after both, tasks contract their links again. Every step keeps the
    components and a node's links are aggregated, never collected. It ends when all links form stars. Rounds
    grow with the logarithm of the longest chain. Each round is written to the shared folder. Links of a node to itself and
    nulls are ignored; no links give no rows.
    """
    edges = links.select(
        F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v")
    edges = saved(edges, "links")
    rows = edges.count()
    edges = saved(_contracted(edges, rows), "links")
    for _ in range(MAX_ROUNDS):
        if _is_star(edges):
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # The node itself hangs on its smallest neighbour.
        large = large.union(smallest.where("m < u").select("u", F.col("m").alias("v"))).where("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = saved(_contracted(small.union(least.select("u", F.col("m").alias("v"))), rows), "links")
        rows = edges.count()
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
