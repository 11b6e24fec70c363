"""Connected components of a distributed graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges that one task settles (16 bytes each), and that a task thins out together; beyond, all tasks work in rounds.
FEW = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and the smallest node that each can reach."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    top = np.arange(len(node))
    while True:
        one, two = top[x], top[y]
        apart = one != two
        if not apart.any():
            return node, node[top]
        np.minimum.at(top, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (top != top[top]).any():
            top = top[top]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> edges from each node to its root among so many edges of a task at a time."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        node, root = roots(*np.concatenate(held, axis=1))
        held.clear()
        apart = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(root[apart])], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1)]))
        if sum(x.shape[1] for x in held) > FEW:
            yield out()
    if held:
        yield out()


def _all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges, which are few -> node, root."""
    held = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches if b.num_rows]
    if held:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, roots(*np.concatenate(held, axis=1)))), ["node", "root"])


def _settled(edges: DataFrame) -> bool:
    """Whether each larger node (a) has one edge, and no smaller one (b) is the larger of another: all lead to roots."""
    at = edges.select(F.col("a").alias("u"), F.lit(1).alias("n")).unionByName(edges.select(F.col("b").alias("u"), F.lit(None).cast("int").alias("n")).distinct())
    return at.groupBy("u").agg(F.count("*").alias("all"), F.count("n").alias("larger")).where("larger > 0 AND all > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root for each node of edges (a, b): root is the smallest node that can be reached. Repeated edges count once.

    Each task first thins its edges to a forest. What is left is counted: up to FEW edges are settled by one task.
    More go through alternating large-star and small-star steps: each node's neighbours are linked to the smallest
    node next to it, first the larger ones, then the smaller ones, until every edge leads to a root. The number of
    rounds grows with the logarithm of the longest path. Minima are partial aggregates, so a node with very many
    neighbours costs a row for each task; nothing but a count and one truth value a round comes to the driver.
    """
    edges = scratch.save(edges.select("a", "b").where("a <> b").mapInArrow(_forests, "a long, b long"), f"cc-{name}-0")
    if edges.count() <= FEW:
        return scratch.save(edges.coalesce(1).mapInArrow(_all_of, "node long, root long"), f"cc-{name}")
    turn = 0
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        turn += 1
        edges = scratch.save(small.select("e.*").where("a <> b").distinct(), f"cc-{name}-{turn}")
        scratch.drop(f"cc-{name}-{turn - 1}")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")))
    return scratch.save(both.distinct(), f"cc-{name}")
