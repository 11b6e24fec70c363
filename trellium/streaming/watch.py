"""Keeping a store up to date from a stream of changes."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store, collect_garbage, connected_edges, upsert_edges, upsert_nodes
from ..sources.base import Subscription

#: Operations on a path, as bits.
CREATE, WRITE, REMOVE, RENAME = 1, 2, 4, 8
CHANGES = "path STRING, op INT, ts TIMESTAMP, text STRING"


def coalesced(changes: DataFrame) -> DataFrame:
    """path, ops, ts, text: one row for each path of a batch, its operations together and its latest text."""
    return changes.groupBy("path").agg(F.bit_or("op").alias("ops"), F.max("ts").alias("ts"), F.max_by("text", "ts").alias("text"))


def routed(events: DataFrame, subscriptions: dict[str, Subscription]) -> DataFrame:
    """events, a row for each subscriber that wants it."""
    wants = F.filter(F.array(*[F.when(s.test(), F.lit(n)) for n, s in subscriptions.items()]), lambda x: x.isNotNull())
    return events.withColumn("subscriber", F.explode(wants))


class Watcher:
    """Applies batches of changes: removed paths go with all below them, others are indexed anew and upserted.

    One micro-batch is one quiet period. Every batch is a generation; a batch that is run again writes the same rows.
    index turns (changes, generation) into nodes and edges. Expired rows are collected every gc_seconds, None never.
    """

    def __init__(self, store: Store, index: Callable[[DataFrame, str], tuple[DataFrame, DataFrame]], gc_seconds: float | None = 300, on_batch: Callable[[str], None] | None = None):
        self.store, self.index, self.gc_seconds, self.on_batch = store, index, gc_seconds, on_batch
        self.collected = time.monotonic()

    def apply(self, changes: DataFrame, batch: int) -> None:
        generation = f"batch-{batch}"
        rows = coalesced(changes).persist()
        gone = rows.where(F.col("ops").bitwiseAND(F.lit(REMOVE | RENAME)) > 0).select(F.concat(F.lit("file://"), "path").alias("_uri"))
        nodes, edges = self.store.read("nodes"), self.store.read("edges")
        below = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(F.split("uri", "/"))), lambda i: F.array_join(F.slice(F.split("uri", "/"), F.lit(1), i), "/")))
        hit = nodes.where("uri IS NOT NULL").select("id", F.explode(below).alias("_uri")).join(gone, "_uri", "left_semi").select("id").distinct()
        nodes = nodes.join(hit, "id", "left_anti").select(*nodes.columns)
        new = rows.where((F.col("ops").bitwiseAND(F.lit(CREATE | WRITE)) > 0) & F.col("text").isNotNull())
        new_nodes, new_edges = self.index(new, generation)
        nodes = upsert_nodes(nodes, new_nodes)
        edges = upsert_edges(edges, new_edges)
        if self.gc_seconds is not None and time.monotonic() - self.collected >= self.gc_seconds:
            nodes, edges = collect_garbage(nodes, edges)
            self.collected = time.monotonic()
        self.store.write("nodes", nodes)
        self.store.write("edges", connected_edges(self.store.read("nodes"), edges))
        rows.unpersist()
        if self.on_batch:
            self.on_batch(generation)

    def start(self, changes: DataFrame, checkpoint: str, quiet: str = "150 milliseconds", once: bool = False) -> StreamingQuery:
        """Run over a stream of CHANGES; once takes what is there and ends."""
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=quiet)).start()
