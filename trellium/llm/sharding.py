"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

class Feistel:
    """A permutation of range(n), made from a key: a balanced Feistel network over the next even number of bits.

    Values that fall out of range(n) go through the network again until they fall inside (cycle walking); the
    network's domain is less than four times n, so that takes fewer than four passes on average.
    """

    def __init__(self, n: int, key: int = 2024, rounds: int = 6):
        self.n, self.key, self.rounds = n, key, rounds
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))

    def _mix(self, x: np.ndarray, r: int) -> np.ndarray:
        x = x + np.uint64((self.key * 0xD1342543DE82EF95 + (r + 1) * 0xA0761D6478BD642F) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & np.uint64(2**self.half - 1)

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        low, half = np.uint64(2**self.half - 1), np.uint64(self.half)
        left, right = x >> half, x & low
        for r in range(self.rounds)[:: -1 if back else 1]:
            if back:
                left, right = right ^ self._mix(left, r), left
            else:
                left, right = right, left ^ self._mix(right, r)
        return (left << half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._pass(np.asarray(x, dtype=np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._pass(x[out], back)
        return x.astype(np.int64)

    def place(self, row) -> np.ndarray:
        """The permuted position of each row number."""
        return self._walk(row, False)

    def row(self, place) -> np.ndarray:
        """The row number at each permuted position; the inverse of place()."""
        return self._walk(place, True)


def locate(row: int, n: int, shards: int, key: int = 2024) -> tuple[int, int]:
    """Shard and slot of a row number, from the sizes alone."""
    place = int(Feistel(n, key).place([row])[0])
    return place % shards, place // shards


def row_numbers(items: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """items with a gapless row_number from 0 in the given order, and their count.

    A range-sorted table is written once; a row's number is its place in its partition plus the sizes of the
    partitions before. One pair of numbers a partition comes to the driver.
    """
    spark = items.sparkSession
    parts = max(items.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = items.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = scratch.save(ranged, "ranged").withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    before, n = {}, 0
    for part, size in sizes:
        before[part], n = n, n + size
    starts = spark.createDataFrame([(p, b) for p, b in before.items()], "_part long, _start long")  # a row for each partition
    number = F.col("_start") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    return ranged.join(F.broadcast(starts), "_part").withColumn("row_number", number).drop("_at", "_part", "_start"), n


def shard_rows(docs: DataFrame, shards: int = 24, *, key: int = 2024, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, row_number, law, shard, slot, grown_shard for each row of docs.

    Rows are numbered from 0 by (doc_id, text_crc32, size), nulls first; a keyed permutation of those numbers deals
    them out, so shard and slot of any row follow from its number, the row count and the key. Law `rows`: the
    shards' row counts are at most one apart and slots are gapless from 0. size is the text's UTF-8 bytes plus 8; a
    null text has size 8 and the checksum of an empty one. Repeated rows are rows like others: rows that tie in all
    three columns may take each other's numbers, which changes no value of the result. Other columns are ignored;
    an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    items = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = row_numbers(items, ["doc_id", "text_crc32", "size"], scratch)
    network = Feistel(max(n, 1), key)

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(network.place(rows.to_numpy()))

    at = numbered.withColumn("_place", place("row_number"))
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 24)
