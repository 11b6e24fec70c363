"""Exact deduplication: a tree-merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import text_key
from .scratch import Scratch

#: A group of copies is hot when it holds over 1/HOT_GROUPS of all rows, so there are at most so many hot groups.
HOT_GROUPS = 4096
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def _digit(column, fan_in: int, j: int):
    return F.floor(column / F.lit(fan_in**j)) % fan_in


def merge_runs(runs: DataFrame, fan_in: int, rounds: int) -> DataFrame:
    """Merge runs of (digest, node, least, n, ties) until each digest has one row.

    There are fan_in ** rounds nodes. In round j each node sends a digest's row to the node that differs from it at
    most in digit j, which becomes the digit of the digest's home; so fan_in runs meet in every merge, a digest has
    at most one row in each node and a group of copies, however large, arrives as at most fan_in rows. least is the
    smallest (null id last, id, row) and ties is how many rows have that id; n is the size so far.
    """
    nodes = fan_in**rounds
    home = F.pmod(F.xxhash64("digest"), F.lit(nodes))
    merged = runs
    for j in range(rounds):
        to = F.col("node") + (_digit(home, fan_in, j) - _digit(F.col("node"), fan_in, j)) * F.lit(fan_in**j)
        merged = (
            merged.withColumn("node", to.cast("long"))
            .groupBy("node", "digest")
            .agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        )
    return merged.drop("node")


def exact_dedup(docs: DataFrame, *, fan_in: int = 8, rounds: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    Texts are equal when they are identical after every run of white space became one space; null counts as empty,
    and an empty text is a text like others. Of equal texts the row with the smallest doc_id stays; a null doc_id
    comes after all others, and of rows that tie one stays, so that each group keeps exactly one row. Other columns
    of docs are not looked at. An empty table gives an empty result. A digest is SHA-256, so equal digests stand for
    equal texts at every level of the merge.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact_dedup")
    nodes = fan_in**rounds
    rows = scratch.save(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(normalised(), 256)).alias("digest"),
            text_key().alias("text_key"),
            F.monotonically_increasing_id().alias("row"),
            F.pmod(F.spark_partition_id(), F.lit(nodes)).cast("long").alias("node"),
        ),
        "digests",
    )
    runs = rows.select(
        "digest", "node", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("least"), F.lit(1).cast("long").alias("n")
    )
    groups = scratch.save(
        merge_runs(runs, fan_in, rounds).where("n > 1").select("digest", F.col("least.doc_id").alias("keep"), F.col("least.row").alias("first"), "n"), "groups"
    )
    hot = F.broadcast(groups.where(F.col("n") > max(1000, rows.count() // HOT_GROUPS)))
    cold = groups.where(F.col("n") <= max(1000, rows.count() // HOT_GROUPS))
    members = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest", "left"), allowMissingColumns=True)
    alone = F.col("n").isNull()
    return members.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_key",
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_key")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
