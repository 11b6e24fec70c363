"""Keeping or dropping whole rows by an operator's decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bytes of rows that are broadcast at most; above, both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def text_key(text: str | Column = "text") -> Column:
    """64 bits that, with doc_id, name a row of documents; rows alike in both have equal texts."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def bounded(df: DataFrame, n: int, width: int = 16) -> DataFrame:
    """df with a broadcast hint if its n rows of width bytes, both counted before, are small; else as it is."""
    return F.broadcast(df) if n * width <= BROADCAST_BYTES else df


def keep_rows(docs: DataFrame, decisions: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs, with all their columns, that decisions keep.

    decisions: doc_id, text_key, kept; a row for each row of docs. Rows that agree in doc_id and text are told apart
    by nothing, so of those with both verdicts as many stay as were kept: one.
    """
    gone = scratch.save(
        decisions.groupBy("doc_id", "text_key").agg(F.max("kept").alias("some"), F.min("kept").alias("all")).where("not all"),
        "gone",
    )
    count = gone.agg(F.count("*"), F.count(F.when(F.col("some"), 1))).first()
    row = docs.select(F.col("doc_id").alias("_id"), text_key(docs["text"]).alias("_key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    same = lambda right: row["_id"].eqNullSafe(right["doc_id"]) & (row["_key"] == right["text_key"])
    out = row.join(small := bounded(gone, count[0]), same(small), "left_anti").select("_row.*")
    if count[1]:
        ties = bounded(gone.where("some"), count[1])
        first = Window.partitionBy("_id", "_key").orderBy(F.lit(0))
        out = out.unionByName(row.join(ties, same(ties), "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_row.*"))
    return out
