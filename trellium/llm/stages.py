"""The operators as stages: each takes (spark, docs, sf_dir), and what it decides takes effect on docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contamination
from .exact_dedup import exact_dedup
from .near_dedup import near_duplicates
from .packing import pack_documents
from .rows import keep_rows
from .scratch import Scratch
from .toxicity import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the classifier gives less than 0.5; it is learned from the labelled ones among docs.

    A null or empty text has the score of an empty bag. Rows that repeat go or stay together; ids may be null; other
    columns are kept as they are. An empty table gives an empty result.
    """
    score = toxicity_model(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    return row.where(score(F.col("_row")["text"]) < 0.5).select("_row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space, the one with the smallest doc_id.

    Null counts as empty, so one row of these stays; a null doc_id comes after all others. Of rows that agree in
    doc_id and text one stays. Other columns are kept as they are; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "drop_copies")
    return keep_rows(docs, exact_dedup(docs, scratch=scratch), scratch)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 75 % of five-word shingles connect, the row with the smallest doc_id.

    Rows without words are linked with nothing and all stay; a null doc_id comes after all others. Of rows that agree
    in doc_id and text one stays. Other columns are kept as they are; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "drop_near_copies")
    return keep_rows(docs, near_duplicates(docs, scratch=scratch), scratch)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs in which no window of ten words of a benchmark item occurs, nor a whole shorter item.

    Null and empty texts stay, and everything does with an empty benchmark. Rows that repeat go or stay together;
    ids may be null; other columns are kept as they are. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "drop_contaminated")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch=scratch)
    return keep_rows(docs, found.withColumn("kept", ~F.col("contaminated")), scratch)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences of at most 2,048 tokens, a row a piece; see pack_documents.

    A null text is empty, which is one token. Rows that repeat are packed each; other columns are dropped. An empty
    table gives an empty result.
    """
    return pack_documents(docs, scratch=Scratch(spark, "pack"))
