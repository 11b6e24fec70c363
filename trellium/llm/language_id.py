"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngrams import BLOCK, blocks, code_points
from .sampling import bounded_sample, fold
from .scratch import cuts, slices

ORDERS, BITS = (1, 2, 3), 16
#: Documents of each language that are learned from, about; see bounded_sample.
TRAIN_BOUND = 5_000


def gram_counts(rows: DataFrame, label: str, bits: int = BITS) -> DataFrame:
    """label, bucket, n: how often the n-grams of each bucket occur in the texts of each label."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1):
            names = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for name in set(names):
                points, begins = code_points([t for t, k in zip(texts, names) if k == name])
                own = sums.setdefault(name, np.zeros(2**bits, np.int64))
                for n in ORDERS:
                    for bucket, counts, _, _ in blocks(points, begins, n, bits, False):
                        own += np.bincount(bucket[counts], minlength=2**bits)
        for name, own in sums.items():
            hot = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(hot), pa.string()), pa.array(hot.astype(np.int32)), pa.array(own[hot])], ["label", "bucket", "n"])

    parts = rows.select(F.col(label).cast("string"), "text").mapInArrow(count, "label string, bucket int, n long")
    return parts.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, label: str, bits: int = BITS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """The labels in order and the matrix of log-probabilities, buckets by labels; its size follows from those alone."""
    found = gram_counts(rows, label, bits).toPandas()
    names = sorted(found["label"].unique())
    table = np.full((2**bits, len(names)), smoothing)
    for k, name in enumerate(names):
        own = found[found["label"] == name]
        table[own["bucket"], k] += own["n"]
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def log_likelihoods(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    points, begins = code_points(texts)
    out = np.zeros((len(texts), table.shape[1]))
    bits = len(table).bit_length() - 1
    for n in ORDERS:
        for bucket, counts, starts, of in blocks(points, begins, n, bits, False, max(1, BLOCK // max(1, table.shape[1]) * 4)):
            got = table[bucket]
            got[~counts] = 0
            out[of] += np.add.reduceat(got, starts, axis=0, dtype=np.float64)
    return out


def identify(docs: DataFrame, labelled: DataFrame, *, label: str = "lang", bound: int = TRAIN_BOUND) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs.

    The model is learned from labelled (doc_id, text and a label), about `bound` documents of each label; rows without
    text or label teach nothing. lang_pred is the label of the highest posterior under equal priors and score that
    posterior. Null texts and those without a letter (Unicode category L) are `und` with score 0, and so is every text when there was
    nothing to learn from; ties go to the first label in order. Repeated rows and null ids are rows like others, other
    columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    teach = labelled.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select("doc_id", "text", F.col(label).cast("string").alias(label))
    names, table = train(bounded_sample(teach, label, bound), label)
    model = spark.sparkContext.broadcast(table)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if names and texts:
                sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
                logs = np.concatenate([log_likelihoods(texts[a:b], model.value) for a, b in cuts(sizes)])
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                best = logs.argmax(axis=1)
                has = np.array([any(map(str.isalpha, t or "")) for t in texts])
                score = np.where(has, 1 / odds.sum(axis=1), 0.0)
                lang = [names[b] if h else "und" for b, h in zip(best, has)]
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.select("doc_id", predict("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from documents outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), docs.where(fold(3) != 1).select("doc_id", "text", "lang"))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")
