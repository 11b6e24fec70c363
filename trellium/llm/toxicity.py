"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngrams import alnum_table, blocks, code_points
from .sampling import fold, labelled_sample, learned
from .scratch import cuts, slices

ORDERS, BITS, WIDTH = (3, 4, 5), 18, 8
#: Documents of each label that are learned from, about, and bytes of their subwords; see labelled_sample and within_bytes.
TRAIN_BOUND, TRAIN_BYTES = 4_000, 192 << 20
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.05, 1e-6
#: Subwords of embedding zero that count in every average, so that a handful of them decides little.
PRIOR = 60


def bags(rows: DataFrame, label: str, bits: int = BITS) -> DataFrame:
    """doc_id, label, bag: the subwords of each text, as bytes of int32 buckets and then uint16 counts, 65,535 at most."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = alnum_table()
        for batch in slices(batches, 2):
            bag = []
            for text in batch.column(2).to_pylist():
                points, begins = code_points([text], table)
                all_of = [b[c] for n in ORDERS for b, c, _, _ in blocks(points, begins, n, bits, True)]
                bucket, count = np.unique(np.concatenate(all_of), return_counts=True)
                bag.append(bucket.astype("<i4").tobytes() + np.minimum(count, 65_535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bag, pa.binary())], ["doc_id", "label", "bag"])

    return rows.select(F.col("doc_id").cast("long"), F.col(label).cast("int"), "text").mapInArrow(take, "doc_id long, label int, bag binary")


def opened(bag: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a bag, as views."""
    n = len(bag) // 6
    return np.frombuffer(bag, "<i4", n), np.frombuffer(bag, "<u2", n, 4 * n)


def train(bag: list[memoryview], labels: np.ndarray, bits: int = BITS, seed: int = 11) -> tuple[np.ndarray, float]:
    """Fit subword vectors and a softmax over their average together; the logit of each subword and the bias.

    Softmax of two classes is a logistic on the difference of their weights, so E (subwords by WIDTH) and one weight
    vector w are fitted; the result is E @ w, as the average of embeddings times w is the average of that.
    """
    rng = np.random.default_rng(seed)
    size = 2**bits
    embed = (rng.standard_normal((size, WIDTH)) * 0.05).astype(np.float32)
    weight = rng.standard_normal(WIDTH).astype(np.float32)
    bias, step = np.float32(0), 0
    moments = [np.zeros_like(embed), np.zeros((size, 1), np.float32), np.zeros_like(weight), np.zeros_like(weight)]
    scale = np.float32(40)  # an average over a whole document is small
    for _ in range(EPOCHS):
        order = rng.permutation(len(bag))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            own = [opened(bag[r]) for r in rows]
            of = np.repeat(np.arange(len(rows)), [len(b) for b, _ in own])
            bucket = np.concatenate([b for b, _ in own])
            part = np.concatenate([c / (c.sum(dtype=np.int64) + PRIOR) for _, c in own]).astype(np.float32) * scale
            used, slot = np.unique(bucket, return_inverse=True)
            logit = np.bincount(of, weights=part * (embed[used] @ weight)[slot], minlength=len(rows)) + bias
            error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - labels[rows]).astype(np.float32) / len(rows)
            pull = np.bincount(slot, weights=part * error[of], minlength=len(used)).astype(np.float32)
            grad_w = embed[used].T @ pull
            grad_e = pull[:, None] * weight[None, :] + DECAY * embed[used]
            step += 1
            warm = np.float32(np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            moments[0][used] = 0.9 * moments[0][used] + 0.1 * grad_e
            moments[1][used] = 0.999 * moments[1][used] + 0.001 * (grad_e**2).mean(axis=1, keepdims=True)
            embed[used] -= RATE * warm * moments[0][used] / (np.sqrt(moments[1][used]) + 1e-8)
            moments[2] = 0.9 * moments[2] + 0.1 * grad_w
            moments[3] = 0.999 * moments[3] + 0.001 * grad_w**2
            weight -= RATE * warm * moments[2] / (np.sqrt(moments[3]) + 1e-8)
            bias -= np.float32(0.5) * error.sum()
    return ((embed @ weight) * scale).astype(np.float32), float(bias)


def logits(texts: list[str | None], subwords: np.ndarray, bias: float, table: np.ndarray) -> np.ndarray:
    points, begins = code_points(texts, table)
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    bits = len(subwords).bit_length() - 1
    for n in ORDERS:
        for bucket, counts, starts, of in blocks(points, begins, n, bits, True):
            total[of] += np.add.reduceat(np.where(counts, subwords[bucket], 0), starts, dtype=np.float64)
            number[of] += np.add.reduceat(counts, starts, dtype=np.int64)
    return total / (number + PRIOR) + bias


def toxicity_model(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", bound: int = TRAIN_BOUND, most: int = TRAIN_BYTES):
    """A function from a column of texts to their toxicity, from 0 to 1.

    It is learned from docs (doc_id, text) whose id has a label 0 or 1 in labels (doc_id, label), about `bound`
    documents of each label and at most about `most` bytes of subwords in all; rows without text or label, and ids
    whose labels disagree, teach nothing, and rows that repeat count once. Null and empty texts, and those without a
    letter or digit, get the score of an empty bag. With no rows to learn from, or of one label only, every score is
    that label's share, 0 without any. Other columns are ignored.
    """
    spark = docs.sparkSession

    def fit(bag: list[memoryview], truth: np.ndarray) -> bytes:
        if len(set(truth)) == 2:
            return pickle.dumps(train(bag, truth.astype(np.float32)))
        return pickle.dumps((np.zeros(2**BITS, np.float32), 30.0 if truth.any() else -30.0))

    subwords, bias = pickle.loads(learned(bags(labelled_sample(docs, labels, label, bound), label), "bag", most, fit))
    model = spark.sparkContext.broadcast((subwords, bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = alnum_table()
        for texts in batches:
            texts = texts.tolist()
            got = np.zeros(len(texts))
            for a, b in cuts(np.fromiter((len(t or "") for t in texts), np.int64, len(texts))):
                got[a:b] = logits(texts[a:b], *model.value, table)
            yield pd.Series(1 / (1 + np.exp(-np.clip(got, -30, 30))))

    return score


def teaching(labels: DataFrame) -> DataFrame:
    """The rows of labels that may teach in the registered queries: those whose fold of five is not 0."""
    return labels.where(fold(5) != 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; learned from labels outside the held-out fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    score = toxicity_model(docs, teaching(labels))
    out = docs.select("doc_id", (fold(5) == 0).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
