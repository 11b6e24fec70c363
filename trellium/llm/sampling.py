"""Held-out rows and bounded samples of labelled ones."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def _spot(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(2**30)) / 2**30


def _shares(rows: DataFrame, label: str, bound: int) -> Column:
    """The share of each label's rows that makes about bound; the counts, one row a label, come to the driver."""
    share = F.lit(None).cast("double")
    for r in rows.groupBy(label).count().collect():
        share = F.when(F.col(label).eqNullSafe(F.lit(r[label])), F.lit(min(1.0, bound / r["count"]))).otherwise(share)
    return share


def bounded_sample(rows: DataFrame, label: str, bound: int, seed: int = 7) -> DataFrame:
    """About bound different rows of (doc_id, text, label) for each label, chosen by a hash of doc_id and text.

    All rows of a label stay where it has no more than bound.
    """
    return rows.where(_spot("doc_id", "text", F.lit(seed)) < _shares(rows, label, bound)).dropDuplicates(["doc_id", "text", label])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int = 7) -> DataFrame:
    """doc_id, text, label: the documents of about bound ids for each label, 0 and 1, chosen by a hash of the id.

    The ids are chosen from labels alone, are broadcast (about twice bound, whatever the tables hold) and pick their
    texts in one scan of docs, so no text is shuffled but the sample's. An id with labels that disagree, a null one and
    a null text teach nothing; repeated rows count once.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
    marks = marks.agg(F.min(label).cast("int").alias(label), F.max(label).cast("int").alias("_most")).where(F.col(label) == F.col("_most")).drop("_most")
    ids = marks.where(_spot("doc_id", F.lit(seed)) < _shares(marks, label, bound))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"])


def within_bytes(rows: DataFrame, column: str, most: int, seed: int = 8) -> DataFrame:
    """rows (doc_id, a binary column, others), or a share of them chosen by a hash of doc_id where the column has more bytes in all than most."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return rows if size <= most else rows.where(_spot("doc_id", F.lit(seed)) < most / size)


def learned(rows: DataFrame, column: str, most: int, fit: Callable[[list[memoryview], np.ndarray], bytes], seed: int = 8) -> bytes:
    """What fit makes of a binary column and the labels of rows (doc_id, label, column), in a fixed order.

    The rows are computed once and go to one task, which learns from those of within_bytes and holds about twice as many
    bytes at most while it reads; no file is written, and only what it has learned comes to the driver.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen, held = [], 0, 0
        size = lambda b: pc.sum(pc.binary_length(b.column(2))).as_py() or 0
        few = lambda b: b if seen <= most else b.filter(pc.less(b.column(3), most / seen))
        for b in batches:
            parts.append(b)
            seen, held = seen + size(b), held + size(b)
            if held > 2 * most:  # the share only falls, so what goes now would go at the end
                parts = list(map(few, parts))
                held = sum(map(size, parts))
        parts = [b for b in map(few, parts) if b.num_rows]
        data = [x.as_buffer() for b in parts for x in b.column(2)]
        ids, labels = (np.concatenate([np.zeros(0, np.int64), *(b.column(i).to_numpy() for b in parts)]) for i in (0, 1))
        order = sorted(range(len(data)), key=lambda i: (ids[i], zlib.crc32(data[i])))
        model = fit([memoryview(data[i]) for i in order], labels[order].astype(np.float64))
        parts.clear()
        data.clear()
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = rows.select("doc_id", "label", column, _spot("doc_id", F.lit(seed)).alias("spot")).repartition(1).mapInArrow(learn, "model binary").collect()
    return bytes(found[0].model) if found else fit([], np.zeros(0))
