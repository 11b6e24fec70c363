"""Similarity search over embeddings."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, embedding_text
from .filters import NodeFilter

#: Node types that are embedded, and texts a provider gets at once (fixed values).
EMBEDDED = ("go:func", "go:struct", "go:interface", "md:section", "md:document", "vcs:commit")
BATCH = 32


class Provider(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class NullProvider:
    """Vectors of zeros."""

    name, dimensions = "null", 384

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.zeros((len(texts), self.dimensions), np.float32)


class HashingProvider:
    """Signed hashes of words; needs nothing but itself, and is the same everywhere."""

    name = "hashing"

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class HttpProvider:
    """A server that answers {model, input} at /api/embed with embeddings, one for each input; a batch is one request."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "nomic-embed-text", dimensions: int = 768, timeout: float = 60):
        self.url, self.model, self.dimensions, self.timeout, self.name = url.rstrip("/"), model, dimensions, timeout, f"http/{model}"

    def embed(self, texts: list[str]) -> np.ndarray:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            got = json.load(answer).get("embeddings", [])
        if len(got) != len(texts):
            raise ValueError(f"{len(texts)} texts got {len(got)} embeddings")
        return np.asarray(got, np.float32).reshape(len(texts), -1)


def embed_nodes(nodes: DataFrame, provider: Provider, generation: str | None = None, types: Sequence[str] = EMBEDDED) -> DataFrame:
    """node_id, embedding of the nodes of those types, of one generation or all; batches that fail are left out."""
    rows = nodes.where(F.col("type").isin(list(types)))
    rows = rows if generation is None else rows.where(F.col("generation") == generation)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at in range(0, len(df), BATCH):
                part = df.iloc[at : at + BATCH]
                try:
                    got = provider.embed(part["text"].tolist())
                except Exception:  # the rest of the table is worth having
                    continue
                yield pd.DataFrame({"node_id": part["id"], "embedding": list(np.asarray(got, np.float32))})

    return rows.select("id", embedding_text().alias("text")).mapInPandas(run, "node_id string, embedding array<float>")


def find_similar(embeddings: DataFrame, vector: Sequence[float], limit: int = 0, nodes: DataFrame | None = None, where: NodeFilter | None = None) -> DataFrame:
    """node_id, score (float32) in order of cosine similarity; nodes that are not there, or filtered, go before the cut."""
    literal = F.array(*[F.lit(float(x)) for x in vector])
    rows = embeddings
    if nodes is not None:
        kept = where.apply(nodes, by_data_ext=True) if where else nodes
        rows = rows.join(kept.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    out = rows.select("node_id", cosine("embedding", literal).cast("float").alias("score")).orderBy(F.desc("score"), "node_id")
    return out.limit(limit) if limit else out


def search(embeddings: DataFrame, vectors: Sequence[tuple[str, Sequence[float]]], limit: int = 20, nodes: DataFrame | None = None, where: NodeFilter | None = None, min_score: float | None = None) -> DataFrame:
    """node_id, score, query: the best of each query's top nodes, each node with the query it fits best.

    vectors are a few (name, vector) pairs, so they are literals next to every row; the top of each query is a partial
    top of every task first. min_score is tested after the cut.
    """
    names = F.array(*[F.struct(F.lit(q).alias("query"), F.array(*[F.lit(float(x)) for x in v]).alias("vector")) for q, v in vectors])
    rows = embeddings
    if nodes is not None:
        kept = where.apply(nodes, by_data_ext=True) if where else nodes
        rows = rows.join(kept.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    scored = rows.select("node_id", "embedding", F.explode(names).alias("q")).select("node_id", "q.query", cosine("embedding", "q.vector").cast("float").alias("score"))
    tops = Window.partitionBy("query").orderBy(F.desc("score"), "node_id")
    best = scored.withColumn("_n", F.row_number().over(tops)).where(F.col("_n") <= limit)
    best = best.groupBy("node_id").agg(F.max("score").alias("score"), F.max_by("query", F.struct("score", "query")).alias("query"))
    out = best.orderBy(F.desc("score"), "node_id").limit(limit)
    return out if min_score is None else out.where(F.col("score") >= min_score)
