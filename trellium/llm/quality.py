"""Document quality: attention-based multiple-instance learning over passages."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import fold, labelled_sample, learned
from .scratch import cuts, slices
from .toxicity import teaching

#: Words of a passage; documents of each label that are learned from, about, and bytes of their passages; see
#: labelled_sample and within_bytes.
PASSAGE, TRAIN_BOUND, TRAIN_BYTES = 48, 2_000, 64 << 20
HIDDEN, ATTEND = 12, 8
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 4e-4
#: Kinds of bytes whose share is a feature of a passage.
KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!?", "|<>{}[]\\/=_", "#$%&*@~^+", "\"'()-`", "\n\r", "\t\f\v"]
#: Features by which words are hashed, each with a sign.
WORDS = 64
FEATURES = len(KINDS) + 8 + WORDS
#: Bytes of text whose passages are worked out at once, and of these the bytes whose hashes are, as each takes some 50.
TEXT, BLOCK = 256 << 10, 64 << 10


def _kinds() -> np.ndarray:
    table = np.full(256, len(KINDS), np.uint8)  # spaces and controls
    for k, chars in enumerate(KINDS):
        table[np.frombuffer(chars.encode(), np.uint8)] = k
    table[128:] = len(KINDS) + 1
    return table


def _words(data: np.ndarray, white: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every word, which begin where begin says."""
    power = np.cumprod(np.full(256, 0x01000193, np.uint64))
    spread = np.zeros(len(begin), np.uint64)
    for a in range(int(begin[0]), len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        i, j = np.searchsorted(begin, a, side="right") - 1, np.searchsorted(begin, b)
        edges = np.maximum(begin[i:j], a)
        place = np.arange(a, b) - np.repeat(begin[i:j], np.diff(np.append(edges, b)))
        spread[i:j] += np.add.reduceat(np.where(white[a:b], 0, data[a:b].astype(np.uint64) + 1) * power[place % 256], edges - a)
    return (spread * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The features of every passage, its bytes, words and their repetition, and how many passages each text has.

    An empty text has one, of zeros. A passage is PASSAGE words between white space, the last of a text may be shorter.
    A text's features are the same whatever texts it is worked out with.
    """
    kinds = _kinds()
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b"  ", np.uint8)
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    white = (data == 32) | ((data >= 9) & (data <= 13))
    begin = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    end = np.flatnonzero(white & np.concatenate([[False], ~white[:-1]]))
    last = np.cumsum(sizes)
    of = np.searchsorted(last, begin, side="right")
    words = np.bincount(of, minlength=len(raw))
    first = np.cumsum(words) - words
    number = np.maximum(1, -(-words // PASSAGE))
    if not len(begin):
        return np.zeros((int(number.sum()), FEATURES), np.float32), number
    passage = (np.cumsum(number) - number)[of] + (np.arange(len(begin)) - first[of]) // PASSAGE
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    at = passage[starts]
    out = np.zeros((int(number.sum()), FEATURES), np.float32)
    count = np.diff(np.append(starts, len(begin))).astype(np.float32)
    edges = begin[starts]
    stops = np.minimum(np.append(edges[1:], len(data)), last[of[starts]])  # not in the white space before the next text
    length = (stops - edges).astype(np.float32)
    kind, between = kinds[data], np.stack([edges, stops], axis=1).ravel()
    for k in range(len(KINDS) + 2):
        if k != len(KINDS):
            out[at, k if k < len(KINDS) else k - 1] = np.add.reduceat(kind == k, between, dtype=np.int64)[::2] / length
    # Words by a hash of their bytes: how many repeat the one before, or an earlier one of the passage.
    word = _words(data, white, begin)
    same = lambda lag: np.concatenate([np.zeros(lag, bool), (word[lag:] == word[:-lag]) & (passage[lag:] == passage[:-lag])]) if len(word) > lag else np.zeros(len(word), bool)
    base = len(KINDS) + 1
    for lag in (1, 2):
        out[at, base + lag - 1] = np.add.reduceat(same(lag), starts, dtype=np.int64) / count
    different = np.unique((passage.astype(np.uint64) << np.uint64(32)) | (word & np.uint64(0xFFFFFFFF))) >> np.uint64(32)
    out[at, base + 2] = np.bincount(different.astype(np.int64), minlength=len(out))[at] / count
    size = (end - begin).astype(np.float32)
    mean = np.add.reduceat(size, starts) / count
    out[at, base + 3] = mean / 8
    out[at, base + 4] = np.sqrt(np.maximum(np.add.reduceat(size**2, starts) / count - mean**2, 0)) / 8
    out[at, base + 5] = np.add.reduceat(size == 1, starts, dtype=np.int64) / count
    out[at, base + 6] = count / PASSAGE
    # What words a passage has: signed counts by hash, over the root of their number.
    slot, sign = (word >> np.uint64(8)).astype(np.int64) % WORDS, np.where(word & np.uint64(64), 1.0, -1.0)
    bag = np.bincount(passage * WORDS + slot, weights=sign, minlength=len(out) * WORDS).reshape(-1, WORDS)[at]
    out[at, base + 7 :] = bag / np.sqrt(count)[:, None]
    return out, number


class GatedAttention:
    """Passages x: h = tanh(x E), attention softmax(((h V tanh) * (h U sigmoid)) w), score sigmoid(sum of a h . c + b)."""

    def __init__(self, features: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.mean, self.spread = np.zeros(features), np.ones(features)
        self.p = {"E": draw(features, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTEND), "U": draw(HIDDEN, ATTEND), "w": draw(ATTEND), "c": draw(HIDDEN), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, number: np.ndarray):
        p, starts = self.p, np.cumsum(number) - number
        of = np.repeat(np.arange(len(number)), number)
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, starts)[of])
        a = s / np.add.reduceat(s, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return score, (x, of, starts, h, t, g, a, z)

    def scores(self, texts: pa.Array) -> pa.Array:
        """The score of every text; TEXT bytes of them at once leave Arrow and are worked out."""
        got = np.zeros(len(texts))
        for a, b in cuts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), size=TEXT):
            got[a:b] = self.forward(*passages(texts.slice(a, b - a).to_pylist()))[0]
        return pa.array(got)

    def gradients(self, error: np.ndarray, kept) -> dict[str, np.ndarray]:
        p = self.p
        x, of, starts, h, t, g, a, z = kept
        dz = error[:, None] * p["c"]
        da = (dz[of] * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, starts)[of])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ error, "b": error.sum(keepdims=True)}

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> GatedAttention:
        rng, step = np.random.default_rng(seed), 0
        passages, sums = sum(map(len, docs)), sum(d.sum(axis=0, dtype=np.float64) for d in docs)
        self.mean = sums / passages
        self.spread = np.sqrt(sum(((d - self.mean) ** 2).sum(axis=0) for d in docs) / passages) + 1e-3
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                score, kept = self.forward(np.concatenate([docs[r] for r in rows]), np.array([len(docs[r]) for r in rows]))
                step += 1
                for k, grad in self.gradients((score - labels[rows]) / len(rows), kept).items():
                    one, two = m[k]
                    if k not in "eb":
                        grad = grad + DECAY * self.p[k]
                    one += 0.1 * (grad - one)
                    two += 0.001 * (grad**2 - two)
                    self.p[k] -= RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
        return self


def _features(rows: DataFrame, label: str) -> DataFrame:
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, size=TEXT):
            x, number = passages(batch.column(2).to_pylist())
            parts = np.split(x, np.cumsum(number)[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())], ["doc_id", "label", "passages"])

    return rows.select(F.col("doc_id").cast("long"), F.col(label).cast("int"), "text").mapInArrow(take, "doc_id long, label int, passages binary")


def quality_model(docs: DataFrame, labels: DataFrame, *, label: str = "quality", bound: int = TRAIN_BOUND, most: int = TRAIN_BYTES):
    """A function from a column of texts to their quality, from 0 to 1.

    It is learned from docs (doc_id, text) whose id has a label 0 or 1 in labels (doc_id, label), about `bound`
    documents of each label and at most about `most` bytes of passages in all; rows without text or label, and ids
    whose labels disagree, teach nothing, and rows that repeat count once. Null and empty texts are one passage of
    zeros. With no rows to learn from, or of one label only, every score is that label's share, 0 without any. Other
    columns are ignored.
    """
    spark = docs.sparkSession

    def fit(rows: list[memoryview], truth: np.ndarray) -> bytes:
        net = GatedAttention(FEATURES)
        if len(set(truth)) == 2:
            net.fit([np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b in rows], truth)
        else:
            net.p["c"][:] = 0
            net.p["b"][:] = 30 if truth.any() else -30
        return pickle.dumps((net.mean, net.spread, net.p))

    net = pickle.loads(learned(_features(labelled_sample(docs, labels, label, bound), label), "passages", most, fit))
    model = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = GatedAttention(FEATURES)
        own.mean, own.spread, own.p = model.value
        for texts in batches:
            got = own.scores(texts)
            del texts
            pa.default_memory_pool().release_unused()  # a batch's texts, before the next one comes
            yield got

    return score


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; learned from labels outside the held-out fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    score = quality_model(docs, teaching(labels))
    out = docs.select("doc_id", (fold(5) == 0).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
