"""Character n-grams of whole batches of texts, hashed with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint32(0x01000193)
_M = np.uint32(0x9E3779B1)
#: Characters of a batch that are worked on at once; a text may cross into the next block.
BLOCK = 1 << 20


def alnum_table(limit: int = 0x3000) -> np.ndarray:
    """Whether each code point below limit is a letter or digit; those above count as such."""
    return np.array([chr(i).isalnum() for i in range(limit)])


def code_points(texts: list[str | None], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case texts as one array of code points, and where each begins. Two spaces stand before and after each.

    With a table, every other character than letters and digits is a space.
    """
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) + 2 for t in low), np.int64, len(low))
    points = np.frombuffer(("  " + "  ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    if table is not None:
        known = np.minimum(points, len(table) - 1)
        points[~table[known] & (points < len(table))] = 32
    return points, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def grams(points: np.ndarray, n: int, bits: int, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n characters from each place, and whether they count.

    With inside, those count that have a space at most at an end; else those that are not spaces alone. As texts are
    two spaces apart, no n-gram of up to three characters, and with inside none at all, holds parts of two texts.
    """
    m = len(points) - n + 1
    h = points[:m].copy()
    for k in range(1, n):
        h *= _P
        h ^= points[k : k + m]
    h = (h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x61C88647 % 2**32)) * _M
    blank = points == 32
    if inside:
        counts = ~(blank[:m] & blank[n - 1 : n - 1 + m])
        for k in range(1, n - 1):
            counts &= ~blank[k : k + m]
    else:
        counts = ~blank[:m]
        for k in range(1, n):
            counts |= ~blank[k : k + m]
    return h >> np.uint32(32 - bits), counts


def blocks(points: np.ndarray, begins: np.ndarray, n: int, bits: int, inside: bool, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of n-grams: buckets, whether they count, where each text's part begins, and which text that is."""
    for at in range(0, len(points) - n + 1, size):
        bucket, counts = grams(points[at : at + size + n - 1], n, bits, inside)
        first, last = np.searchsorted(begins, [at, at + len(bucket) - 1], side="right") - 1
        yield bucket, counts, np.maximum(begins[first : last + 1] - at, 0), np.arange(first, last + 1)
