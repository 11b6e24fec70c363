"""Intermediate tables, and the size of batches that Python works on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..shared import Scratch, shared_folder

__all__ = ["Scratch", "cuts", "shared_folder", "slices"]

#: Rows and bytes of text that Python works on at once; a text that is longer stands alone.
ROWS, BYTES = 512, 4 << 20


def cuts(lengths: np.ndarray, rows: int = ROWS, size: int = BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of so many rows, and of so many bytes together, at most; at least a row each."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(lengths):
        stop = int(np.searchsorted(total, total[at] + size, side="right")) - 1
        stop = max(at + 1, min(stop, at + rows, len(lengths)))
        yield at, stop
        at = stop


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, which Spark bounds by rows and by bytes for all its tables alike, in parts with little text in a column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for a, b in cuts(lengths, rows, size):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()  # workers are used again, by other stages too
