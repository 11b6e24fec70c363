"""Removal of repeated byte strings by a distributed merge of front-coded, sorted suffix runs."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import text_key
from .scratch import Scratch, slices

#: Bytes of a string that counts as repeated, and of the gram by which equal strings find each other.
LENGTH, GRAM = 50, 16
#: Anchors that a task holds before it sends them on, and strings of a run.
HELD, RUN = 2_000_000, 400_000
_LAST = 2**63 - 1
_PLACE = 24
_U = np.uint64


def _side(length: int) -> int:
    """The bytes beside its anchor that every window of `length` bytes has to the left of it, or to the right."""
    return min(GRAM, (length - GRAM + 1) // 2)


def anchors(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (text, start, windows, place, hashes): the strings of all texts that share an anchor.

    A window is `length` bytes; its anchor is the place of the gram in it with the least hash, the first of several.
    Windows that follow each other and share their anchor are one string, from start on, with so many windows; place is
    the anchor's in the text. Equal windows have equal grams at their anchors, wherever they stand. The rows of hashes
    are of the gram, of the gram with the bytes of a side before it, and with those after it.
    """
    span, side = length - GRAM + 1, _side(length)
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) < 1 << 22:
            size += len(texts[stop])
            stop += 1
        data = np.frombuffer(b"".join(texts[at:stop]) + bytes(8), np.uint8)
        ends = np.cumsum([len(t) for t in texts[at:stop]])
        for lo in range(0, size, (1 << _PLACE) - 4096):  # a text may be longer than places have bits
            hi = min(size, lo + (1 << _PLACE) - 4096 + length - 1)
            n = hi - lo - GRAM + 1
            if n < span:
                continue
            eight = np.ndarray((hi - lo - 7,), "<u8", data, lo, (1,))
            h = eight[:n] * _U(0x9E3779B97F4A7C15)
            for k in range(8, GRAM, 8):
                h ^= h >> _U(32)
                h = (h ^ eight[k : k + n]) * _U(0xC2B2AE3D27D4EB4F)
            h ^= h >> _U(32)
            h *= _U(0xD6E8FEB86659FD93)
            h ^= h >> _U(29)
            least = (h & _U(2**64 - 2**_PLACE)) | np.arange(n, dtype=np.uint64)
            width = 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
            place = (least & _U(2**_PLACE - 1)).astype(np.int64)
            begin = np.arange(lo, lo + len(place))
            text = np.searchsorted(ends, begin, side="right")
            inside = begin + length <= ends[text]
            new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0) | np.diff(inside, prepend=False))
            windows = np.diff(np.append(new, len(place)))
            new, windows = new[inside[new]], windows[inside[new]]
            first = (ends - [len(t) for t in texts[at:stop]])[text[new]]
            own = h[place[new]]
            left = h[np.maximum(place[new] - side, 0)] ^ own * _U(0x9E3779B97F4A7C15)
            right = h[np.minimum(place[new] + side, n - 1)] ^ own * _U(0xC2B2AE3D27D4EB4F)
            yield at + text[new], begin[new] - first, windows, place[new] + lo - first, np.stack([own, left, right])
        at = stop


def _bytes(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _ids(column) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


#: An anchor: hashes of its gram with what stands before and after, and of which of them two documents are known to have.
_SEEN = np.dtype([("left", "<u4"), ("right", "<u4"), ("row", "<i8"), ("place", "<u4"), ("back", "u1"), ("windows", "u1"), ("known", "u1")])
#: A repeated string: its document's row, where it starts, and which of its windows repeat another, as bits.
_SPAN = np.dtype([("row", "<i8"), ("start", "<u4"), ("bits", "<u8")])
#: A shared anchor: its document's row, and its place and the shape of its string.
_SHARED = np.dtype([("row", "<i8"), ("both", "<u8")])
#: Anchors or repeats in bytes that a task gathers before it deals them out by document.
GATHERED = 64 << 20


def _sides(back: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether some window of the string has a side before its anchor, and whether one has it after."""
    return back >= _side(length), windows.astype(np.int64) - 1 + length - back - GRAM >= _side(length)


def _several(hashes: np.ndarray, row: np.ndarray, some: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which of some have the hash of another document's, or of a known one; and the first of each such group."""
    shared, first = np.zeros(len(row), bool), np.zeros(len(row), bool)
    if len(at := np.flatnonzero(some)):
        at = at[np.argsort(hashes[at])]
        h, r = hashes[at], row[at]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(r, edge) != np.maximum.reduceat(r, edge)
        if known is not None:
            several |= np.logical_or.reduceat(known[at], edge)
        shared[at] = np.repeat(several, np.diff(np.append(edge, len(at))))
        first[at[edge[several]]] = True
    return shared, first


def _shared_of(row: np.ndarray, place: np.ndarray, back: np.ndarray, windows: np.ndarray) -> np.ndarray:
    own = np.zeros(len(row), _SHARED)
    own["row"], own["both"] = row, place.astype("<u8") << _U(16) | back.astype("<u8") << _U(8) | windows.astype("<u8")
    return own


def _fingerprints(buckets: int, length: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, text -> bucket, found, blob.

        Every window has a side before or after its anchor, so an anchor of which no other document has the gram with
        either side stands in no repeated window. What two documents held here have in common is found already, and
        goes to the bucket of its row; with the rest to the bucket of the gram's hash go those of them only that are
        the first with a side here. So no bucket gets more of a gram with a side than one anchor from each task.
        """
        held: list[tuple[np.ndarray, ...]] = []
        sizes = 0

        def out() -> pa.RecordBatch:
            row, place, back, windows = (np.concatenate(x) for x in zip(*(x[:4] for x in held)))
            h, left, right = np.concatenate([x[4] for x in held], axis=1)
            held.clear()
            before, after = _sides(back, windows, length)
            (on_left, first), (on_right, second) = _several(left, row, before), _several(right, row, after)
            found = on_left | on_right
            pick = np.flatnonzero(before & (first | ~on_left) | after & (second | ~on_right))
            to, blobs = _dealt(_shared_of(*(x[found] for x in (row, place, back, windows))), buckets)
            own = np.zeros(len(pick), _SEEN)
            own["left"], own["right"], own["row"], own["place"] = left[pick] >> _U(32), right[pick] >> _U(32), row[pick], place[pick]
            own["back"], own["windows"], own["known"] = back[pick], windows[pick], on_left[pick] | on_right[pick] << 1
            probe = (h[pick] % _U(buckets)).astype(np.int64)
            by = np.lexsort((own["left"], probe))
            own, probe = own[by], probe[by]
            cuts = np.flatnonzero(np.diff(probe, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(probe))):
                blobs.append(struct.pack("<I", b - a) + pa.compress(_planes(own[a:b]), "zstd", asbytes=True))
            known = [True] * len(to) + [False] * len(cuts)
            return pa.RecordBatch.from_arrays([pa.array(to + probe[cuts].tolist(), pa.int32()), pa.array(known), pa.array(blobs, pa.binary())], ["bucket", "found", "blob"])

        for batch in slices(batches, 1):
            row = batch.column(0).to_numpy()
            for text, start, windows, place, h in anchors(_bytes(batch.column(1)), length):
                held.append((row[text], place.astype(np.uint32), (place - start).astype(np.uint8), windows.astype(np.uint8), h))
                sizes += len(text)
                if sizes > HELD:
                    yield out()
                    sizes = 0
        if sizes:
            yield out()

    return send


def _open(blob: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", blob)[0]
    planes = np.frombuffer(pa.decompress(blob[4:], n * _SEEN.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(_SEEN.itemsize, n).T).view(_SEEN).ravel()


def _by_bucket(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[list]]]:
    """The rows of a bucket together; they come sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for bucket, *rest in zip(batch.column("bucket").to_pylist(), *(batch.column(n).to_pylist() for n in names)):
            if bucket != now and rows:
                yield now, rows
                rows = []
            now = bucket
            rows.append(rest)
    if rows:
        yield now, rows


def _dealt(own: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Buckets of rows, and what belongs to each as one blob: so many at most, however many documents there are."""
    to = own["row"] % buckets
    order = np.lexsort((own["row"], to))
    own, to = own[order], to[order]
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    blobs = [struct.pack("<I", b - a) + pa.compress(own[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(cuts, np.append(cuts[1:], len(to)))]
    return to[cuts].tolist(), blobs


def _blobs(own: np.ndarray, buckets: int) -> pa.RecordBatch:
    to, blobs = _dealt(own, buckets)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _meeting(kind: np.dtype, every: bool):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bucket, late, row, doc_id, text, blob, sorted by bucket and late -> row, doc_id, text, own.

        The blobs of a bucket come before its texts; own is what of them belongs to the row. Rows to which nothing
        belongs are left out unless every row is wanted.
        """
        now, parts, own = None, [], None
        for batch in batches:
            bucket, late = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | np.diff(late, prepend=False)).tolist()
            for a, b in zip(cuts, cuts[1:] + [len(bucket)]):
                if bucket[a] != now:
                    now, parts, own = bucket[a], [np.zeros(0, kind)], None
                if not late[a]:
                    for blob in batch.column(5).slice(a, b - a).to_pylist():
                        parts.append(np.frombuffer(pa.decompress(blob[4:], struct.unpack_from("<I", blob)[0] * kind.itemsize, "zstd", asbytes=True), kind))
                    continue
                if own is None:
                    own = np.concatenate(parts)
                    own, parts = own[np.argsort(own["row"], kind="stable")], []
                    of = np.ascontiguousarray(own["row"])
                row = batch.column(2).slice(a, b - a).to_numpy()
                lo, hi = np.searchsorted(of, row), np.searchsorted(of, row, "right")
                pick = np.arange(b - a) if every else np.flatnonzero(hi > lo)
                if len(pick):
                    at = pa.array(pick + a)
                    found = pa.array([own[x:y].tobytes() for x, y in zip(lo[pick].tolist(), hi[pick].tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (2, 3, 4)), found], ["row", "doc_id", "text", "own"])

    return meet


def _beside(texts: DataFrame, blobs: DataFrame) -> DataFrame:
    """Texts and the blobs of their buckets in one exchange, as _meeting takes them."""
    texts = texts.select("bucket", F.lit(True).alias("late"), "row", "doc_id", "text", F.lit(None).cast("binary").alias("blob"))
    blobs = blobs.select("bucket", F.lit(False).alias("late"), F.lit(0).cast("long").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob")
    return blobs.unionByName(texts).repartition("bucket").sortWithinPartitions("bucket", "late")


def _shared(buckets: int, length: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bucket, found, blob -> bucket, blob: the anchors that several documents have with a side, by row."""
        held: list[np.ndarray] = []
        size = 0
        for bucket, blobs in _by_bucket(batches, ["found", "blob"]):
            if found := [b for known, b in blobs if known]:
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(found), pa.int32()), pa.array(found, pa.binary())], ["bucket", "blob"])
            if probe := [_open(b) for known, b in blobs if not known]:
                own = np.concatenate(probe)
                before, after = _sides(own["back"], own["windows"], length)
                hit = _several(own["left"], own["row"], before, own["known"] & 1 > 0)[0] | _several(own["right"], own["row"], after, own["known"] & 2 > 0)[0]
                own = own[hit & (own["known"] == 0)]
                held.append(_shared_of(own["row"], own["place"], own["back"], own["windows"]))
                size += held[-1].nbytes
            if size > GATHERED:
                yield _blobs(np.concatenate(held), buckets)
                held.clear()
                size = 0
        if size:
            yield _blobs(np.concatenate(held), buckets)

    return meet


def _common(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix of a and b, which agree in the first `at` bytes."""
    n = min(len(a), len(b)) - at
    differ = int.from_bytes(a[at : at + n]) ^ int.from_bytes(b[at : at + n])
    return at + n - (differ.bit_length() + 7) // 8


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: like stands by like."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


#: The common prefix, the size, the id and the number of refs of each key; the row and the start of each ref.
_PLANES = ("u1", "u1", "<i8", "<u4", "<i8", "<u4")
_WIDE = tuple(np.dtype(t).itemsize for t in _PLANES)


def _shares(keys: np.ndarray) -> np.ndarray:
    """Of each row of a matrix of bytes, how many it has in common with the row before."""
    differ = np.ones((len(keys), keys.shape[1] + 1), bool)
    differ[1:, :-1] = keys[1:] != keys[:-1]
    return differ.argmax(axis=1)


def _coded(keys: np.ndarray, size: np.ndarray, ident: np.ndarray, count: np.ndarray, row: np.ndarray, start: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Runs of sorted keys that begin at first: rows of a matrix that are size long, their ids, and how many of the refs (row, start) each has."""
    same = np.minimum(np.minimum(_shares(keys), size), np.concatenate([[0], size[:-1]]))  # the padding is no part of a key
    same[first] = 0
    column = np.arange(keys.shape[1])
    rest = keys[(column >= same[:, None]) & (column < size[:, None])].tobytes()
    planes = [np.frombuffer(_planes(x.astype(t)), np.uint8).reshape(np.dtype(t).itemsize, len(x)) for x, t in zip((same, size, ident, count, row, start), _PLANES)]
    stop = np.append(first[1:], len(keys))
    refs, bytes_ = (np.concatenate([[0], np.cumsum(x)]) for x in (count, size - same))
    out = []
    for a, b, c, d, e, f in zip(*(x.tolist() for x in (first, stop, refs[first], refs[stop], bytes_[first], bytes_[stop]))):
        out.append(b"".join([struct.pack("<II", b - a, d - c), *(p[:, a:b].tobytes() for p in planes[:4]), *(p[:, c:d].tobytes() for p in planes[4:]), rest[e:f]]))
    return out


def _read(runs: list[bytes], width: int = 0) -> tuple[list[int], tuple[np.ndarray, ...]]:
    """How many keys each run has, and what _coded took for all of them, with the common prefixes with the key before.

    Keys are in a matrix of that width at least.
    """
    parts: list[list[np.ndarray]] = [[] for _ in range(len(_PLANES) + 1)]
    sizes = []
    for run in runs:
        n, refs = struct.unpack_from("<II", run)
        data, at = np.frombuffer(run, np.uint8, offset=8), 0
        for part, wide, k in zip(parts, _WIDE, (n, n, n, n, refs, refs)):
            part.append(data[at : at + k * wide].reshape(wide, k))
            at += k * wide
        parts[-1].append(data[at:])
        sizes.append(n)
    same, size, *rest = (np.ascontiguousarray(np.concatenate(x, axis=1).T).view(t).ravel() for x, t in zip(parts, _PLANES))
    same, size, column = same.astype(np.int64), size.astype(np.int64), np.arange(max(width, int(size.max(initial=0))))
    keys = np.zeros((len(size), len(column)), np.uint8)
    keys[(column >= same[:, None]) & (column < size[:, None])] = np.concatenate(parts[-1])
    for a in range(0, len(keys), 1 << 14):
        part, shared, ends = (x[max(a - 1, 0) : a + (1 << 14)] for x in (keys, same, size))
        shared = np.concatenate([[0], shared[1:]])  # the first is whole, by the part before
        if top := int(shared.max()):
            source = np.where(column[:top] >= shared[:, None], np.arange(len(part), dtype=np.int32)[:, None], np.int32(0))
            part[:, :top] = np.take_along_axis(part[:, :top], np.maximum.accumulate(source, axis=0), 0)
            part[column >= ends[:, None]] = 0
    return sizes, (keys, size, *rest, same)


def front_coded(records: list[tuple[bytes, int, list[tuple[int, int]]]]) -> bytes:
    """Sorted records (key, id, refs): of each key only what differs from the one before."""
    width = max((len(r[0]) for r in records), default=0)
    keys = np.frombuffer(b"".join([r[0].ljust(width, b"\0") for r in records]), np.uint8).reshape(len(records), width)
    refs = np.array([x for r in records for x in r[2]], np.int64).reshape(-1, 2)
    size, ident, count = (np.array(x, np.int64) for x in ([len(r[0]) for r in records], [r[1] for r in records], [len(r[2]) for r in records]))
    return b"".join(_coded(keys, size, ident, count, refs[:, 0], refs[:, 1], np.zeros(min(1, len(keys)), np.int64)))


def decoded(run: bytes) -> Iterator[tuple[bytes, int, int, list[tuple[int, int]]]]:
    """key, common prefix with the key before, id, refs."""
    if not run:
        return
    _, (keys, size, ident, count, row, start, same) = _read([run])
    refs = list(zip(row.tolist(), start.tolist()))
    stop = np.cumsum(count).tolist()
    for key, n, shared, i, a, b in zip(keys, size.tolist(), same.tolist(), ident.tolist(), [0, *stop], stop):
        yield key[:n].tobytes(), shared, i, refs[a:b]


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs of (key, common prefix with the one before, ...) with a tree of losers.

    Every head knows how much it shares with the last winner. Of two heads the one that shares more is the smaller
    and no byte is looked at; heads that share as much are compared from there on, and the loser then knows how much
    it shares with the winner. So no byte of a known prefix is compared again.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    share = [0] * k
    losers = [0] * k

    def duel(i: int, j: int) -> tuple[int, int]:
        if heads[i] is None:
            return j, i
        if heads[j] is None or share[i] > share[j]:
            return i, j
        if share[i] < share[j]:
            return j, i
        a, b = heads[i][0], heads[j][0]
        if a == b:
            share[j] = len(a)
            return i, j
        same = _common(a, b, share[i])
        if a[same:] < b[same:]:
            share[j] = same
            return i, j
        share[i] = same
        return j, i

    def play(node: int) -> int:
        if node >= k:
            return node - k
        won, losers[node] = duel(play(2 * node), play(2 * node + 1))
        return won

    top = play(1)
    while heads[top] is not None:
        yield heads[top]
        heads[top] = head = next(runs[top], None)
        share[top] = head[1] if head else 0
        node = (top + k) // 2
        while node:
            top, losers[node] = duel(top, losers[node])
            node //= 2


def _width(length: int) -> int:
    """The bytes of a key at most, with one more for its own length."""
    return 2 * length - GRAM + 2


def _keys(data: np.ndarray, start: np.ndarray, windows: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """A row for each string of data, which ends in bytes to spare.

    A key is the gram, the length of the suffix from the anchor on, the rest of the suffix, and what stands before it:
    equal for equal strings with the same anchor. NULs fill it up, and its length is the last byte of the row.
    """
    column = np.arange(_width(length), dtype=np.int32)
    left = (place - start).astype(np.int32)[:, None]
    right = (windows - 1 + length).astype(np.int32)[:, None] - left
    # Of the columns beyond the suffix, the first is the string's start.
    keys = data[place[:, None] + (column - (column > GRAM) - np.where(column > right, left + right, 0))]
    keys[column > left + right] = 0
    keys[:, GRAM], keys[:, -1] = right[:, 0], (left + right)[:, 0] + 1
    return keys


def _range_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of a matrix of bytes, which are as many as fill numbers of 64 bits."""
    h = np.zeros(len(rows), np.uint64)
    for part in rows.view("<u8").T:
        h = (h ^ part) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return h


def _edges(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups begin, and their sizes."""
    edge = np.flatnonzero(new)
    return edge, np.diff(np.append(edge, len(new)))


def _runs(buckets: int, length: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, doc_id, text, own (shared anchors) -> bucket, found, blob: sorted runs, and found already, what is certain to be a repeat.

        Of equal strings in documents held here, those of the smallest id go into the run; the others repeat it.
        """
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            keys, start, windows, row, ident = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(keys.view(f"S{keys.shape[1]}").ravel())  # no row ends in NUL, as its length does not
            keys, start, windows, row, ident = (x[order] for x in (keys, start, windows, row, ident))
            edge, size = _edges(_shares(keys) < keys.shape[1])
            least = np.minimum.reduceat(ident, edge)
            own = ident == np.repeat(least, size)
            spans = np.zeros(int((~own).sum()), _SPAN)
            spans["row"], spans["start"], spans["bits"] = row[~own], start[~own], (_U(1) << windows[~own].astype(np.uint64)) - _U(1)
            to, blobs = _dealt(spans, buckets)
            found = len(to)
            count = np.add.reduceat(own.astype(np.int64), edge)
            keys, at = keys[edge], np.flatnonzero(own)
            gram = np.ascontiguousarray(keys[:, :GRAM]).view("<u8")
            bucket = ((gram[:, 0] * _U(0x9E3779B97F4A7C15) ^ gram[:, 1]) * _U(0xD6E8FEB86659FD93) >> _U(33)).astype(np.int64) % buckets
            by = np.argsort(bucket, kind="stable")
            first = np.cumsum(count) - count
            cuts, _ = _edges(np.diff(bucket[by], prepend=-1) != 0)
            keys, least, count, first = (x[by] for x in (keys, least, count, first))
            refs = at[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(at))]
            for run in _coded(keys[:, :-1], keys[:, -1].astype(np.int64), least, count, row[refs], start[refs], cuts):
                blobs.append(struct.pack("<I", len(run)) + pa.compress(run, "zstd", asbytes=True))
            to += bucket[by][cuts].tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array([True] * found + [False] * len(cuts)), pa.array(blobs, pa.binary())], ["bucket", "found", "blob"]
            )

        count = 0
        for batch in slices(batches, 2):
            row, ident, texts = batch.column(0).to_numpy(), _ids(batch.column(1)), _bytes(batch.column(2))
            data = np.frombuffer(b"".join(texts) + bytes(_width(length)), np.uint8)
            first = np.cumsum([0, *map(len, texts)])
            kept = [np.unique(np.frombuffer(x, _SHARED)["both"]).astype(np.int64) for x in batch.column(3).to_pylist()]
            text, both = np.repeat(np.arange(len(kept)), [len(x) for x in kept]), np.concatenate(kept)
            for a in range(0, len(text), 1 << 15):
                of, one = text[a : a + (1 << 15)], both[a : a + (1 << 15)]
                place, back, windows = one >> 16, one >> 8 & 255, one & 255
                keys = _keys(data, first[of] + place - back, windows, first[of] + place, length)
                held.append((keys, place - back, windows, row[of], ident[of]))
                count += len(of)
                if count > RUN:
                    yield out()
                    count = 0
        if count:
            yield out()

    return sort


def _mixed(keys: np.ndarray, ident: np.ndarray, length: int) -> np.ndarray:
    """Which windows of each key a key of a smaller id has too, as bits.

    Equal windows have their anchor at the same place in them, so those are compared that have so many bytes before it.
    """
    most = length - GRAM
    left = keys[:, -1].astype(np.int64) - 1 - keys[:, GRAM]
    column = np.arange(2 * most + GRAM)
    # The strings in order, with all anchors in one column.
    on = column - most
    right = keys[:, GRAM].astype(np.int64)[:, None]
    source = np.where(on < 0, 1 + right + left[:, None] + on, on + (on >= GRAM))
    whole = np.take_along_axis(keys, np.clip(source, 0, keys.shape[1] - 1), 1)
    bits = np.zeros(len(keys), np.uint64)
    for before in range(most + 1):
        pick = np.flatnonzero((left >= before) & (right[:, 0] >= length - before))
        if len(pick) < 2:
            continue
        window = np.zeros((len(pick), -(-length // 8) * 8), np.uint8)
        window[:, :length] = whole[pick, most - before : most - before + length]
        h = _range_hashes(window)
        order = np.argsort(h)
        h = h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        again = np.flatnonzero(~new)
        if (window[order[again]] != window[order[again - 1]]).any():  # hashes bring equal windows together, bytes decide
            order = np.lexsort(window.T)
            new = _shares(window[order]) < window.shape[1]
        edge, size = _edges(new)
        own = ident[pick[order]]
        hit = pick[order[own > np.repeat(np.minimum.reduceat(own, edge), size)]]
        bits[hit] |= _U(1) << (left[hit] - before).astype(np.uint64)
    return bits


#: Keys whose windows are compared at once; keys of one gram stay together.
MIXED = 1 << 16


def _repeated(keys: np.ndarray, ident: np.ndarray, length: int) -> np.ndarray:
    """Which windows of each of the merged keys repeat one of a smaller id, as bits, by the prefixes that neighbours share."""
    shares = _shares(keys)
    edge, size = _edges(shares < GRAM)
    least = np.minimum.reduceat(ident, edge)
    several = least != np.maximum.reduceat(ident, edge)
    one = np.add.reduceat((shares < keys.shape[1]).astype(np.int64), edge) == 1
    bits = np.zeros(len(keys), np.uint64)
    again = np.flatnonzero(np.repeat(several & one, size) & (ident > np.repeat(least, size)))
    bits[again] = (_U(1) << (keys[again, -1].astype(np.int64) - length).astype(np.uint64)) - _U(1)
    groups = np.flatnonzero(several & ~one)
    total = np.cumsum(size[groups])
    at = 0
    while at < len(groups):
        stop = max(at + 1, int(np.searchsorted(total, total[at] - size[groups[at]] + MIXED, "right")))
        n = size[groups[at:stop]]
        pick = np.repeat(edge[groups[at:stop]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        bits[pick] = _mixed(keys[pick], ident[pick], length)
        at = stop
    return bits


def _repeats(buckets: int, length: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bucket, found, blob, sorted by bucket -> bucket, blob: the windows that repeat one of a smaller id, by row."""
        held: list[np.ndarray] = []
        gathered = 0
        for bucket, blobs in _by_bucket(batches, ["found", "blob"]):
            if found := [b for known, b in blobs if known]:
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(found), pa.int32()), pa.array(found, pa.binary())], ["bucket", "blob"])
            runs = [pa.decompress(b[4:], struct.unpack_from("<I", b)[0], "zstd", asbytes=True) for known, b in blobs if not known]
            if not runs:
                continue
            sizes, (keys, size, ident, count, row, start, same) = _read(runs, _width(length))
            runs.clear()
            keys[:, -1] = size
            heads, shares, stops = keys.view(f"V{keys.shape[1]}").ravel(), same.tolist(), np.cumsum(sizes).tolist()
            one = lambda a, b: zip(heads[a:b].tolist(), shares[a:b], range(a, b))
            at = len(keys)
            order = np.fromiter((x[2] for x in merged([one(a, b) for a, b in zip([0, *stops], stops)])), np.int64, at)
            bits = np.zeros(at, np.uint64)
            bits[order] = _repeated(keys[order], ident[order], length)
            bits = np.repeat(bits, count)
            own = np.zeros(int(np.count_nonzero(bits)), _SPAN)
            own["row"], own["start"], own["bits"] = row[bits > 0], start[bits > 0], bits[bits > 0]
            held.append(own)
            gathered += own.nbytes
            if gathered > GATHERED:
                yield _blobs(np.concatenate(held), buckets)
                held.clear()
                gathered = 0
        if gathered:
            yield _blobs(np.concatenate(held), buckets)

    return merge


def covered(n: int, found: bytes, length: int) -> np.ndarray:
    """Which of n bytes a repeated string covers."""
    depth = np.zeros(n + 1, np.int64)
    spans = np.frombuffer(found, _SPAN)
    start, bits = spans["start"].astype(np.int64), spans["bits"]
    whole = (bits & (bits + _U(1))) == 0  # windows 0 .. k - 1, which is most often so
    at, stop = [start[whole]], [start[whole] + np.round(np.log2(bits[whole] + _U(1))).astype(np.int64) - 1 + length]
    if not whole.all():
        start, bits = start[~whole], bits[~whole]
        on = ((bits[:, None] >> np.arange(64, dtype=np.uint64)) & _U(1)).astype(bool)
        row, j = np.nonzero(on)
        at.append(start[row] + j)
        stop.append(start[row] + j + length)
    depth += np.bincount(np.concatenate(at), minlength=n + 1)[: n + 1]
    depth -= np.bincount(np.concatenate(stop), minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0


def _rest(length: int, with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, doc_id, text, own -> the result."""
        for batch in slices(batches, 2):
            out: list[list] = [[], [], [], [], []]
            for data, found in zip(_bytes(batch.column(2)), batch.column(3).to_pylist()):
                kept = data
                removed = spans = 0
                if found:
                    gone = covered(len(data), found, length)
                    removed, spans = int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for x, y in zip(out, (len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                    x.append(y)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column(1)] + [pa.array(x, t) for x, t in zip(out, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"][: 5 + with_text])

    return cut


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes) for each row of docs.

    A byte goes when a string of `length` bytes that covers it also starts in a document with a smaller doc_id; the
    input decides, not what is left of it. Texts are UTF-8 bytes; what is kept may therefore begin within a character.

    The suffix array is sparse: of a document's suffixes those at anchors, and of these those whose gram, with a side,
    another document has too, are sorted, front-coded and exchanged by gram; a loser tree merges the runs of all tasks,
    and the prefixes that neighbours then share tell which are equal. No repeated string is missed, as equal strings
    have the same anchor. Of equal strings a task sends the smallest document only.

    Null texts are empty. A null doc_id counts as larger than any other; documents of the same id, repeated rows
    too, take nothing from each other. Other columns are ignored; an empty table gives an empty result.
    """
    if not GRAM < length <= GRAM + 63:
        raise ValueError("length must be from 17 to 79")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffix_dedup")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.xxhash64("doc_id", text_key()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = texts.withColumn("bucket", F.pmod("row", F.lit(buckets)).cast("int"))
    by_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    sent = texts.select("row", "text").mapInArrow(_fingerprints(buckets, length), "bucket int, found boolean, blob binary")
    places = scratch.save(by_bucket(sent).mapInArrow(_shared(buckets, length), "bucket int, blob binary"), "places", free=True)
    meet, sort, rest = _meeting(_SHARED, False), _runs(buckets, length), _rest(length, with_text)
    runs = _beside(dealt, places).mapInArrow(lambda batches: sort(meet(batches)), "bucket int, found boolean, blob binary")
    repeats = scratch.save(by_bucket(runs).mapInArrow(_repeats(buckets, length), "bucket int, blob binary"), "repeats", free=True)
    scratch.drop("places")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    every = _meeting(_SPAN, True)
    return _beside(dealt, repeats).mapInArrow(lambda batches: rest(every(batches)), schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that a document of a smaller id has."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
