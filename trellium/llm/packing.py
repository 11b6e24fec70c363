"""Best-fit packing, planned over the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, slices

CAPACITY = 2048
#: Runs whose ids a task remembers; beyond that, it keeps those of the last texts.
REMEMBERED = 400_000
#: New runs that are encoded as one text; their ids are told apart by where they stand in it.
LINE = 64
#: Texts, and bytes of them, that are split together.
TEXTS, BYTES = 700, 5 << 19


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: By byte: letters that the tokenizer's normaliser only puts in lower case (ASCII's, and those of Latin-1 in UTF-8), digits,
#: other visible characters of ASCII; 0 for the rest, and for the apostrophe, with which the pattern's endings begin.
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = _SIGN
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3]] = _LETTER
_KINDS[48:58], _KINDS[39] = _DIGIT, 0
_LOWER = np.array([b + 32 * (65 <= b <= 90) for b in range(256)], np.uint8)


def _byte_letters() -> np.ndarray:
    """For each byte the character that stands for it in byte-level BPE; a space stays one.

    Printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    sign = np.arange(256, dtype="<u4")
    sign[rest] = np.arange(256, 256 + len(rest))
    sign[32] = 32
    return sign


def _parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings (or binaries), and where each begins and the last ends."""
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at - at[0]


def _array(kind: pa.DataType, data: np.ndarray, at: np.ndarray) -> pa.Array:
    at = np.ascontiguousarray(at, dtype=np.int64)
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def runs(pieces: pa.Array, special: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces without white space (large strings) as runs: the runs, which of them are whole hard pieces, and where each piece's runs begin.

    A plain piece has letters, digits and signs as in _KINDS only, and no byte in special. Its runs, in lower case, are
    the pattern's matches: letters or signs that follow each other, and single digits. Any other piece is hard and one
    run, as it is. An empty piece has no runs.
    """
    data, at = _parts(pieces)
    kind = _KINDS[data]
    kind[np.isin(data, np.frombuffer(special, np.uint8))] = 0
    after = np.concatenate([[False], data[:-1] == 0xC3])[: len(data)]
    bad = (kind == 0) | (after != ((data & 0xC0) == 0x80)) | after & ((data == 0x97) | (data == 0xB7))  # × and ÷ are signs
    hard = np.zeros(len(pieces), bool)
    hard[np.searchsorted(at, np.flatnonzero(bad), side="right") - 1] = True
    plain = ~np.repeat(hard, np.diff(at))
    begin = plain & ((kind == _DIGIT) | np.concatenate([[True], kind[1:] != kind[:-1]])[: len(data)])
    begin[at[:-1][at[:-1] < at[1:]]] = True
    cuts = np.flatnonzero(begin)
    low = np.where(after & (data < 0x9F), data + np.uint8(32), _LOWER[data])
    every = _array(pa.large_string(), np.where(plain, low, data), np.append(cuts, len(data)))
    return every, ~plain[cuts], np.searchsorted(cuts, at)


def encoder(path: str):
    """A function from a column of texts to all their ids, little-endian unsigned 32-bit, and where each text's ids end.

    The tokenizer drops white space and matches nothing across it, so a text's ids are those of its pieces between
    ASCII white space, one after the other, and a plain piece's are those of its runs. Arrow splits the texts and
    numbers the different pieces, numpy cuts these into runs, and Arrow numbers the different runs; what is new among
    these is encoded, all of it together, and the ids are gathered back. Plain runs skip the normaliser and the pattern,
    which would only put them in lower case and match them whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    whole, letters = Tokenizer.from_file(path), _byte_letters()
    special = "".join(sorted({t.content[0] for t in whole.get_added_tokens_decoder().values()})).encode()
    plain = Tokenizer(whole.model)
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    known, known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def joined(got: list, cuts: list[np.ndarray]) -> pa.Array:
        """The ids of strings, encoded some at a time; cuts: where the ids of each begin, and those of the last end."""
        ids = [np.array(x.ids, "<u4") for x in got]
        before = np.cumsum([0, *map(len, ids)])
        at = [c[:-1] + b for c, b in zip(cuts, before)]
        return _array(pa.large_binary(), np.concatenate(ids).view(np.uint8), 4 * np.concatenate([*at, before[-1:]]))

    def plain_ids(new: pa.Array) -> pa.Array:
        data, at = _parts(pc.binary_join_element_wise(new, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))
        text, at = letters[data].tobytes().decode("utf-32-le"), at[[*range(0, len(new), LINE), len(new)]].tolist()
        got = plain.encode_batch([text[a : b - 1] for a, b in zip(at, at[1:])], add_special_tokens=False)
        sizes = [min(LINE, len(new) - k) for k in range(0, len(new), LINE)]
        return joined(got, [np.searchsorted(np.array(x.word_ids), np.arange(n + 1)) for x, n in zip(got, sizes)])

    def hard_ids(new: pa.Array) -> pa.Array:
        new = new.to_pylist()
        lines = [new[k : k + LINE] for k in range(0, len(new), LINE)]
        got = whole.encode_batch([" ".join(x) for x in lines], add_special_tokens=False)
        begin = [np.cumsum([0, *(len(p) + 1 for p in x)]) for x in lines]
        return joined(got, [np.searchsorted(np.fromiter((o[0] for o in x.offsets), np.int64, len(x.ids)), b) for x, b in zip(got, begin)])

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal known, known_ids
        pieces = pc.ascii_split_whitespace(texts.fill_null(""))
        number = pieces.flatten().dictionary_encode()
        every, hard, first = runs(number.dictionary.cast(pa.large_string()), special)
        every = every.dictionary_encode()
        different, of = every.dictionary, every.indices
        is_hard = np.zeros(len(different), bool)
        is_hard[of.to_numpy()] = hard
        place = pc.index_in(different, value_set=known)
        new = place.is_null().to_numpy(zero_copy_only=False)
        place = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for which, ids in ((new & ~is_hard, plain_ids), (new & is_hard, hard_ids)):
            if which.any():
                fresh = different.filter(pa.array(which))
                place[which] = len(known) + np.arange(len(fresh))
                known, known_ids = pa.concat_arrays([known, fresh]), pa.concat_arrays([known_ids, ids(fresh)])
        own = known_ids.take(pa.array(place))
        if len(known) > REMEMBERED:
            known, known_ids = different, own
        data, at = _parts(own.take(of))
        data, at = _parts(_array(pa.large_binary(), data, at[first]).take(number.indices))
        return data.view("<u4"), at[np.cumsum(pc.list_value_length(pieces).to_numpy())] // 4

    return encode


def token_pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as bytes) of every document's pieces.

    A document is its ids and then the id `end`; one longer than capacity is cut into pieces of capacity, the last of
    which may be shorter. A null or empty text is the one id `end`.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, width = encoder(path), np.array([end], dtype="<u4").tobytes(), 4 * capacity
        for batch in slices(batches, 1, TEXTS, BYTES):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            every, stops = encode(batch.column(1))
            for i, (a, b) in enumerate(zip([0, *stops[:-1].tolist()], stops.tolist())):
                whole = memoryview(every[a:b].tobytes() + last)
                for k, at in enumerate(range(0, len(whole), width)):
                    part = whole[at : at + width]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(bytes(part))
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
            out += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(ids, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, first sequence, offset, count).

    Items of one length with ranks first .. first + count - 1 go to as many sequences that follow each other, at the
    same offset. The longest items go first, each into the fullest sequences that still take it; sequences with the
    same room are handled together, so the work depends on how many lengths there are and not on how many items.
    """
    rules: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    fresh = 0

    def free(left: int, sequence: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((sequence, count))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                left, sequence, count = capacity, fresh, -(-todo // (capacity // length))
                fresh += count
            else:
                left = rooms[at]
                sequence, count = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            each = left // length
            full = min(count, todo // each)
            for k in range(each if full else 0):
                rules.append((length, rank + k * full, sequence, capacity - left + k * length, full))
            rank, todo = rank + full * each, todo - full * each
            free(left - each * length, sequence, full)
            sequence, count = sequence + full, count - full
            if todo and count:  # fewer than one sequence takes
                for k in range(todo):
                    rules.append((length, rank + k, sequence, capacity - left + k * length, 1))
                free(left - todo * length, sequence, 1)
                rank, todo, sequence, count = rank + todo, 0, sequence + 1, count - 1
            free(left, sequence, count)
    return rules


def best_fit(pieces: DataFrame, *, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """pieces with sequence_id and offset: best-fit packing into sequences of at most capacity.

    length must be from 1 to capacity. Pieces are ranked within their length by partition, then by (doc_id, piece):
    a rank is a local rank plus the count of that length in the partitions before, so no task sees all pieces of a
    length. Only the histogram, at most one row a length, comes to the driver; the plan made from it has at most a row
    for each pair of a length and a room, and is broadcast. Pieces that tie take each other's places. An empty table
    gives an empty result.
    """
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    pieces = scratch.save(pieces.withColumn("_part", F.spark_partition_id()), "pieces")
    sizes = pieces.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rules = np.array(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(rules)

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_part", "length").orderBy("doc_id", "piece", "start")
    ranked = pieces.withColumn("_rank", F.row_number().over(local) - 1).join(starts, ["_part", "length"])
    ranked = ranked.select(*[c for c in pieces.columns if c != "_part"], (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))
    at = ranked.columns.index("length")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset, _ = sent.value.T
        keys = (length << 44) | first
        for batch in batches:
            if not batch.num_rows:
                continue
            of, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at, batch.num_columns - 1))
            k = np.searchsorted(keys, (of << 44) | rank, side="right") - 1
            kept = batch.columns[:-1] + [pa.array(sequence[k] + rank - first[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays(kept, batch.schema.names[:-1] + ["sequence_id", "offset"])

    schema = ranked.drop("_rank").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.mapInArrow(take, schema)


def pack_documents(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Tokenise and pack docs: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset for each piece.

    A null text counts as empty, which is one id. Repeated rows and null ids are documents like others; other columns
    are ignored.
    """
    return best_fit(token_pieces(docs, path or vocabulary(), capacity=capacity, with_ids=with_ids), capacity=capacity, scratch=scratch)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
