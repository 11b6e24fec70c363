"""Near-duplicates by a chosen-path set similarity join over word shingles."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .exact_dedup import HOT_GROUPS
from .rows import bounded, text_key
from .scratch import Scratch, slices

SHINGLE, PERCENT = 5, 75
#: Share of the pairs at the threshold that the forest finds at least, by which trees are counted.
RECALL = 0.9995
#: Levels below a tree's root; each has two minwise functions of its own in every tree.
DEEP = 4
#: Documents of a node that are compared exhaustively, that one task branches further by itself, and places of the
#: sketch that prunes in nodes.
SMALL, LOCAL, SKETCH = 96, 4096, 64
#: Pairs whose sketches agree in a smaller share are not looked at again: 5 standard deviations under 75 %.
LIKELY = 0.47
#: Those that agree with a large node's pivot in this share leave the node: whoever is linked with them is likely to be
#: linked with the pivot, as 1 - similarity is a metric.
ALIKE = 0.85
#: Documents that one task compares at once; larger groups are dealt into blocks of that size.
GROUP = 1_000
#: A node too large for a task with so many documents at most outside its most frequent label is settled by comparing
#: these with all of it, in blocks of so many.
STRAYS, BLOCK = 512, 2048

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the different n-word shingles, sorted. A-Z counts as a-z; words stand between ASCII white space.

    Fewer words are one shingle; no words are none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return np.unique(_mixed(out))


def trees(recall: float = RECALL, percent: int = PERCENT) -> int:
    """Trees by which a pair at the threshold is found with probability recall.

    It shares a minwise token, and so a root, with probability s = percent / 100. Below, a node branches by one
    function or by two, evenly, so what holds for a level with probability p holds for the one above with
    1 - (1 - s p) / 2 - (1 - s p)^2 / 2. Pairs that are more alike are found more often, and nodes that are compared
    before the last level lose fewer.
    """
    s, p = percent / 100, 1.0
    for _ in range(DEEP):
        p = 1 - (1 - s * p) / 2 - (1 - s * p) ** 2 / 2
    return 1 if s * p >= 1 else max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - s * p))))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n trees: the roots' functions, then two for each level of each tree, then the sketch's."""
    rng = np.random.default_rng(97)
    n += 2 * DEEP * n + SKETCH
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def _sketches(n: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = _functions(n)
        for batch in slices(batches, 1):
            number, digest, first, deeper, sketch = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text)
                number.append(len(own))
                digest.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                least = np.full(len(factor), 2**32 - 1, np.uint32)
                x = (own >> _U(32)).astype(np.uint32)
                for at in range(0, len(x), 2048):
                    part = x[at : at + 2048]
                    np.minimum(least, (factor[:, None] * part[None, :] + shift[:, None]).min(axis=1), out=least)
                first.append(least[:n].view(np.int32))
                deeper.append(least[n:-SKETCH].astype("<u4").tobytes())
                sketch.append(_mixed(least[-SKETCH:].astype(np.uint64)).astype("<u2").tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * n, pa.int32()), pa.array(np.concatenate(first) if first else [], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(number, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(deeper, pa.binary()), pa.array(sketch, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "digest", "roots", "deeper", "sketch"],
            )

    return take


def _marks(column: pa.Array, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, n)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, least, node, label, deeper, sketch, pivot -> share for pivot: in how much a sketch agrees with the pivot's."""
    for batch in batches:
        if batch.num_rows:
            own, pivot = (_marks(batch.column(i), "<u2", SKETCH) for i in (5, 6))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array((own == pivot).mean(axis=1))], [*batch.schema.names[:6], "share"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that agree in the first column, by which the rows are sorted."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        keys = rest.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] <= keys[-1] else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        if cut:
            yield rest.slice(0, cut).combine_chunks()
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _stars(node: np.ndarray, comp: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of the nodes met in each component, with each other one met there."""
    node, comp = node[met], comp[met]
    order = np.lexsort((node, comp))
    node, comp = node[order], comp[order]
    edges = _bounds(comp)
    first = np.repeat(node[edges[:-1]], np.diff(edges)) if len(node) else node
    return first[first != node], node[first != node]


def _compare(rows: np.ndarray, marks: np.ndarray, comp: np.ndarray, met: np.ndarray) -> None:
    """Join the components of all likely pairs among rows; rows of one component are not compared."""
    own = marks[rows]
    for k in range(1, len(rows)):
        other = np.flatnonzero(comp[rows[:k]] != comp[rows[k]])
        _join(rows[k], rows[other[(own[other] == own[k]).sum(axis=1) >= LIKELY * SKETCH]], comp, met)


def _join(row: int, hit: np.ndarray, comp: np.ndarray, met: np.ndarray) -> None:
    hit = hit[comp[hit] != comp[row]]
    if len(hit):
        met[hit] = met[row] = True
        comp[np.isin(comp, comp[hit])] = comp[row]


def _branched(path: int, level: int, deeper: np.ndarray, marks: np.ndarray, comp: np.ndarray, met: np.ndarray) -> None:
    """Join the components of likely pairs that the subtree of a node finds; a node of one component ends."""
    todo = [(np.arange(len(comp)), level, path)]
    while todo:
        rows, level, path = todo.pop()
        if (comp[rows] == comp[rows[0]]).all():
            continue
        if len(rows) <= SMALL:
            _compare(rows, marks, comp, met)
            continue
        agree = (marks[rows] == marks[rows[0]]).sum(axis=1)
        last = level == DEEP
        _join(rows[0], rows if last else rows[agree >= LIKELY * SKETCH], comp, met)
        rest = rows[agree < ALIKE * SKETCH]
        for branch in range(0 if last else 1 + (path & 1)):
            order = np.argsort(deeper[rest, 2 * level + branch], kind="stable")
            edges = _bounds(deeper[rest[order], 2 * level + branch])
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo > 1:
                    some = rest[order[lo:hi]]
                    below = struct.pack("<QBI", path & (2**64 - 1), 2 * level + branch, deeper[some[0], 2 * level + branch])
                    todo.append((some, level + 1, xxhash.xxh3_64_intdigest(below)))


def _likely_links(level: int | None):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """path, node, label, deeper, sketch, sorted by path -> a, b: in each path, what chains of likely pairs connect, as stars.

        Nodes of one label are known to be connected. Of a level, larger nodes are branched; without one, every pair
        is compared.
        """
        for table in _groups(batches):
            path, node, label = (table.column(i).to_numpy() for i in (0, 1, 2))
            marks = _marks(table.column(4), "<u2", SKETCH)
            deeper = None if level is None else _marks(table.column(3), "<u4", 2 * DEEP)
            edges = _bounds(path)
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            two = two[(label[two] != label[two + 1]) & ((marks[two] == marks[two + 1]).sum(axis=1) >= LIKELY * SKETCH)]
            a, b = [node[two]], [node[two + 1]]
            for k in np.flatnonzero(size > 2):
                lo, hi = edges[k], edges[k + 1]
                comp, met = np.unique(label[lo:hi], return_inverse=True)[1], np.zeros(hi - lo, bool)
                if level is None:
                    _compare(np.arange(hi - lo), marks[lo:hi], comp, met)
                else:
                    _branched(int(path[lo]), level, deeper[lo:hi], marks[lo:hi], comp, met)
                for x, y in zip((a, b), _stars(node[lo:hi], comp, met)):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return link


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _postings(sets: list[np.ndarray]) -> tuple:
    """An inverted index of a group: sizes, documents by shingle, and where each document's lists begin and how long."""
    every, size = np.concatenate(sets), np.array([len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    of = np.repeat(np.arange(len(sets)), size)[order]
    new = np.concatenate([[True], every[order][1:] != every[order][:-1]]) if len(every) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    which = np.empty(len(every), np.int64)
    which[order] = np.cumsum(new) - 1
    return size, of, edge, np.diff(np.append(edge, len(every))), np.split(which, np.cumsum(size)[:-1])


def _links(index: tuple, k: int, percent: int) -> np.ndarray:
    """Which documents of a group are linked with the k-th: all intersections at once, from the lists of its shingles."""
    size, of, edge, length, which = index
    both = np.zeros(len(size), np.int64)
    for at in range(0, len(which[k]), 2048):
        begin, n = edge[which[k][at : at + 2048]], length[which[k][at : at + 2048]]
        place = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        both += np.bincount(of[place], minlength=len(size))
    return (both > 0) & (100 * both >= percent * (size + size[k] - both))


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, node, label, minor, text, sorted by key -> a, b: what confirmed links connect in each key.

        Nodes of one label are known to be connected. Of two that are not minor nothing is compared once any is minor.
        Of the nodes with confirmed links the smallest is paired with each other one that it is connected with.
        """
        for table in _groups(batches):
            key, node, label, minor = (table.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = _bounds(key)
            a, b = [], []
            for lo, hi in zip(edges[:-1], edges[1:]):
                own = {int(n): i for i, n in zip(range(lo, hi), node[lo:hi])}  # rows that repeat once
                rows = list(own.values())
                sets = [shingles(table.column(4)[i].as_py()) for i in rows]
                _, comp = np.unique(label[rows], return_inverse=True)
                flag = minor[rows].astype(bool)
                index, met = None, np.zeros(len(rows), bool)
                for k in range(1, len(rows)):
                    # Most often the document before is of the same group, and there is no other.
                    if not flag.any() and comp[k - 1] != comp[k] and _linked(sets[k - 1], sets[k], percent):
                        met[[k - 1, k]] = True
                        comp[comp == comp[k]] = comp[k - 1]
                    if (comp[:k] == comp[k]).all():
                        continue
                    index = index or _postings(sets)
                    hit = np.flatnonzero((comp[:k] != comp[k]) & _links(index, k, percent)[:k] & (flag[:k] | flag[k] | ~flag.any()))
                    for j in hit:
                        if comp[j] != comp[k]:
                            met[[j, k]] = True
                            comp[comp == comp[k]] = comp[j]
                for x, y in zip((a, b), _stars(node[rows], comp, met)):
                    x += y.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return confirm


def _by_key(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(function, schema)


_PATHS = "path long, least long, node long, label long, deeper binary, sketch binary"


def candidate_groups(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: what the links of the chosen-path forest over reps (node, roots, deeper, sketch) connect.

    In the root of a tree a document chooses the path of its least token under the tree's function; documents in a node
    of up to SMALL are compared by sketch exhaustively. In a larger node all are compared with its first document, the
    pivot; likely pairs are linked, and what is nearly the pivot need not go on. The others branch by their least token
    under one or two functions of this level and tree, as the path draws, level by level: for pairs at the threshold
    more than one child on average holds both, while those of little in common part. What is still together after the
    last level agrees almost wholly and is linked as it is.

    A node of up to LOCAL documents is branched to the end by one task. A larger one takes its step over all tasks; what
    has been connected so far is labelled, and nodes of a single label go no further: their links would connect nothing
    new. Nor do those with few documents outside their most frequent label, once these are compared with the whole node.
    """
    members = reps.select("node", F.posexplode("roots").alias("tree", "token")).select("node", "tree", F.xxhash64("tree", "token").alias("path"))
    counted = members.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    own = F.substring("deeper", F.col("tree") * (8 * DEEP) + 1, 8 * DEEP).alias("deeper")
    members = members.join(counted, "path").join(reps.drop("roots"), "node").select("path", "n", "least", "node", F.col("node").alias("label"), own, "sketch")
    members = scratch.save(members, "level-0")
    known = None
    for level in range(DEEP + 1):
        fitting = members.where(F.col("n") <= LOCAL).select("path", "node", "label", "deeper", "sketch")
        links = scratch.save(_by_key(fitting, "path", _likely_links(level), "a long, b long"), f"links-{level}")
        if known is not None:
            links = links.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
        large = members.where(F.col("n") > LOCAL)
        if large.isEmpty():
            return components(links, scratch, f"known-{level}")
        pivots = large.where("node = least").select("path", F.col("sketch").alias("pivot")).dropDuplicates(["path"])
        beside = large.join(pivots, "path").select("path", "least", "node", "label", "deeper", "sketch", "pivot")
        beside = scratch.save(beside.mapInArrow(_shares, f"{_PATHS}, share double"), f"large-{level}")
        last = level == DEEP
        links = links.unionByName(beside.where(F.lit(last) | (F.col("share") >= LIKELY)).select(F.col("least").alias("a"), F.col("node").alias("b")))
        known = components(links, scratch, f"known-{level}")
        if last:
            return known
        beside = beside.drop("label").join(known, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        parts = beside.groupBy("path", "label").agg(F.count("*").alias("part")).groupBy("path")
        parts = parts.agg(F.max_by("label", F.struct("part", "label")).alias("main"), F.sum("part").alias("n"), (F.sum("part") - F.max("part")).alias("strays")).where("strays > 0")
        beside = scratch.save(beside.join(parts, "path"), f"several-{level}")
        if beside.isEmpty():
            return known
        blocks = F.ceil(F.col("n") / BLOCK)
        block = F.when(F.col("label") != F.col("main"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(6)), blocks)))
        few = beside.where(F.col("strays") <= STRAYS).withColumn("block", F.explode(block))
        few = few.select(F.xxhash64("path", "block").alias("path"), "node", "label", "deeper", "sketch")
        strays = scratch.save(_by_key(few, "path", _likely_links(None), "a long, b long"), f"strays-{level}")
        known = components(strays.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch, f"all-{level}")
        branch = F.explode(F.when(F.col("path") % 2 != 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        rest = beside.where((F.col("strays") > STRAYS) & (F.col("share") < ALIKE)).withColumn("branch", branch)
        token = F.expr(f"substring(deeper, 4 * ({2 * level} + branch) + 1, 4)")
        rest = rest.select("node", "label", "deeper", "sketch", F.xxhash64("path", "branch", token).alias("path"))
        counted = rest.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("least"), (F.min("label") < F.max("label")).alias("several")).where("several").drop("several")
        members = scratch.save(rest.join(counted, "path"), f"level-{level + 1}")
    return known


def _confirm_large(texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """node, root: what confirmed links connect in groups of over GROUP nodes. texts: blob, n, node, text.

    First the nodes of every block are compared with each other and with a few that all blocks share; as soon as two
    are connected they need no more comparisons. Then what is not connected with the largest component of its blob is
    compared with all blocks, block by block; so no pair is left out, though most need no look.
    """
    blocks = F.ceil(F.col("n") / (GROUP // 2))
    dealt = scratch.save(texts, "large-texts").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), blocks))
    shared = F.pmod(F.xxhash64("node", F.lit(4)), F.col("n")) < 8
    spread = dealt.withColumn("block", F.explode(F.when(shared, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array("block"))))
    rows = spread.select(F.xxhash64("blob", "block").alias("key"), "node", F.col("node").alias("label"), F.lit(False).alias("minor"), "text")
    first = scratch.save(_by_key(rows, "key", _confirmed(percent), "a long, b long"), "sure-1")
    roots = components(first, scratch, "large")
    labelled = dealt.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    of = labelled.groupBy("blob", "label").count()
    most = of.groupBy("blob").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    most = scratch.save(most, "parted")
    if most.isEmpty():
        return roots
    left = labelled.join(most, "blob").withColumn("minor", F.col("label") != F.col("main"))
    counts = left.groupBy("blob").agg(F.count(F.when(F.col("minor"), 1)).alias("minors")).withColumn("rounds", F.ceil(F.col("minors") / (GROUP // 2)))
    left = left.join(counts, "blob").withColumn("round", F.pmod(F.xxhash64("node", F.lit(5)), F.col("rounds")))
    every = F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)
    members = left.withColumn("round", F.explode(every)).select("blob", "round", "block", "node", "label", "minor", "text")
    minors = left.where("minor").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select("blob", "round", "block", "node", "label", "minor", "text")
    # A member that is minor counts as such only in its own round, where it is sent to every block.
    pairs = members.where("not minor").unionByName(members.where("minor").withColumn("minor", F.lit(False))).unionByName(minors)
    rows = pairs.groupBy("blob", "round", "block", "node", "label").agg(F.max("minor").alias("minor"), F.first("text").alias("text"))
    rows = rows.select(F.xxhash64("blob", "round", "block").alias("key"), "node", "label", "minor", "text")
    more = _by_key(rows, "key", _confirmed(percent), "a long, b long").unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(more, scratch, "sure-2")


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, text_key.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of five-word shingles;
    component_id is the smallest doc_id that can be reached over links, and one row of each component is kept: that
    with this id. Documents with equal sets are one class, of which a representative takes part: copies are never
    expanded into pairs. The chosen-path forest only says which classes may belong together; every link is confirmed
    on the full sets. A pair at the threshold shares a leaf of some tree with probability recall at least (see trees);
    every tree has functions of its own. Its sketch then hides it with 2e-7; more alike pairs are missed less.

    A null text counts as empty; documents without words have no shingles and are linked with nothing. Repeated rows
    are of one class. A null doc_id comes after all others; a component of such rows only has a null id. Of rows with
    the smallest id of a component one is kept; where such rows have the same doc_id and text_key they may be told
    apart by nothing. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near_dedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    schema = "doc_id long, text_key long, n_shingles long, digest binary, roots array<int>, deeper binary, sketch binary"
    rows = scratch.save(texts.mapInArrow(_sketches(trees(recall, percent)), schema).withColumn("row", F.monotonically_increasing_id()), "sketches")
    smallest = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "row")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(smallest).alias("least"), F.count("*").alias("n"))
    classes = scratch.save(classes.withColumn("node", F.col("least.row")), "classes")
    reps = rows.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    reps = reps.select("node", "roots", "deeper", "sketch")

    blobs = candidate_groups(scratch.save(reps, "reps"), scratch).withColumnRenamed("root", "blob")
    sizes = scratch.save(blobs.groupBy("blob").agg(F.count("*").alias("n")), "sizes")
    count, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    active = blobs.join(classes.select("node", F.col("least.doc_id").alias("id"), F.col("least.text_key").alias("key")), "node")
    active = bounded(scratch.save(active.join(sizes, "blob"), "active"), count, 40)
    found = texts.join(active, texts["doc_id"].eqNullSafe(active["id"]) & (texts["text_key"] == active["key"])).select("blob", "n", "node", "text")
    small = found.where(F.col("n") <= GROUP).select(F.col("blob").alias("key"), "node", F.col("node").alias("label"), F.lit(False).alias("minor"), "text")
    # A group of up to GROUP is whole in its task, which so knows its components.
    links = scratch.save(_by_key(small, "key", _confirmed(percent), "a long, b long"), "confirmed")
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    if most > GROUP:
        roots = roots.unionByName(_confirm_large(found.where(F.col("n") > GROUP), percent, scratch))

    member = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = member.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("size")).where("size > 1")
    member = scratch.save(member.join(whole.select("root", F.col("least").alias("top")), "root").select("digest", "n", F.col("top.doc_id").alias("component_id"), F.col("top.row").alias("first")), "member")
    limit = max(1000, rows.count() // HOT_GROUPS)
    rows = rows.select("doc_id", "text_key", "n_shingles", "digest", "row")
    hot = F.broadcast(member.where(F.col("n") > limit))  # at most HOT_GROUPS rows
    out = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(member.where(F.col("n") <= limit), "digest", "left"), allowMissingColumns=True)
    alone = F.col("n").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("row") == F.col("first"))).alias("kept"), "text_key")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicates among all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_key")
