"""Neighbours, descendants, ancestors, paths, trees and impact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import display_name
from ..functions.scalars import field as json_field
from ..model import NodeNotFound
from ..plans.paths import distances, of_types, oriented, reachable
from ..shared import settled

DEPTH, PATHS = 6, 3


def descendants(edges: DataFrame, roots: DataFrame, types: Sequence[str] = ("contains", "has")) -> DataFrame:
    """id of the roots and of all under them, each once; cycles end."""
    return reachable(oriented(of_types(edges, types), "out"), roots, 0, None)


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "both", types: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """direction, edge_type, edge_id and the node for each edge at a node; outgoing first, then by the other node's id, then by edge id.

    Edges to nodes that are not there are skipped.
    """
    if nodes.where(F.col("id") == node_id).isEmpty():
        raise NodeNotFound(node_id)
    kept = of_types(edges, types) if types else edges
    parts = []
    if direction in ("out", "both"):
        parts.append(kept.where(F.col("from_id") == node_id).select(F.lit("out").alias("direction"), F.col("type").alias("edge_type"), F.col("id").alias("edge_id"), F.col("to_id").alias("id")))
    if direction in ("in", "both"):
        parts.append(kept.where(F.col("to_id") == node_id).select(F.lit("in").alias("direction"), F.col("type").alias("edge_type"), F.col("id").alias("edge_id"), F.col("from_id").alias("id")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = found.join(nodes, "id").orderBy(F.col("direction").desc(), "id", "edge_id")
    return out.limit(most) if most else out


def neighbor_nodes(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "both") -> DataFrame:
    """The different nodes next to a node."""
    hops = oriented(edges, {"both": "any"}.get(direction, direction)).where(F.col("src") == node_id)
    return nodes.join(hops.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")


def children(nodes: DataFrame, edges: DataFrame, node_id: str, types: Sequence[str] = ("contains", "has")) -> DataFrame:
    ids = of_types(edges, types).where(F.col("from_id") == node_id).select(F.col("to_id").alias("id"))
    return nodes.join(ids, "id", "left_semi")


def parents(nodes: DataFrame, edges: DataFrame, node_id: str, types: Sequence[str] = ("contained_by", "belongs_to")) -> DataFrame:
    return children(nodes, edges, node_id, types)


def ancestors(edges: DataFrame, starts: DataFrame, types: Sequence[str] = ("contained_by", "belongs_to")) -> DataFrame:
    """start, depth, id: the chain of first parents (by edge id) of each start (id), nearest first; cycles end."""
    first = Window.partitionBy("from_id").orderBy("id")
    up = of_types(edges, types).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("from_id").alias("_from"), F.col("to_id").alias("_to"))
    front = starts.select(F.col("id").alias("start"), F.lit(0).alias("depth"), "id", F.array("id").alias("_seen"))
    out = None
    while True:
        front = front.join(up, F.col("id") == F.col("_from")).where(~F.array_contains("_seen", F.col("_to")))
        front = front.select("start", (F.col("depth") + 1).alias("depth"), F.col("_to").alias("id"), F.concat("_seen", F.array("_to")).alias("_seen"))
        front = settled(front)
        if front.isEmpty():
            break
        out = front if out is None else out.unionByName(front)
    return (front if out is None else out).drop("_seen")


def find_paths(nodes: DataFrame, edges: DataFrame, start: str, goal: str, max_depth: int = DEPTH, max_paths: int = PATHS, types: Sequence[str] = ()) -> DataFrame:
    """length, steps: the shortest simple paths over edges in either direction, shortest first, then by their steps.

    A step is (node_id, edge_type, incoming). Paths go on while fewer than max_paths have arrived; each leaves out the
    nodes it has been to. To prune, only nodes within reach of the goal by what is left of the depth are entered.
    """
    if nodes.where(F.col("id") == start).isEmpty():
        raise NodeNotFound(start)
    kept = of_types(edges, types) if types else edges
    known = nodes.select(F.col("id").alias("dst"))
    out = kept.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("type").alias("edge_type"), F.lit(False).alias("incoming"))
    back = kept.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), F.col("type").alias("edge_type"), F.lit(True).alias("incoming"))
    hops = out.unionByName(back).where("src <> dst").join(known, "dst", "left_semi")
    step = "array<struct<node_id:string,edge_type:string,incoming:boolean>>"
    spark = nodes.sparkSession
    front = spark.createDataFrame([(start,)], "at string").select("at", F.array("at").alias("seen"), F.array().cast(step).alias("steps"))
    back_hops = hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = settled(distances(back_hops, spark.createDataFrame([(goal,)], "id string"), max_depth - 1))
    done, found = None, 0
    for depth in range(1, max_depth + 1) if start != goal else ():
        ahead = hops.join(near.where(F.col("distance") <= max_depth - depth).select("id"), F.col("dst") == F.col("id"), "left_semi")
        front = front.join(ahead, front["at"] == ahead["src"]).where(~F.array_contains("seen", F.col("dst")))
        one = F.array(F.struct(F.col("dst").alias("node_id"), "edge_type", "incoming"))
        front = front.select(F.col("dst").alias("at"), F.concat("seen", F.array("dst")).alias("seen"), F.concat("steps", one).alias("steps"))
        front = settled(front)
        here = front.where(F.col("at") == goal).select(F.lit(depth).alias("length"), "steps")
        done = here if done is None else done.unionByName(here)
        found += here.count()
        front = front.where(F.col("at") != goal)
        if found >= max_paths or front.isEmpty():
            break
    if done is None:
        return spark.createDataFrame([], f"length int, steps {step}")
    return done.orderBy("length", "steps").limit(max_paths)


def tree(nodes: DataFrame, edges: DataFrame, root: str, depth: int = 3, types: Sequence[str] = (), below: Sequence[str] = ("contains", "has")) -> DataFrame:
    """depth, id, name, more and sort, in the order a tree is printed; depth 0 has no limit.

    With types, only nodes of those types and what leads to them are shown. more is how many children a node on the
    last level has. A node that several lead to is shown under each, but never under itself.
    """
    hops = of_types(edges, below).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()
    shown = nodes.select("id", display_name().alias("name"), "type")
    if types:
        kept = shown.where(F.col("type").isin(list(types))).select("id")
        above = reachable(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst")), kept, 0, None)
        shown = shown.join(above, "id", "left_semi")
    front = shown.where(F.col("id") == root).select(F.lit(0).alias("depth"), "id", "name", F.array("id").alias("seen"), F.array(F.struct("name", "id")).alias("sort"))
    out, level = front, 0
    while not depth or level < depth:
        level += 1
        front = front.select(F.col("id").alias("src"), "seen", "sort").join(hops, "src").where(~F.array_contains("seen", F.col("dst")))
        front = front.join(shown, front["dst"] == shown["id"])
        front = front.select(F.lit(level).alias("depth"), "id", "name", F.concat("seen", F.array("id")).alias("seen"), F.concat("sort", F.array(F.struct("name", "id"))).alias("sort"))
        front = settled(front)
        if front.isEmpty():
            break
        out = out.unionByName(front)
    more = hops.join(shown.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_below"))
    out = out.join(more, "id", "left")
    last = F.col("depth") == depth if depth else F.lit(False)
    return out.select("depth", "id", "name", F.when(last, F.coalesce("_below", F.lit(0))).otherwise(0).alias("more"), "sort").orderBy("sort")


def tree_text(rows: DataFrame) -> str:
    """The tree as lines; its depth and so its size are bounded by the caller."""
    lines = []
    for r in rows.collect():
        lines.append("  " * r["depth"] + r["name"] + (f" (+{r['more']} items)" if r["more"] else ""))
    return "\n".join(lines)


def resolve(nodes: DataFrame, reference: str) -> str:
    """The id that a URI, else a name, else an id stands for; of several the smallest."""
    rank = F.when(F.col("uri") == reference, 0).when(F.col("name") == reference, 1).when(F.col("id") == reference, 2)
    got = nodes.select("id", rank.alias("r")).where("r IS NOT NULL").orderBy("r", "id").limit(1).collect()
    if not got:
        raise NodeNotFound(reference)
    return got[0]["id"]


def impact(nodes: DataFrame, edges: DataFrame, symbol: str) -> tuple[DataFrame, DataFrame]:
    """What refers to a symbol, by package, and who imports those packages.

    First (package, refs, kinds): go:ref nodes with a references edge to a node of that name, grouped by the directory
    of their URI. Second (package, importer): sources of imports edges to the nodes of those packages.
    """
    targets = nodes.where((F.col("name") == symbol) & (F.col("type") != "go:ref")).select(F.col("id").alias("to_id"))
    hits = edges.where("type = 'references'").join(targets, "to_id", "left_semi").select(F.col("from_id").alias("id"))
    refs = nodes.where("type = 'go:ref'").join(hits, "id", "left_semi")
    package = F.regexp_replace(F.regexp_replace("uri", r"#.*$", ""), r"/[^/]*$", "")
    by = refs.groupBy(package.alias("package")).agg(F.count("*").alias("refs"), F.array_sort(F.collect_set(F.try_variant_get("data", "$.kind", "string"))).alias("kinds"))
    packages = nodes.where("type = 'go:package'").join(by.select(F.col("package").alias("uri")), "uri", "left_semi").select(F.col("id").alias("to_id"), F.col("uri").alias("package"))
    importers = edges.where("type = 'imports'").join(packages, "to_id").join(nodes.select(F.col("id").alias("from_id"), F.col("name").alias("importer")), "from_id")
    return by, importers.select("package", "importer").distinct()


def enclosing(extents: DataFrame, positions: DataFrame) -> DataFrame:
    """file, pos, owner: for each position the extent (file, start, stop, owner) with start <= pos < stop.

    An as-of join without a range join: both are put in order, and the last extent that began is the answer if it
    still holds. Extents of one file must not overlap, nor nest: beyond an inner one's end a position would have no owner. A file of any size is
    dealt out in ranges: each range has a window of its own, and takes over the last extent of the ranges before.
    """
    marks = extents.select("file", F.col("start").alias("at"), F.lit(0).alias("_kind"), F.struct("owner", "stop", "start").alias("_x"))
    marks = marks.unionByName(positions.select("file", F.col("pos").alias("at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_x"].dataType).alias("_x")))
    marks = settled(marks.repartitionByRange("file", "at", "_kind").withColumn("_range", F.spark_partition_id()))
    w = Window.partitionBy("file", "_range").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = marks.groupBy("file", "_range").agg(F.max_by("_x", F.when(F.col("_kind") == 0, F.col("at"))).alias("_x"))
    ranges = ranges.select(F.col("file").alias("_file"), F.col("_range").alias("_of"), F.last("_x", ignorenulls=True).over(before).alias("_carried"))
    seen = marks.withColumn("_last", F.last("_x", ignorenulls=True).over(w)).where("_kind = 1")
    seen = seen.join(ranges.where("_carried IS NOT NULL"), F.col("file").eqNullSafe(F.col("_file")) & (F.col("_range") == F.col("_of")), "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return seen.select("file", F.col("at").alias("pos"), F.when(F.col("_last.stop") > F.col("at"), F.col("_last.owner")).alias("owner"))


def implementations(structs: DataFrame, interfaces: DataFrame) -> DataFrame:
    """struct, interface for each struct (struct, method) that has all methods of an interface (interface, method).

    Relational division: methods both have, counted, against how many the interface has.
    """
    need = interfaces.distinct().groupBy("interface").agg(F.count("*").alias("_need"))
    have = structs.distinct().join(interfaces.distinct(), "method").groupBy("struct", "interface").agg(F.count("*").alias("_have"))
    return have.join(need, "interface").where("_have = _need").select("struct", "interface")


def calls(pairs: DataFrame) -> DataFrame:
    """One calls edge for each different (caller, callee)."""
    from ..model import make_edges

    return make_edges(pairs.dropDuplicates(["caller", "callee"]).select(F.lit("calls").alias("type"), F.col("caller").alias("from_id"), F.col("callee").alias("to_id")))


#: Edge types that lead from a node to what holds it (fixed values).
UPWARD = ["contained_by", "belongs_to", "located_at"]


def navigation(nodes: DataFrame, edges: DataFrame, node_id: str, page: int = 20, offset: int = 0, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of a node's edges by type and side, and one page of each group by name, those from offset on.

    group is parent for what the node's edges of UPWARD lead to, child for its other edges, and in for edges to it. where
    speaks of the nodes on the page. One node's groups are ranked in one task each, as a page needs.
    """
    hops = oriented(edges, "out").where(F.col("src") == node_id).select("type", F.lit("out").alias("side"), "dst").unionByName(
        oriented(edges, "in").where(F.col("src") == node_id).select("type", F.lit("in").alias("side"), "dst")
    )
    counts = hops.groupBy("side", "type").count()
    group = F.when(F.col("side") == "in", "in").when(F.col("edge_type").isin(UPWARD), "parent").otherwise("child")
    shown = nodes if where is None else nodes.where(where)
    rows = hops.withColumnRenamed("type", "edge_type").join(shown, F.col("dst") == F.col("id"))
    rows = rows.withColumns({"group": group, "_n": F.row_number().over(Window.partitionBy("side", "edge_type").orderBy("name", "id"))})
    return counts, rows.where((F.col("_n") > offset) & (F.col("_n") <= offset + page)).drop("_n", "dst")


def siblings(nodes: DataFrame, edges: DataFrame, node_id: str, page: int = 20, offset: int = 0) -> DataFrame:
    """A page by name of what the first parent contains, or has if it contains nothing; the node itself is among them."""
    up = edges.where((F.col("from_id") == node_id) & F.col("type").isin("contained_by", "belongs_to"))
    first = up.join(nodes.select(F.col("id").alias("to_id"), "name"), "to_id").orderBy("type", "name", "to_id").limit(1).select(F.col("to_id").alias("from_id"))
    below = edges.where(F.col("type").isin("contains", "has")).join(F.broadcast(first), "from_id", "left_semi").select("type", "to_id")
    kinds = below.agg(F.min("type").alias("type"))
    held = below.join(F.broadcast(kinds), "type", "left_semi").select(F.col("to_id").alias("id")).distinct()
    out = nodes.join(held, "id", "left_semi").orderBy("name", "id")
    return (out.offset(offset) if offset else out).limit(page)


def document_children(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """place and the columns of the sections and code blocks that a document or section has, in the order of the text."""
    held = edges.where((F.col("type") == "has") & (F.col("from_id") == node_id)).select(F.col("to_id").alias("id"))
    place = F.coalesce(json_field("data", "position.line", "int"), json_field("data", "position", "int"), F.lit(0))
    return nodes.where(F.col("type").isin("md:section", "md:codeblock")).join(held, "id", "left_semi").select(place.alias("place"), "*").orderBy("place", "id")


def document_text(nodes: DataFrame, edges: DataFrame, node_id: str) -> str:
    """A document or section with all below it as markdown.

    The parts below are found level by level on the cluster; only those of the one document are fetched, to be joined.
    """
    parts = nodes.where(F.col("type").isin("md:document", "md:section", "md:codeblock"))
    has = edges.where("type = 'has'").select("from_id", "to_id")
    ids = nodes.sparkSession.createDataFrame([(node_id,)], "id string")
    under = reachable(has.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), ids, 0, None)
    place = F.coalesce(json_field("data", "position.line", "int"), json_field("data", "position", "int"), F.lit(0))
    kept = parts.join(under, "id", "left_semi").select("id", "type", "name", place.alias("place"), json_field("data", "level", "int").alias("level"), json_field("data", "content").alias("content"))
    up = has.join(kept.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id"), F.col("from_id").alias("above"))
    rows = {r["id"]: r for r in kept.collect()}
    if node_id not in rows:
        raise NodeNotFound(node_id)
    below: dict[str, list] = {}
    for r in up.join(kept.select("id"), "id", "left_semi").collect():
        below.setdefault(r["above"], []).append(rows[r["id"]])
    out, todo = [], [rows[node_id]]
    while todo:
        r = todo.pop()
        if r["type"] == "md:codeblock":
            out.append(f"```{r['name'] or ''}\n{(r['content'] or '').rstrip(chr(10))}\n```\n")
        elif r["type"] == "md:section":
            out.append("#" * (r["level"] or 1) + f" {r['name']}\n" + (f"\n{r['content']}\n" if r["content"] else ""))
        todo += sorted(below.get(r["id"], []), key=lambda x: (x["place"], x["id"]), reverse=True)
    return "\n".join(out)
