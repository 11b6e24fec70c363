"""Counts and schema, found from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import field
from ..shared import counted, sized
from .filters import NodeFilter

SAMPLE = 500


def count_nodes(nodes: DataFrame, edges: DataFrame, where: NodeFilter = NodeFilter(), by: str = "type", order: str = "count", limit: int | None = None) -> DataFrame:
    """name, count of nodes by type, label, extension (of files) or, with "", of all."""
    df = where.apply(nodes, edges)
    if by == "label":
        df = df.select(F.explode("labels").alias("name"))
    elif by == "extension":
        df = df.where("type = 'fs:file'").select(field("data", "ext").alias("name")).where("name <> ''")
    else:
        df = df.select((F.col("type") if by else F.lit("")).alias("name"))
    return _ordered(df.groupBy("name").agg(F.count("*").alias("count")), order, limit)


def count_edges(nodes: DataFrame, edges: DataFrame, source: NodeFilter | None = None, target: NodeFilter | None = None, types: Sequence[str] = (), by: str = "type", order: str = "count", limit: int | None = None) -> DataFrame:
    """name, count of edges by type or of all, whose ends the filters let through."""
    df = edges.where(F.col("type").isin(list(types))) if types else edges
    for end, where in (("from_id", source), ("to_id", target)):
        if where is not None:
            df = df.join(where.apply(nodes, edges).select(F.col("id").alias(end)), end, "left_semi")
    return _ordered(df.groupBy((F.col("type") if by else F.lit("")).alias("name")).agg(F.count("*").alias("count")), order, limit)


def _ordered(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    df = df.orderBy(F.desc("count"), "name") if order == "count" else df.orderBy("name")
    return df.limit(limit) if limit else df


def narrowed(counts: DataFrame, prefix: str = "", order: str = "count", limit: int | None = None) -> DataFrame:
    """Counts whose name begins with a prefix."""
    return _ordered(counts.where(F.col("name").startswith(prefix)), order, limit)


def describe_nodes(nodes: DataFrame) -> DataFrame:
    """type, count of all nodes, expired ones too, most first."""
    return nodes.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def describe_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """type, count, connections [(from_type, to_type, count)] of the edges whose ends are there, most first."""
    ends = edges.join(nodes.select(F.col("id").alias("from_id"), F.col("type").alias("from_type")), "from_id").join(nodes.select(F.col("id").alias("to_id"), F.col("type").alias("to_type")), "to_id")
    by = ends.groupBy("type", "from_type", "to_type").agg(F.count("*").alias("count"))
    most = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "from_type", "to_type", "count")))
    out = by.groupBy("type").agg(F.sum("count").alias("total"), most.alias("c"))
    return out.select("type", F.col("total").alias("count"), F.transform("c", lambda x: F.struct(x["from_type"].alias("from_type"), x["to_type"].alias("to_type"), x["count"].alias("count"))).alias("connections")).orderBy(F.desc("count"), "type")


def describe_fields(nodes: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """type, field: the keys of data in a sample of so many nodes of each type, the first by id."""
    n = Window.partitionBy("type").orderBy("id")
    some = nodes.where("data IS NOT NULL").withColumn("_n", F.row_number().over(n)).where(F.col("_n") <= sample)
    return some.select("type", F.explode(F.json_object_keys(F.to_json("data"))).alias("field")).distinct().orderBy("type", "field")


def stats(nodes: DataFrame, edges: DataFrame, scope: str | None = None, top: int = 10) -> DataFrame:
    """section, name, count: node types, edge types, extensions (the top ones) and labels, of all or of a scope."""
    inner, own = nodes, edges
    if scope:
        inner, count = counted(NodeFilter(scope=scope).apply(nodes, edges).select("id", "type", "labels", "data"))
        own = edges.join(sized(inner.select(F.col("id").alias("from_id")), count, "from_id"), "from_id", "left_semi")
    parts = [("types", count_nodes(inner, own)), ("edges", count_edges(inner, own)), ("extensions", count_nodes(inner, own, by="extension", limit=top)), ("labels", count_nodes(inner, own, by="label"))]
    out = None
    for section, df in parts:
        part = df.select(F.lit(section).alias("section"), "name", "count")
        out = part if out is None else out.unionByName(part)
    return out


def info(nodes: DataFrame, edges: DataFrame, runs: DataFrame | None = None) -> dict:
    """A few totals: nodes, edges, orphans, projects by language, the latest run."""
    from .store import orphan_edges

    langs = nodes.where("type = 'project:root'").groupBy(field("data", "language").alias("language")).count()
    last = runs.orderBy(F.desc("finished_at")).limit(1).collect() if runs is not None else []
    return {"nodes": nodes.count(), "edges": edges.count(), "orphans": orphan_edges(nodes, edges).count(), "projects": {r["language"]: r["count"] for r in langs.collect()}, "last_run": last[0].asDict() if last else None}
