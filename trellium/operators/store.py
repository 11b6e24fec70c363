"""Writing, upserts, staleness, expiry and garbage, over whole tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EDGE, EMBEDDING, NODE, RUN, EngineError, conform, empty
from ..shared import settled


def _latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def _numbered(batch: DataFrame, order: str | None) -> DataFrame:
    """batch with the order of its rows; made-up numbers are written, as a plan that ran twice could give others."""
    return batch.withColumn("_seq", F.col(order)) if order else settled(batch.withColumn("_seq", F.monotonically_increasing_id()))


def upsert_nodes(base: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """base with batch written over it by id: all but created_at (and root) is replaced, the last row of an id counts.

    batch may carry an order column of its own; else its rows of one id must agree, or any is taken.
    """
    _unique_uris(base, batch)
    new = _numbered(batch, order)
    first = new.groupBy("id").agg(F.min_by("created_at", "_seq").alias("_first"))
    new = _latest(new, ["id"], "_seq").drop("_seq", *([order] if order else [])).join(first, "id")
    old = base.select("id", F.col("created_at").alias("_old"), F.col("root").alias("_root"), F.lit(True).alias("_known"))
    merged = new.join(old, "id", "left")
    created, root = F.when(F.col("_known"), F.col("_old")).otherwise(F.col("_first")), F.when(F.col("_known"), F.col("_root")).otherwise(F.col("root"))
    merged = merged.withColumns({"created_at": created, "root": root}).select(*base.columns)
    return base.join(new.select("id"), "id", "left_anti").select(*base.columns).unionByName(merged)


def _unique_uris(base: DataFrame, batch: DataFrame) -> None:
    """A URI that is not empty belongs to one id."""
    left = base.join(batch.select("id").distinct(), "id", "left_anti").select("id", "uri").unionByName(batch.select("id", "uri")).where("uri <> ''")
    clash = left.groupBy("uri").agg(F.count_distinct("id").alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise EngineError(f"uri {clash[0]['uri']} belongs to several nodes")


def upsert_edges(base: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """base with batch written over it by (type, from_id, to_id): id and created_at of the first writing stay."""
    keys = ["type", "from_id", "to_id"]
    new = _numbered(batch, order)
    first = new.groupBy(*keys).agg(F.min_by(F.struct("id", "created_at"), "_seq").alias("_first"))
    new = _latest(new, keys, "_seq").drop("_seq", *([order] if order else [])).join(first, keys)
    merged = new.join(base.select(*keys, F.struct("id", "created_at").alias("_old")), keys, "left")
    kept = F.coalesce("_old", "_first")
    merged = merged.withColumns({"id": kept["id"], "created_at": kept["created_at"]}).select(*base.columns)
    return base.join(new.select(*keys), keys, "left_anti").select(*base.columns).unionByName(merged)


def upsert_embeddings(base: DataFrame, batch: DataFrame) -> DataFrame:
    """base with batch written over it by node_id; of several rows of one id in a batch the greatest vector counts."""
    new = batch.groupBy("node_id").agg(F.max("embedding").alias("embedding"))
    return base.join(new.select("node_id"), "node_id", "left_anti").select("node_id", "embedding").unionByName(new)


def stale_edges(nodes: DataFrame, edges: DataFrame, generation: str, *uri_prefixes: str) -> DataFrame:
    """Edges of another generation (null is none) that start at a node whose URI has one of the prefixes."""
    own = nodes.where(reduce(Column.__or__, (F.col("uri").startswith(p) for p in uri_prefixes))).select(F.col("id").alias("from_id"))
    return edges.where(F.col("generation") != generation).join(own, "from_id", "left_semi").select(*edges.columns)


def stale(df: DataFrame, generation: str, uri_prefix: str | None = None) -> DataFrame:
    """Rows of another generation (null is none), under a prefix of their URI."""
    out = df.where(F.col("generation") != generation)
    return out.where(F.col("uri").startswith(uri_prefix)) if uri_prefix else out


def fresh(df: DataFrame, generation: str, uri_prefix: str | None = None) -> DataFrame:
    """What is left once stale rows are deleted."""
    gone = F.col("generation") != generation
    gone = gone & F.col("uri").startswith(uri_prefix) if uri_prefix else gone
    return df.where(~F.coalesce(gone, F.lit(False)))


def without_prefix(nodes: DataFrame, uri_prefix: str) -> DataFrame:
    return nodes.where(~F.coalesce(F.col("uri").startswith(uri_prefix), F.lit(False)))


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges one of whose ends is not there; expiry does not matter."""
    ids = nodes.select("id")
    ends = edges.join(ids.select(F.col("id").alias("_f")), F.col("from_id") == F.col("_f"), "left").join(ids.select(F.col("id").alias("_t")), F.col("to_id") == F.col("_t"), "left")
    return ends.where("_f IS NULL OR _t IS NULL").select(*edges.columns)


def connected_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    out = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return out.select(*edges.columns)


def expired(df: DataFrame, now: int | None = None) -> DataFrame:
    return df.where(F.col("expires_at") <= (F.unix_timestamp() if now is None else F.lit(now)))


def unexpired(df: DataFrame, now: int | None = None) -> DataFrame:
    at = F.unix_timestamp() if now is None else F.lit(now)
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > at))


def with_ttl(df: DataFrame, seconds: int, now: int | None = None) -> DataFrame:
    """Rows that expire in so many seconds, or never for 0 or less."""
    at = F.unix_timestamp() if now is None else F.lit(now)
    return df.withColumn("expires_at", (at + seconds).cast("long") if seconds > 0 else F.lit(None).cast("long"))


def garbage(nodes: DataFrame, edges: DataFrame, now: int | None = None) -> DataFrame:
    """what, count that a collection would remove: expired nodes and edges, then edges that are orphans without them."""
    left = unexpired(nodes, now), unexpired(edges, now)
    parts = [("expired_nodes", expired(nodes, now)), ("expired_edges", expired(edges, now)), ("orphan_edges", orphan_edges(*left))]
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("count")).select(F.lit(n).alias("what"), "count") for n, df in parts))


def collect_garbage(nodes: DataFrame, edges: DataFrame, now: int | None = None) -> tuple[DataFrame, DataFrame]:
    nodes = unexpired(nodes, now)
    return nodes, connected_edges(nodes, unexpired(edges, now))


class Store:
    """Tables in a folder, each version a folder of its own; the last one that is whole counts.

    A version is whole once its mark _SUCCESS is there, which Spark writes after all else. So a writer that dies at any
    time leaves the version before it current, and the last version but one stays for frames that read it still. Tables
    are written as Parquet; nodes and edges are
    sorted by type and id within files, so that a type or id prefix reads few row groups.
    """

    TABLES = {"nodes": NODE, "edges": EDGE, "embeddings": EMBEDDING, "index_runs": RUN}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, table: str) -> list[str]:
        """The versions that are whole, the current one first."""
        fs, p = self._fs(f"{self.folder}/{table}")
        names = sorted((f.getPath().getName() for f in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
        return [n for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.folder}/{table}/{n}/_SUCCESS")[1])]

    def read(self, table: str) -> DataFrame:
        known = self._versions(table)
        if not known:
            return empty(self.spark, self.TABLES[table])
        return conform(self.spark.read.parquet(f"{self.folder}/{table}/{known[0]}"), self.TABLES[table])

    def write(self, table: str, df: DataFrame) -> None:
        known = self._versions(table)
        version = f"v{int(known[0][1:13]) + 1 if known else 0:012d}-{uuid.uuid4().hex[:8]}"
        rows = conform(df, self.TABLES[table])
        if table in ("nodes", "edges"):
            rows = rows.sortWithinPartitions("type", "id")
        rows.write.parquet(f"{self.folder}/{table}/{version}")
        for old in known[1:]:
            fs, p = self._fs(f"{self.folder}/{table}/{old}")
            fs.delete(p, True)

    def append_run(self, **values) -> None:
        row = self.spark.createDataFrame([tuple(values.get(c.split(" ")[0]) for c in RUN.split(", "))], RUN)
        self.write("index_runs", self.read("index_runs").unionByName(row))

    def latest_run(self) -> DataFrame:
        return self.read("index_runs").orderBy(F.desc("finished_at")).limit(1)
