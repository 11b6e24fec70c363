"""The data model: node and edge tables, their types, and the views without expired rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import edge_id, short_id

NODE = (
    "id STRING, type STRING, uri STRING, key STRING, name STRING, labels ARRAY<STRING>, data VARIANT, generation STRING, "
    "root STRING, created_at STRING, updated_at STRING, expires_at BIGINT"
)
EDGE = "id STRING, type STRING, from_id STRING, to_id STRING, data VARIANT, generation STRING, created_at STRING, expires_at BIGINT"
EMBEDDING = "node_id STRING, embedding ARRAY<FLOAT>"
RUN = (
    "started_at STRING, finished_at STRING, duration_ms BIGINT, root_path STRING, files_indexed BIGINT, dirs_indexed BIGINT, "
    "repos_indexed BIGINT, stale_removed BIGINT, generation STRING"
)
NODE_COLUMNS = ["id", "type", "uri", "key", "name", "labels", "data", "generation", "root", "created_at", "updated_at"]
EDGE_COLUMNS = ["id", "type", "from_id", "to_id", "data", "generation", "created_at"]
ROW_COLUMNS = NODE_COLUMNS[:8]

#: Node types and edge types that are known from the start (fixed values).
NODE_TYPES = {
    "fs": ["dir", "file", "link"],
    "vcs": ["repo", "remote", "branch", "tag", "commit"],
    "md": ["document", "section", "codeblock", "link", "image"],
    "go": ["module", "package", "struct", "interface", "func", "method", "field", "const", "var", "ref"],
    "project": ["root", "license"],
    "code": ["todo"],
}
EDGE_TYPES = [
    "contains", "contained_by", "has", "belongs_to", "located_at", "links_to", "references", "depends_on", "imports",
    "defines", "implements", "tests", "calls", "embeds", "parent_of", "modifies",
]


class _Names:
    """Type names as attributes: NodeType.fs_file is fs:file, EdgeType.contains is contains."""

    def __init__(self, names: list[str]):
        self.__dict__.update({n.replace(":", "_"): n for n in names})

    def __iter__(self):
        return iter(self.__dict__.values())


NodeType = _Names([f"{domain}:{name}" for domain, names in NODE_TYPES.items() for name in names])
EdgeType = _Names(EDGE_TYPES)


class EngineError(Exception):
    """Base of this package's errors."""


class QueryError(EngineError):
    """A query that can't be run; phase is validate, compile or execute."""

    def __init__(self, phase: str, message: str):
        super().__init__(f"{phase}: {message}")
        self.phase = phase


class NodeNotFound(EngineError):
    pass


class EdgeNotFound(EngineError):
    pass


class NoEmbeddingProvider(EngineError):
    pass


class NoSource(EngineError):
    pass


class RegistryError(EngineError):
    pass


@dataclass
class Registry:
    """Allowed node types, and edge types with the node types they may lead from and to (empty: any)."""

    nodes: set[str] = field(default_factory=lambda: {f"{d}:{n}" for d, names in NODE_TYPES.items() for n in names})
    edges: dict[str, tuple[frozenset[str], frozenset[str]]] = field(default_factory=lambda: {e: (frozenset(), frozenset()) for e in EDGE_TYPES})

    def register_node(self, kind: str) -> None:
        self.nodes.add(kind)

    def register_edge(self, kind: str, sources=(), targets=()) -> None:
        """The last registration of an edge type counts."""
        self.edges[kind] = (frozenset(sources), frozenset(targets))

    def check(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """The nodes and edges that are not allowed: what, id, reason."""
        bad = nodes.where(~F.col("type").isin(*self.nodes)).select(F.lit("node").alias("what"), "id", F.lit("unknown type").alias("reason"))
        reason: Column = F.when(~F.col("e.type").isin(*self.edges), F.lit("unknown type"))
        for kind, (sources, targets) in self.edges.items():
            for side, allowed in (("f", sources), ("t", targets)):
                if allowed:
                    reason = reason.when((F.col("e.type") == kind) & ~F.col(f"{side}.type").isin(*allowed), F.lit(f"{kind} does not fit its {'source' if side == 'f' else 'target'}"))
        joined = edges.alias("e").join(nodes.alias("f"), F.col("e.from_id") == F.col("f.id"), "left").join(nodes.alias("t"), F.col("e.to_id") == F.col("t.id"), "left")
        return bad.unionByName(joined.select(F.lit("edge").alias("what"), "e.id", reason.alias("reason")).where("reason IS NOT NULL"))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of schema, missing ones null; a STRING data column is read as JSON."""
    types = dict(df.dtypes)
    out = []
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        if name not in types:
            value = F.lit(None).cast(kind)
        elif kind == "VARIANT" and types[name] == "string":
            value = F.try_parse_json(F.col(name))
        elif types[name] == "variant":
            value = F.col(name)
        else:
            value = F.col(name).cast(kind)
        if name == "labels":
            value = F.coalesce(value, F.array().cast("array<string>"))
        out.append(value.alias(name))
    return df.select(*out)


def make_nodes(df: DataFrame) -> DataFrame:
    """Rows as nodes; a missing id follows from the uri."""
    df = conform(df, NODE)
    return df.withColumn("id", F.coalesce("id", F.when(F.col("uri") != "", short_id("uri"))))


def make_edges(df: DataFrame) -> DataFrame:
    """Rows as edges; a missing id follows from type, from_id and to_id."""
    df = conform(df, EDGE)
    return df.withColumn("id", F.coalesce("id", edge_id("type", "from_id", "to_id")))


def both_ways(edges: DataFrame, back: str) -> DataFrame:
    """edges and, as edges of type back, their reverses."""
    swapped = edges.select(F.lit(back).alias("type"), F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), *[c for c in edges.columns if c not in ("id", "type", "from_id", "to_id")])
    return make_edges(edges.drop("id").unionByName(swapped))


def active(df: DataFrame, now: int | None = None) -> DataFrame:
    """Rows that have not expired."""
    at = F.unix_timestamp() if now is None else F.lit(now)
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > at))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    plain = spark.createDataFrame([], schema.replace("VARIANT", "STRING"))
    return conform(plain, schema)
