"""The engine: a graph, its queries, searches and upkeep."""

from __future__ import annotations

import contextlib
import io
import time
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import path_of, scope_prefix
from .model import EDGE, EMBEDDING, NODE, EdgeNotFound, NodeNotFound, NoEmbeddingProvider, QueryError, Registry, active, conform, empty, make_nodes
from .operators import context, graph, introspect, output, store, vector
from .operators.filters import NodeFilter, find
from .plans.ast import Query
from .plans.builder import Select, built
from .plans.compile import Result, compile_query
from .plans.parser import parse
from .plans.unparse import dump, unparse
from .shared import settled
from .sources.base import Source, Sources, wanted
from .sources.text import with_labels


class Engine:
    """Over tables of nodes and edges (and embeddings), given or kept in a Store; all results are lazy frames."""

    def __init__(self, spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None, embeddings: DataFrame | None = None, provider: vector.Provider | None = None, folder: str | None = None):
        self.spark, self.provider, self.registry, self.sources = spark, provider, Registry(), Sources()
        self.store = store.Store(spark, folder) if folder else None
        read = lambda t, schema: self.store.read(t) if self.store else empty(spark, schema)
        self.nodes = conform(nodes, NODE) if nodes is not None else read("nodes", NODE)
        self.edges = conform(edges, EDGE) if edges is not None else read("edges", EDGE)
        self.embeddings = embeddings if embeddings is not None else read("embeddings", EMBEDDING)

    # queries

    def query(self, q: str | Query | Select, params: dict | None = None) -> Result:
        return compile_query(parse(q) if isinstance(q, str) else built(q), self.nodes, self.edges, params)

    def rows(self, q: str | Query | Select, params: dict | None = None, how: str = "table") -> Iterator[str]:
        """The result of a query as text; what fails while it runs is a QueryError of phase execute."""
        result = self.query(q, params)
        try:
            yield from output.rendered(result, how)
        except PySparkException as e:
            raise QueryError("execute", str(e)) from e

    def sql(self, q: str | Query | Select, params: dict | None = None) -> DataFrame:
        return self.query(q, params).df

    def explain(self, q: str | Query | Select, params: dict | None = None) -> str:
        """The query as text, its tree, and Spark's plan."""
        tree = parse(q) if isinstance(q, str) else built(q)
        with contextlib.redirect_stdout(out := io.StringIO()):
            compile_query(tree, self.nodes, self.edges, params).df.explain("formatted")
        return f"{unparse(tree)}\n\n{dump(tree)}\n{out.getvalue()}"

    def find(self, where: NodeFilter = NodeFilter(), order_by: str | None = None, descending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
        return find(active(self.nodes), active(self.edges), where, order_by, descending, limit, offset)

    def node(self, node_id: str) -> DataFrame:
        return self._one(active(self.nodes).where(F.col("id") == node_id), NodeNotFound, node_id)

    def edge(self, edge_id: str) -> DataFrame:
        return self._one(active(self.edges).where(F.col("id") == edge_id), EdgeNotFound, edge_id)

    def node_by_uri(self, uri: str) -> DataFrame:
        return self._one(active(self.nodes).where(F.col("uri") == uri), NodeNotFound, uri)

    def node_by_key(self, kind: str, key: str) -> DataFrame:
        return self._one(active(self.nodes).where((F.col("type") == kind) & (F.col("key") == key)), NodeNotFound, f"{kind} {key}")

    @staticmethod
    def _one(df: DataFrame, error: type[Exception], what: str) -> DataFrame:
        out = df.limit(1)
        if out.isEmpty():
            raise error(what)
        return out

    def by_prefix(self, prefix: str, limit: int = 100) -> DataFrame:
        if len(prefix) < 4:
            raise ValueError("a prefix of an id has at least four characters")
        return active(self.nodes).where(F.col("id").startswith(prefix)).orderBy("id").limit(limit)

    def edges_from(self, node_id: str) -> DataFrame:
        return active(self.edges).where(F.col("from_id") == node_id)

    def edges_to(self, node_id: str) -> DataFrame:
        return active(self.edges).where(F.col("to_id") == node_id)

    # graph

    def neighbors(self, reference: str, direction: str = "both", types: Sequence[str] = (), most: int | None = None) -> DataFrame:
        return graph.neighbors(active(self.nodes), active(self.edges), self.resolve(reference), direction, types, most)

    def find_path(self, start: str, goal: str, max_depth: int = graph.DEPTH, max_paths: int = graph.PATHS, types: Sequence[str] = ()) -> DataFrame:
        return graph.find_paths(active(self.nodes), active(self.edges), self.resolve(start), self.resolve(goal), max_depth, max_paths, types)

    def tree(self, reference: str, depth: int = 3, types: Sequence[str] = ()) -> DataFrame:
        return graph.tree(active(self.nodes), active(self.edges), self.resolve(reference), depth, types)

    def navigate(self, reference: str, page: int = 20, offset: int = 0, where=None) -> tuple[DataFrame, DataFrame]:
        return graph.navigation(active(self.nodes), active(self.edges), self.resolve(reference), page, offset, where)

    def siblings(self, reference: str, page: int = 20, offset: int = 0) -> DataFrame:
        return graph.siblings(active(self.nodes), active(self.edges), self.resolve(reference), page, offset)

    def document(self, reference: str) -> str:
        return graph.document_text(active(self.nodes), active(self.edges), self.resolve(reference))

    def impact(self, symbol: str) -> tuple[DataFrame, DataFrame]:
        return graph.impact(active(self.nodes), active(self.edges), symbol)

    def resolve(self, reference: str) -> str:
        return graph.resolve(active(self.nodes), reference)

    # search

    def search(self, queries: Sequence[str], limit: int = 20, where: NodeFilter | None = None, min_score: float | None = None) -> DataFrame:
        if self.provider is None:
            raise NoEmbeddingProvider("searching by text needs an embedding provider")
        vectors = list(zip(queries, self.provider.embed(list(queries)).tolist()))
        return vector.search(self.embeddings, vectors, limit, active(self.nodes), where, min_score)

    def semantic_find(self, queries: Sequence[str], kind: str | None = None, path: str | None = None, limit: int = 20, min_score: float = 0.5, exclude_types: Sequence[str] = ()) -> DataFrame:
        """search() as the command does it: scores of 0.5 and more, one type, and below path only if a type is given."""
        prefix = scope_prefix(kind, path) if kind and path else None
        return self.search(queries, limit, NodeFilter(types=[kind] if kind else [], uri_prefix=prefix, exclude_types=exclude_types), min_score)

    def find_similar(self, values: Sequence[float], limit: int = 0, where: NodeFilter | None = None) -> DataFrame:
        return vector.find_similar(self.embeddings, values, limit, active(self.nodes), where)

    def context(self, task: str, files: DataFrame, max_tokens: int = 8000):
        return context.gather(active(self.nodes), active(self.edges), files, task, max_tokens)

    # introspection

    def describe(self, include_fields: bool = False) -> dict[str, DataFrame]:
        out = {"nodes": introspect.describe_nodes(self.nodes), "edges": introspect.describe_edges(self.nodes, self.edges)}
        return out | ({"fields": introspect.describe_fields(self.nodes)} if include_fields else {})

    def stats(self, scope: str | None = None) -> DataFrame:
        return introspect.stats(active(self.nodes), active(self.edges), scope)

    def info(self) -> dict:
        return introspect.info(active(self.nodes), active(self.edges), self.store.read("index_runs") if self.store else None)

    # writing

    def _save(self, *tables: str) -> None:
        for t in tables if self.store else ():
            self.store.write(t, getattr(self, t))
            setattr(self, t, self.store.read(t))

    def put_nodes(self, rows: DataFrame) -> None:
        self.nodes = store.upsert_nodes(self.nodes, make_nodes(rows))
        self._save("nodes")

    def put_edges(self, rows: DataFrame) -> None:
        self.edges = store.upsert_edges(self.edges, rows)
        self._save("edges")

    def put_embeddings(self, rows: DataFrame) -> None:
        self.embeddings = store.upsert_embeddings(self.embeddings, rows)
        self._save("embeddings")

    def write_node(self, uri: str, kind: str, name: str | None = None, data: str | None = None, labels: Sequence[str] = (), ttl: int = 0) -> None:
        """Upsert one node by URI, and embed it if its type is one that is embedded."""
        now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        row = self.spark.createDataFrame([(kind, uri, name, data, list(labels), now, now)], "type string, uri string, name string, data string, labels array<string>, created_at string, updated_at string")
        row = store.with_ttl(make_nodes(row), ttl)
        self.put_nodes(row)
        if self.provider is not None:
            self.put_embeddings(vector.embed_nodes(row, self.provider))

    def delete_node(self, node_id: str) -> None:
        self.node(node_id)
        self.nodes = self.nodes.where(F.col("id") != node_id)
        self._save("nodes")

    def delete_edge(self, edge_id: str) -> None:
        self.edge(edge_id)
        self.edges = self.edges.where(F.col("id") != edge_id)
        self._save("edges")

    def delete_by_path(self, uri_prefix: str) -> None:
        self.nodes = store.without_prefix(self.nodes, uri_prefix)
        self.edges = store.connected_edges(self.nodes, self.edges)
        self._save("nodes", "edges")

    def gc(self, dry_run: bool = False) -> DataFrame:
        """what, count of the garbage; unless dry_run it is gone afterwards."""
        found = store.garbage(self.nodes, self.edges)
        if not dry_run:
            found = self.spark.createDataFrame(found.collect(), found.schema)
            self.nodes, self.edges = store.collect_garbage(self.nodes, self.edges)
            self._save("nodes", "edges")
        return found

    def register_source(self, source: Source) -> None:
        self.sources.register(source)

    def index(self, uri: str, skip_gc: bool = False) -> dict:
        """Read a source, write its nodes and edges as a new generation, drop what is stale below it, and record the run.

        What the source found goes as visited events to the sources that want them; their nodes of older generations
        below the same path, and so those of files that are gone, are dropped too. When all is written, sources that
        have a last stage add the edges it finds.
        """
        source, generation, began = self.sources.of(uri), uuid.uuid4().hex, time.time()
        nodes, edges = source.read(self.spark, uri, generation)
        listeners = self.sources.subscribers()
        if listeners:
            nodes, edges = settled(nodes), settled(edges)
        events = nodes.select(F.lit("visited").alias("event"), "id", "type", "name", "uri", path_of("uri").alias("path"))
        labels = None
        for listener in listeners:
            more_nodes, more_edges, more_labels = listener.handle(wanted(events, listener.subscriptions), generation, uri)
            if more_nodes is not None:
                nodes, edges = nodes.unionByName(more_nodes), edges.unionByName(more_edges)
            if more_labels is not None:
                labels = more_labels if labels is None else labels.unionByName(more_labels)
        if labels is not None:
            every = labels.select("id", F.explode("labels").alias("l")).groupBy("id").agg(F.array_sort(F.collect_set("l")).alias("labels"))
            nodes = with_labels(nodes, every)
        if listeners:
            nodes, edges = settled(nodes), settled(edges)
        places = [uri, *(f"{scheme}{uri.split('://', 1)[-1]}" for scheme in self.sources.derived())]
        old = reduce(DataFrame.unionByName, (store.stale(self.nodes, generation, p).select("id") for p in places))
        gone = settled(old.join(nodes.select("id"), "id", "left_anti").distinct())
        kept = self.nodes.join(gone, "id", "left_anti").select(*self.nodes.columns)
        # Each step is written before the next reads it, as a plan of all would hold the first ones many times over.
        self.nodes = settled(store.upsert_nodes(kept, nodes))
        edges = settled(store.upsert_edges(self.edges, edges))
        dropped = store.stale_edges(self.nodes, edges, generation, *places)
        self.edges = edges.join(dropped.select("id"), "id", "left_anti").select(*edges.columns)
        self._save("nodes", "edges")
        last = [s.post(self.nodes, self.edges, generation) for s in self.sources.known if hasattr(s, "post")]
        if last:
            self.edges = store.upsert_edges(self.edges, reduce(DataFrame.unionByName, last))
        if not skip_gc:
            self.edges = store.connected_edges(self.nodes, self.edges)
        if last or not skip_gc:
            self._save("edges")
        if self.provider is not None:
            self.put_embeddings(vector.embed_nodes(self.nodes, self.provider, generation))
        counts = {r["type"]: r["count"] for r in self.nodes.where(F.col("generation") == generation).groupBy("type").count().collect()}
        stamp = lambda t: time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(t))
        run = {"started_at": stamp(began), "finished_at": stamp(time.time()), "duration_ms": int(1000 * (time.time() - began)), "root_path": uri, "files_indexed": counts.get("fs:file", 0), "dirs_indexed": counts.get("fs:dir", 0), "repos_indexed": counts.get("vcs:repo", 0), "stale_removed": gone.count(), "generation": generation}
        if self.store:
            self.store.append_run(**run)
        return run
