"""The engine as a command: python -m trellium --store FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import calendar
import sys
import time
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.scalars import ago_text, count_text, duration_text, scope_prefix
from .model import EngineError, active
from .operators import context, graph, introspect, output
from .operators.filters import NodeFilter
from .operators.vector import HashingProvider, HttpProvider, NullProvider
from .plans.compile import Result
from .plans.parser import parse
from .plans.unparse import dump, unparse
from .plans.validate import validate
from .sources.events import AnnotationSource, LabelSource, MarkdownSource, ProjectSource, texts
from .sources.files import FileSource
from .sources.git import GitSource
from .sources.symbols import SymbolSource

NEIGHBORS = 50
Lines = Iterator[str]


def engine(spark: SparkSession, args) -> Engine:
    provider = {"none": lambda: None, "null": NullProvider, "hashing": HashingProvider, "http": lambda: HttpProvider(args.embed_url)}[args.embed]()
    out = Engine(spark, provider=provider, folder=args.store)
    for source in (FileSource(), GitSource(), SymbolSource(), AnnotationSource(), MarkdownSource(), ProjectSource(), LabelSource()):
        out.register_source(source)
    return out


def _nodes(e: Engine, df: DataFrame, how: str) -> Lines:
    return output.rendered(Result(df.drop("expires_at"), "nodes", df.columns), how)


def _frame(df: DataFrame, how: str) -> Lines:
    return output.rendered(Result(df, "rows", df.columns), "json" if how == "json" else "table")


def _counts(df: DataFrame, how: str) -> Lines:
    return output.rendered(Result(df.orderBy(F.desc("count"), "name"), "counts", ["name", "count"], "name"), how)


def _scope(e: Engine, args) -> str | None:
    return None if args.everywhere or not args.path else e.resolve(args.path if "://" in args.path else f"file://{Path(args.path).resolve()}")


def index(e: Engine, args) -> Lines:
    uri = args.path if "://" in args.path else f"file://{Path(args.path).resolve()}"
    run = e.index(uri, skip_gc=args.no_gc)
    yield f"{count_text(run['files_indexed'])} files, {count_text(run['dirs_indexed'])} folders, {count_text(run['stale_removed'])} gone, {duration_text(run['duration_ms'] / 1000)}"


def query(e: Engine, args) -> Lines:
    if args.explain:
        yield e.explain(args.text)
    else:
        yield from e.rows(args.text, how=args.output)


def show_parse(e: Engine | None, args) -> Lines:
    tree = parse(args.text)
    yield unparse(tree)
    yield dump(tree)
    yield from (f"problem: {p}" for p in validate(tree))


def find(e: Engine, args) -> Lines:
    types = args.type or []
    if args.text:
        path = None if args.everywhere else str(Path(args.path or ".").resolve())
        found = e.semantic_find(args.text, types[0] if types else None, path, args.limit, args.min_score, args.exclude or ())
        rows = found.join(active(e.nodes).select(F.col("id").alias("node_id"), "type", "name", "uri"), "node_id").orderBy(F.desc("score"), "node_id")
        return _frame(rows, args.output)
    prefix = None if args.everywhere or not args.path else scope_prefix(types[0] if types else "fs:file", str(Path(args.path).resolve()))
    where = NodeFilter(types=types, name_glob=args.name, labels=args.label or (), extensions=args.ext or (), exclude_types=args.exclude or (), uri_prefix=prefix, root_only=args.root)
    return _nodes(e, e.find(where, "name", limit=args.limit), args.output)


def types(e: Engine, args) -> Lines:
    scope = _scope(e, args)
    nodes, edges = active(e.nodes), active(e.edges)
    if scope:
        under = graph.descendants(edges, e.spark.createDataFrame([(scope,)], "id string"))
        nodes, edges = nodes.join(under, "id", "left_semi"), edges.join(under.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    if args.command == "edges":
        return _counts(edges.groupBy(F.col("type").alias("name")).count(), args.output)
    counts = introspect.count_nodes(nodes, edges, by="label" if args.command == "labels" else "type")
    return _counts(counts.where(F.col("name").startswith(args.prefix)) if getattr(args, "prefix", None) else counts, args.output)


def stats(e: Engine, args) -> Lines:
    return _frame(e.stats(_scope(e, args)).orderBy("section", F.desc("count"), "name"), args.output)


def info(e: Engine, args) -> Lines:
    got = e.info()
    for name in ("nodes", "edges", "orphans"):
        yield f"{name}: {count_text(got[name])}"
    yield from (f"{language} projects: {count_text(n)}" for language, n in sorted(got["projects"].items()))
    if last := got["last_run"]:
        yield f"last run: {last['root_path']}, {ago_text(time.time() - calendar.timegm(time.strptime(last['finished_at'], '%Y-%m-%dT%H:%M:%SZ')))}"


def describe(e: Engine, args) -> Lines:
    for name, df in e.describe(args.fields).items():
        yield name
        yield from _frame(df, args.output)


def show(e: Engine, args) -> Lines:
    found = e.by_prefix(args.reference, 2).collect() if len(args.reference) >= 4 else []
    node = found[0]["id"] if len(found) == 1 else e.resolve(args.reference)
    row = e.node(node)
    yield from _nodes(e, row, "json")
    counts, _ = graph.navigation(active(e.nodes), active(e.edges), node)
    for r in counts.orderBy("side", "type").collect():
        yield f"{r['side']} {r['type']}  {r['count']}"
    if row.first()["type"] in ("md:document", "md:section"):
        yield graph.document_text(active(e.nodes), active(e.edges), node)


def tree(e: Engine, args) -> Lines:
    yield graph.tree_text(e.tree(args.reference, args.depth, args.type or ()))


def neighbors(e: Engine, args) -> Lines:
    found = e.neighbors(args.reference, args.direction, args.edge or (), args.limit)
    return _frame(found.select("direction", "edge_type", "id", "type", "name"), args.output)


def path(e: Engine, args) -> Lines:
    found = e.find_path(args.reference, args.goal, args.depth, args.limit, args.edge or ()).collect()
    if not found:
        yield "No path"
    for r in found:
        yield " ".join(f"{'<-' if s['incoming'] else '-'}[{s['edge_type']}]{'-' if s['incoming'] else '->'} {s['node_id']}" for s in r["steps"])


def impact(e: Engine, args) -> Lines:
    by, importers = e.impact(args.symbol)
    yield from _frame(by.orderBy(F.desc("refs"), "package"), args.output)
    yield from _frame(importers.orderBy("package", "importer"), args.output)


def gc(e: Engine, args) -> Lines:
    return _frame(e.gc(args.dry_run), args.output)


def write_node(e: Engine, args) -> Lines:
    e.write_node(args.uri, args.type, args.name, args.data, args.label or (), args.ttl)
    yield e.node_by_uri(args.uri).first()["id"]


def gather(e: Engine, args) -> Lines:
    files = texts(active(e.nodes).where("type = 'fs:file'").select(F.regexp_replace("uri", "^file://", "").alias("path")), f"file://{Path(args.path).resolve()}")
    task, kept, left = e.context(args.text, files, args.tokens)
    yield context.as_json(task, kept, left) if args.output == "json" else context.manifest(kept, left) if args.manifest else context.as_text(kept)


COMMANDS: dict[str, Callable] = {
    "index": index, "query": query, "parse": show_parse, "find": find, "search": find, "types": types, "edges": types,
    "labels": types, "stats": stats, "info": info, "describe": describe, "show": show, "tree": tree, "neighbors": neighbors,
    "path": path, "impact": impact, "gc": gc, "write-node": write_node, "context": gather,
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("trellium", description="A property graph of files, repositories, documents and symbols.")
    out.add_argument("--store", default=".trellium", help="folder of the store, which the cluster shares")
    out.add_argument("--embed", choices=["none", "null", "hashing", "http"], default="none")
    out.add_argument("--embed-url", default="http://localhost:11434")
    sub = out.add_subparsers(dest="command", required=True)
    of = {name: sub.add_parser(name) for name in COMMANDS}
    for p in of.values():
        p.add_argument("-o", "--output", choices=output.FORMATS, default="table")
    on = lambda names, *flags, **kw: [of[n].add_argument(*flags, **kw) for n in names.split()]
    on("index", "path", nargs="?", default=".")
    on("index", "--no-gc", action="store_true")
    on("query parse", "text")
    on("query", "--explain", action="store_true")
    on("find", "text", nargs="*")
    on("search", "text", nargs="+")
    on("find search", "--name")
    on("find search", "--min-score", type=float, default=0.5)
    on("find search", "--root", action="store_true")
    for flag in ("type", "label", "ext", "exclude"):
        on("find search", f"--{flag}", action="append")
    on("find search types edges labels stats", "--path")
    on("find search types edges labels stats", "-g", "--global", dest="everywhere", action="store_true")
    on("find search", "--limit", type=int, default=20)
    on("labels", "--prefix")
    on("describe", "--fields", action="store_true")
    on("show tree neighbors path", "reference")
    on("path", "goal")
    on("tree", "--depth", type=int, default=3)
    on("tree", "--type", action="append")
    on("neighbors", "--direction", choices=["in", "out", "both"], default="both")
    on("neighbors", "--limit", type=int, default=NEIGHBORS)
    on("path", "--depth", type=int, default=graph.DEPTH)
    on("path", "--limit", type=int, default=graph.PATHS)
    on("neighbors path", "--edge", action="append")
    on("impact", "symbol")
    on("gc", "--dry-run", action="store_true")
    on("write-node", "uri")
    on("write-node", "type")
    on("write-node", "--name")
    on("write-node", "--data")
    on("write-node", "--label", action="append")
    on("write-node", "--ttl", type=int, default=0)
    on("context", "text")
    on("context", "--path", default=".")
    on("context", "--tokens", type=int, default=8000)
    on("context", "--manifest", action="store_true")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, write: Callable[[str], object] = print) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "parse":
            lines = show_parse(None, args)
        else:
            spark = spark or SparkSession.builder.appName("trellium").getOrCreate()
            lines = COMMANDS[args.command](engine(spark, args), args)
        for line in lines:
            write(line)
    except (EngineError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0
