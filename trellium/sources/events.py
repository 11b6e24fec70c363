"""Sources that listen to the files another source finds: annotations, markdown, projects and licences, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import path_of, short_id
from ..model import both_ways, make_edges, make_nodes
from .base import Graph, Subscription
from .text import MANIFESTS, RULES, annotations, markdown, markdown_graph, project_graph, tagged

VISITED = ("visited",)


def texts(events: DataFrame, root: str, names: str | None = None) -> DataFrame:
    """path, text of the files below a root that events (path) speak of; names is a glob that the listing goes by."""
    read = events.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (read.option("pathGlobFilter", names) if names else read).load(path_only(root))
    files = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("content").cast("string").alias("text"))
    return files.join(events.select("path"), "path", "left_semi")


def path_only(uri: str) -> str:
    return uri.split("://", 1)[-1]


class _Listener:
    schemes: tuple[str, ...] = ()

    def read(self, spark, uri, generation):  # never asked, as it has no scheme
        raise NotImplementedError(f"{self.name} reads no URI of its own")


class AnnotationSource(_Listener):
    """A code:todo node for each annotation of a file, which the file contains."""

    name, derived = "todo", ("file+todo://",)
    subscriptions = (Subscription(VISITED, "fs:file"),)

    def handle(self, events: DataFrame, generation: str, root: str) -> tuple[DataFrame, DataFrame, None]:
        found = annotations(texts(events, root))
        uri = F.concat(F.lit("file+todo://"), "path", F.lit("#L"), F.col("line").cast("string"))
        name = F.when(F.col("text") == "", F.col("kind")).otherwise(F.concat("kind", F.lit(": "), "text"))
        name = F.when(F.length(name) > 80, F.concat(F.left(name, F.lit(77)), F.lit("..."))).otherwise(name)
        data = F.to_variant_object(F.struct(F.col("path").alias("file"), "line", "kind", "text", F.coalesce("before", F.lit("")).alias("context")))
        rows = found.select(
            "path", F.lit("code:todo").alias("type"), uri.alias("uri"), F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("key"),
            name.alias("name"), F.array(F.lower("kind")).alias("labels"), data.alias("data"), F.lit(generation).alias("generation"),
        )
        held = rows.select(F.lit("contains").alias("type"), short_id(F.concat(F.lit("file://"), "path")).alias("from_id"), short_id("uri").alias("to_id"), "generation")
        return make_nodes(rows.drop("path")), both_ways(make_edges(held), "contained_by"), None


class MarkdownSource(_Listener):
    """The parts of markdown files; links to files that are there become edges at the end."""

    name, derived = "markdown", ("file+md://",)
    subscriptions = (Subscription(VISITED, "fs:file", extension="md"),)

    def handle(self, events: DataFrame, generation: str, root: str) -> tuple[DataFrame, DataFrame, None]:
        nodes, edges = markdown_graph(markdown(texts(events, root, "*.md")), generation)
        documents = nodes.where("type = 'md:document'").select(F.lit("has").alias("type"), short_id(F.concat(F.lit("file://"), path_of("uri"))).alias("from_id"), F.col("id").alias("to_id"), "generation")
        return nodes, edges.unionByName(both_ways(make_edges(documents), "belongs_to")), None


class ProjectSource(_Listener):
    """Projects by their manifests and licences by their files; a project labels its folder."""

    name, derived = "project", ("project+file://", "license+file://")
    subscriptions = (*[Subscription(VISITED, "fs:file", name=m) for m in MANIFESTS], *[Subscription(VISITED, "fs:file", glob=g) for g in ("LICENSE*", "LICENCE*", "COPYING")])

    def handle(self, events: DataFrame, generation: str, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return project_graph(texts(events, root, "{" + ",".join([*MANIFESTS, "LICENSE*", "LICENCE*", "COPYING"]) + "}"), generation)


class LabelSource(_Listener):
    """Labels of files by rule; paths are those below the root."""

    name = "tagger"
    subscriptions = (Subscription(VISITED, "fs:file"),)

    def __init__(self, rules=RULES):
        self.rules = rules

    def handle(self, events: DataFrame, generation: str, root: str) -> tuple[None, None, DataFrame]:
        below = F.substr(F.col("path"), F.lit(len(path_only(root).rstrip("/")) + 2))
        rows = events.withColumn("labels", F.array().cast("array<string>"))
        return None, None, tagged(rows, below, self.rules).where(F.size("labels") > 0).select("id", "labels")


__all__ = ["AnnotationSource", "Graph", "LabelSource", "MarkdownSource", "ProjectSource", "texts"]
