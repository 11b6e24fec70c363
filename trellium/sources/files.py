"""A folder as nodes: files, directories and what contains what."""

from __future__ import annotations

import mimetypes
import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extension, path_glob_regex
from ..model import both_ways, conform, make_edges, make_nodes, NODE
from ..shared import settled

#: What is left out unless asked for (fixed values).
EXCLUDED = [
    ".git", "node_modules", "__pycache__", "target", "vendor", "venv", "env", "dist", "build", "site-packages", ".devspace",
    ".DS_Store", "*.log",
]
#: Media types of extensions, from the platform's table.
TYPES = {e.lstrip("."): t for e, t in mimetypes.types_map.items()}


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, modified of every file below a folder, listed by the cluster; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))


def walked(spark: SparkSession, folder: str, exclude: list[str] = EXCLUDED) -> DataFrame:
    """path, type and target of the folders and symbolic links below a folder that every worker can see, the empty ones too.

    Level by level, a level's folders dealt out over the workers; excluded folders and links are not entered.
    """
    barred = re.compile("|".join(path_glob_regex(g) for g in exclude) or "(?!)")
    schema = "path string, type string, target string"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path in df["path"]:
                with os.scandir(path) as entries:
                    rows = [(e.path, "fs:link", os.readlink(e.path)) if e.is_symlink() else (e.path, "fs:dir", None) for e in entries if e.is_symlink() or e.is_dir()]
                yield pd.DataFrame(rows, columns=["path", "type", "target"], dtype=object)

    level = spark.createDataFrame([(folder.rstrip("/"), "fs:dir", None)], schema)
    found = [level]
    skip = F.element_at(F.split("path", "/"), -1).rlike(barred.pattern)
    while True:
        level = settled(level.where("type = 'fs:dir'").where(~skip if len(found) > 1 else F.lit(True)).repartition("path").mapInPandas(scan, schema))
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def file_graph(files: DataFrame, root: str, generation: str, include: list[str] | None = None, exclude: list[str] = EXCLUDED, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of files (path, size, modified) below root, and of others (path, type, target): folders and links.

    A link is a node with its target, and nothing is reached through it. Excluded names and globs win over included ones. An excluded directory is a node without anything in it; included
    globs speak of files only. Directories follow from the paths
    of files, and from others if they are empty.
    """
    root = root.rstrip("/")
    skip = [path_glob_regex(g) for g in exclude]
    parts = F.split(F.substr(F.col("path"), F.lit(len(root) + 2)), "/")
    hit = lambda name: F.exists(F.array(*[F.lit(s) for s in skip]), lambda s: F.regexp_like(name, s)) if skip else F.lit(False)
    rows = files.where(F.col("path").startswith(root + "/")).withColumn("_parts", parts)
    cut = F.array_position(F.transform("_parts", lambda p: hit(p)), True)
    rows = rows.withColumn("_cut", cut)
    whole = rows.where("_cut = 0")
    if include:
        keep = F.lit(False)
        for g in include:
            keep |= F.element_at("_parts", -1).rlike(path_glob_regex(g)) | F.array_join("_parts", "/").rlike(path_glob_regex(g))
        whole = whole.where(keep)
    depth = F.when(F.col("_cut") > 0, F.least(F.col("_cut"), F.size("_parts") - 1)).otherwise(F.size("_parts") - 1)
    folders = rows.select(F.explode(F.transform(F.sequence(F.lit(0), depth.cast("int")), lambda i: F.concat_ws("/", F.lit(root), F.filter("_parts", lambda _, k: k < i)))).alias("path"))
    folders = folders.where(F.col("path") != "").distinct().select("path", F.lit("fs:dir").alias("type"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("modified"))
    folders = folders.withColumn("path", F.regexp_replace("path", "/$", "")).distinct()
    both = folders.unionByName(whole.select("path", F.lit("fs:file").alias("type"), "size", "modified")).withColumn("target", F.lit(None).cast("string"))
    if others is not None:
        links = others.where("type = 'fs:link'")
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        through = both.select("path", F.explode(above).alias("_up")).join(links.select(F.col("path").alias("_up")), "_up", "left_semi")
        both = both.join(through.select("path"), "path", "left_anti").unionByName(others.withColumns({"size": F.lit(None).cast("long"), "modified": F.lit(None).cast("string")}).select(*both.columns)).distinct()
    both = settled(both.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("ext", extension("name")))
    kinds = F.create_map(*[F.lit(x) for pair in sorted(TYPES.items()) for x in pair])
    media = F.coalesce(F.try_element_at(kinds, F.lower("ext")), F.lit("application/octet-stream"))
    data = F.when(F.col("type") == "fs:file", F.to_variant_object(F.struct("name", "size", "modified", "ext", media.alias("content_type")))).when(F.col("type") == "fs:link", F.to_variant_object(F.struct("name", "target"))).otherwise(F.to_variant_object(F.struct("name")))
    nodes = make_nodes(conform(both.select("type", F.concat(F.lit("file://"), "path").alias("uri"), "name", data.alias("data"), F.lit(generation).alias("generation")), NODE))
    above = nodes.select(F.regexp_replace("uri", "/[^/]*$", "").alias("_up"), F.col("id").alias("to_id"))
    owners = nodes.where("type = 'fs:dir'").select(F.col("uri").alias("_up"), F.col("id").alias("from_id"))
    held = above.join(owners, "_up").select(F.lit("contains").alias("type"), "from_id", "to_id", F.lit(generation).alias("generation"))
    return nodes, both_ways(make_edges(held), "contained_by")


class FileSource:
    name, schemes = "fs", ("file://",)

    def __init__(self, include: list[str] | None = None, exclude: list[str] = EXCLUDED, walk: bool = True):
        """walk finds links and empty folders too, which a listing of files does not know of."""
        self.include, self.exclude, self.walk = include, exclude, walk

    def read(self, spark: SparkSession, uri: str, generation: str) -> tuple[DataFrame, DataFrame]:
        root = uri.removeprefix("file://")
        return file_graph(listing(spark, root), root, generation, self.include, self.exclude, walked(spark, root, self.exclude) if self.walk else None)
