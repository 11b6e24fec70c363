"""A git repository as nodes, read with the git program where there is one."""

from __future__ import annotations

import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import commit_name, short_id
from ..model import NoSource, both_ways, make_edges, make_nodes
from .text import commits

MOST_COMMITS = 500
_FORMAT = "%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%B%x1e"


def _git(path: str, *args: str) -> str:
    return subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, check=True).stdout


def numstat(text: str) -> dict[str, tuple[int, int, int]]:
    """Files changed, lines added and lines removed by commit, of a log with numbers; of binary files no lines."""
    out = {}
    for block in text.split("\x1e")[1:]:
        sha, *lines = block.strip("\n").split("\n")
        rows = [x.split("\t") for x in lines if x.count("\t") >= 2]
        number = lambda x: int(x) if x.isdigit() else 0
        out[sha] = len(rows), sum(number(r[0]) for r in rows), sum(number(r[1]) for r in rows)
    return out


class GitSource:
    """The history is read on the driver: it is bounded by MOST_COMMITS."""

    name, schemes = "git", ("git+file://",)

    def __init__(self, most: int = MOST_COMMITS):
        self.most = most

    def read(self, spark: SparkSession, uri: str, generation: str) -> tuple[DataFrame, DataFrame]:
        if not shutil.which("git"):
            raise NoSource("git is not installed")
        path = uri.removeprefix("git+file://")
        log = [tuple(x.strip("\n").split("\x1f")) for x in _git(path, "log", f"-{self.most}", f"--format={_FORMAT}").split("\x1e") if x.strip()]
        changes = numstat(_git(path, "log", f"-{self.most}", "--no-merges", "--root", "--numstat", "--format=%x1e%H"))
        log = [(*x, *changes.get(x[0], (0, 0, 0))) for x in log]
        raw = spark.createDataFrame(log, "sha string, parents string, author string, email string, date string, message string, files_changed long, insertions long, deletions long")
        raw = raw.withColumns({c: F.when(F.size(F.split("parents", " ")) > 1, 0).otherwise(F.when(F.col("parents") == "", 0).otherwise(F.col(c))) for c in ("files_changed", "insertions", "deletions")})
        parsed = commits(raw).withColumn("parents", F.filter(F.split("parents", " "), lambda p: p != ""))
        of = lambda sha: F.concat(F.lit(f"{uri}#commit:"), sha)
        data = F.to_variant_object(F.struct("sha", "author", "email", "date", "message", "type", "scope", "breaking", "subject", "body", "refs", "footers", "parents", "files_changed", "insertions", "deletions"))
        nodes = make_nodes(parsed.select(F.lit("vcs:commit").alias("type"), of(F.col("sha")).alias("uri"), F.col("sha").alias("key"), commit_name("sha", "subject").alias("name"), data.alias("data"), F.lit(generation).alias("generation")))
        refs = [("vcs:repo", uri, path.rstrip("/").rsplit("/", 1)[-1])]
        refs += [("vcs:branch", f"{uri}#branch:{b}", b) for b in _git(path, "branch", "--format=%(refname:short)").split()]
        refs += [("vcs:tag", f"{uri}#tag:{t}", t) for t in _git(path, "tag").split()]
        refs += [("vcs:remote", f"{uri}#remote:{r}", r) for r in _git(path, "remote").split()]
        heads = make_nodes(spark.createDataFrame(refs, "type string, uri string, name string").withColumn("generation", F.lit(generation)))
        every = heads.unionByName(nodes)
        has = every.where("type <> 'vcs:repo'").select(F.lit("has").alias("type"), short_id(F.lit(uri)).alias("from_id"), F.col("id").alias("to_id"), F.lit(generation).alias("generation"))
        up = parsed.select("sha", F.explode("parents").alias("p")).select(F.lit("parent_of").alias("type"), short_id(of(F.col("sha"))).alias("from_id"), short_id(of(F.col("p"))).alias("to_id"), F.lit(generation).alias("generation"))
        return every, both_ways(make_edges(has), "belongs_to").unionByName(make_edges(up))
