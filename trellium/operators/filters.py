"""Structural filters of nodes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import field, glob_regex, like
from ..plans.predicates import any_of


@dataclass(frozen=True)
class NodeFilter:
    """All given parts must hold; within a part one of the values is enough."""

    types: Sequence[str] = ()
    uri_prefix: str | None = None
    name: str | None = None
    name_glob: str | None = None
    labels: Sequence[str] = ()
    extensions: Sequence[str] = ()
    ids: Sequence[str] = ()
    generation: str | None = None
    root_only: bool = False
    exclude_types: Sequence[str] = ()
    data: tuple[tuple[str, object], ...] = ()
    scope: str | None = None

    def test(self, by_data_ext: bool = False) -> Column:
        out = F.lit(True)
        for kinds, keep in ((self.types, True), (self.exclude_types, False)):
            if kinds:
                hit = F.lit(False)
                for k in kinds:
                    hit |= F.col("type").rlike(glob_regex(k)) if any(c in k for c in "*?") else F.col("type") == k
                out &= hit if keep else ~hit
        if self.uri_prefix:
            out &= F.col("uri").startswith(self.uri_prefix)
        if self.name is not None:
            out &= F.col("name") == self.name
        if self.name_glob:
            out &= F.col("name").rlike(glob_regex(self.name_glob))
        if self.labels:
            out &= any_of(F.col("labels"), self.labels)
        if self.extensions:
            hit = F.lit(False)
            for e in self.extensions:
                hit |= field("data", "ext") == e if by_data_ext else F.col("name").endswith("." + e)
            out &= hit
        if self.ids:
            out &= F.col("id").isin(list(self.ids))
        if self.generation is not None:
            out &= F.col("generation") == self.generation
        for path, value in self.data:
            kind = "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "double"
            out &= field("data", path, kind) == F.lit(value)
        return out

    def apply(self, nodes: DataFrame, edges: DataFrame | None = None, by_data_ext: bool = False) -> DataFrame:
        out = nodes.where(self.test(by_data_ext))
        if self.root_only:
            inner = edges.where(F.col("type") == "contains").select(F.col("to_id").alias("id")).distinct()
            out = out.join(inner, "id", "left_anti")
        if self.scope:
            from .graph import descendants

            out = out.join(descendants(edges, out.sparkSession.createDataFrame([(self.scope,)], "id string")), "id", "left_semi")
        return out


#: Extensions that count as code (fixed values).
CODE = ["go", "py", "js", "ts", "tsx", "rs", "c", "cpp", "java", "rb", "sh", "lua", "zig", "swift"]


def compare(path: str, op: str, value: str) -> Column:
    """A column, or a field of data, against a text: GLOB, LIKE, =, !=, > or <; an empty text lets all through."""
    if not value:
        return F.lit(True)
    side = field("data", path.removeprefix("data.")) if path.startswith("data.") else F.col(path)
    tests = {"GLOB": lambda: side.rlike(glob_regex(value)), "LIKE": lambda: like(side, value), "=": lambda: side == value, "!=": lambda: side != value, ">": lambda: side > value, "<": lambda: side < value}
    if op not in tests:
        raise ValueError(f"no operator {op}")
    return tests[op]()


def category(*names: str) -> Column:
    """Nodes of any of the categories dirs, files, code, docs and git; without names all."""
    kind = F.col("type")
    known = {"dirs": kind == "fs:dir", "files": kind == "fs:file", "code": (kind == "fs:file") & field("data", "ext").isin(CODE), "docs": kind.startswith("md:"), "git": kind.startswith("vcs:")}
    return reduce(Column.__or__, (known[n] for n in names)) if names else F.lit(True)


ORDERS = {"name": "name", "updated": "updated_at", "updated_at": "updated_at", "created": "created_at", "created_at": "created_at", "type": "type"}


def find(nodes: DataFrame, edges: DataFrame, where: NodeFilter, order_by: str | None = None, descending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Nodes that a filter lets through; ties of the order are broken by id."""
    out = where.apply(nodes, edges)
    if order_by:
        key = F.col(ORDERS[order_by])
        out = out.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out
