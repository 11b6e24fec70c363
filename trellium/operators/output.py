"""Results as text: JSON, a table, paths, URIs, a count, or lines of names.

What is printed is fetched row by row and bounded by the query, or by what is asked for; a count is made by the cluster.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import Result

FORMATS = ("json", "table", "path", "uri", "count", "text")
WIDTH = 40
#: Columns of a table of nodes that are shown where any row has them.
SHOWN = ["id", "type", "name", "uri", "key", "labels", "data"]


def rendered(result: Result, how: str = "table") -> Iterator[str]:
    if how not in FORMATS:
        raise ValueError(f"no format {how}")
    if how == "count":
        yield str(result.count())
        return
    df = result.df
    if how in ("path", "uri"):
        yield from _uris(df, how)
        return
    rows = _plain(df, result)
    if how == "json":
        yield from _json(rows)
    elif how == "table":
        yield from _table(rows)
    elif result.kind == "counts":
        yield from count_lines([(str(next((v for k, v in r.items() if k != "count"), "")), r["count"]) for r in _dicts(rows)])
    else:
        yield from node_lines(rows)


def _plain(df: DataFrame, result: Result) -> DataFrame:
    """df without kinds that Python has no value for, a count's name called by what it was grouped by."""
    out = df.select(*[F.to_json(c).alias(c) if t == "variant" else F.col(f"`{c}`") for c, t in df.dtypes])
    if result.kind == "counts" and result.grouping and "name" in out.columns and result.grouping not in out.columns:
        out = out.withColumnRenamed("name", result.grouping)
    return out


def _dicts(df: DataFrame) -> Iterator[dict]:
    variants = {"data", "value"} & set(df.columns)
    for r in df.toLocalIterator():
        yield {k: json.loads(v) if k in variants and isinstance(v, str) and v[:1] in "{[" else v for k, v in r.asDict(recursive=True).items()}


def _json(df: DataFrame) -> Iterator[str]:
    shown = [json.dumps(r, ensure_ascii=False, default=str) for r in _dicts(df)]
    yield "[]" if not shown else "[\n" + ",\n".join("  " + x for x in shown) + "\n]"


def short(value, width: int = WIDTH) -> str:
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    return text if len(text) <= width else text[: width - 3] + "..."


def _table(df: DataFrame) -> Iterator[str]:
    rows = list(_dicts(df))
    if not rows:
        yield "No results"
        return
    names = list(rows[0])
    if set(SHOWN) <= set(names):  # whole nodes: only what there is
        names = [n for n in SHOWN if any(r[n] not in (None, "", []) for r in rows)]
    cells = [[n.upper() for n in names], *[[short(r[n]) for n in names] for r in rows]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(names))]
    for r in cells:
        yield "  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip()


def _uris(df: DataFrame, how: str) -> Iterator[str]:
    if "uri" not in df.columns:
        raise ValueError("only nodes with their URI have paths")
    path = F.regexp_replace(F.regexp_replace("uri", r"^[a-z+]+://", ""), r"#.*$", "")
    kept = df.where("uri <> ''").select(path if how == "path" else F.col("uri"))
    for r in kept.toLocalIterator():
        yield r[0]


def count_lines(rows: list[tuple[str, int]]) -> Iterator[str]:
    wide = max((len(n) for n, _ in rows), default=0)
    for name, count in rows:
        yield f"{name.ljust(wide)}  {count}"


def node_lines(df: DataFrame) -> Iterator[str]:
    for r in _dicts(df):
        if {"id", "name", "type"} <= set(r):
            yield f"[{r['id'][:7]}] {r['name'] or ''} ({r['type']}) [{', '.join(r.get('labels') or []) or '-'}]"
        else:
            yield "  ".join(short(v) for v in r.values())
