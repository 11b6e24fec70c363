"""Hops over edges: reachability and paths of variable length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex
from ..shared import counted, sized

#: Hops of an unbounded pattern in FROM; reachability in EXISTS has no bound.
MOST_HOPS = 20


def type_test(column: Column, kind: str | None) -> Column | None:
    if not kind or kind == "*":
        return None
    return column.rlike(glob_regex(kind)) if any(c in kind for c in "*?[") else column == kind


def of_types(edges: DataFrame, types) -> DataFrame:
    test = None
    for kind in types:
        one = type_test(F.col("type"), kind)
        if one is None:
            return edges
        test = one if test is None else test | one
    return edges if test is None else edges.where(test)


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """edges with src and dst added; of an undirected edge both ways, of a loop one."""
    out = edges.withColumns({"src": F.col("from_id"), "dst": F.col("to_id")})
    back = edges.withColumns({"src": F.col("to_id"), "dst": F.col("from_id")})
    if direction == "any":
        return out.unionByName(back.where("from_id <> to_id"))
    return out if direction == "out" else back


def reachable(hops: DataFrame, seeds: DataFrame, low: int, high: int | None) -> DataFrame:
    """The ids, once each, that low to high hops (src, dst) lead to from seeds (id).

    Up to low, the frontier is what walks of just so many hops lead to; from there on it is what is new, and advances
    until it is empty, so cycles end. Edges are never shuffled for a frontier that is counted as small.
    """
    hops = hops.select("src", "dst").where("dst IS NOT NULL")
    frontier, count = counted(seeds.select("id").distinct())
    found, total = (frontier, count) if low == 0 else (None, 0)
    seen, turn = frontier, 0
    while count and (high is None or turn < high):
        nxt = hops.join(sized(frontier, count, "id"), F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        if found is not None:
            nxt = nxt.join(sized(found, total, "id"), "id", "left_anti")
        frontier, count = counted(nxt)
        turn += 1
        if count and turn >= low:
            found, total = frontier if found is None else found.unionByName(frontier), total + count
    return seen.limit(0) if found is None else sized(found, total, "id")


def walks(hops: DataFrame, seeds: DataFrame, low: int, high: int | None, most: int = MOST_HOPS) -> tuple[DataFrame, int, int]:
    """src, dst of every walk of low to high hops from seeds (id): a row for each walk, however often it ends alike.

    With it, how many walks there are, and how many rows seeds has.
    """
    step = hops.select(F.col("src").alias("_at"), F.col("dst").alias("_to"))
    starts, count = counted(seeds.groupBy(F.col("id").alias("src")).agg(F.count("*").alias("_rows")))
    rows = starts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    front = starts.select("src", F.col("src").alias("dst"))
    parts, total = ([front], count) if low == 0 else ([], 0)
    for turn in range(1, (high if high is not None else most) + 1):
        front = sized(front, count, "dst").join(step, F.col("dst") == F.col("_at")).select("src", F.col("_to").alias("dst"))
        front, count = counted(front)
        if not count:
            break
        if turn >= low:
            parts.append(front)
            total += count
    out = parts[0] if parts else front.limit(0)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out, total, rows


def distances(hops: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """id, distance of all that at most so many hops (src, dst) lead to from seeds (id)."""
    hops = hops.select("src", "dst")
    front, count = counted(seeds.select("id", F.lit(0).alias("distance")).distinct())
    found, total = front, count
    for turn in range(1, most + 1):
        nxt = hops.join(sized(front, count, "id"), F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct().join(sized(found.select("id"), total, "id"), "id", "left_anti")
        front, count = counted(nxt.withColumn("distance", F.lit(turn)))
        if not count:
            break
        found, total = found.unionByName(front), total + count
    return found
