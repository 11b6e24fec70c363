"""What a source is, which events it wants, and a register of sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex
from ..model import NoSource

Graph = tuple[DataFrame, DataFrame]


class Source(Protocol):
    """Reads what a URI stands for.

    A source may have more: `subscriptions` and `handle(events, generation, root)`, which turns the events it wants into
    nodes and edges, and labels (id, labels) of other nodes or None; `derived`, the schemes of the URIs of nodes it makes
    of others' files, so that they go when the file does; and `post(nodes, edges, generation)`, edges that are found once
    all else is read.
    """

    name: str
    schemes: tuple[str, ...]

    def read(self, spark: SparkSession, uri: str, generation: str) -> Graph: ...


@dataclass(frozen=True)
class Subscription:
    """Which events a source wants; None is any."""

    events: tuple[str, ...] = ()
    node_type: str | None = None
    name: str | None = None
    glob: str | None = None
    extension: str | None = None

    def test(self) -> Column:
        out = F.lit(True)
        if self.events:
            out &= F.col("event").isin(*self.events)
        if self.node_type:
            out &= F.col("type") == self.node_type
        if self.name:
            out &= F.col("name") == self.name
        if self.glob:
            out &= F.col("name").rlike(glob_regex(self.glob))
        if self.extension:
            out &= F.col("name").endswith("." + self.extension.lstrip("."))
        return out


def wanted(events: DataFrame, subscriptions: Sequence[Subscription]) -> DataFrame:
    """The events that any of the subscriptions fits, each once."""
    return events.where(reduce(Column.__or__, (s.test() for s in subscriptions), F.lit(False)))


class Sources:
    def __init__(self) -> None:
        self.known: list[Source] = []

    def register(self, source: Source) -> None:
        self.known.append(source)

    def of(self, uri: str) -> Source:
        for source in self.known:
            if source.schemes and uri.startswith(source.schemes):
                return source
        raise NoSource(uri)

    def subscribers(self) -> list[Source]:
        return [s for s in self.known if getattr(s, "subscriptions", ())]

    def derived(self) -> list[str]:
        return sorted({x for s in self.known for x in getattr(s, "derived", ())})
