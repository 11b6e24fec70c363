"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class Selector:
    """A dotted name: a column, data.path, variable, variable.field or variable.data.path."""

    parts: tuple[str, ...]

    def __str__(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class CountCall:
    pass


@dataclass(frozen=True)
class Column:
    expr: Selector | Star | CountCall
    alias: str | None = None


@dataclass(frozen=True)
class Comparison:
    left: Selector | CountCall
    op: str  # = != < <= > >= LIKE GLOB NOT LIKE NOT GLOB
    value: Any


@dataclass(frozen=True)
class In:
    left: Selector
    values: Any  # a tuple or a Query
    negated: bool = False


@dataclass(frozen=True)
class Between:
    left: Selector
    low: Any
    high: Any
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    left: Selector
    negated: bool = False


@dataclass(frozen=True)
class Labels:
    """CONTAINS: mode is ANY or ALL."""

    left: Selector
    mode: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    pattern: Pattern
    negated: bool = False


@dataclass(frozen=True)
class Not:
    expr: Any


@dataclass(frozen=True)
class Paren:
    expr: Any


@dataclass(frozen=True)
class Binary:
    op: str  # AND, OR
    left: Any
    right: Any


@dataclass(frozen=True)
class NodePattern:
    var: str | None = None
    type: str | None = None
    where: Any = None


@dataclass(frozen=True)
class EdgePattern:
    var: str | None = None
    types: tuple[str, ...] = ()
    direction: str = "out"  # out, in, any
    low: int | None = None  # None: one hop and no quantifier
    high: int | None = None  # None with low: no upper bound

    def hops(self, low: int, high: int | None) -> EdgePattern:
        return replace(self, low=low, high=high)


@dataclass(frozen=True)
class Pattern:
    """Node, edge, node and so on."""

    elements: tuple


@dataclass(frozen=True)
class Table:
    name: str


@dataclass(frozen=True)
class Unnest:
    """FROM table, json_each(selector) AS alias."""

    table: str
    function: str
    selector: Selector
    alias: str | None = None


@dataclass(frozen=True)
class Patterns:
    patterns: tuple[Pattern, ...]


@dataclass(frozen=True)
class Order:
    expr: Selector | CountCall
    descending: bool = False


@dataclass(frozen=True)
class Query:
    columns: tuple[Column, ...]
    source: Table | Unnest | Patterns
    where: Any = None
    group_by: tuple[Selector, ...] = ()
    having: Any = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False


def conjuncts(expr) -> list:
    if expr is None:
        return []
    if isinstance(expr, Paren):
        return conjuncts(expr.expr)
    if isinstance(expr, Binary) and expr.op == "AND":
        return conjuncts(expr.left) + conjuncts(expr.right)
    return [expr]


def walk(expr):
    """expr and all expressions in it."""
    if expr is None:
        return
    yield expr
    if isinstance(expr, (Paren, Not)):
        yield from walk(expr.expr)
    elif isinstance(expr, Binary):
        yield from walk(expr.left)
        yield from walk(expr.right)
