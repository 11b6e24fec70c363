"""A fluent way to write queries; every method returns a new object."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from .ast import (
    Between, Binary, Column, Comparison, CountCall, EdgePattern, Exists, In, IsNull, Labels, NodePattern, Not, Order,
    Paren, Pattern, Patterns, Query, Selector, Star, Table, Unnest,
)

Count = CountCall()


def _selector(x) -> Any:
    if isinstance(x, (Selector, CountCall, Star)):
        return x
    return x.selector if isinstance(x, Ref) else Selector(tuple(x.split(".")))


def _checked(v):
    if not isinstance(v, (str, int, float, bool)) and type(v).__name__ != "Parameter":
        raise TypeError(f"not a value of the language: {v!r}")
    return v


class Ref:
    """A selector with comparison methods."""

    def __init__(self, *parts: str):
        self.selector = Selector(tuple(p for part in parts for p in part.split(".")))

    def field(self, name: str) -> Ref:
        return Ref(*self.selector.parts, name)

    def data(self, path: str) -> Ref:
        return Ref(*self.selector.parts, "data", path)

    def _op(self, op: str, v) -> Comparison:
        return Comparison(self.selector, op, _checked(v))

    def eq(self, v):
        return self._op("=", v)

    def ne(self, v):
        return self._op("!=", v)

    def lt(self, v):
        return self._op("<", v)

    def le(self, v):
        return self._op("<=", v)

    def gt(self, v):
        return self._op(">", v)

    def ge(self, v):
        return self._op(">=", v)

    def like(self, v):
        return self._op("LIKE", v)

    def glob(self, v):
        return self._op("GLOB", v)

    def is_in(self, *values):
        if len(values) == 1 and isinstance(values[0], (Query, Select)):
            return In(self.selector, built(values[0]))
        return In(self.selector, tuple(map(_checked, values)))

    def not_in(self, *values):
        return replace(self.is_in(*values), negated=True)

    def between(self, low, high):
        return Between(self.selector, _checked(low), _checked(high))

    def is_null(self):
        return IsNull(self.selector)

    def is_not_null(self):
        return IsNull(self.selector, True)

    def contains_any(self, *values):
        return Labels(self.selector, "ANY", values)

    def contains_all(self, *values):
        return Labels(self.selector, "ALL", values)

    def not_contains_any(self, *values):
        return Labels(self.selector, "ANY", values, True)

    def not_contains_all(self, *values):
        return Labels(self.selector, "ALL", values, True)

    not_contains = not_contains_any


def count_is(op: str, n: int) -> Comparison:
    return Comparison(Count, op, n)


def _folded(op: str, exprs) -> Any:
    out = None
    for e in exprs:
        if len(exprs) > 1 and isinstance(e, Binary) and e.op != op:
            e = Paren(e)
        out = e if out is None else Binary(op, out, e)
    return out


def all_of(*exprs):
    return _folded("AND", exprs)


def any_of(*exprs):
    return _folded("OR", exprs)


def negate(expr):
    if isinstance(expr, Exists):
        return replace(expr, negated=not expr.negated)
    return Not(expr if isinstance(expr, (Comparison, Paren)) else Paren(expr))


def exists(pattern) -> Exists:
    return Exists(pattern.done() if isinstance(pattern, PatternBuilder) else pattern)


def not_exists(pattern) -> Exists:
    return replace(exists(pattern), negated=True)


def node(var: str | None = None, type: str | None = None, where=None) -> NodePattern:
    return NodePattern(var, type, where)


def edge(*types: str, var: str | None = None) -> EdgePattern:
    return EdgePattern(var, types)


@dataclass(frozen=True)
class PatternBuilder:
    elements: tuple

    def _add(self, e, n, direction) -> PatternBuilder:
        e = EdgePattern(None, (e,)) if isinstance(e, str) else e or EdgePattern()
        n = NodePattern(n) if isinstance(n, str) else n or NodePattern()
        return PatternBuilder((*self.elements, replace(e, direction=direction), n))

    def to(self, e=None, n=None):
        return self._add(e, n, "out")

    def from_(self, e=None, n=None):
        return self._add(e, n, "in")

    def either(self, e=None, n=None):
        return self._add(e, n, "any")

    def done(self) -> Pattern:
        return Pattern(self.elements)


def pattern(start: NodePattern | str) -> PatternBuilder:
    return PatternBuilder((NodePattern(start) if isinstance(start, str) else start,))


def scoped_to(node_id: str, table: str = "nodes") -> Exists:
    """Rows at the node of this id or anywhere under it by contains or has."""
    root = NodePattern("scope_root", None, Ref("id").eq(node_id))
    return Exists(Pattern((root, EdgePattern(None, ("contains", "has"), "out", 0, None), NodePattern(table))))


@dataclass(frozen=True)
class Select:
    query: Query

    def _with(self, **parts) -> Select:
        return Select(replace(self.query, **parts))

    def where(self, *exprs) -> Select:
        return self._with(where=all_of(*([self.query.where] if self.query.where is not None else []), *exprs))

    def scoped_to(self, node_id: str) -> Select:
        source = self.query.source
        return self.where(scoped_to(node_id, source.table if isinstance(source, Unnest) else source.name))

    def group_by(self, *selectors) -> Select:
        return self._with(group_by=tuple(map(_selector, selectors)))

    def having(self, expr) -> Select:
        return self._with(having=expr)

    def order_by(self, *selectors, descending: bool = False) -> Select:
        return self._with(order_by=(*self.query.order_by, *[Order(_selector(s), descending) for s in selectors]))

    def order_by_count(self, descending: bool = True) -> Select:
        return self._with(order_by=(*self.query.order_by, Order(Count, descending)))

    def limit(self, n: int) -> Select:
        return self._with(limit=n)

    def offset(self, n: int) -> Select:
        return self._with(offset=n)

    def distinct(self) -> Select:
        return self._with(distinct=True)

    def build(self) -> Query:
        return self.query


def built(q) -> Query:
    return q.build() if isinstance(q, Select) else q


@dataclass(frozen=True)
class From:
    source: Any

    def select(self, *columns) -> Select:
        made = tuple(c if isinstance(c, Column) else Column(_selector(c)) for c in columns)
        return Select(Query(made or (Column(Star()),), self.source))

    def select_distinct(self, *columns) -> Select:
        return self.select(*columns).distinct()

    def json_each(self, selector: str, alias: str | None = None) -> From:
        return From(Unnest(self.source.name, "json_each", _selector(selector), alias))


Nodes, Edges = From(Table("nodes")), From(Table("edges"))


def from_patterns(*patterns) -> From:
    return From(Patterns(tuple(p.done() if isinstance(p, PatternBuilder) else p for p in patterns)))
