"""Expressions over a scope, with the comparison rules of the language.

JSON values keep their kind: a number never equals a text and sorts before it, booleans count as 1 and 0. Plain columns
are text, and a number they are compared with becomes text; expires_at is the one plain number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex, like
from ..model import QueryError
from .ast import Between, Binary, Comparison, CountCall, Exists, In, IsNull, Labels, Not, Parameter, Paren, Query, Selector

OPS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


class Value:
    """What a selector stands for: a plain column, or a place in a VARIANT."""

    def __init__(self, column: Column, kind: str = "text"):
        self.column, self.kind = column, kind  # text, number, labels, json

    def _kinds(self) -> tuple[Column, Column]:
        of = F.schema_of_variant(self.column)
        return of == "STRING", of.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN|INT|TINYINT|SMALLINT)")

    def null(self) -> Column:
        if self.kind != "json":
            return self.column.isNull()
        return self.column.isNull() | F.is_variant_null(self.column)

    def text(self) -> Column:
        """As text: the text itself, a number's digits, other JSON as JSON."""
        if self.kind == "labels":
            return F.to_json(self.column)
        if self.kind != "json":
            return self.column.cast("string")
        string, number = self._kinds()
        return F.when(self.null(), None).when(string | number, F.try_variant_get(self.column, "$", "string")).otherwise(F.to_json(self.column))

    def number(self) -> Column:
        """A JSON number or boolean as a double, else null."""
        _, number = self._kinds()
        flag = F.try_variant_get(self.column, "$", "boolean")
        whole = F.when(F.schema_of_variant(self.column) == "BOOLEAN", flag.cast("double")).otherwise(F.try_variant_get(self.column, "$", "double"))
        return F.when(number, whole)

    def compare(self, op: str, literal) -> Column:
        if isinstance(literal, bool):
            literal = int(literal)
        if self.kind == "number":
            if isinstance(literal, str):
                return F.when(self.column.isNotNull(), F.lit(op in ("<", "<=", "!=")))
            return OPS[op](self.column, F.lit(literal))
        if self.kind != "json":
            return OPS[op](self.text(), F.lit(str(literal)))
        if isinstance(literal, str):
            below = op in ("<", "<=", "!=")
            _, number = self._kinds()
            return F.when(self.null(), None).when(number, F.lit(below)).otherwise(OPS[op](self.text(), F.lit(literal)))
        above = op in (">", ">=", "!=")
        return F.when(self.null(), None).otherwise(F.coalesce(OPS[op](self.number(), F.lit(float(literal))), F.lit(above)))

    def sort_keys(self, descending: bool) -> list[Column]:
        """Nulls first, then numbers, then texts; reversed when descending."""
        if self.kind == "json":
            keys = [F.when(self.null(), 0).when(self.number().isNotNull(), 1).otherwise(2), self.number(), F.when(self.number().isNull(), self.text())]
        else:
            keys = [self.column if self.kind == "number" else self.text()]
        return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def any_of(label_column: Column, values) -> Column:
    return F.arrays_overlap(F.coalesce(label_column, F.array().cast("array<string>")), F.array(*[F.lit(v) for v in values]))


def all_of(label_column: Column, values) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(v) for v in values]), F.coalesce(label_column, F.array().cast("array<string>")))) == 0


class Predicates:
    """Compiles expressions; resolve gives a selector's Value, members runs a subquery, exists tests a pattern."""

    def __init__(self, resolve: Callable[[Selector | CountCall], Value], params: dict, members=None, exists=None):
        self.resolve, self.params, self.members, self.exists = resolve, params, members, exists

    def literal(self, v):
        if not isinstance(v, Parameter):
            return v
        key = int(v.name) if v.name.isdigit() and int(v.name) in self.params else v.name
        if key not in self.params:
            raise QueryError("compile", f"no value for parameter ${v.name}")
        return self.params[key]

    def __call__(self, x) -> Column:
        match x:
            case Paren():
                return self(x.expr)
            case Binary():
                a, b = self(x.left), self(x.right)
                return a & b if x.op == "AND" else a | b
            case Not():
                return ~self(x.expr)
            case Comparison():
                return self.comparison(x)
            case In():
                value = self.resolve(x.left)
                if isinstance(x.values, Query):
                    found = value.text().isin(self.members(x.values))
                else:
                    found = None
                    for v in x.values:
                        one = value.compare("=", self.literal(v))
                        found = one if found is None else found | one
                return ~found if x.negated else found
            case Between():
                value = self.resolve(x.left)
                inside = value.compare(">=", self.literal(x.low)) & value.compare("<=", self.literal(x.high))
                return ~inside if x.negated else inside
            case IsNull():
                null = self.resolve(x.left).null()
                return ~null if x.negated else null
            case Labels():
                values = [self.literal(v) for v in x.values]
                if not all(isinstance(v, str) for v in values):
                    raise QueryError("compile", "CONTAINS takes texts")
                value = self.resolve(x.left)
                if value.kind != "labels":
                    raise QueryError("compile", "CONTAINS works on labels of nodes")
                found = all_of(value.column, values) if x.mode == "ALL" else any_of(value.column, values)
                return ~found if x.negated else found
            case Exists():
                found = self.exists(x.pattern)
                return ~found if x.negated else found
        raise QueryError("compile", f"not an expression: {type(x).__name__}")

    def comparison(self, x: Comparison) -> Column:
        value, literal = self.resolve(x.left), self.literal(x.value)
        op = x.op.removeprefix("NOT ")
        if op in ("LIKE", "GLOB"):
            found = like(value.text(), str(literal)) if op == "LIKE" else value.text().rlike(glob_regex(str(literal)))
            return ~found if x.op.startswith("NOT ") else found
        return value.compare(op, literal)
