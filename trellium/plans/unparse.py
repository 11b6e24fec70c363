"""From syntax tree to text, and trees for people."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from .ast import (
    Between, Binary, Column, Comparison, CountCall, EdgePattern, Exists, In, IsNull, Labels, NodePattern, Not, Order,
    Parameter, Paren, Pattern, Patterns, Query, Selector, Star, Table, Unnest,
)


def value_text(v) -> str:
    if isinstance(v, Parameter):
        return f"${v.name}"
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def unparse(x) -> str:
    match x:
        case Selector():
            return str(x)
        case Star():
            return "*"
        case CountCall():
            return "COUNT(*)"
        case Column():
            return unparse(x.expr) + (f" AS {x.alias}" if x.alias else "")
        case Order():
            return unparse(x.expr) + " DESC" * x.descending
        case Comparison():
            return f"{unparse(x.left)} {x.op} {value_text(x.value)}"
        case In():
            inner = unparse(x.values) if isinstance(x.values, Query) else ", ".join(map(value_text, x.values))
            return f"{unparse(x.left)} {'NOT ' * x.negated}IN ({inner})"
        case Between():
            return f"{unparse(x.left)} {'NOT ' * x.negated}BETWEEN {value_text(x.low)} AND {value_text(x.high)}"
        case IsNull():
            return f"{unparse(x.left)} IS {'NOT ' * x.negated}NULL"
        case Labels():
            return f"{unparse(x.left)} {'NOT ' * x.negated}CONTAINS {x.mode} ({', '.join(map(value_text, x.values))})"
        case Exists():
            return f"{'NOT ' * x.negated}EXISTS {unparse(x.pattern)}"
        case Not():
            inner = x.expr if isinstance(x.expr, (Paren, Comparison, In, Between, IsNull, Labels)) else Paren(x.expr)
            return f"NOT {unparse(inner)}"
        case Paren():
            return f"({unparse(x.expr)})"
        case Binary():
            sides = (Paren(s) if x.op == "AND" and isinstance(s, Binary) and s.op == "OR" else s for s in (x.left, x.right))
            return f" {x.op} ".join(map(unparse, sides))
        case NodePattern():
            return f"({x.var or ''}{':' + x.type if x.type else ''}{' WHERE ' + unparse(x.where) if x.where else ''})"
        case EdgePattern():
            hops = ""
            if x.low is not None:
                hops = f"*{x.low}" if x.low == x.high else f"*{x.low}..{'' if x.high is None else x.high}"
            inner = f"{x.var or ''}{':' + '|'.join(x.types) if x.types else ''}{hops}"
            return {"out": "-[{}]->", "in": "<-[{}]-", "any": "-[{}]-"}[x.direction].format(inner)
        case Pattern():
            return "".join(map(unparse, x.elements))
        case Patterns():
            return ", ".join(map(unparse, x.patterns))
        case Table():
            return x.name
        case Unnest():
            return f"{x.table}, {x.function}({x.selector})" + (f" AS {x.alias}" if x.alias else "")
        case Query():
            out = "SELECT " + "DISTINCT " * x.distinct + ", ".join(map(unparse, x.columns)) + " FROM " + unparse(x.source)
            for word, part in (("WHERE", x.where), ("HAVING", None)):
                out += f" {word} {unparse(part)}" if part is not None else ""
            out += " GROUP BY " + ", ".join(map(unparse, x.group_by)) if x.group_by else ""
            out += f" HAVING {unparse(x.having)}" if x.having is not None else ""
            out += " ORDER BY " + ", ".join(map(unparse, x.order_by)) if x.order_by else ""
            out += f" LIMIT {x.limit}" if x.limit is not None else ""
            return out + (f" OFFSET {x.offset}" if x.offset is not None else "")
    raise TypeError(type(x).__name__)


def dump(x, depth: int = 0) -> str:
    """The tree, a line for each node."""
    pad = "  " * depth
    if is_dataclass(x):
        inner = "".join(dump(getattr(x, f.name), depth + 1) for f in fields(x) if getattr(x, f.name) not in (None, (), False))
        return f"{pad}{type(x).__name__}\n{inner}"
    if isinstance(x, tuple):
        return "".join(dump(i, depth) for i in x)
    return f"{pad}{x!r}\n"


def as_json(x):
    """The tree as JSON values."""
    if is_dataclass(x):
        return {"node": type(x).__name__} | {f.name: as_json(getattr(x, f.name)) for f in fields(x)}
    return [as_json(i) for i in x] if isinstance(x, tuple) else x
