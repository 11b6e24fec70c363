"""From text to syntax tree: a tokenizer and a recursive descent."""

from __future__ import annotations

import re
from functools import lru_cache

from ..model import QueryError
from .ast import (
    Between, Binary, Column, Comparison, CountCall, EdgePattern, Exists, In, IsNull, Labels, NodePattern, Not, Order,
    Parameter, Paren, Pattern, Patterns, Query, Selector, Star, Table, Unnest,
)

TOKEN = re.compile(
    r"(?P<skip>\s+|--[^\n]*)|(?P<arrow>->|<-)|(?P<op><=|>=|!=|=|<|>)|(?P<dots>\.\.)|(?P<string>'(?:[^']|'')*')"
    r"|(?P<number>\d+(?:\.\d+)?)|(?P<param>\$\w+)|(?P<word>[^\W\d]\w*)|(?P<glob>[*?]+)|(?P<mark>[()\[\],.:|-])"
)


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError("validate", f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    return out + [("end", "", at)]


class _Parser:
    def __init__(self, text: str):
        self.all, self.at = tokens(text), 0

    def peek(self, *words: str, ahead: int = 0) -> bool:
        kind, text, _ = self.all[min(self.at + ahead, len(self.all) - 1)]
        return kind != "string" and text.upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> str:
        text = self.all[self.at][1]
        if not self.take(*words):
            raise QueryError("validate", f"expected {' or '.join(words)}, found {text or 'the end'!r} at {self.all[self.at][2]}")
        return text

    def kind(self, *kinds: str) -> str:
        kind, text, place = self.all[self.at]
        if kind not in kinds:
            raise QueryError("validate", f"expected {' or '.join(kinds)}, found {text or 'the end'!r} at {place}")
        self.at += 1
        return text

    def query(self, nested: bool = False) -> Query:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        columns = self.listed(self.column)
        self.need("FROM")
        source, where, group, having, order, limit, offset = self.source(), None, (), None, (), None, None
        if self.take("WHERE"):
            where = self.either()
        if self.take("GROUP"):
            self.need("BY")
            group = self.listed(self.selector)
        if self.take("HAVING"):
            having = self.either()
        if self.take("ORDER"):
            self.need("BY")
            order = self.listed(self.order)
        if self.take("LIMIT"):
            limit = int(self.kind("number"))
        if self.take("OFFSET"):
            offset = int(self.kind("number"))
        if not nested:
            self.kind("end")
        return Query(columns, source, where, group, having, order, limit, offset, distinct)

    def listed(self, item) -> tuple:
        out = [item()]
        while self.take(","):
            out.append(item())
        return tuple(out)

    def counted(self) -> bool:
        if self.peek("COUNT") and self.peek("(", ahead=1):
            self.at += 1
            self.need("(")
            self.need("*")
            self.need(")")
            return True
        return False

    def column(self) -> Column:
        expr = Star() if self.take("*") else CountCall() if self.counted() else self.selector()
        return Column(expr, self.kind("word") if self.take("AS") else None)

    def selector(self) -> Selector:
        parts = [self.kind("word")]
        while self.take("."):
            parts.append(self.kind("word"))
        return Selector(tuple(parts))

    def order(self) -> Order:
        expr = CountCall() if self.counted() else self.selector()
        down = self.take("DESC")
        if not down:
            self.take("ASC")
        return Order(expr, down)

    def source(self):
        if self.peek("("):
            return Patterns(self.listed(self.pattern))
        name = self.kind("word")
        if self.take(","):
            function = self.kind("word")
            self.need("(")
            selector = self.selector()
            self.need(")")
            self.take("AS")
            alias = None
            if self.all[self.at][0] == "word" and not self.peek("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET"):
                alias = self.kind("word")
            return Unnest(name, function, selector, alias)
        return Table(name)

    def pattern(self) -> Pattern:
        out = [self.node()]
        while self.peek("-", "<-"):
            out.append(self.edge())
            out.append(self.node())
        return Pattern(tuple(out))

    def node(self) -> NodePattern:
        self.need("(")
        var = kind = where = None
        if self.all[self.at][0] == "word" and not self.peek("WHERE"):
            var = self.kind("word")
        if self.take(":"):
            kind = ""
            while self.all[self.at][0] in ("word", "glob") or self.peek(":"):
                if self.peek("WHERE") and kind:
                    break
                kind += self.all[self.at][1]
                self.at += 1
        if self.take("WHERE"):
            where = self.either()
        self.need(")")
        return NodePattern(var, kind, where)

    def edge(self) -> EdgePattern:
        begin = self.need("-", "<-")
        self.need("[")
        var, types, low, high = None, (), None, None
        if self.all[self.at][0] == "word":
            var = self.kind("word")
        if self.take(":") and not self.peek("*"):
            types = [self.kind("word")]
            while self.take("|"):
                types.append(self.kind("word"))
        if self.take("*"):
            low, high = 1, None
            if self.all[self.at][0] == "number":
                low = high = int(self.kind("number"))
                if self.take(".."):
                    high = int(self.kind("number")) if self.all[self.at][0] == "number" else None
            elif self.take(".."):
                high = int(self.kind("number"))
        self.need("]")
        end = self.need("-", "->")
        direction = "in" if (begin, end) == ("<-", "-") else "out" if (begin, end) == ("-", "->") else "any"
        return EdgePattern(var, tuple(types), direction, low, high)

    def either(self):
        out = self.both()
        while self.take("OR"):
            out = Binary("OR", out, self.both())
        return out

    def both(self):
        out = self.one()
        while self.take("AND"):
            out = Binary("AND", out, self.one())
        return out

    def one(self):
        if self.take("NOT"):
            if self.take("EXISTS"):
                return Exists(self.pattern(), True)
            return Not(self.primary())
        return self.primary()

    def primary(self):
        if self.take("EXISTS"):
            return Exists(self.pattern())
        if self.take("("):
            out = self.either()
            self.need(")")
            return Paren(out)
        left = CountCall() if self.counted() else self.selector()
        if self.all[self.at][0] == "op":
            return Comparison(left, self.kind("op"), self.value())
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return IsNull(left, negated)
        negated = self.take("NOT")
        no = "NOT " if negated else ""
        if self.take("LIKE"):
            return Comparison(left, no + "LIKE", self.value())
        if self.take("GLOB"):
            return Comparison(left, no + "GLOB", self.value())
        if self.take("BETWEEN"):
            low = self.value()
            self.need("AND")
            return Between(left, low, self.value(), negated)
        if self.take("IN"):
            self.need("(")
            values = self.query(nested=True) if self.peek("SELECT") else self.listed(self.value)
            self.need(")")
            return In(left, values, negated)
        if self.take("CONTAINS"):
            mode = self.need("ANY", "ALL").upper() if self.peek("ANY", "ALL") else "ANY"
            self.need("(")
            values = self.listed(self.value)
            self.need(")")
            return Labels(left, mode, values, negated)
        raise QueryError("validate", f"expected a predicate after {left}, found {self.all[self.at][1]!r} at {self.all[self.at][2]}")

    def value(self):
        kind, text, place = self.all[self.at]
        self.at += 1
        if kind == "string":
            return text[1:-1].replace("''", "'")
        if kind == "number":
            return float(text) if "." in text else int(text)
        if kind == "param":
            return Parameter(text[1:])
        if text.upper() in ("TRUE", "FALSE"):
            return text.upper() == "TRUE"
        raise QueryError("validate", f"expected a value, found {text!r} at {place}")


@lru_cache(maxsize=1024)
def parse(text: str) -> Query:
    return _Parser(text).query()


def parse_expression(text: str):
    p = _Parser(text)
    out = p.either()
    p.kind("end")
    return out


def parse_pattern(text: str) -> Pattern:
    p = _Parser(text)
    out = p.pattern()
    p.kind("end")
    return out
