"""What can be said against a query before it is compiled."""

from __future__ import annotations

from .ast import Between, Comparison, CountCall, EdgePattern, Exists, In, IsNull, Labels, NodePattern, Patterns, Query, Selector, Star, Table, Unnest, walk


def _selectors(expr):
    for x in walk(expr):
        if isinstance(x, (Comparison, In, Between, IsNull, Labels)) and isinstance(x.left, Selector):
            yield x.left


def validate(q: Query) -> list[str]:
    out: list[str] = []
    if not q.columns:
        out.append("SELECT needs at least one column")
    if q.having is not None and not q.group_by:
        out.append("HAVING requires GROUP BY")
    if isinstance(q.source, (Table, Unnest)):
        name = q.source.name if isinstance(q.source, Table) else q.source.table
        if name not in ("nodes", "edges"):
            out.append(f"unknown table {name}: FROM takes nodes, edges or a pattern")
        if isinstance(q.source, Unnest) and q.source.function.lower() != "json_each":
            out.append(f"unknown table function {q.source.function}")
        if q.group_by and any(isinstance(c.expr, Star) for c in q.columns):
            out.append("SELECT * does not go with GROUP BY")
    elif isinstance(q.source, Patterns):
        known: set[str] = set()
        for pattern in q.source.patterns:
            own: set[str] = set()
            for e in pattern.elements:
                if e.var and e.var in own:
                    out.append(f"duplicate variable {e.var} in a pattern")
                if e.var:
                    own.add(e.var)
                if isinstance(e, NodePattern) and e.where is not None:
                    out += _scope(e.where)
            known |= own
        if not known:
            out.append("a pattern needs at least one variable")
        used = [c.expr for c in q.columns if isinstance(c.expr, Selector)] + list(q.group_by) + [o.expr for o in q.order_by if isinstance(o.expr, Selector)]
        aliases = {c.alias for c in q.columns if c.alias}
        for s in used + list(_selectors(q.where)) + list(_selectors(q.having)):
            if s.parts[0] not in known and str(s) not in aliases:
                out.append(f"undefined variable {s.parts[0]}")
    for part in (q.where, q.having):
        for x in walk(part):
            if isinstance(x, Exists) and len(x.pattern.elements) < 3:
                out.append("EXISTS needs a pattern with an edge")
            if isinstance(x, In) and isinstance(x.values, Query):
                out += validate(x.values)
                if len(x.values.columns) != 1 or isinstance(x.values.columns[0].expr, (Star, CountCall)):
                    out.append("a subquery of IN selects one column")
    for x in walk(q.where):
        if isinstance(x, Comparison) and isinstance(x.left, CountCall):
            out.append("COUNT(*) belongs in HAVING")
    if isinstance(q.source, Patterns):
        for e in (e for p in q.source.patterns for e in p.elements if isinstance(e, EdgePattern)):
            if e.high is not None and e.low is not None and e.high < e.low:
                out.append("a hop range must not be empty")
    return out


def _scope(expr) -> list[str]:
    return [f"a node's WHERE takes fields of that node, not {s}" for s in _selectors(expr) if len(s.parts) > 1 and s.parts[0] != "data"]
