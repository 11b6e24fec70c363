"""From syntax tree to DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_COLUMNS, NODE_COLUMNS, ROW_COLUMNS, QueryError, active
from ..shared import FEW, FEW_WHOLE, counted, sized
from .ast import Column, CountCall, EdgePattern, Exists, In, NodePattern, Pattern, Patterns, Query, Selector, Star, Table, Unnest, conjuncts
from .paths import of_types, oriented, reachable, type_test, walks
from .predicates import Predicates, Value
from .validate import validate


@dataclass
class Result:
    """A lazy result: kind is nodes, edges, counts or rows; counts have the columns name and count."""

    df: DataFrame
    kind: str
    columns: list[str]
    grouping: str | None = None

    def count(self) -> int:
        """The sum of the counts, or the number of rows."""
        if self.kind == "counts":
            return self.df.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        return self.df.count()


PLAIN = {"nodes": [*NODE_COLUMNS, "expires_at"], "edges": [*EDGE_COLUMNS, "expires_at"]}


def _value(name: str, column: SparkColumn) -> Value:
    return Value(column, "labels" if name == "labels" else "json" if name == "data" else "number" if name == "expires_at" else "text")


def _json(data: SparkColumn, path: tuple[str, ...]) -> Value:
    return Value(F.try_variant_get(data, "$." + ".".join(path), "variant"), "json")


class Compiler:
    def __init__(self, nodes: DataFrame, edges: DataFrame, params: dict | None = None, now: int | None = None):
        self.tables = {"nodes": active(nodes, now), "edges": active(edges, now)}
        self.params = params or {}

    def run(self, q: Query) -> Result:
        if problems := validate(q):
            raise QueryError("validate", "; ".join(problems))
        if isinstance(q.source, Patterns):
            return self.pattern_query(q)
        return self.table_query(q)

    # --- tables, with or without json_each

    def table_query(self, q: Query) -> Result:
        unnest = q.source if isinstance(q.source, Unnest) else None
        table = unnest.table if unnest else q.source.name
        df, star = self.tables[table], NODE_COLUMNS if table == "nodes" else EDGE_COLUMNS

        def resolve(s) -> Value:
            if isinstance(s, CountCall):
                return Value(F.col("_count"), "number")
            parts = s.parts
            if unnest and len(parts) == 1 and parts[0] in ("value", "key"):
                return Value(F.col("_each"), "json") if parts[0] == "value" else Value(F.col("_at"), "text")
            if unnest and unnest.alias and parts[0] == unnest.alias:
                return Value(F.col("_at"), "text") if parts[1:] == ("key",) else Value(F.col("_each"), "json")
            if parts[0] == table and len(parts) > 1:
                parts = parts[1:]
            if parts[0] not in PLAIN[table]:
                raise QueryError("compile", f"{table} has no column {s}")
            if len(parts) > 1 and parts[0] != "data":
                raise QueryError("compile", f"{parts[0]} has no fields")
            return _json(F.col("data"), parts[1:]) if len(parts) > 1 else _value(parts[0], F.col(parts[0]))

        if unnest:
            df = self.unnested(df, resolve(unnest.selector))
        link = "id" if table == "nodes" else "from_id"
        test = Predicates(resolve, self.params, self.members, lambda p: F.col(link).isin(self.holders(p, table)))
        for part in conjuncts(q.where):
            df = self.filtered(df, part, test, {None: link, table: link})
        return self.finish(q, df, resolve, test, table, lambda: [(c, F.col(c)) for c in star])

    @staticmethod
    def unnested(df: DataFrame, value: Value) -> DataFrame:
        """A row for each element or member, with its key _at and value _each; one for a scalar, none for null."""
        if value.kind == "labels":
            each = df.select("*", F.posexplode(value.column).alias("_at", "_text")).withColumn("_at", F.col("_at").cast("string"))
            return each.withColumn("_each", F.col("_text").cast("variant")).drop("_text")
        held = df.withColumn("_json", value.column).where(~value.null())
        kind = F.schema_of_variant("_json")
        nested = kind.rlike("^(ARRAY|OBJECT)")
        members = F.when(kind.startswith("OBJECT"), F.try_variant_get("_json", "$", "map<string,variant>"))
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get("_json", "$", "array<variant>"))
        pairs = F.coalesce(
            F.transform(items, lambda x, i: F.struct(i.cast("string").alias("_at"), x.alias("_each"))),
            F.transform(F.map_entries(members), lambda e: F.struct(e["key"].alias("_at"), e["value"].alias("_each"))),
            F.when(~nested, F.array(F.struct(F.lit(None).cast("string").alias("_at"), F.col("_json").alias("_each")))),
        )
        return held.withColumn("_pairs", pairs).drop("_json").select("*", F.explode("_pairs").alias("_pair")).select("*", "_pair._at", "_pair._each").drop("_pairs", "_pair")

    def members(self, q: Query) -> DataFrame:
        """The one column of a subquery, as text."""
        got = self.run(replace(q, columns=(Column(q.columns[0].expr, "_member"),))).df
        return got.select(F.col("_member").cast("string"))

    def filtered(self, df: DataFrame, part, test: Predicates, links: dict) -> DataFrame:
        """df where part holds; a pattern that must or must not exist is a semi or anti join, and so is NOT IN a subquery."""
        if isinstance(part, Exists):
            name = next((e.var for e in part.pattern.elements if isinstance(e, NodePattern) and e.var in links), None)
            ids = self.holders(part.pattern, name).withColumnRenamed("id", "_holder")
            return df.join(ids, df[links[name]] == ids["_holder"], "left_anti" if part.negated else "left_semi")
        if isinstance(part, In) and part.negated and isinstance(part.values, Query):
            return self.without(df, test.resolve(part.left).text(), self.members(part.values))
        return df.where(test(part))

    @staticmethod
    def without(df: DataFrame, value: SparkColumn, members: DataFrame) -> DataFrame:
        """df where value NOT IN members: of no members all rows, of members with a null none.

        Spark's own NOT IN of columns that may be null broadcasts all members.
        """
        members, count = counted(members.distinct())
        if not count:
            return df
        if not members.where("_member IS NULL").isEmpty():
            return df.limit(0)
        return df.where(value.isNotNull()).join(sized(members, count, "_member"), value == F.col("_member"), "left_anti")

    # --- what all queries end with

    def finish(self, q: Query, df: DataFrame, resolve, test: Predicates, what: str, star, whole=None) -> Result:
        names = {c.alias: c.expr for c in q.columns if c.alias}
        look = lambda s: resolve(names.get(s.parts[0], s)) if isinstance(s, Selector) and len(s.parts) == 1 and s.parts[0] in names else resolve(s)
        counted = any(isinstance(c.expr, CountCall) for c in q.columns) or bool(q.group_by)
        out: list[tuple[str, SparkColumn]] = []
        if counted:
            keys = [resolve(s) for s in q.group_by]
            grouped = df.groupBy(*[k.text().alias(f"_key{i}") for i, k in enumerate(keys)])
            extra, by = {}, {str(s): i for i, s in enumerate(q.group_by)}
            for i, c in enumerate(q.columns):
                if isinstance(c.expr, Selector) and str(c.expr) not in by:
                    extra[f"_bare{i}"] = F.any_value(resolve(c.expr).text())
            for i, o in enumerate(q.order_by):
                if isinstance(o.expr, Selector) and str(o.expr) not in by and str(o.expr) not in names:
                    extra[f"_sort{i}"] = F.any_value(resolve(o.expr).text())
            kinds = {f"_number{i}": F.min(k.number()) for i, k in enumerate(keys) if k.kind == "json"}
            df = grouped.agg(F.count("*").alias("_count"), *[v.alias(k) for k, v in (extra | kinds).items()])

            def after(s) -> Value:
                if isinstance(s, CountCall):
                    return Value(F.col("_count"), "number")
                s = names.get(str(s), s)
                if isinstance(s, CountCall):
                    return Value(F.col("_count"), "number")
                if str(s) in by:
                    return Value(F.col(f"_key{by[str(s)]}"))
                raise QueryError("compile", f"{s} is neither grouped nor counted")

            if q.having is not None:
                df = df.where(Predicates(after, self.params)(q.having))
            for i, c in enumerate(q.columns):
                if isinstance(c.expr, CountCall):
                    out.append((c.alias or "COUNT(*)", F.col("_count")))
                else:
                    out.append((c.alias or str(c.expr), F.col(f"_key{by[str(c.expr)]}") if str(c.expr) in by else F.col(f"_bare{i}")))

            def sort_keys(o, i):
                e = names.get(str(o.expr), o.expr) if isinstance(o.expr, Selector) else o.expr
                if isinstance(e, Selector) and str(e) in by and f"_number{by[str(e)]}" in kinds:
                    n, t = F.col(f"_number{by[str(e)]}"), F.col(f"_key{by[str(e)]}")
                    keys = [F.when(t.isNull(), 0).when(n.isNotNull(), 1).otherwise(2), n, t]
                    return [k.desc_nulls_last() if o.descending else k.asc_nulls_first() for k in keys]
                return (Value(F.col(f"_sort{i}")) if f"_sort{i}" in extra else after(o.expr)).sort_keys(o.descending)
        else:
            for c in q.columns:
                if isinstance(c.expr, Star):
                    out += star()
                elif whole and isinstance(c.expr, Selector) and (got := whole(c)) is not None:
                    out += got
                else:
                    value = resolve(c.expr)
                    plain = value.kind in ("labels", "number") or len(c.expr.parts) == 1 and value.kind == "json" and c.expr.parts == ("data",)
                    out.append((c.alias or str(c.expr), value.column if plain or c.expr.parts[-1] == "data" and value.kind == "json" else value.text()))
            sort_keys = lambda o, i: look(o.expr).sort_keys(o.descending)
        counts = counted and any(isinstance(c.expr, CountCall) for c in q.columns) and len(q.columns) <= 2
        kind = "counts" if counts else "rows" if counted and len(q.columns) > 1 else what
        order = [k for i, o in enumerate(q.order_by) for k in sort_keys(o, i)]
        if q.distinct:
            shown = df.select(*[(F.to_json(c) if t.startswith("variant") else c).alias(n) for (n, c), t in zip(out, self.types(df, out))]).distinct()
            df = shown.orderBy(*[self.shown(o, q, shown) for o in q.order_by]) if order else shown
        else:
            df = df.orderBy(*order) if order else df
            df = df.select(*[c.alias(n) for n, c in out])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Result(df, kind, [n for n, _ in out], str(q.group_by[0]) if q.group_by else None)

    @staticmethod
    def types(df: DataFrame, out) -> list[str]:
        return [t for _, t in df.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(out)]).dtypes]

    @staticmethod
    def shown(o, q: Query, df: DataFrame) -> SparkColumn:
        name = next((c.alias or str(c.expr) for c in q.columns if str(o.expr) in (c.alias, str(c.expr))), str(o.expr))
        if name not in df.columns:
            raise QueryError("compile", f"SELECT DISTINCT is ordered by what it selects, not by {o.expr}")
        return df[f"`{name}`"].desc_nulls_last() if o.descending else df[f"`{name}`"].asc_nulls_first()

    # --- patterns

    def node_rows(self, e: NodePattern) -> DataFrame:
        """The nodes that an element allows by itself."""
        df = self.tables["nodes"]
        if (test := type_test(F.col("type"), e.type)) is not None:
            df = df.where(test)
        if e.where is not None:

            def resolve(s) -> Value:
                parts = s.parts[1:] if s.parts[0] == e.var and len(s.parts) > 1 else s.parts
                if parts[0] not in PLAIN["nodes"]:
                    raise QueryError("compile", f"nodes have no column {s}")
                return _json(F.col("data"), parts[1:]) if len(parts) > 1 else _value(parts[0], F.col(parts[0]))

            test = Predicates(resolve, self.params, self.members, lambda p: F.col("id").isin(self.holders(p, "nodes")))
            for part in conjuncts(e.where):
                df = self.filtered(df, part, test, {}) if isinstance(part, In) else df.where(test(part))
        return df

    def hop_rows(self, e: EdgePattern) -> DataFrame:
        return oriented(of_types(self.tables["edges"], e.types), e.direction)

    def holders(self, pattern: Pattern, outer: str | None) -> DataFrame:
        """The ids, once each, of the nodes for which the pattern exists.

        They stand at the element that is named as the outer row is, else at the first. What is left and right of it
        asks nothing of each other, so each side is a chain of semi joins, and a hop of variable length a reachability.
        """
        elements = pattern.elements
        at = next((i for i, e in enumerate(elements) if isinstance(e, NodePattern) and outer and e.var == outer), 0)
        ids = None
        if elements[at].type or elements[at].where is not None:
            ids = self.node_rows(elements[at]).select("id")
        turned = {"in": "out", "out": "in", "any": "any"}
        right = [replace(e, direction=turned[e.direction]) if isinstance(e, EdgePattern) else e for e in elements[:at:-1]]
        for side in (elements[:at], right):
            if not side:
                continue
            found = self.node_rows(side[0]).select("id")
            for edge, node in zip(side[1::2], [*side[2::2], None]):
                hops = self.hop_rows(edge)
                if edge.low is None:
                    found = hops.join(found, hops["src"] == found["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
                else:
                    found = reachable(hops, found, edge.low, edge.high)
                if node is not None:
                    found = self.node_rows(node).select("id").join(found, "id", "left_semi")
            ids = found if ids is None else ids.join(found, "id", "left_semi")
        return ids.distinct()

    @staticmethod
    def ends(rows: DataFrame, hops: DataFrame, count: int) -> DataFrame:
        """The nodes of rows that count walks may end at; those that are in no walk may be left out."""
        if count <= FEW:
            return rows.join(F.broadcast(hops.select(F.col("dst").alias("_end")).distinct()), F.col("id") == F.col("_end"), "left_semi")
        return sized(rows, rows.count(), "id", FEW_WHOLE)

    def pattern_query(self, q: Query) -> Result:
        """Fixed hops are equi joins of nodes and edges in order; a hop of variable length joins the walks it allows."""
        df, kinds, seen = None, {}, []
        fresh = 0

        def prefixed(rows: DataFrame, var: str) -> DataFrame:
            return rows.select(*[F.col(c).alias(f"{var}__{c}") for c in rows.columns])

        for pattern in q.source.patterns:
            left = None
            for i, e in enumerate(pattern.elements):
                if isinstance(e, EdgePattern):
                    continue
                var = e.var or f"_n{(fresh := fresh + 1)}"
                known, rows = var in kinds, self.node_rows(e)
                if i == 0:
                    if known:
                        df = df.join(rows.select(F.col("id").alias("_id")), F.col(f"{var}__id") == F.col("_id"), "left_semi") if e.type or e.where is not None else df
                    else:
                        df = prefixed(rows, var) if df is None else df.crossJoin(prefixed(rows, var))
                else:
                    edge = pattern.elements[i - 1]
                    name = edge.var or f"_e{(fresh := fresh + 1)}"
                    hops = self.hop_rows(edge)
                    if edge.low is not None:
                        hops, count, starts = walks(hops, df.select(F.col(f"{left}__id").alias("id")), edge.low, edge.high)
                        if not known:
                            rows = self.ends(rows, hops, count)
                        df, hops = (F.broadcast(df), hops) if starts <= FEW_WHOLE else (df, sized(hops, count, "src"))
                    hops = prefixed(hops, name)
                    if edge.var and edge.low is None:
                        kinds[name] = "edges"
                        seen.append(name)
                    df = df.join(hops, F.col(f"{left}__id") == F.col(f"{name}__src"))
                    if known:
                        df = df.where(F.col(f"{var}__id") == F.col(f"{name}__dst"))
                        if e.type or e.where is not None:
                            df = df.join(rows.select(F.col("id").alias("_id")), F.col(f"{var}__id") == F.col("_id"), "left_semi")
                    else:
                        df = df.join(prefixed(rows, var), F.col(f"{name}__dst") == F.col(f"{var}__id"))
                if not known:
                    kinds[var] = "nodes"
                    if e.var:
                        seen.append(var)
                left = var

        def resolve(s) -> Value:
            if isinstance(s, CountCall):
                return Value(F.col("_count"), "number")
            var, *path = s.parts
            if var not in kinds:
                raise QueryError("compile", f"undefined variable {var}")
            if not path:
                return Value(F.col(f"{var}__id"))
            if path[0] not in PLAIN[kinds[var]]:
                raise QueryError("compile", f"{var} has no field {path[0]}")
            return _json(F.col(f"{var}__data"), tuple(path[1:])) if len(path) > 1 else _value(path[0], F.col(f"{var}__{path[0]}"))

        links = {v: f"{v}__id" for v in seen if kinds[v] == "nodes"}
        links[None] = next(iter(links.values()), None)

        def exists(p: Pattern) -> SparkColumn:
            name = next((e.var for e in p.elements if isinstance(e, NodePattern) and e.var in links), None)
            return F.col(links[name]).isin(self.holders(p, name))

        test = Predicates(resolve, self.params, self.members, exists)
        for part in conjuncts(q.where):
            df = self.filtered(df, part, test, links)

        selected = [c.expr.parts[0] for c in q.columns if isinstance(c.expr, Selector)]
        starred = any(isinstance(c.expr, Star) for c in q.columns)
        nodes = [v for v in seen if kinds[v] == "nodes"]
        several = len(set(selected)) > 1 or starred and len(nodes) > 1 or starred and bool(selected)

        def expanded(var: str) -> list[tuple[str, SparkColumn]]:
            columns = ROW_COLUMNS if kinds[var] == "nodes" else EDGE_COLUMNS
            if not several:
                columns = NODE_COLUMNS if kinds[var] == "nodes" else EDGE_COLUMNS
            return [(f"{var}.{c}" if several else c, F.col(f"{var}__{c}")) for c in columns]

        def whole(c: Column):
            if len(c.expr.parts) == 1:
                return [(c.alias, F.col(f"{c.expr.parts[0]}__id"))] if c.alias else expanded(c.expr.parts[0])
            return None

        bare_edge = any(isinstance(c.expr, Selector) and len(c.expr.parts) == 1 and kinds.get(c.expr.parts[0]) == "edges" for c in q.columns)
        what = "rows" if several else "edges" if bare_edge else "nodes"
        return self.finish(q, df, resolve, test, what, lambda: reduce(list.__add__, [expanded(v) for v in nodes], []), whole)


def compile_query(q: Query, nodes: DataFrame, edges: DataFrame, params: dict | None = None, now: int | None = None) -> Result:
    return Compiler(nodes, edges, params, now).run(q)
