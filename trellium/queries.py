"""The registered queries over the graph of the star-schema tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.scalars import content_hash, edge_id, short_id, slug, token_estimate
from .model import active, conform
from .operators import context, graph, introspect, store, vector
from .operators.filters import NodeFilter, category, compare, find
from .plans.compile import compile_query
from .plans.parser import parse
from .plans.paths import of_types, oriented, reachable
from .sources import symbols
from .sources.tables import embeddings_of, table_graph
from .sources.text import Rule, annotations, clean_path, commits, licence, markdown, merged_ranges, project_graph, tagged

ALL = ("geo", "org", "item", "doc", "event")
GEO, ORG, ITEM, DOC, EVENT = ("geo",), ("geo", "org"), ("item",), ("geo", "org", "doc"), ("event",)
FULL = ("geo", "org", "item", "doc")

_COLUMNS = "id, type, uri, key, name, labels, size, status, total, acctbal, k"


def _row(prefix: str, key: str, kind: str, table: str, name: str = "NULL", labels: str = "[]", **fields: str) -> str:
    own = ", ".join(f"{fields.get(f, 'NULL')}::{t} AS {f}" for f, t in (("size", "DOUBLE"), ("status", "VARCHAR"), ("total", "DOUBLE"), ("acctbal", "DOUBLE"), ("k", "BIGINT")))
    return f"SELECT '{prefix}:' || {key} AS id, {kind} AS type, 'tbl://{prefix}/' || {key} AS uri, {key}::VARCHAR AS key, {name}::VARCHAR AS name, {labels}::VARCHAR[] AS labels, {own} FROM {table}"


def _pair(kind: str, source: str, target: str, table: str, back: str | None = None) -> str:
    out = f"SELECT '{kind}' AS type, {source} AS from_id, {target} AS to_id FROM {table}"
    return out + (f" UNION ALL SELECT '{back}', {target}, {source} FROM {table}" if back else "")


_NODES = {
    "geo": [_row("region", "r_regionkey", "'geo:region'", "region", "r_name"), _row("nation", "n_nationkey", "'geo:nation'", "nation", "n_name")],
    "org": [
        _row("supplier", "s_suppkey", "'org:supplier'", "supplier", "s_name", acctbal="s_acctbal"),
        _row("customer", "c_custkey", "'org:customer'", "customer", "c_name", "['seg:' || c_mktsegment]", acctbal="c_acctbal"),
    ],
    "item": [_row("part", "p_partkey", "'item:part'", "part", "p_name", "['brand:' || p_brand]", size="p_size")],
    "doc": [_row("order", "o_orderkey", "'doc:order'", "orders", labels="['status:' || o_orderstatus, 'prio:' || o_orderpriority]", status="o_orderstatus", total="o_totalprice")],
    "event": [
        _row("event", "event_id", "'evt:' || event_type", "events", k="regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)"),
        _row("user", "user_id", "'org:user'", "(SELECT DISTINCT user_id FROM events)"),
    ],
}
_EDGES = {
    "geo": [_pair("contains", "'region:' || n_regionkey", "'nation:' || n_nationkey", "nation", "contained_by")],
    "org": [
        _pair("has", "'nation:' || s_nationkey", "'supplier:' || s_suppkey", "supplier", "belongs_to"),
        _pair("has", "'nation:' || c_nationkey", "'customer:' || c_custkey", "customer", "belongs_to"),
    ],
    "item": [],
    "doc": [_pair("has", "'customer:' || o_custkey", "'order:' || o_orderkey", "orders", "belongs_to")],
    "event": [_pair("has", "'user:' || user_id", "'event:' || event_id", "events", "belongs_to")],
}
_LINES = [
    _pair("references", "'order:' || l_orderkey", "'part:' || l_partkey", "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"),
    _pair("supplies", "'supplier:' || l_suppkey", "'part:' || l_partkey", "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"),
]


def prelude(parts: tuple[str, ...]) -> str:
    """WITH nodes AS (...), edges AS (...): the same graph as table_graph, its data as columns."""
    nodes = " UNION ALL ".join(x for p in parts for x in _NODES[p])
    lines = _LINES if "doc" in parts and "item" in parts else []
    pairs = [x for p in parts for x in _EDGES[p]] + lines or ["SELECT '' AS type, '' AS from_id, '' AS to_id WHERE false"]
    return f"WITH RECURSIVE nodes AS ({nodes}), edges AS (SELECT concat_ws('|', type, from_id, to_id) AS id, * FROM ({' UNION ALL '.join(pairs)}))"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _language(name: str, parts: tuple[str, ...], text: str, sql: str, params: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compile_query(parse(text), *table_graph(spark, sf_dir, parts), params).df

    QUERIES[name] = run
    ORACLES[name] = f"{prelude(parts)} {sql}"


def _operator(name: str, parts: tuple[str, ...], run: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(*table_graph(spark, sf_dir, parts))
    if sql:
        ORACLES[name] = f"{prelude(parts)} {sql}"


def _tables(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# Flat queries.
_language("flat_count", ALL, "SELECT COUNT(*) AS count FROM nodes", "SELECT count(*) AS count FROM nodes")
_language("flat_group_type", ALL, "SELECT type, COUNT(*) AS count FROM nodes GROUP BY type ORDER BY COUNT(*) DESC", "SELECT type, count(*) AS count FROM nodes GROUP BY type")
_language("flat_where_eq", ORG, "SELECT id, name FROM nodes WHERE name = 'ASIA'", "SELECT id, name FROM nodes WHERE name = 'ASIA'")
_language("flat_star", GEO, "SELECT * FROM nodes", "SELECT id, type, uri, key, name, to_json(labels) AS labels, NULL::VARCHAR AS data, NULL::VARCHAR AS generation, NULL::VARCHAR AS root, NULL::VARCHAR AS created_at, NULL::VARCHAR AS updated_at FROM nodes")
QUERIES["flat_star"] = lambda spark, d, f=QUERIES["flat_star"]: f(spark, d).withColumn("labels", F.to_json("labels")).withColumn("data", F.to_json("data"))
_language("flat_where_num", ITEM, "SELECT id FROM nodes WHERE data.size > 40", "SELECT id FROM nodes WHERE size > 40")
_language("flat_where_text_of_number", ITEM, "SELECT id FROM nodes WHERE data.size = '10'", "SELECT id FROM nodes WHERE false")
_language("flat_json_path", ITEM, "SELECT id, data.size AS size FROM nodes WHERE data.size <= 3", "SELECT id, CAST(CAST(size AS INT) AS VARCHAR) AS size FROM nodes WHERE size <= 3")
_language("flat_like", ORG, "SELECT id FROM nodes WHERE name LIKE 'CUSTOMER%1'", "SELECT id FROM nodes WHERE name ILIKE 'customer%1'")
_language("flat_not_like", ORG, "SELECT id FROM nodes WHERE name NOT LIKE 'customer%'", "SELECT id FROM nodes WHERE name NOT ILIKE 'customer%'")
_language("flat_glob", ORG, "SELECT id FROM nodes WHERE name GLOB '*[0-4]?'", "SELECT id FROM nodes WHERE name GLOB '*[0-4]?'")
_language("flat_not_glob", ORG, "SELECT id FROM nodes WHERE type NOT GLOB 'org:*'", "SELECT id FROM nodes WHERE type NOT LIKE 'org:%'")
_language("flat_in", ORG, "SELECT id FROM nodes WHERE type IN ('geo:region', 'org:supplier')", "SELECT id FROM nodes WHERE type IN ('geo:region', 'org:supplier')")
_language("flat_not_in", ORG, "SELECT id FROM nodes WHERE type NOT IN ('geo:region', 'org:customer')", "SELECT id FROM nodes WHERE type NOT IN ('geo:region', 'org:customer')")
_language("flat_between", ITEM, "SELECT id FROM nodes WHERE data.size BETWEEN 5 AND 9", "SELECT id FROM nodes WHERE size BETWEEN 5 AND 9")
_language("flat_null", ("item", "doc"), "SELECT type, COUNT(*) AS count FROM nodes WHERE data.size IS NULL GROUP BY type", "SELECT type, count(*) AS count FROM nodes WHERE size IS NULL GROUP BY type")
_language("flat_not_null", ALL, "SELECT type, COUNT(*) AS count FROM nodes WHERE name IS NOT NULL GROUP BY type", "SELECT type, count(*) AS count FROM nodes WHERE name IS NOT NULL GROUP BY type")
_language(
    "flat_bool_tree", ("item", "doc"), "SELECT id FROM nodes WHERE (data.size < 5 OR data.total > 300000) AND NOT (id LIKE '%7') AND (type = 'item:part' OR data.status = 'F')",
    "SELECT id FROM nodes WHERE (size < 5 OR total > 300000) AND NOT (id LIKE '%7') AND (type = 'item:part' OR status = 'F')",
)
_language("flat_labels_any", DOC, "SELECT id FROM nodes WHERE labels CONTAINS ANY ('status:P', 'seg:BUILDING')", "SELECT id FROM nodes WHERE list_has_any(labels, ['status:P', 'seg:BUILDING'])")
_language("flat_labels_all", DOC, "SELECT id FROM nodes WHERE labels CONTAINS ALL ('status:F', 'prio:1-URGENT')", "SELECT id FROM nodes WHERE list_has_all(labels, ['status:F', 'prio:1-URGENT'])")
_language("flat_labels_not", DOC, "SELECT type, COUNT(*) AS count FROM nodes WHERE labels NOT CONTAINS ('status:F') GROUP BY type", "SELECT type, count(*) AS count FROM nodes WHERE NOT list_has_any(labels, ['status:F']) GROUP BY type")
_language(
    "flat_labels_not_all", DOC, "SELECT type, COUNT(*) AS count FROM nodes WHERE labels NOT CONTAINS ALL ('status:F', 'prio:1-URGENT') GROUP BY type",
    "SELECT type, count(*) AS count FROM nodes WHERE NOT list_has_all(labels, ['status:F', 'prio:1-URGENT']) GROUP BY type",
)
_language("flat_distinct", ALL, "SELECT DISTINCT type FROM nodes", "SELECT DISTINCT type FROM nodes")
_language("flat_order_limit_offset", ORG, "SELECT id, name FROM nodes WHERE type = 'org:customer' ORDER BY name DESC, id LIMIT 7 OFFSET 5", "SELECT id, name FROM nodes WHERE type = 'org:customer' ORDER BY name DESC NULLS LAST, id LIMIT 7 OFFSET 5")
_language(
    "flat_order_json", ITEM, "SELECT id, data.size AS size FROM nodes ORDER BY data.size DESC, id LIMIT 9",
    "SELECT id, CAST(CAST(size AS INT) AS VARCHAR) AS size FROM nodes ORDER BY nodes.size DESC NULLS LAST, id LIMIT 9",
)
_language("flat_having", ALL, "SELECT type, COUNT(*) AS count FROM nodes GROUP BY type HAVING COUNT(*) > 100", "SELECT type, count(*) AS count FROM nodes GROUP BY type HAVING count(*) > 100")
_language("flat_group_json", ITEM, "SELECT data.size AS size, COUNT(*) AS count FROM nodes GROUP BY data.size", "SELECT CAST(CAST(size AS INT) AS VARCHAR) AS size, count(*) AS count FROM nodes GROUP BY 1")
_language("flat_group_two", DOC, "SELECT type, data.status AS status, COUNT(*) AS count FROM nodes GROUP BY type, data.status", "SELECT type, status, count(*) AS count FROM nodes GROUP BY ALL")
_language("flat_parameters", ITEM, "SELECT id FROM nodes WHERE data.size > $least AND name LIKE $1", "SELECT id FROM nodes WHERE size > 45 AND name ILIKE '%a%'", {"least": 45, 1: "%a%"})
_language("edges_star", GEO, "SELECT * FROM edges", "SELECT id, type, from_id, to_id, NULL::VARCHAR AS data, NULL::VARCHAR AS generation, NULL::VARCHAR AS created_at FROM edges")
QUERIES["edges_star"] = lambda spark, d, f=QUERIES["edges_star"]: f(spark, d).withColumn("data", F.to_json("data"))
_language("edges_group_type", FULL, "SELECT type, COUNT(*) AS count FROM edges GROUP BY type", "SELECT type, count(*) AS count FROM edges GROUP BY type")

# Those above whose text speaks of the whole graph, over all of it.
_operator("flat_star_all", ALL, lambda n, e: compile_query(parse("SELECT * FROM nodes"), n, e, None).df.withColumn("labels", F.to_json("labels")).withColumn("data", F.to_json("data")), None)
_language("flat_not_glob_all", ALL, "SELECT id FROM nodes WHERE type NOT GLOB 'org:*'", "SELECT id FROM nodes WHERE type NOT LIKE 'org:%'")
_language("flat_not_in_all", ALL, "SELECT id FROM nodes WHERE type NOT IN ('geo:region', 'org:customer')", "SELECT id FROM nodes WHERE type NOT IN ('geo:region', 'org:customer')")
_language("edges_star_all", ALL, "SELECT * FROM edges", "SELECT id, type, from_id, to_id, NULL::VARCHAR AS data, NULL::VARCHAR AS generation, NULL::VARCHAR AS created_at FROM edges")
QUERIES["edges_star_all"] = lambda spark, d, f=QUERIES["edges_star_all"]: f(spark, d).withColumn("data", F.to_json("data"))
_language("edges_group_type_all", ALL, "SELECT type, COUNT(*) AS count FROM edges GROUP BY type", "SELECT type, count(*) AS count FROM edges GROUP BY type")

_language(
    "in_subquery", DOC, "SELECT id FROM nodes WHERE type = 'org:customer' AND id IN (SELECT from_id FROM edges WHERE type = 'has')",
    "SELECT id FROM nodes WHERE type = 'org:customer' AND id IN (SELECT from_id FROM edges WHERE type = 'has')",
)
_language(
    "not_in_subquery", DOC, "SELECT id FROM nodes WHERE type IN ('org:customer', 'org:supplier') AND id NOT IN (SELECT from_id FROM edges WHERE type = 'has')",
    "SELECT id FROM nodes WHERE type IN ('org:customer', 'org:supplier') AND id NOT IN (SELECT from_id FROM edges WHERE type = 'has')",
)
_language("not_in_subquery_with_null", DOC, "SELECT id FROM nodes WHERE id NOT IN (SELECT name FROM nodes)", "SELECT id FROM nodes WHERE id NOT IN (SELECT name FROM nodes)")
_language(
    "in_subquery_or", DOC, "SELECT id FROM nodes WHERE type = 'org:customer' AND (id IN (SELECT from_id FROM edges WHERE type = 'has') OR name LIKE '%7')",
    "SELECT id FROM nodes WHERE type = 'org:customer' AND (id IN (SELECT from_id FROM edges WHERE type = 'has') OR name LIKE '%7')",
)

# json_each.
_language("json_each_labels", DOC, "SELECT value, COUNT(*) AS count FROM nodes, json_each(labels) GROUP BY value ORDER BY COUNT(*) DESC", "SELECT l AS value, count(*) AS count FROM (SELECT unnest(labels) AS l FROM nodes) GROUP BY 1")
_language(
    "json_each_where", DOC, "SELECT l, COUNT(*) AS count FROM nodes, json_each(labels) AS l WHERE nodes.type = 'doc:order' AND l GLOB 'prio:[12]*' GROUP BY l HAVING COUNT(*) > 1",
    "SELECT l, count(*) AS count FROM (SELECT unnest(labels) AS l FROM nodes WHERE type = 'doc:order') WHERE l LIKE 'prio:1%' OR l LIKE 'prio:2%' GROUP BY 1 HAVING count(*) > 1",
)
_language("json_each_members", EVENT, "SELECT key, COUNT(*) AS count FROM nodes, json_each(data) GROUP BY key", "SELECT k AS key, count(*) AS count FROM (SELECT unnest(CASE WHEN type LIKE 'evt:%' THEN ['k', 'value'] ELSE [] END) AS k FROM nodes) GROUP BY 1")

# Patterns.
_CHAIN = "FROM nodes a JOIN edges e ON e.from_id = a.id JOIN nodes b ON b.id = e.to_id"
_language("pattern_1hop", ORG, "SELECT b.id AS id FROM (a:geo:region)-[:contains]->(b:geo:nation) WHERE a.name = 'ASIA'", f"SELECT b.id AS id {_CHAIN} WHERE a.type = 'geo:region' AND b.type = 'geo:nation' AND e.type = 'contains' AND a.name = 'ASIA'")
_language("pattern_incoming", ORG, "SELECT b.id AS id, a.id AS of FROM (a:geo:nation)<-[:contains]-(b:geo:region)", f"SELECT a.id AS id, b.id AS of {_CHAIN} WHERE a.type = 'geo:region' AND b.type = 'geo:nation' AND e.type = 'contains'")
_language(
    "pattern_undirected", GEO, "SELECT a.id AS a, b.id AS b FROM (a)-[:contains]-(b)",
    f"SELECT a.id AS a, b.id AS b {_CHAIN} WHERE e.type = 'contains' UNION ALL SELECT b.id, a.id {_CHAIN} WHERE e.type = 'contains' AND a.id <> b.id",
)
_language("pattern_multi_type", ORG, "SELECT b.type AS type, COUNT(*) AS count FROM (a:geo:*)-[:contains|has]->(b) GROUP BY b.type", f"SELECT b.type AS type, count(*) AS count {_CHAIN} WHERE a.type LIKE 'geo:%' AND e.type IN ('contains', 'has') GROUP BY 1")
_language("pattern_type_glob", ORG, "SELECT a.name AS a, COUNT(*) AS count FROM (a:geo:nation)-[:has]->(b:org:*) GROUP BY a.name", f"SELECT a.name AS a, count(*) AS count {_CHAIN} WHERE a.type = 'geo:nation' AND e.type = 'has' AND b.type LIKE 'org:%' GROUP BY 1")
_language("pattern_edge_var", GEO, "SELECT e.id AS id, e.type AS type FROM (a:geo:region)-[e]->(b)", f"SELECT e.id AS id, e.type AS type {_CHAIN} WHERE a.type = 'geo:region'")
_language(
    "pattern_chain", FULL, "SELECT r.name AS region, COUNT(*) AS count FROM (r:geo:region)-[:contains]->(n:geo:nation)-[:has]->(c:org:customer)-[:has]->(o:doc:order) WHERE o.data.status = 'F' GROUP BY r.name",
    "SELECT r.name AS region, count(*) AS count FROM nodes r JOIN edges e1 ON e1.from_id = r.id AND e1.type = 'contains' JOIN nodes n ON n.id = e1.to_id AND n.type = 'geo:nation' "
    "JOIN edges e2 ON e2.from_id = n.id AND e2.type = 'has' JOIN nodes c ON c.id = e2.to_id AND c.type = 'org:customer' JOIN edges e3 ON e3.from_id = c.id AND e3.type = 'has' "
    "JOIN nodes o ON o.id = e3.to_id AND o.type = 'doc:order' WHERE r.type = 'geo:region' AND o.status = 'F' GROUP BY 1",
)
_language(
    "pattern_shared_vars", FULL, "SELECT p.id AS part, COUNT(*) AS count FROM (o:doc:order)-[:references]->(p:item:part), (s:org:supplier)-[:supplies]->(p) WHERE p.data.size > 48 GROUP BY p.id",
    "SELECT p.id AS part, count(*) AS count FROM nodes p JOIN edges e ON e.to_id = p.id AND e.type = 'references' JOIN edges f ON f.to_id = p.id AND f.type = 'supplies' WHERE p.type = 'item:part' AND p.size > 48 GROUP BY 1",
)
_language("pattern_rows", GEO, "SELECT a.name, b.name FROM (a:geo:region)-[:contains]->(b) WHERE a.name LIKE 'a%'", f'SELECT a.name AS "a.name", b.name AS "b.name" {_CHAIN} WHERE a.type = \'geo:region\' AND e.type = \'contains\' AND a.name ILIKE \'a%\'')
_language("pattern_group_bare", GEO, "SELECT a.name AS name, a.type AS type, COUNT(*) AS count FROM (a:geo:region)-[:contains]->(b) GROUP BY a.id", f"SELECT any_value(a.name) AS name, any_value(a.type) AS type, count(*) AS count {_CHAIN} WHERE a.type = 'geo:region' AND e.type = 'contains' GROUP BY a.id")
_language("pattern_having", DOC, "SELECT c.id AS id, COUNT(*) AS count FROM (c:org:customer)-[:has]->(o:doc:order) GROUP BY c.id HAVING COUNT(*) > 15", f"SELECT a.id AS id, count(*) AS count {_CHAIN} WHERE a.type = 'org:customer' AND e.type = 'has' AND b.type = 'doc:order' GROUP BY 1 HAVING count(*) > 15")
_language("pattern_inline_where", ORG, "SELECT b.id AS id FROM (:geo:nation WHERE name = 'NATION_3' OR name LIKE 'nation_1%')-[:has]->(b:org:supplier)", f"SELECT b.id AS id {_CHAIN} WHERE a.type = 'geo:nation' AND (a.name = 'NATION_3' OR a.name ILIKE 'nation_1%') AND e.type = 'has' AND b.type = 'org:supplier'")
_language("pattern_count", ORG, "SELECT COUNT(*) AS count FROM (a:geo:nation)-[:has]->(b:org:customer)", f"SELECT count(*) AS count {_CHAIN} WHERE a.type = 'geo:nation' AND e.type = 'has' AND b.type = 'org:customer'")
_language("pattern_distinct_order", ORG, "SELECT DISTINCT a.name AS name FROM (a:geo:nation)-[:has]->(b) ORDER BY a.name LIMIT 8", f"SELECT DISTINCT a.name AS name {_CHAIN} WHERE a.type = 'geo:nation' AND e.type = 'has' ORDER BY 1 NULLS FIRST LIMIT 8")


def _hops(low: int, high: int, types: str, start: str) -> str:
    return (
        f", walk AS (SELECT id AS start, id AS place, 0 AS n FROM nodes WHERE {start} UNION ALL SELECT start, to_id, n + 1 FROM walk JOIN edges ON from_id = place AND edges.type IN ({types}) WHERE n < {high}) "
        f"SELECT start, place, n FROM walk WHERE n >= {low}"
    )


_TYPES, _CONTAINS = "'contains', 'has'", "'contains'"
_REGIONS, _ASIA = "type = 'geo:region'", "type = 'geo:region' AND name = 'ASIA'"
_language("hops_exact", DOC, "SELECT b.id AS id FROM (a:geo:region)-[:contains|has*3]->(b) WHERE a.name = 'ASIA'", "")
ORACLES["hops_exact"] = f"{prelude(DOC)} {_hops(3, 3, _TYPES, _ASIA)}".replace("SELECT start, place, n FROM walk", "SELECT place AS id FROM walk")
_language("hops_range", DOC, "SELECT b.type AS type, COUNT(*) AS count FROM (a:geo:region)-[:contains|has*1..3]->(b) GROUP BY b.type", "")
ORACLES["hops_range"] = f"{prelude(DOC)} {_hops(1, 3, _TYPES, _REGIONS)}".replace("SELECT start, place, n FROM walk", "SELECT type, count(*) AS count FROM walk JOIN nodes ON id = place") + " GROUP BY type"
_language("hops_unbounded", DOC, "SELECT a.name AS region, COUNT(*) AS count FROM (a:geo:region)-[:contains|has*]->(b:doc:order) GROUP BY a.name", "")
ORACLES["hops_unbounded"] = f"{prelude(DOC)} {_hops(1, 20, _TYPES, _REGIONS)}".replace("SELECT start, place, n FROM walk", "SELECT a.name AS region, count(*) AS count FROM walk JOIN nodes a ON a.id = start JOIN nodes b ON b.id = place AND b.type = 'doc:order'") + " GROUP BY 1"
_language("hops_zero", ORG, "SELECT b.type AS type, COUNT(*) AS count FROM (a:geo:region)-[:contains*0..2]->(b) GROUP BY b.type", "")
ORACLES["hops_zero"] = f"{prelude(ORG)} {_hops(0, 2, _CONTAINS, _REGIONS)}".replace("SELECT start, place, n FROM walk", "SELECT type, count(*) AS count FROM walk JOIN nodes ON id = place") + " GROUP BY type"

_language("exists_1hop", DOC, "SELECT id FROM nodes WHERE type = 'org:customer' AND EXISTS (nodes)-[:has]->(:doc:order)", "SELECT id FROM nodes WHERE type = 'org:customer' AND id IN (SELECT from_id FROM edges JOIN nodes o ON o.id = to_id WHERE edges.type = 'has' AND o.type = 'doc:order')")
_language("not_exists_1hop", DOC, "SELECT id FROM nodes WHERE type = 'org:customer' AND NOT EXISTS (nodes)-[:has]->(:doc:order WHERE data.total > 300000)", "SELECT id FROM nodes WHERE type = 'org:customer' AND id NOT IN (SELECT from_id FROM edges JOIN nodes o ON o.id = to_id WHERE edges.type = 'has' AND o.type = 'doc:order' AND o.total > 300000)")
_language(
    "exists_inline_where", DOC, "SELECT COUNT(*) AS count FROM nodes WHERE EXISTS (nodes)-[:has]->(:doc:order WHERE data.total > 250000)",
    "SELECT count(*) AS count FROM nodes WHERE id IN (SELECT from_id FROM edges JOIN nodes o ON o.id = to_id WHERE edges.type = 'has' AND o.type = 'doc:order' AND o.total > 250000)",
)
_language(
    "exists_in_pattern", DOC, "SELECT c.id AS id FROM (n:geo:nation)-[:has]->(c:org:customer) WHERE n.name = 'NATION_3' AND NOT EXISTS (c)-[:has]->(:doc:order WHERE data.total > 460000)",
    f"SELECT b.id AS id {_CHAIN} WHERE a.type = 'geo:nation' AND a.name = 'NATION_3' AND e.type = 'has' AND b.type = 'org:customer' AND b.id NOT IN (SELECT from_id FROM edges x JOIN nodes o ON o.id = x.to_id WHERE x.type = 'has' AND o.total > 460000)",
)
_SCOPE = f", under AS (SELECT 'region:2' AS id UNION SELECT to_id FROM under JOIN edges ON from_id = under.id AND edges.type IN ({_TYPES}))"
_ROOT = "(r WHERE id = 'region:2')-[:contains|has*0..]->"
_language("scope_nodes", DOC, f"SELECT type, COUNT(*) AS count FROM nodes WHERE EXISTS {_ROOT}(nodes) GROUP BY type", f"{_SCOPE} SELECT type, count(*) AS count FROM nodes WHERE id IN (SELECT id FROM under) GROUP BY type")
_language("scope_edges", DOC, f"SELECT type, COUNT(*) AS count FROM edges WHERE EXISTS {_ROOT}(edges) GROUP BY type", f"{_SCOPE} SELECT type, count(*) AS count FROM edges WHERE from_id IN (SELECT id FROM under) GROUP BY type")
_language(
    "scope_labels", DOC, f"SELECT value, COUNT(*) AS count FROM nodes, json_each(labels) WHERE EXISTS {_ROOT}(nodes) GROUP BY value",
    f"{_SCOPE} SELECT l AS value, count(*) AS count FROM (SELECT unnest(labels) AS l FROM nodes WHERE id IN (SELECT id FROM under)) GROUP BY 1",
)

# Operators beyond the language.
_operator("neighbors_both", ORG, lambda n, e: graph.neighbors(n, e, "nation:3").select("direction", "edge_type", "id"), "SELECT 'out' AS direction, type AS edge_type, to_id AS id FROM edges WHERE from_id = 'nation:3' UNION ALL SELECT 'in', type, from_id FROM edges WHERE to_id = 'nation:3'")
_operator("neighbor_nodes", ORG, lambda n, e: graph.neighbor_nodes(n, e, "nation:3").select("id"), "SELECT to_id AS id FROM edges WHERE from_id = 'nation:3' UNION SELECT from_id FROM edges WHERE to_id = 'nation:3'")
_operator("children", ORG, lambda n, e: graph.children(n, e, "region:1").select("id", "name"), "SELECT id, name FROM nodes WHERE id IN (SELECT to_id FROM edges WHERE from_id = 'region:1' AND type IN ('contains', 'has'))")
_operator("parents", ORG, lambda n, e: graph.parents(n, e, "nation:4").select("id", "name"), "SELECT id, name FROM nodes WHERE id IN (SELECT to_id FROM edges WHERE from_id = 'nation:4' AND type IN ('contained_by', 'belongs_to'))")
_operator(
    "ancestors", DOC, lambda n, e: graph.ancestors(e, n.where("type = 'doc:order'").select("id")).groupBy("depth").agg(F.count("*").alias("count"), F.count_distinct("id").alias("ids")),
    ", up AS (SELECT from_id AS f, min(id) AS e, arg_min(to_id, id) AS t FROM edges WHERE type IN ('contained_by', 'belongs_to') GROUP BY 1), w AS (SELECT id AS start, id AS place, 0 AS depth FROM nodes WHERE type = 'doc:order' "
    "UNION ALL SELECT start, t, depth + 1 FROM w JOIN up ON f = place WHERE depth < 10) SELECT depth, count(*) AS count, count(DISTINCT place) AS ids FROM w WHERE depth > 0 GROUP BY depth",
)
_STEP = "struct_pack(node_id := t, edge_type := kind, incoming := back)"
_operator(
    "paths_shortest", ORG,
    lambda n, e: graph.find_paths(n, e, "customer:1", "supplier:3", 5, 7).select(
        "length", F.array_join(F.transform("steps", lambda x: F.concat_ws(" ", x["node_id"], x["edge_type"], x["incoming"].cast("string"))), ", ").alias("steps")
    ),
    ", hop AS (SELECT from_id AS s, to_id AS t, type AS kind, false AS back FROM edges UNION ALL SELECT to_id, from_id, type, true FROM edges), "
    f"d AS (SELECT 'customer:1' AS place, ['customer:1'] AS seen, 0 AS n, list_slice([struct_pack(node_id := '', edge_type := '', incoming := false)], 2, 1) AS steps "
    f"UNION ALL SELECT t, list_append(seen, t), n + 1, list_append(steps, {_STEP}) FROM d JOIN hop ON s = place WHERE n < 5 AND place <> 'supplier:3' AND NOT list_contains(seen, t) "
    "AND (t LIKE 'nation:%' OR t LIKE 'region:%' OR t = 'supplier:3')), p AS (SELECT n AS length, steps FROM d WHERE place = 'supplier:3' ORDER BY n, steps LIMIT 7) "
    "SELECT length, array_to_string(list_transform(steps, lambda x: x.node_id || ' ' || x.edge_type || ' ' || x.incoming), ', ') AS steps FROM p",
)
_operator(
    "tree_rows", ORG, lambda n, e: graph.tree(n, e, "region:0", 1).select("depth", "id", "name"),
    "SELECT 0 AS depth, id, name FROM nodes WHERE id = 'region:0' UNION ALL SELECT 1, n.id, n.name FROM edges JOIN nodes n ON n.id = to_id WHERE from_id = 'region:0' AND edges.type = 'contains'",
)
_operator("reachable_from_regions", DOC, lambda n, e: reachable(oriented(of_types(e, ["contains", "has"]), "out"), n.where("type = 'geo:region'").select("id"), 1, None).join(n, "id").groupBy("type").agg(F.count("*").alias("count")), "SELECT type, count(*) AS count FROM nodes WHERE type IN ('geo:nation', 'org:supplier', 'org:customer', 'doc:order') GROUP BY type")
_ORPHANS = "type = 'org:customer' AND (key::INT % 3) = 0"
_operator("orphan_edges", DOC, lambda n, e: store.orphan_edges(n.where("NOT (type = 'org:customer' AND CAST(key AS INT) % 3 = 0)"), e).groupBy("type").agg(F.count("*").alias("count")), f", gone AS (SELECT id FROM nodes WHERE {_ORPHANS}) SELECT type, count(*) AS count FROM edges WHERE from_id IN (SELECT id FROM gone) OR to_id IN (SELECT id FROM gone) GROUP BY type")
_operator(
    "expired_counts", DOC, lambda n, e: store.garbage(n.withColumn("expires_at", F.when(F.col("type") == "org:customer", F.col("key").cast("long"))), e, now=50),
    "SELECT 'expired_nodes' AS what, count(*) AS count FROM nodes WHERE type = 'org:customer' AND key::INT <= 50 UNION ALL SELECT 'expired_edges', 0 UNION ALL "
    "SELECT 'orphan_edges', count(*) FROM edges WHERE from_id IN (SELECT id FROM nodes WHERE type = 'org:customer' AND key::INT <= 50) OR to_id IN (SELECT id FROM nodes WHERE type = 'org:customer' AND key::INT <= 50)",
)
_operator("active_nodes", ORG, lambda n, e: active(n.withColumn("expires_at", F.when(F.col("type") == "org:customer", F.col("key").cast("long"))), 100).groupBy("type").agg(F.count("*").alias("count")), "SELECT type, count(*) AS count FROM nodes WHERE type <> 'org:customer' OR key::INT > 100 GROUP BY type")
_operator("stale_by_prefix", ORG, lambda n, e: store.stale(n.withColumn("generation", F.when(F.col("type") == "org:supplier", None).otherwise(F.concat(F.lit("g"), (F.length("key") % 2).cast("string")))), "g1", "tbl://c").select("id"), "SELECT id FROM nodes WHERE type = 'org:customer' AND length(key) % 2 = 0")
_operator("delete_by_prefix", ORG, lambda n, e: store.connected_edges(k := store.without_prefix(n, "tbl://nation/1"), e).groupBy("type").agg(F.count("*").alias("count")), ", k AS (SELECT id FROM nodes WHERE NOT starts_with(uri, 'tbl://nation/1')) SELECT type, count(*) AS count FROM edges WHERE from_id IN (FROM k) AND to_id IN (FROM k) GROUP BY type")
_operator("count_nodes_type", ALL, lambda n, e: introspect.count_nodes(n, e), "SELECT type AS name, count(*) AS count FROM nodes GROUP BY type")
_operator("count_nodes_label", DOC, lambda n, e: introspect.count_nodes(n, e, by="label", limit=6), "SELECT l AS name, count(*) AS count FROM (SELECT unnest(labels) AS l FROM nodes) GROUP BY l ORDER BY 2 DESC, 1 LIMIT 6")
_operator("count_edges_from_to", DOC, lambda n, e: introspect.count_edges(n, e, NodeFilter(types=["org:*"]), NodeFilter(labels=["status:F"])), f"SELECT e.type AS name, count(*) AS count {_CHAIN} WHERE a.type LIKE 'org:%' AND list_contains(b.labels, 'status:F') GROUP BY 1")
_operator(
    "describe_edges", DOC,
    lambda n, e: introspect.describe_edges(n, e).select("type", F.col("count").alias("total"), F.posexplode("connections").alias("at", "c")).select("type", "total", "at", "c.from_type", "c.to_type", "c.count"),
    f", c AS (SELECT e.type AS type, a.type AS from_type, b.type AS to_type, count(*) AS count {_CHAIN} GROUP BY 1, 2, 3) SELECT type, CAST(sum(count) OVER (PARTITION BY type) AS BIGINT) AS total, "
    "CAST(row_number() OVER (PARTITION BY type ORDER BY count DESC, from_type, to_type) - 1 AS INT) AS at, from_type, to_type, count FROM c",
)
_operator("describe_edge_types", DOC, lambda n, e: introspect.describe_edges(n, e).select("type", "count", F.size("connections").cast("long").alias("kinds")), f"SELECT e.type AS type, count(*) AS count, count(DISTINCT a.type || ' ' || b.type) AS kinds {_CHAIN} GROUP BY 1")
_operator("describe_fields", FULL, lambda n, e: introspect.describe_fields(n), "SELECT * FROM (VALUES ('org:supplier', 'acctbal'), ('org:customer', 'acctbal'), ('org:customer', 'segment'), ('item:part', 'type'), ('item:part', 'size'), ('item:part', 'price'), ('doc:order', 'status'), ('doc:order', 'priority'), ('doc:order', 'total')) AS t(type, field)")
_operator("stats_sections", DOC, lambda n, e: introspect.stats(n, e, "region:2"), f"{_SCOPE} SELECT 'types' AS section, type AS name, count(*) AS count FROM nodes WHERE id IN (SELECT id FROM under) GROUP BY type UNION ALL SELECT 'edges', type, count(*) FROM edges WHERE from_id IN (SELECT id FROM under) GROUP BY type UNION ALL SELECT 'labels', l, count(*) FROM (SELECT unnest(labels) AS l FROM nodes WHERE id IN (SELECT id FROM under)) GROUP BY l")
_operator("find_filter", FULL, lambda n, e: find(n, e, NodeFilter(types=["org:customer", "item:*"], name_glob="*[a-m]*", labels=["seg:BUILDING", "brand:Brand#12", "brand:Brand#23"]), "name", limit=25).select("id"), "SELECT id FROM nodes WHERE (type = 'org:customer' OR type LIKE 'item:%') AND name GLOB '*[a-m]*' AND list_has_any(labels, ['seg:BUILDING', 'brand:Brand#12', 'brand:Brand#23']) ORDER BY name NULLS FIRST, id LIMIT 25")
_operator("find_roots", ORG, lambda n, e: find(n, e, NodeFilter(root_only=True, exclude_types=["org:*"])).select("id"), "SELECT id FROM nodes WHERE type NOT LIKE 'org:%' AND id NOT IN (SELECT to_id FROM edges WHERE type = 'contains')")
_operator("navigation_counts", ORG, lambda n, e: graph.navigation(n, e, "nation:7")[0], "SELECT 'out' AS side, type, count(*) AS count FROM edges WHERE from_id = 'nation:7' GROUP BY type UNION ALL SELECT 'in', type, count(*) FROM edges WHERE to_id = 'nation:7' GROUP BY type")
_operator(
    "upsert_latest", ORG, lambda n, e: (lambda batch: store.upsert_nodes(n, batch, "seq").where("type = 'org:customer'").groupBy("name").agg(F.count("*").alias("count")).where("count > 1"))(
        reduce(DataFrame.unionByName, (n.where("type = 'org:customer' AND CAST(key AS INT) <= 10").withColumns({"name": F.lit(f"written {i}"), "seq": F.lit(i)}) for i in (1, 2)))
    ),
    "SELECT 'written 2' AS name, count(*) AS count FROM nodes WHERE type = 'org:customer' AND key::INT <= 10 HAVING count(*) > 1",
)
_operator("id_from_uri", ORG, lambda n, e: n.select("uri", short_id("uri").alias("short")), "SELECT uri, replace(replace(rtrim(to_base64(unhex(substr(sha256(uri), 1, 32))), '='), '+', '-'), '/', '_') AS short FROM nodes")
_operator("edge_id_from_key", ORG, lambda n, e: e.select("type", "from_id", "to_id", edge_id("type", "from_id", "to_id").alias("short")), "SELECT type, from_id, to_id, replace(replace(rtrim(to_base64(unhex(substr(sha256(type || chr(0) || from_id || chr(0) || to_id), 1, 32))), '='), '+', '-'), '/', '_') AS short FROM edges")

_VECTOR = "SELECT embedding FROM embeddings WHERE vec_id = {}"


def _stored(spark: SparkSession, sf_dir: str, vec: int) -> list[float]:
    return embeddings_of(spark, sf_dir).where(F.col("node_id") == f"vec:{vec}").first()["embedding"]


_tables("vector_topk", lambda s, d: vector.find_similar(embeddings_of(s, d), _stored(s, d, 7), 10).select("node_id", F.round(F.col("score").cast("double"), 4).alias("score")), f"SELECT 'vec:' || vec_id AS node_id, round(list_cosine_similarity(embedding::DOUBLE[], ({_VECTOR.format(7)})::DOUBLE[])::FLOAT::DOUBLE, 4) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], ({_VECTOR.format(7)})::DOUBLE[])::FLOAT DESC, node_id LIMIT 10")
_tables(
    "vector_multi_query", lambda s, d: vector.search(embeddings_of(s, d), [("a", _stored(s, d, 7)), ("b", _stored(s, d, 11))], 12).select("node_id", "query", F.round(F.col("score").cast("double"), 4).alias("score")),
    "WITH q AS (SELECT CASE vec_id WHEN 7 THEN 'a' ELSE 'b' END AS query, embedding AS v FROM embeddings WHERE vec_id IN (7, 11)), s AS (SELECT 'vec:' || vec_id AS node_id, query, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[])::FLOAT AS score FROM embeddings, q), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node_id) AS n FROM s), b AS (SELECT node_id, max(score) AS score, arg_max(query, (score, query)) AS query FROM t WHERE n <= 12 GROUP BY node_id) "
    "SELECT node_id, query, round(score::DOUBLE, 4) AS score FROM b ORDER BY b.score DESC, node_id LIMIT 12",
)

# The engine's own calls, most of them looked up by a row that every table has.
def _engine(name: str, parts: tuple[str, ...], run: Callable[[Engine], DataFrame], sql: str) -> None:
    _operator(name, parts, lambda n, e: run(Engine(n.sparkSession, n, e)), sql)


_engine("node_by_id", ORG, lambda g: g.node("customer:7").select("id", "type", "uri", "key", "name"), "SELECT id, type, uri, key, name FROM nodes WHERE id = 'customer:7'")
_engine("node_by_uri", ORG, lambda g: g.node_by_uri("tbl://nation/3").select("id", "name"), "SELECT id, name FROM nodes WHERE uri = 'tbl://nation/3'")
_engine("node_by_key", ORG, lambda g: g.node_by_key("org:supplier", "5").select("id", "uri"), "SELECT id, uri FROM nodes WHERE type = 'org:supplier' AND key = '5'")
_engine("nodes_by_prefix", DOC, lambda g: g.by_prefix("customer:1", 25).select("id", "type"), "SELECT id, type FROM nodes WHERE starts_with(id, 'customer:1') ORDER BY id LIMIT 25")
_engine("edges_from_node", DOC, lambda g: g.edges_from("nation:3").select("type", "to_id"), "SELECT type, to_id FROM edges WHERE from_id = 'nation:3'")
_engine("edges_to_node", DOC, lambda g: g.edges_to("nation:3").select("type", "from_id"), "SELECT type, from_id FROM edges WHERE to_id = 'nation:3'")
_engine("neighbors_limited", DOC, lambda g: g.neighbors("NATION_4", "in", ["belongs_to"], 9).select("direction", "edge_type", "id"), "SELECT 'in' AS direction, edges.type AS edge_type, from_id AS id FROM edges WHERE to_id = 'nation:4' AND type = 'belongs_to' ORDER BY id LIMIT 9")
_engine(
    "tree_by_type", ORG, lambda g: g.tree("region:1", 2, ["org:supplier"]).select("depth", "id", "name", "more"),
    "SELECT 0 AS depth, id, name, 0 AS more FROM nodes WHERE id = 'region:1' AND EXISTS (SELECT 1 FROM edges x JOIN edges y ON y.from_id = x.to_id AND y.type = 'has' AND y.to_id LIKE 'supplier:%' WHERE x.from_id = 'region:1' AND x.type = 'contains') "
    "UNION ALL SELECT 1, n.id, n.name, 0 FROM edges x JOIN nodes n ON n.id = x.to_id WHERE x.from_id = 'region:1' AND x.type = 'contains' AND EXISTS (SELECT 1 FROM edges y WHERE y.from_id = n.id AND y.to_id LIKE 'supplier:%') "
    "UNION ALL SELECT 2, s.id, s.name, 0 FROM edges x JOIN edges y ON y.from_id = x.to_id AND y.type = 'has' JOIN nodes s ON s.id = y.to_id AND s.type = 'org:supplier' WHERE x.from_id = 'region:1' AND x.type = 'contains'",
)
_engine("delete_one_node", ORG, lambda g: (g.delete_node("nation:2"), g.nodes.groupBy("type").agg(F.count("*").alias("count")))[1], "SELECT type, count(*) AS count FROM nodes WHERE id <> 'nation:2' GROUP BY type")
_engine(
    "delete_path", DOC, lambda g: (g.delete_by_path("tbl://nation/1"), g.edges.groupBy("type").agg(F.count("*").alias("count")))[1],
    ", k AS (SELECT id FROM nodes WHERE NOT starts_with(uri, 'tbl://nation/1')) SELECT type, count(*) AS count FROM edges WHERE from_id IN (FROM k) AND to_id IN (FROM k) GROUP BY type",
)
_engine(
    "write_nodes_again", ORG,
    lambda g: (g.put_nodes(g.nodes.where("type = 'org:supplier'").withColumns({"name": F.concat(F.lit("new "), "name"), "created_at": F.lit("later")})), g.nodes.where("type LIKE 'org:%'").select("id", "name", F.col("created_at").alias("made")))[1],
    "SELECT id, CASE type WHEN 'org:supplier' THEN 'new ' || name ELSE name END AS name, CAST(NULL AS VARCHAR) AS made FROM nodes WHERE type LIKE 'org:%'",
)
_engine(
    "write_edges_again", ORG,
    lambda g: (
        g.put_edges(g.edges.where("type = 'has'").withColumn("id", F.lit("other")).unionByName(g.edges.where("type = 'has'").withColumns({"type": F.lit("owns"), "id": F.concat(F.lit("owns "), "id")}))),
        g.edges.groupBy("type").agg(F.count("*").alias("count"), F.count_distinct("id").alias("ids"), F.count(F.when(F.col("id") == "other", 1)).alias("other")),
    )[1],
    "SELECT type, count(*) AS count, count(*) AS ids, 0 AS other FROM (SELECT type FROM edges UNION ALL SELECT 'owns' FROM edges WHERE type = 'has') GROUP BY type",
)
_engine("query_params", DOC, lambda g: g.sql("SELECT id FROM nodes WHERE type = $kind AND data.total > $least", {"kind": "doc:order", "least": 400000}), "SELECT id FROM nodes WHERE type = 'doc:order' AND total > 400000")
_engine("count_by_extension", DOC, lambda g: introspect.count_nodes(g.nodes.withColumns({"type": F.lit("fs:file"), "data": F.parse_json(F.concat(F.lit('{"ext":"x'), F.length("key"), F.lit('"}')))}), g.edges, by="extension"), "SELECT 'x' || length(key) AS name, count(*) AS count FROM nodes GROUP BY 1")
_engine("counts_narrowed", DOC, lambda g: introspect.narrowed(introspect.count_nodes(g.nodes, g.edges, by="label"), "seg:", "name", 3), "SELECT l AS name, count(*) AS count FROM (SELECT unnest(labels) AS l FROM nodes) WHERE starts_with(l, 'seg:') GROUP BY l ORDER BY l LIMIT 3")
_engine("graph_totals", DOC, lambda g: (lambda i: g.spark.createDataFrame([(i["nodes"], i["edges"], i["orphans"])], "nodes long, edges long, orphans long"))(g.info()), "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, 0 AS orphans")
_engine(
    "stale_edges", ORG, lambda g: store.stale_edges(g.nodes, g.edges.withColumn("generation", F.when(F.col("type") == "has", "old").when(F.col("type") == "contains", "new")), "new", "tbl://nation/1").groupBy("type", "from_id").agg(F.count("*").alias("count")),
    "SELECT type, from_id, count(*) AS count FROM edges WHERE type = 'has' AND from_id LIKE 'nation:1%' GROUP BY 1, 2",
)
_engine("expiry_views", ORG, lambda g: store.unexpired(store.with_ttl(g.nodes.where("type = 'org:supplier'"), 60, 1000).unionByName(store.with_ttl(g.nodes.where("type = 'geo:nation'"), 0, 1000)), 1060).groupBy("type").agg(F.count("*").alias("count")), "SELECT type, count(*) AS count FROM nodes WHERE type = 'geo:nation' GROUP BY type")
_engine("reachable_low_bound", DOC, lambda g: reachable(oriented(of_types(g.edges, ["contains", "has"]), "out"), g.nodes.where("id = 'region:2'").select("id"), 2, None), f"{_SCOPE} SELECT id FROM under WHERE id <> 'region:2' AND id NOT LIKE 'nation:%'")
_engine(
    "impact_packages", ORG,
    lambda g: graph.impact(
        g.nodes.withColumns({"type": F.when(F.col("type") == "org:supplier", "go:ref").otherwise(F.col("type")), "data": F.parse_json(F.lit('{"kind":"call"}'))}),
        g.edges.where("type = 'belongs_to'").withColumn("type", F.lit("references")), "NATION_3")[0].select("package", "refs", F.array_join("kinds", ",").alias("kinds")),
    "SELECT 'tbl://supplier' AS package, count(*) AS refs, 'call' AS kinds FROM edges WHERE type = 'belongs_to' AND to_id = 'nation:3' AND from_id LIKE 'supplier:%' HAVING count(*) > 0",
)
_tables(
    "embeddings_again", lambda s, d: (lambda v: store.upsert_embeddings(v, v.where("node_id LIKE 'vec:1%'").withColumn("embedding", F.transform("embedding", lambda x: x * 0))).select("node_id", (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)) == 0).alias("blank")))(embeddings_of(s, d)),
    "SELECT 'vec:' || vec_id AS node_id, CAST(vec_id AS VARCHAR) LIKE '1%' AS blank FROM embeddings",
)
_tables(
    "calls_once", lambda s, d: graph.calls(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("caller"), F.col("l_partkey").cast("string").alias("callee"))).select("type", "from_id", "to_id"),
    "SELECT DISTINCT 'calls' AS type, CAST(l_suppkey AS VARCHAR) AS from_id, CAST(l_partkey AS VARCHAR) AS to_id FROM lineitem",
)

# Texts.


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat("text", F.lit("\n# TODO: look at "), F.coalesce("source", F.lit("?")), F.lit("\nplain\n  // fixme first "), F.coalesce("lang", F.lit("?")))
    return annotations(docs.select(F.col("doc_id").cast("string").alias("path"), text.alias("text"))).select("path", "line", "kind", "text")


_tables(
    "todo_scan_all", _noted,
    "WITH t AS (SELECT doc_id, text || chr(10) || '# TODO: look at ' || coalesce(source, '?') || chr(10) || 'plain' || chr(10) || '  // fixme first ' || coalesce(lang, '?') AS text FROM documents), l AS (SELECT string_split(text, chr(10)) AS ls, doc_id FROM t WHERE strlen(text) <= 2097152 AND NOT contains(left(text, 512), chr(0))), "
    "r AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, regexp_extract(unnest(ls), '(?i)^\\s*(?://|#|--|;)\\s*\\*?\\s*(TODO|FIXME|HACK|XXX|NOTE)\\b[:.]?\\s*(.*)', ['kind', 'text']) AS m FROM l) "
    "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line AS INT) AS line, upper(m.kind) AS kind, trim(m.text) AS text FROM r WHERE m.kind <> ''",
)
_HAS = "contains(head, '{}')".format
_BYTES = "coalesce(" + ", ".join(f"try(decode(encode(text)[1:{n}]))" for n in (1024, 1023, 1022, 1021)) + ")"  # a character cut in two goes
_LICENCE = (
    f"CASE WHEN {_HAS('permission is hereby granted, free of charge')} THEN 'MIT' WHEN {_HAS('apache license, version 2.0')} THEN 'Apache-2.0' "
    f"WHEN {_HAS('gnu general public license')} AND {_HAS('version 3')} THEN 'GPL-3.0-only' WHEN {_HAS('gnu general public license')} AND {_HAS('version 2')} THEN 'GPL-2.0-only' "
    f"WHEN {_HAS('gnu lesser general public license')} AND {_HAS('version 2.1')} THEN 'LGPL-2.1-only' "
    f"WHEN {_HAS('redistribution and use in source and binary forms')} THEN CASE WHEN {_HAS('neither the name')} THEN 'BSD-3-Clause' ELSE 'BSD-2-Clause' END "
    f"WHEN {_HAS('permission to use, copy, modify, and/or distribute')} THEN 'ISC' WHEN {_HAS('mozilla public license, version 2.0')} THEN 'MPL-2.0' "
    "ELSE 'unknown' END"
)
_tables(
    "licence_detect_all", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(licence("text").alias("licence")).groupBy("licence").agg(F.count("*").alias("count")),
    f"WITH t AS (SELECT lower({_BYTES}) AS head FROM documents) SELECT {_LICENCE} AS licence, count(*) AS count FROM t GROUP BY 1",
)
_tables(
    "commit_parse", lambda s, d: commits(s.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.col("event_type"), F.lit("(u"), F.col("user_id").cast("string"), F.lit("): did it\n\nwhy\n\nRefs: #"), F.col("event_id").cast("string"), F.lit(", X-1")).alias("message"))).select("event_id", "type", "scope", "subject", "body", F.array_join("refs", " ").alias("refs")),
    "SELECT event_id, event_type AS type, 'u' || user_id AS scope, 'did it' AS subject, 'why' AS body, '#' || event_id || ' X-1' AS refs FROM events",
)
_operator("tagger_rules", ITEM, lambda n, e: tagged(n.withColumn("labels", F.array().cast("array<string>")), F.regexp_replace("uri", "^tbl://", ""), [Rule(("small",), "item:part", None, "part/?"), Rule(("a", "small"), "item:part", "*a*", "**/*")]).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("count")), "SELECT 'small' AS label, count(*) AS count FROM nodes WHERE length(key) = 1 OR name LIKE '%a%' UNION ALL SELECT 'a', count(*) FROM nodes WHERE name LIKE '%a%' AND name NOT LIKE '%/%' HAVING count(*) > 0")
_tables(
    "range_merge", lambda s, d: merged_ranges(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_partkey").cast("long").alias("start"), (F.col("l_partkey") + F.col("l_linenumber")).cast("long").alias("stop"), F.col("l_quantity").alias("score"), F.lit("x").alias("reason"))).select("file", "start", "stop", "score"),
    "WITH r AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, l_partkey AS start, l_partkey + l_linenumber AS stop, l_quantity AS score FROM lineitem), m AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY file ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 1 ELSE 0 END AS fresh FROM r), "
    "g AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY start, stop) AS island FROM m) SELECT file, min(start) AS start, max(stop) AS stop, max(score) AS score FROM g GROUP BY file, island",
)
_tables(
    "enclosing_extent_all", lambda s, d: (lambda o: graph.enclosing(o.select(F.lit("f").alias("file"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 6).alias("stop"), F.col("o_custkey").alias("owner")), o.select(F.lit("f").alias("file"), (F.col("o_orderkey") * 10 + F.col("o_custkey") % 10).alias("pos"))).where("owner IS NOT NULL"))(s.read.parquet(f"{d}/orders.parquet")),
    "SELECT 'f' AS file, o_orderkey * 10 + o_custkey % 10 AS pos, o_custkey AS owner FROM orders WHERE o_custkey % 10 < 6",
)
_tables(
    "implementations", lambda s, d: (lambda l: graph.implementations(l.select(F.col("l_orderkey").alias("struct"), F.col("l_returnflag").alias("method")), l.select(F.col("l_linestatus").alias("interface"), F.col("l_returnflag").alias("method"))).orderBy("struct", "interface"))(s.read.parquet(f"{d}/lineitem.parquet")),
    "WITH s AS (SELECT DISTINCT l_orderkey AS struct, l_returnflag AS method FROM lineitem), i AS (SELECT DISTINCT l_linestatus AS interface, l_returnflag AS method FROM lineitem), h AS (SELECT struct, interface, count(*) AS have FROM s JOIN i USING (method) GROUP BY ALL) "
    "SELECT struct, interface FROM h JOIN (SELECT interface, count(*) AS need FROM i GROUP BY 1) USING (interface) WHERE have = need",
)


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat("text", F.lit("\n\n# Doc "), F.col("doc_id").cast("string"), F.lit("\n\nintro [x](./other.md)\n\n## "), F.coalesce("lang", F.lit("none")), F.lit("\n\n```py\n# no heading\n```\n"))
    return markdown(docs.select(F.col("doc_id").cast("string").alias("path"), text.alias("text"))).groupBy("kind", "section").agg(F.count("*").alias("count"))


_tables("markdown_parts", _markdown, None)


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = table_graph(spark, sf_dir, ORG)
    kinds = F.when(F.col("type") == "geo:nation", "go:interface").when(F.col("type") == "org:supplier", "go:method").otherwise("go:ref")
    return context.ring_walk(nodes.withColumn("type", kinds), edges, context.Task("", ("NATION_3",), ("supplier",)))


_tables(
    "ring_walk", _rings,
    f"{prelude(ORG)} SELECT id, 0 AS ring, 100.0::DOUBLE AS score, 'definition' AS reason FROM nodes WHERE name = 'NATION_3' AND type = 'geo:nation' "
    "UNION ALL SELECT to_id, 1, 80.0, 'member' FROM edges WHERE from_id = 'nation:3' AND type = 'has'",
)

# Pages of a navigator, symbols, projects and what scalars give.
_operator(
    "navigation_page", ORG, lambda n, e: graph.navigation(n, e, "nation:7", 6, 2)[1].select("side", "edge_type", "group", "id", "name"),
    ", g AS (SELECT 'out' AS side, type AS edge_type, CASE WHEN type IN ('contained_by', 'belongs_to', 'located_at') THEN 'parent' ELSE 'child' END AS \"group\", to_id AS id FROM edges WHERE from_id = 'nation:7' "
    "UNION ALL SELECT 'in', type, 'in', from_id FROM edges WHERE to_id = 'nation:7') "
    "SELECT side, edge_type, \"group\", id, name FROM g JOIN nodes USING (id) QUALIFY row_number() OVER (PARTITION BY side, edge_type ORDER BY name, id) BETWEEN 3 AND 8",
)
_operator(
    "siblings_page", ORG, lambda n, e: graph.siblings(n, e, "nation:7", 3, 1).select("id", "name"),
    "SELECT id, name FROM nodes WHERE id IN (SELECT to_id FROM edges WHERE type = 'contains' AND from_id IN (SELECT to_id FROM edges WHERE from_id = 'nation:7' AND type = 'contained_by')) ORDER BY name, id LIMIT 3 OFFSET 1",
)
_operator(
    "navigator_filter", DOC, lambda n, e: n.where(compare("data.status", "!=", "F") & compare("id", "GLOB", "order:1*") & ~category("files", "docs", "git")).select("id"),
    "SELECT id FROM nodes WHERE status <> 'F' AND id GLOB 'order:1*'",
)


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as structs, the flags of their lines as methods, and an interface of all flags."""
    suppliers, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "lineitem"))
    flags = lines.select("l_suppkey", F.concat(F.lit("M"), "l_returnflag").alias("name")).distinct()
    package, struct = F.concat(F.lit("p"), "s_nationkey"), F.concat(F.lit("S"), "s_suppkey")
    row = lambda df, package, kind, owner, name: df.select(F.lit("/m").alias("module"), package.alias("package"), F.lit(kind).alias("kind"), owner.alias("owner"), name.alias("name"))
    no = F.lit(None).cast("string")
    rows = row(suppliers, package, "struct", no, struct).unionByName(row(suppliers.join(flags, F.col("s_suppkey") == F.col("l_suppkey")), package, "method", struct, F.col("name")))
    rows = rows.unionByName(row(flags.select("name").distinct(), F.lit("i"), "imethod", F.lit("Flags"), F.col("name"))).unionByName(row(spark.range(1), F.lit("i"), "interface", no, F.lit("Flags")))
    empty = lambda schema: spark.createDataFrame([], schema)
    _, edges = symbols.symbol_graph(conform(rows, symbols.SYMBOL), empty(symbols.REFERENCE), empty(symbols.RELATION), "g")
    return edges.groupBy("type").agg(F.count("*").alias("count"))


_tables(
    "symbol_edges", _symbols,
    "WITH m AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), i AS (SELECT DISTINCT l_returnflag AS f FROM lineitem), "
    "p AS (SELECT count(DISTINCT s_nationkey) + 1 AS n FROM supplier), h AS (SELECT (SELECT count(*) FROM m) + (SELECT count(*) FROM i) AS n), "
    "k AS (SELECT count(*) AS n FROM (SELECT s FROM m GROUP BY s HAVING count(*) = (SELECT count(*) FROM i))) "
    "SELECT 'contains' AS type, n AS count FROM p UNION ALL SELECT 'contained_by', n FROM p UNION ALL SELECT 'has', n FROM h UNION ALL SELECT 'belongs_to', n FROM h UNION ALL SELECT 'implements', n FROM k WHERE n > 0 "
    "UNION ALL SELECT 'defines', (SELECT count(*) FROM supplier) + (SELECT count(*) FROM m) + 1",
)


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the licence of a project of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    file = lambda name: docs.select(F.concat(F.lit("/r/d"), F.col("doc_id").cast("string"), F.lit(f"/{name}")).alias("path"), "text")
    nodes, _, _ = project_graph(file("Gemfile").unionByName(file("LICENSE")), "g")
    return nodes.select("type", "uri", "name")


_tables(
    "projects_and_licences", _projects,
    f"WITH t AS (SELECT doc_id, lower({_BYTES}) AS head FROM documents) SELECT 'project:root' AS type, 'project+file:///r/d' || doc_id AS uri, 'd' || doc_id AS name FROM t "
    f"UNION ALL SELECT 'project:license', 'license+file:///r/d' || doc_id || '/LICENSE', {_LICENCE} FROM t",
)


_tables(
    "links_cleaned", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", clean_path(F.concat(F.lit("/w/"), "lang", F.lit("/../d"), F.col("doc_id").cast("string"), F.lit("/./a.md"))).alias("path")),
    "SELECT doc_id, CASE WHEN lang IS NOT NULL THEN '/w/d' || doc_id || '/a.md' END AS path FROM documents",
)
_tables(
    "text_measures", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", token_estimate("text").alias("tokens"), content_hash("text").alias("hash")),
    "SELECT doc_id, (length(text) + 3) // 4 AS tokens, left(sha256(text), 16) AS hash FROM documents",
)
_tables(
    "name_slugs", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", slug("p_name").alias("slug")),
    "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '-') AS slug FROM part",
)
