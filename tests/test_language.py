"""Queries over the base fixture, with the answers that are known for it."""

import pytest

from trellium.model import QueryError, make_edges, make_nodes
from trellium.plans import builder as b
from trellium.plans.compile import compile_query
from trellium.plans.parser import parse, parse_expression
from trellium.plans.unparse import as_json, dump, unparse

NODES = [
    ("n0", "fs:file", "file:///test1.go", "test1.go", '{"ext":"go","size":100}', ["test", "code"]),
    ("n1", "fs:file", "file:///test2.py", "test2.py", '{"ext":"py","size":200}', ["test"]),
    ("n2", "fs:file", "file:///README.md", "README.md", '{"ext":"md"}', None),
    ("n3", "fs:file", "file:///main.go", "main.go", '{"ext":"go","size":50}', None),
    ("n4", "fs:dir", "file:///src", "src", None, ["source"]),
    ("n5", "fs:dir", "file:///cmd", "cmd", None, None),
    ("n6", "vcs:repo", "git+file:///repo", "myrepo", None, None),
    ("n7", "vcs:branch", "git+file:///repo#main", "main", None, None),
    ("n8", "vcs:branch", "git+file:///repo#dev", "dev", None, None),
]
EDGES = [
    ("contains", "n4", "n0"), ("contains", "n4", "n1"), ("contains", "n5", "n3"), ("has", "n6", "n7"), ("has", "n6", "n8"),
    ("located_at", "n6", "n4"), ("references", "n0", "n3"),
]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = make_nodes(spark.createDataFrame(NODES, "id string, type string, uri string, name string, data string, labels array<string>"))
    edges = make_edges(spark.createDataFrame(EDGES, "type string, from_id string, to_id string"))
    return nodes.persist(), edges.persist()


CASES = [
    ("SELECT * FROM nodes", 9, "nodes"),
    ("SELECT name FROM nodes WHERE type GLOB 'fs:*'", 6, "nodes"),
    ("SELECT id FROM nodes WHERE labels CONTAINS ANY ('test','code')", 2, "nodes"),
    ("SELECT id FROM nodes WHERE labels CONTAINS ALL ('test','code')", 1, "nodes"),
    ("SELECT id FROM nodes WHERE labels NOT CONTAINS ('test')", 7, "nodes"),
    ("SELECT id FROM nodes WHERE labels NOT CONTAINS ALL ('test','code')", 8, "nodes"),
    ("SELECT id FROM nodes WHERE data.ext = 'go'", 2, "nodes"),
    ("SELECT id FROM nodes WHERE data.size BETWEEN 50 AND 150", 2, "nodes"),
    ("SELECT id FROM nodes WHERE data.size = '50'", 0, "nodes"),
    ("SELECT id FROM nodes WHERE data.ext > 5", 4, "nodes"),
    ("SELECT id FROM nodes WHERE data IS NOT NULL", 4, "nodes"),
    ("SELECT id FROM nodes WHERE name LIKE 'readme%'", 1, "nodes"),
    ("SELECT type, COUNT(*) FROM nodes GROUP BY type HAVING COUNT(*) > 1", 3, "counts"),
    ("SELECT id FROM nodes LIMIT 2 OFFSET 8", 1, "nodes"),
    ("SELECT DISTINCT type FROM nodes", 4, "nodes"),
    ("SELECT * FROM edges", 7, "edges"),
    ("SELECT file FROM (dir:fs:dir)-[:contains]->(file:fs:file)", 3, "nodes"),
    ("SELECT e FROM (dir:fs:dir)-[e:contains]->(file:fs:file)", 3, "edges"),
    ("SELECT b FROM (a)-[:contains|has]->(b)", 5, "nodes"),
    ("SELECT a, b FROM (a)-[:references]-(b)", 2, "rows"),
    ("SELECT dir.name, dir.type, COUNT(*) FROM (dir:fs:dir)-[:contains]->(f:fs:file) GROUP BY dir.id", 2, "rows"),
    ("SELECT value, COUNT(*) FROM nodes, json_each(labels) WHERE value != '' GROUP BY value", 3, "counts"),
    ("SELECT type, COUNT(*) FROM edges WHERE EXISTS (r WHERE id = 'n4')-[:contains|has*0..]->(edges) GROUP BY type", 2, "counts"),
    ("SELECT id FROM nodes WHERE id NOT IN (SELECT from_id FROM edges)", 5, "nodes"),
    ("SELECT id FROM nodes WHERE id IN (SELECT from_id FROM edges) OR name = 'dev'", 5, "nodes"),
    ("SELECT b FROM (:fs:dir WHERE name = 'src')-[:contains]->(b)", 2, "nodes"),
    ("SELECT id FROM nodes WHERE id = 'n4' AND NOT EXISTS (nodes)-[:contains]->(:fs:file)", 0, "nodes"),
    ("SELECT id FROM nodes WHERE EXISTS (nodes)-[:contains]->(:fs:file WHERE data.ext = 'py') OR EXISTS (nodes)<-[:has]-(:vcs:repo)", 3, "nodes"),
    ("SELECT a.name, b.name FROM (a)-[:located_at*0..3]->(b) WHERE a.name = 'myrepo'", 2, "rows"),
    ("SELECT r FROM (r:vcs:repo)-[:has]->(b:vcs:branch), (r)-[:located_at]->(d:fs:dir)", 2, "nodes"),
]


@pytest.mark.parametrize("text,rows,kind", CASES)
def test_answers(graph, text, rows, kind):
    got = compile_query(parse(text), *graph)
    assert (got.df.count(), got.kind) == (rows, kind)


def test_cycles_end(spark):
    nodes = make_nodes(spark.createDataFrame([(x, "fs:dir") for x in "abc"], "id string, type string"))
    edges = make_edges(spark.createDataFrame([("contains", "a", "b"), ("contains", "b", "c"), ("contains", "c", "a")], "type string, from_id string, to_id string"))
    q = "SELECT id FROM nodes WHERE EXISTS (r WHERE id = 'a')-[:contains*{}]->(nodes)"
    assert compile_query(parse(q.format("0..")), nodes, edges).df.count() == 3
    assert [r.id for r in compile_query(parse(q.format("2")), nodes, edges).df.collect()] == ["c"]
    walks = compile_query(parse("SELECT b FROM (a WHERE id = 'a')-[:contains*1..7]->(b)"), nodes, edges)
    assert walks.df.count() == 7


def test_not_in_a_large_subquery_is_not_broadcast(spark):
    n = spark.range(110_000)
    nodes = make_nodes(n.selectExpr("concat('f', id) AS id", "'fs:file' AS type", "if(id % 2 = 0, concat('f', id), null) AS name"))
    edges = make_edges(n.where("id > 4").selectExpr("'has' AS type", "concat('f', id) AS from_id", "'x' AS to_id"))
    run = lambda q: compile_query(parse(q), nodes, edges).df
    df = run("SELECT id FROM nodes WHERE id NOT IN (SELECT from_id FROM edges)")
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in df.collect()} == {"f0", "f1", "f2", "f3", "f4"}
    assert {r.id for r in run("SELECT id FROM nodes WHERE name NOT IN (SELECT from_id FROM edges)").collect()} == {"f0", "f2", "f4"}, "null is in no set for sure"
    assert run("SELECT id FROM nodes WHERE id NOT IN (SELECT name FROM nodes)").count() == 0
    assert run("SELECT id FROM nodes WHERE name NOT IN (SELECT from_id FROM edges WHERE type = 'no')").count() == 110_000


def test_many_walks_are_not_broadcast(spark):
    """Compressed files of walks are small, and so are the tables of their ends; their rows are not."""
    n = spark.range(110_000)
    nodes = make_nodes(n.selectExpr("concat('f', id) AS id", "'fs:file' AS type", "concat('u', id) AS uri", "concat('f', id) AS name").unionAll(spark.sql("SELECT 'r', 'fs:dir', 'u', 'root'")))
    edges = make_edges(n.selectExpr("'contains' AS type", "'r' AS from_id", "concat('f', id) AS to_id"))
    df = compile_query(parse("SELECT a.name AS name, COUNT(*) AS count FROM (a:fs:dir)-[:contains*]->(b:fs:file) GROUP BY a.name"), nodes, edges).df
    assert df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1, "that of the one folder"
    assert [tuple(r) for r in df.collect()] == [("root", 110_000)]


@pytest.mark.parametrize("text", [c[0] for c in CASES])
def test_unparse_round_trip(text):
    tree = parse(text)
    assert parse(unparse(tree)) == tree
    assert dump(tree) and as_json(tree)


@pytest.mark.parametrize(
    "text,part",
    [
        ("SELECT id FROM nodes HAVING COUNT(*) > 1", "HAVING requires GROUP BY"),
        ("SELECT id FROM things", "unknown table"),
        ("SELECT x FROM (a)-[]->(b)", "undefined variable x"),
        ("SELECT a FROM (a)-[a]->(b)", "duplicate variable"),
        ("SELECT * FROM ()-[]->()", "at least one variable"),
        ("SELECT id FROM nodes, other(labels)", "table function"),
    ],
)
def test_invalid(graph, text, part):
    with pytest.raises(QueryError) as e:
        compile_query(parse(text), *graph)
    assert e.value.phase == "validate" and part in str(e.value)


def test_parameters(graph):
    q = parse("SELECT id FROM nodes WHERE data.size > $least AND type = $1")
    assert compile_query(q, *graph, {"least": 60, 1: "fs:file"}).df.count() == 2
    with pytest.raises(QueryError):
        compile_query(q, *graph)


def test_builder_agrees_with_parser(graph):
    made = b.Nodes.select("type", b.Count).where(b.any_of(b.Ref("data.ext").eq("go"), b.Ref("type").glob("vcs:*"))).group_by("type").order_by_count().build()
    assert made == parse("SELECT type, COUNT(*) FROM nodes WHERE data.ext = 'go' OR type GLOB 'vcs:*' GROUP BY type ORDER BY COUNT(*) DESC")
    files = b.from_patterns(b.pattern(b.node("d", "fs:dir")).to(b.edge("contains"), b.node("f"))).select("f").where(b.Ref("d.name").eq("src"))
    assert compile_query(files.build(), *graph).df.count() == 2
    assert compile_query(b.Nodes.select("id").scoped_to("n4").build(), *graph).df.count() == 3
    both = b.all_of(b.Ref("a").eq(1), b.any_of(b.Ref("b").eq(2), b.Ref("c").eq(3)))
    assert both == parse_expression("a = 1 AND (b = 2 OR c = 3)")


def test_count_helper(graph):
    assert compile_query(parse("SELECT COUNT(*) AS count FROM nodes"), *graph).count() == 9
