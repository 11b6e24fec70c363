"""Graph, store, search, sources, context and streaming over small inputs."""

import json
import re

import pytest
from pyspark.sql import functions as F

from trellium import queries
from trellium.engine import Engine
from trellium.model import NodeNotFound, Registry, make_edges, make_nodes
from trellium.operators import context, graph, introspect, store, vector
from trellium.operators.filters import NodeFilter, category, compare, find
from trellium.sources import files as fs
from trellium.sources import text as tx
from trellium.streaming.watch import CHANGES, CREATE, REMOVE, Subscription, Watcher, coalesced, routed


def nodes_of(spark, rows, schema="id string, type string, uri string, name string"):
    return make_nodes(spark.createDataFrame(rows, schema))


def edges_of(spark, rows):
    return make_edges(spark.createDataFrame(rows, "type string, from_id string, to_id string"))


@pytest.fixture(scope="module")
def calls(spark):
    nodes = nodes_of(spark, [(x, "go:func", f"u:{x}", x) for x in "ABCDE"])
    return nodes, edges_of(spark, [("calls", "A", "B"), ("calls", "B", "C"), ("calls", "C", "D"), ("uses", "B", "E")])


def test_paths(calls):
    one = graph.find_paths(*calls, "A", "B").collect()
    assert one[0].length == 1 and one[0].steps[0].edge_type == "calls"
    assert graph.find_paths(*calls, "A", "D").first().length == 3
    assert graph.find_paths(*calls, "D", "A", max_depth=2).isEmpty()
    back = graph.find_paths(*calls, "D", "A").first()
    assert back.length == 3 and all(s.incoming for s in back.steps)
    assert graph.find_paths(*calls, "A", "A").isEmpty()
    with pytest.raises(NodeNotFound):
        graph.find_paths(*calls, "none", "A")


def test_neighbors(calls):
    got = graph.neighbors(*calls, "B").select("direction", "id").collect()
    assert [r.direction for r in got] == ["out", "out", "in"] and {r.id for r in got} == {"C", "E", "A"}
    assert graph.neighbors(*calls, "A", "in").isEmpty()
    assert graph.neighbors(*calls, "B", "out", ["uses"]).first().id == "E"
    with pytest.raises(NodeNotFound):
        graph.neighbors(*calls, "none")


def test_neighbors_are_ordered_by_their_ids(spark):
    nodes = nodes_of(spark, [(x, "t", f"u:{x}", x) for x in ("n", "c:1", "c:10", "c:2")])
    edges = edges_of(spark, [("has", x, "n") for x in ("c:1", "c:10", "c:2")]).withColumn("id", F.concat_ws("|", "type", "from_id", "to_id"))
    assert [r.id for r in graph.neighbors(nodes, edges, "n").collect()] == ["c:1", "c:10", "c:2"]
    assert [r.id for r in graph.neighbors(nodes, edges, "n", most=1).collect()] == ["c:1"]


def test_stats_of_a_large_scope(spark):
    """The scope is worked out once, and what is joined with it is dealt out by its rows."""
    n = spark.range(110_000)
    nodes = make_nodes(n.selectExpr("concat('f', id) AS id", "'fs:file' AS type", "concat('u', id) AS uri", "array('l') AS labels", """'{"ext": "go"}' AS data""").unionAll(spark.sql("SELECT 'r', 'fs:dir', 'u', array(), null")))
    edges = make_edges(n.selectExpr("'contains' AS type", "if(id >= 0, 'r', 'none') AS from_id", "concat('f', id) AS to_id"))
    df = introspect.stats(nodes, edges, "r")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in df.collect()} == {("types", "fs:file", 110_000), ("types", "fs:dir", 1), ("edges", "contains", 110_000), ("extensions", "go", 110_000), ("labels", "l", 110_000)}


def test_tree(spark):
    nodes = nodes_of(spark, [("r", "fs:dir", "", "root"), ("a", "fs:file", "", "file1.txt"), ("s", "fs:dir", "", "subdir"), ("b", "fs:file", "", "file2.txt"), ("n", "fs:dir", "", "nested"), ("d", "fs:file", "", "deep.txt")])
    edges = edges_of(spark, [("contains", x, y) for x, y in ("ra", "rs", "sb", "sn", "nd")])
    assert graph.tree_text(graph.tree(nodes, edges, "r", 0)).split("\n") == ["root/", "  file1.txt", "  subdir/", "    file2.txt", "    nested/", "      deep.txt"]
    assert "subdir/ (+2 items)" in graph.tree_text(graph.tree(nodes, edges, "r", 1))


def test_store(spark, tmp_path):
    base = nodes_of(spark, [("1", "t", "u1", "a"), ("2", "t", "u2", "b")]).withColumn("created_at", F.lit("old"))
    batch = nodes_of(spark, [("2", "t", "u2", "new"), ("3", "t", "u3", "c")]).withColumn("created_at", F.lit("now"))
    got = {r.id: (r.name, r.created_at) for r in store.upsert_nodes(base, batch).collect()}
    assert got == {"1": ("a", "old"), "2": ("new", "old"), "3": ("c", "now")}
    with pytest.raises(Exception, match="several"):
        store.upsert_nodes(base, nodes_of(spark, [("9", "t", "u1", "x")]))
    edges = edges_of(spark, [("e", "1", "2"), ("e", "1", "gone")])
    assert store.orphan_edges(base, edges).first().to_id == "gone"
    old = store.with_ttl(base, 5, now=0)
    assert store.expired(old, 5).count() == 2 and store.unexpired(old, 4).count() == 2
    stored = store.Store(spark, str(tmp_path))
    stored.write("nodes", base)
    stored.write("nodes", store.upsert_nodes(stored.read("nodes"), batch))
    assert stored.read("nodes").count() == 3


def test_engine(spark, tmp_path):
    (tmp_path / "src/a").mkdir(parents=True)
    (tmp_path / "src/a/x.go").write_text("package a")
    (tmp_path / "src/node_modules").mkdir()
    (tmp_path / "src/node_modules/y.js").write_text("1")
    e = Engine(spark, folder=str(tmp_path / "store"), provider=vector.HashingProvider(16))
    e.register_source(fs.FileSource())
    run = e.index(f"file://{tmp_path}/src")
    assert run["files_indexed"] == 1 and run["dirs_indexed"] == 3
    assert e.sql("SELECT name FROM nodes WHERE data.ext = 'go'").first().name == "x.go"
    assert e.sql(f"SELECT f FROM (d:fs:dir WHERE name = 'a')-[:contains]->(f:fs:file)").count() == 1
    e.write_node("custom://1", "go:func", "search me", '{"doc": "alpha beta"}')
    assert e.search(["search me go:func alpha beta"]).first().score > 0.9
    assert e.describe(True)["fields"].count() > 3 and "Plan" in e.explain("SELECT id FROM nodes")
    e.delete_by_path(f"file://{tmp_path}/src/a")
    assert e.sql("SELECT name FROM nodes WHERE data.ext = 'go'").isEmpty()
    assert e.gc(dry_run=True).count() == 3 and e.info()["last_run"]["files_indexed"] == 1


def test_describe_and_find(spark):
    nodes = nodes_of(spark, [("a", "fs:dir", "file:///a", "a"), ("x", "fs:file", "file:///a/x.go", "x.go"), ("p", "go:package", "go:a", "a")])
    edges = edges_of(spark, [("contains", "a", "x"), ("contains", "a", "p"), ("belongs_to", "x", "a")])
    got = introspect.describe_edges(nodes, edges).collect()
    assert [(r.type, r["count"], len(r.connections)) for r in got] == [("contains", 2, 2), ("belongs_to", 1, 1)]
    assert [r.id for r in find(nodes, edges, NodeFilter(root_only=True)).collect()] == ["a"]
    assert find(nodes, edges, NodeFilter(extensions=["go"], uri_prefix="file:///a")).first().id == "x"
    assert Registry().check(nodes, edges_of(spark, [("odd", "a", "x")])).first().reason == "unknown type"


def test_vectors(spark):
    rows = spark.createDataFrame([("a", [0.1, 0.2, 0.9]), ("b", [1.0, 0.0, 0.0]), ("c", []), ("d", [0.0, 0.0, 0.0])], "node_id string, embedding array<float>")
    got = vector.find_similar(rows, [0.1, 0.2, 0.9]).collect()
    assert got[0].node_id == "a" and abs(got[0].score - 1) < 1e-6 and got[-1].score == 0
    both = vector.search(rows, [("p", [1.0, 0.0, 0.0]), ("q", [0.1, 0.2, 0.9])], 2).collect()
    assert {(r.node_id, r.query) for r in both} == {("a", "q"), ("b", "p")}


@pytest.mark.parametrize(
    "message,want",
    [
        ("feat(query): add pattern matching", ("feat", "query", False, "add pattern matching", [])),
        ("fix: handle nil pointer in walker", ("fix", "", False, "handle nil pointer in walker", [])),
        ("refactor!: rename Storage interface", ("refactor", "", True, "rename Storage interface", [])),
        ("feat: x\n\nbody here\n\nRefs: #8, DEV-100", ("feat", "", False, "x", ["#8", "DEV-100"])),
        ("fix: x\n\nBREAKING CHANGE: all of it", ("fix", "", True, "x", [])),
        ("Initial commit", ("", "", False, "Initial commit", [])),
    ],
)
def test_commits(spark, message, want):
    r = tx.commits(spark.createDataFrame([(message,)], "message string")).first()
    assert (r.type, r.scope, r.breaking, r.subject, r.refs) == want


def test_text_sources(spark):
    files = spark.createDataFrame([("/a/x.go", "x\n// TODO: do it\ny # not here TODO\n--fixme later")], "path string, text string")
    assert [(r.line, r.kind, r.text, r.before) for r in tx.annotations(files).collect()] == [(2, "TODO", "do it", "x"), (4, "FIXME", "later", "y # not here TODO")]
    doc = "# My Document\n\n## Getting Started\n```bash\nmake\n```\n### Installation\n```go\nx\n```\n## API Reference\n[out](https://x.y) [in](./other.md) ![i](p.png)\n"
    parts = tx.markdown(spark.createDataFrame([("/d/a.md", doc)], "path string, text string")).collect()
    assert [p.section for p in parts if p.kind == "section"] == ["h1-my-document", "h1-my-document/h2-getting-started", "h1-my-document/h2-getting-started/h3-installation", "h1-my-document/h2-api-reference"]
    assert sum(p.kind == "codeblock" for p in parts) == 2 and parts[0].name == "My Document"
    nodes, edges = tx.markdown_graph(spark.createDataFrame(parts), "g")
    assert nodes.where("type = 'md:link'").count() == 1 and edges.where("type = 'links_to'").count() == 1
    mods = spark.createDataFrame([("/m/go.mod", "module a/b\n\ngo 1.22\n\nrequire (\n\tx v1\n\ty v2\n)\n"), ("/m/package.json", '{"name": "n", "version": "2", "dependencies": {"a": "1"}}')], "path string, text string")
    assert {(r.language, r.name, r.version, r.dep_count) for r in tx.manifests(mods).collect()} == {("go", "a/b", "1.22", 2), ("node", "n", "2", 1)}
    lic = spark.createDataFrame([("Under the Apache License, Version 2.0",), ("nothing",)], "t string").select(tx.licence("t").alias("l"))
    assert [r.l for r in lic.collect()] == ["Apache-2.0", "unknown"]
    files = spark.createDataFrame([("fs:file", "a_test.go", "pkg/a_test.go"), ("fs:dir", "docs", "docs")], "type string, name string, path string").withColumn("labels", F.array().cast("array<string>"))
    assert [r.labels for r in tx.tagged(files, F.col("path")).collect()] == [["test:file"], []]


def test_many_ranges_are_dealt_out(spark, monkeypatch):
    rows = spark.range(600).selectExpr("concat('f', id % 60) AS file", "id AS start", "id + 1 AS stop", "1.0 AS score", "'a' AS reason")
    plain = {tuple(r) for r in tx.merged_ranges(rows).drop("reasons").collect()}
    monkeypatch.setattr(tx, "RANGES", 10, raising=False)
    out = tx.merged_ranges(rows).drop("reasons")
    assert out.rdd.getNumPartitions() == 60, "not joined to fewer by their compressed bytes"
    assert {tuple(r) for r in out.collect()} == plain and len(plain) == 600


def test_ranges_and_budget(spark):
    rows = spark.createDataFrame([("f", 4, 8, 100.0, "a"), ("f", 10, 12, 50.0, "b"), ("f", 30, 31, 10.0, "c")], "file string, start int, stop int, score double, reason string")
    assert [(r.start, r.stop, r.score) for r in tx.merged_ranges(rows).orderBy("start").collect()] == [(4, 12, 100.0), (30, 31, 10.0)]
    block = lambda f, n, s: context.Block(f, 1, 1, "x" * (4 * n), s)
    kept, out = context.fit([block("a.go", 10, 100), block("b.go", 10, 80)], 1000)
    assert len(kept) == 2 and sum(b.tokens for b in kept) == 20
    kept, out = context.fit([block("a.go", 250, 100), block("b.go", 250, 80), block("c.go", 250, 40)], 700)
    assert [b.file for b in kept] == ["a.go", "b.go"] and [b.file for b in out] == ["c.go"]
    task = context.parse_task("Fix the NewNode bug in `Storage`")
    assert task.intent == "fix" and set(task.symbols) == {"NewNode", "Storage"}


def test_ring_walk(spark):
    nodes = make_nodes(
        spark.createDataFrame(
            [
                ("s", "go:interface", "Storage", "go:p", '{"position":{"file":"s.go","line":3,"end_line":5}}'), ("g", "go:method", "Get", "go:p", None),
                ("m", "go:struct", "MemoryStorage", "go:p", None), ("h", "go:method", "Get", "go:p", None),
                ("r1", "go:ref", "Storage", "go:p", '{"kind":"type","position":{"file":"main.go","line":10}}'), ("r2", "go:ref", "Storage", "go:p", '{"kind":"call","position":{"file":"main.go","line":15}}'),
            ],
            "id string, type string, name string, uri string, data string",
        )
    )
    edges = edges_of(spark, [("has", "s", "g"), ("has", "m", "h")])
    got = {r.id: r.score for r in context.ring_walk(nodes, edges, context.Task("", ("Storage",))).collect()}
    assert (got["s"], got["g"], got["m"], got["r1"], got["r2"]) == (100, 80, 75, 64, 69)


def test_ring_walk_limits_each_symbol(spark):
    at = lambda f: f'{{"kind":"type","position":{{"file":"{f}","line":1}}}}'
    rows = [(f"a{i:02}", "go:func", "Alpha", "go:p", None) for i in range(12)] + [("b", "go:struct", "Beta", "go:q", None), ("bm", "go:method", "run", "go:z", None)]
    rows += [(f"r{i:03}", "go:ref", "Alpha", "go:x", at("a.go")) for i in range(105)] + [("s1", "go:ref", "Beta", "go:x", at("b.go")), ("s2", "go:ref", "Beta", "go:x", None), ("s3", "go:ref", "Beta", "go:x", None)]
    rows += [("s4", "go:ref", "Gamma", "go:x", at("c.go")), ("s5", "go:ref", "Beta", "go:x", at("a.go"))]
    rows += [(f"c{i:02}", "go:func", f"C{i}", "go:p", None) for i in range(60)] + [("d", "go:func", "D", "go:q", None)]
    nodes = make_nodes(spark.createDataFrame(rows, "id string, type string, name string, uri string, data string"))
    got = {r.id: (r.ring, r.score) for r in context.ring_walk(nodes, edges_of(spark, [("has", "b", "bm")]), context.Task("", ("Alpha", "Beta", "Gamma"))).collect()}
    assert sorted(k for k, v in got.items() if v[0] == 0) == [f"a{i:02}" for i in range(10)] + ["b"]
    assert got["bm"] == (1, 80) and got["d"] == (3, 40)
    assert sorted(k for k, v in got.items() if v[0] == 2) == [f"r{i:03}" for i in range(100)] + ["s1", "s2", "s3", "s5"]
    assert (got["r000"], got["s1"], got["s2"], got["s5"]) == ((2, 80), (2, 60), (2, 60), (2, 80))
    assert [k for k in sorted(got) if k[0] == "c"] == [f"c{i:02}" for i in range(38)]  # the twelve definitions are of the package too


def test_relations(spark):
    extents = spark.createDataFrame([("f", 0, 10, "a"), ("f", 20, 30, "b")], "file string, start int, stop int, owner string")
    at = spark.createDataFrame([("f", 5), ("f", 15), ("f", 20)], "file string, pos int")
    assert {(r.pos, r.owner) for r in graph.enclosing(extents, at).collect()} == {(5, "a"), (15, None), (20, "b")}


def test_enclosing_deals_out_one_file(spark):
    extents = [("f", 10 * k, 10 * k + 6, k) for k in range(300)] + [("g", 0, 10**6, -1), (None, 0, 9, -2)]
    at = [("f", 10 * k + k % 10) for k in range(300)] + [("g", k) for k in range(300)] + [(None, 4)]
    want = {(f, p, next((o for g, a, b, o in extents if g == f and a <= p < b), None)) for f, p in at}
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = graph.enclosing(spark.createDataFrame(extents, "file string, start int, stop int, owner int"), spark.createDataFrame(at, "file string, pos int"))
        rows = got.withColumn("_task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(coalesce, "true")
    assert len(rows) == len(at) and {(r.file, r.pos, r.owner) for r in rows} == want
    assert len({r._task for r in rows if r.file == "f"}) > 1


def test_enclosing_extent_reads_all_orders(spark):
    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet").collect()
    want = sorted((o.o_orderkey * 10 + o.o_custkey % 10, o.o_custkey) for o in orders if o.o_custkey % 10 < 6)
    assert sorted((r.pos, r.owner) for r in queries.QUERIES["enclosing_extent_all"](spark, folder).collect()) == want


DOCUMENTS = [
    (1, "# Real\n\n// TODO: mend it\nsee [a](b.md)\n```sh\nmake\n```\n"),
    (2, "Notice\nUnder the Apache License, Version 2.0\n" + "word " * 30_000 + "\n; note. at the end"),
    (3, "## Late\nPermission to use, copy, modify, and/or distribute"),
    (4, ""),
    (5, None),
]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("documents"))
    rows = spark.createDataFrame([(i, t, "en" if i < 5 else None, "web") for i, t in DOCUMENTS], "doc_id long, text string, lang string, source string")
    rows.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return folder


def test_text_queries_read_whole_texts(spark, documents):
    want = []
    for i, t in DOCUMENTS:
        for n, line in enumerate(f"{t}\n# TODO: look at web\nplain\n  // fixme first en".split("\n") if t is not None else []):
            if m := re.match(tx.ANNOTATION, line):
                want.append((str(i), n + 1, m[1].upper(), m[2].strip(" ")))
    got = [tuple(r) for r in queries.QUERIES["todo_scan_all"](spark, documents).collect()]
    assert sorted(got) == sorted(want) and {("1", 3, "TODO", "mend it"), ("2", 4, "NOTE", "at the end")} < set(got)
    got = {r["licence"]: r["count"] for r in queries.QUERIES["licence_detect_all"](spark, documents).collect()}
    assert got == {"Apache-2.0": 1, "ISC": 1, "unknown": 3}


def test_markdown_query_reads_whole_texts(spark, documents):
    got = {(r["kind"], r["section"]): r["count"] for r in queries.QUERIES["markdown_parts"](spark, documents).collect()}
    assert got[("section", "h1-real")] == 1 and got[("codeblock", "h1-real")] == 1 and got[("section", "h2-late")] == 1
    assert got[("document", "")] == 5 and got[("link", "")] == 5
    assert got[("section", "h1-doc-4/h2-en")] == 1 and ("section", "h1-doc-5") not in got


def test_whole_graph_queries_read_all_tables(spark):
    folder = "/root/testdata/sf0.001"
    t = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    size = {x: t(x).count() for x in ("region", "nation", "supplier", "customer", "part", "orders", "events")}
    users = t("events").select("user_id").distinct().count()
    run = lambda name: queries.QUERIES[name](spark, folder)
    star = run("flat_star_all").collect()
    assert len(star) == sum(size.values()) + users
    one = t("orders").orderBy("o_orderkey").first()
    data = json.loads(next(r.data for r in star if r.id == f"order:{one.o_orderkey}"))
    assert data == {"status": one.o_orderstatus, "priority": one.o_orderpriority, "total": one.o_totalprice}
    assert run("flat_not_glob_all").count() == sum(size[x] for x in ("region", "nation", "part", "orders", "events"))
    assert run("flat_not_in_all").count() == len(star) - size["region"] - size["customer"]
    lines = [t("lineitem").select(x, "l_partkey").distinct().count() for x in ("l_orderkey", "l_suppkey")]
    has = sum(size[x] for x in ("supplier", "customer", "orders", "events"))
    want = {"contains": size["nation"], "contained_by": size["nation"], "has": has, "belongs_to": has, "references": lines[0], "supplies": lines[1]}
    assert {r["type"]: r["count"] for r in run("edges_group_type_all").collect()} == want
    assert run("edges_star_all").count() == sum(want.values())


def test_stream(spark, tmp_path):
    base = store.Store(spark, str(tmp_path / "store"))

    def index(changes, generation):
        rows = changes.select(F.lit("fs:file").alias("type"), F.concat(F.lit("file://"), "path").alias("uri"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(generation).alias("generation"))
        return make_nodes(rows), edges_of(spark, [])

    watcher = Watcher(base, index, gc_seconds=None)
    schema = spark.createDataFrame([], CHANGES).schema
    for n, rows in enumerate([[("/a/x", CREATE, "1"), ("/a/y", CREATE, "2"), ("/b", CREATE, "3")], [("/a", REMOVE, None)]]):
        spark.createDataFrame(rows, "path string, op int, text string").select("path", "op", F.current_timestamp().alias("ts"), "text").write.mode("append").parquet(str(tmp_path / "in"))
        q = watcher.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "check"), once=True)
        q.awaitTermination(60)
        assert q.exception() is None
        assert base.read("nodes").count() == (3, 1)[n]
    events = spark.createDataFrame([("indexed", "fs:file", "a.md"), ("deleted", "fs:file", "b.go")], "event string, type string, name string")
    got = routed(events, {"md": Subscription(extension="md"), "gone": Subscription(events=("deleted",))}).collect()
    assert {(r.name, r.subscriber) for r in got} == {("a.md", "md"), ("b.go", "gone")}
    twice = spark.createDataFrame([("/x", 1, None, "a"), ("/x", 2, None, "b")], CHANGES)
    assert coalesced(twice).first().ops == 3


def test_a_writer_that_dies_leaves_the_version_before_it(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/graph")
    kept.append_run(root_path="one")
    kept.append_run(root_path="two")
    (tmp_path / "graph/index_runs/v999999999999-dead").mkdir()  # begun, and no more than that
    assert {r.root_path for r in kept.read("index_runs").collect()} == {"one", "two"}
    assert kept.read("nodes").count() == 0


def test_vectors_of_one_batch_that_repeat_an_id(spark):
    base = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "node_id string, embedding array<float>")
    batch = spark.createDataFrame([("a", [2.0]), ("a", [3.0]), ("c", [0.0])], "node_id string, embedding array<float>")
    got = sorted((r.node_id, r.embedding[0]) for r in store.upsert_embeddings(base, batch).collect())
    assert got == [("a", 3.0), ("b", 1.0), ("c", 0.0)]


def test_extents_of_several_files_side_by_side(spark):
    extents = spark.createDataFrame([("f", 0, 10, "a"), ("f", 10, 20, "b"), ("g", 5, 8, "c")], "file string, start long, stop long, owner string")
    positions = spark.createDataFrame([("f", 9), ("f", 10), ("f", 20), ("g", 4), ("g", 5), ("h", 1)], "file string, pos long")
    got = {(r.file, r.pos): r.owner for r in graph.enclosing(extents, positions).collect()}
    assert got == {("f", 9): "a", ("f", 10): "b", ("f", 20): None, ("g", 4): None, ("g", 5): "c", ("h", 1): None}


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture(scope="module")
def tree_of_files(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    write(root, "go.mod", "module example.org/a\n\ngo 1.22\n")
    write(root, "LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person")
    write(root, "README.md", "# Top\n\nSee [it](docs/../docs/a.md).\n\n## Use\n\nrun it\n\n```sh\nmake\n```\n")
    write(root, "docs/a.md", "# A\n[up](../README.md) [out](https://x.y/z)\n")
    write(root, "src/x_test.go", "package x\n// TODO: more\n")
    write(root, "node_modules/skip/me.js", "// TODO: never\n")
    (root / "empty").mkdir()
    (root / "link").symlink_to(root / "docs")
    return root


def test_index_with_listeners_and_commands(spark, tree_of_files, tmp_path, capsys):
    from trellium.cli import main

    run = lambda *args: (got := [], main(["--store", f"file://{tmp_path}/store", *args], spark, got.append))[0]
    root = tree_of_files
    assert run("index", str(root))[0].startswith("5 files, 5 folders, 0 gone")
    e = Engine(spark, folder=f"file://{tmp_path}/store")
    kinds = {r["type"]: r["count"] for r in e.nodes.groupBy("type").count().collect()}
    assert kinds == {"fs:dir": 5, "fs:file": 5, "fs:link": 1, "md:document": 2, "md:section": 3, "md:codeblock": 1, "md:link": 1, "code:todo": 1, "project:root": 1, "project:license": 1}
    uri_of = {r.id: r.uri for r in e.nodes.collect()}
    edges = {(r.type, uri_of[r.from_id].removeprefix(f"file://{root}"), uri_of[r.to_id].removeprefix(f"file://{root}")) for r in e.edges.collect()}
    assert {(a, b) for t, a, b in edges if t == "links_to"} == {(f"file+md://{root}/README.md", "/docs/a.md"), (f"file+md://{root}/docs/a.md", "/README.md")}
    assert ("located_at", f"project+file://{root}", "") in edges and ("has", f"project+file://{root}", f"license+file://{root}/LICENSE") in edges
    assert ("contains", "/src/x_test.go", f"file+todo://{root}/src/x_test.go#L2") in edges and ("contains", "", "/link") in edges
    labels = {r.uri.removeprefix(f"file://{root}"): r.labels for r in e.nodes.where("type LIKE 'fs:%' AND size(labels) > 0").collect()}
    assert labels == {"": ["project:go"], "/go.mod": ["build:config", "lang:go"], "/LICENSE": ["docs:license"], "/README.md": ["docs:readme"], "/src/x_test.go": ["test:file"]}

    (root / "src/x_test.go").write_text("package x\n")
    (root / "docs/a.md").unlink()
    assert run("index", str(root))[0].startswith("4 files")
    e = Engine(spark, folder=f"file://{tmp_path}/store")
    assert e.nodes.where("type = 'code:todo' OR uri LIKE '%docs/a.md%'").isEmpty() and e.edges.where("type = 'links_to'").isEmpty()

    assert run("query", "SELECT COUNT(*) AS count FROM nodes WHERE type = 'fs:file'", "-o", "json") == ['[\n  {"count": 4}\n]']
    assert run("query", "SELECT * FROM nodes WHERE type = 'fs:file'", "-o", "count") == ["4"]
    assert sorted(run("query", "SELECT * FROM nodes WHERE type = 'fs:file'", "-o", "path")) == sorted(f"{root}/{x}" for x in ("go.mod", "LICENSE", "README.md", "src/x_test.go"))
    assert run("query", "SELECT name FROM nodes WHERE name = 'nothing'") == ["No results"]
    assert run("types", "-o", "text")[0].split() == ["fs:dir", "5"]
    assert "  src/" in run("tree", f"file://{root}")[0].split("\n")
    assert run("labels", "--prefix", "docs:", "-o", "text") == ["docs:license  1", "docs:readme   1"]
    assert any("parent" in x or "in contains" in x for x in run("show", f"file://{root}/README.md"))
    document = run("show", f"file+md://{root}/README.md")[-1]
    assert document.startswith("# Top\n\nSee [it]") and document.index("## Use") < document.index("```sh\nmake\n```")
    assert run("find", "--name", "*.md", "-o", "uri") == [f"file://{root}/README.md"]
    assert run("write-node", "x://1", "fs:file", "--name", "one") and run("neighbors", f"file://{root}", "--edge", "contains", "--limit", "2")[0].startswith("DIRECTION")
    assert run("path", f"file://{root}", f"file://{root}/go.mod", "--edge", "contains")[0].startswith("-[contains]->")
    assert len(run("gc", "--dry-run")) == 4 and run("info") and run("stats") and run("describe") and run("impact", "x")
    assert "nodes" in run("parse", "SELECT * FROM nodes")[0]
    assert main(["--store", f"file://{tmp_path}/store", "show", "nowhere"], spark, print) == 1 and "nowhere" in capsys.readouterr().err


def test_siblings_and_pages(spark):
    nodes = nodes_of(spark, [("d", "fs:dir", "u:d", "d"), *[(x, "fs:file", f"u:{x}", x) for x in "abc"], ("l", "fs:link", "u:l", "l")])
    edges = edges_of(spark, [*[("contains", "d", x) for x in "abc"], *[("contained_by", x, "d") for x in "abc"], ("links_to", "a", "l")])
    assert [r.name for r in graph.siblings(nodes, edges, "b").collect()] == ["a", "b", "c"]
    assert [r.name for r in graph.siblings(nodes, edges, "b", 1, 1).collect()] == ["b"] and graph.siblings(nodes, edges, "d").isEmpty()
    page = lambda **kw: [r.id for r in graph.navigation(nodes, edges, "d", **kw)[1].where("side = 'out'").orderBy("name").collect()]
    assert page(page=2) == ["a", "b"] and page(page=2, offset=2) == ["c"] and page(where=compare("name", ">", "a")) == ["b", "c"]
    assert {(r.group, r.id) for r in graph.navigation(nodes, edges, "a")[1].collect()} == {("parent", "d"), ("child", "l"), ("in", "d")}


def test_filters_of_a_navigator(spark):
    nodes = make_nodes(spark.createDataFrame([("1", "fs:file", "A.go", '{"ext":"go"}'), ("2", "fs:file", "b.md", '{"ext":"md"}'), ("3", "md:section", "c", None), ("4", "vcs:tag", "v1", None)], "id string, type string, name string, data string"))
    ids = lambda test: sorted(r.id for r in nodes.where(test).collect())
    assert ids(compare("name", "LIKE", "a%")) == ["1"] and ids(compare("name", "GLOB", "a*")) == [] and ids(compare("data.ext", "!=", "go")) == ["2"]
    assert ids(compare("name", "=", "")) == ["1", "2", "3", "4"] and ids(category("code", "git")) == ["1", "4"] and ids(category("docs")) == ["3"] and len(ids(category())) == 4
    with pytest.raises(ValueError):
        compare("name", "~", "x")


def test_symbols(spark):
    from trellium.sources.symbols import REFERENCE, RELATION, SYMBOL, symbol_graph

    at = lambda file, line, end: ("", "", file, line, 1, end)
    symbols = [
        ("/m", "m/p", "interface", None, "Store", *at("a.go", 1, 3)), ("/m", "m/p", "imethod", "Store", "Get", *at("a.go", 2, 2)), ("/m", "m/p", "imethod", "Store", "Put", *at("a.go", 3, 3)),
        ("/m", "m/q", "struct", None, "Memory", *at("b.go", 1, 2)), ("/m", "m/q", "field", "Memory", "Size", *at("b.go", 2, 2)),
        ("/m", "m/q", "method", "Memory", "Get", *at("b.go", 4, 6)), ("/m", "m/q", "method", "Memory", "Put", *at("b.go", 7, 9)),
        ("/m", "m/q", "struct", None, "Half", *at("b.go", 10, 10)), ("/m", "m/q", "method", "Half", "Get", *at("b.go", 11, 12)),
        ("/m", "m/q", "func", None, "Run", *at("c.go", 1, 9)), ("/m", "m/q", "func", None, "hidden", *at("c.go", 10, 12)),
    ]
    uses = [("/m", "m/q", "c.go", n, 2, "call", "Get", "m/q", "method", "Memory") for n in (3, 4)] + [("/m", "m/q", "c.go", 11, 2, "call", "Get", "m/q", "method", "Memory"), ("/m", "m/q", "c.go", 5, 1, "call", "Print", "fmt", "func", None)]
    relations = [("/m", "imports", "m/q", None, "m/p", None, None), ("/m", "embeds", "m/q", "Half", "m/q", "Memory", "struct")]
    nodes, edges = symbol_graph(spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(uses, REFERENCE), spark.createDataFrame(relations, RELATION), "g")
    short = {r.id: r.uri.removeprefix("go+file:///m") for r in nodes.collect()}
    kinds = {r["type"]: r["count"] for r in nodes.groupBy("type").count().collect()}
    assert kinds == {"go:module": 1, "go:package": 2, "go:interface": 1, "go:method": 5, "go:struct": 2, "go:field": 1, "go:func": 1, "go:ref": 4}
    got = {(r.type, short[r.from_id], short[r.to_id]) for r in edges.collect()}
    q = "/pkg/m/q"
    assert {x for x in got if x[0] == "implements"} == {("implements", f"{q}/struct/Memory", "/pkg/m/p/interface/Store")}
    assert {x for x in got if x[0] == "calls"} == {("calls", f"{q}/func/Run", f"{q}/method/Memory.Get")}
    assert len([x for x in got if x[0] == "references"]) == 3 and ("imports", q, "/pkg/m/p") in got and ("embeds", f"{q}/struct/Half", f"{q}/struct/Memory") in got
    assert {b for t, a, b in got if t == "has" and a == f"{q}/struct/Memory"} == {f"{q}/struct/Memory/field/Size", f"{q}/method/Memory.Get", f"{q}/method/Memory.Put"}


def test_git_numbers_and_texts_of_numbers():
    from trellium.functions.scalars import ago_text, count_text, duration_text, size_text
    from trellium.model import EdgeType, NodeType
    from trellium.sources.git import numstat

    assert numstat("\x1eabc\n\n3\t1\tx.py\n-\t-\ty.png\n\x1edef\n") == {"abc": (2, 3, 1), "def": (0, 0, 0)}
    assert [size_text(n) for n in (5, 1536, 1 << 20, 3 << 30)] == ["5 B", "1.5 KB", "1.0 MB", "3.0 GB"]
    assert [duration_text(s) for s in (0.5, 59.9, 60, 61, 3600, 3661)] == ["< 1s", "59s", "1m", "1m 1s", "1h", "1h 1m"]
    assert [ago_text(s) for s in (3, 60, 7200, 86400, 200000)] == ["just now", "1 minute ago", "2 hours ago", "1 day ago", "2 days ago"]
    assert count_text(1234567) == "1,234,567" and NodeType.fs_file == "fs:file" and EdgeType.contains == "contains" and "md:link" in set(NodeType)


def test_provider_over_http():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            body = json.dumps({"embeddings": [[float(len(t)), 1.0] for t in texts if t != "lost"]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = vector.HttpProvider(f"http://127.0.0.1:{server.server_port}", dimensions=2)
        assert provider.embed(["a", "bcd"]).tolist() == [[1.0, 1.0], [3.0, 1.0]]
        with pytest.raises(ValueError):
            provider.embed(["a", "lost"])
    finally:
        server.shutdown()


def test_token_counts_and_clean_paths(spark):
    from trellium.functions.scalars import token_count

    rows = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    assert [r.n for r in rows.select(token_count("t", str.split).alias("n")).collect()] == [3, 0, 0]
    paths = spark.createDataFrame([("/a/b/../c.md",), ("/a/./b//c",), ("/../x",)], "p string")
    assert [r.p for r in paths.select(tx.clean_path("p").alias("p")).collect()] == ["/a/c.md", "/a/b/c", "/x"]
