"""A property graph over the star-schema tables of a folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE, NODE, conform, empty


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def _data(**fields):
    return F.to_variant_object(F.struct(*[c.alias(n) for n, c in fields.items()]))


def table_graph(spark: SparkSession, folder: str, parts: tuple[str, ...] = ("geo", "org", "item", "doc", "event")) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of the tables in a folder; parts chooses which, so that a query reads no more than it needs.

    geo: regions, nations. org: customers, suppliers. item: parts. doc: orders. event: events, users.
    Ids are readable, such as nation:3; contains and has edges come with their reverses.
    """
    t = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    nodes, edges = [], []

    def node(df, prefix, key, kind, name=None, labels=None, data=None, created=None):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        row = [_key(prefix, key).alias("id"), kind.alias("type"), F.concat(F.lit(f"tbl://{prefix}/"), F.col(key).cast("string")).alias("uri"), F.col(key).cast("string").alias("key")]
        row += [(F.col(name) if name else F.lit(None).cast("string")).alias("name"), (labels if labels is not None else F.array().cast("array<string>")).alias("labels")]
        row += [(data if data is not None else F.lit(None).cast("variant")).alias("data")]
        nodes.append(conform(df.select(*row), NODE))

    def edge(df, kind, source, target, back=None, data=None):
        row = df.select(source.alias("from_id"), target.alias("to_id"), (data if data is not None else F.lit(None).cast("variant")).alias("data"))
        for k, a, b in ((kind, "from_id", "to_id"), (back, "to_id", "from_id")):
            if k:
                named = row.select(F.concat_ws("|", F.lit(k), a, b).alias("id"), F.lit(k).alias("type"), F.col(a).alias("from_id"), F.col(b).alias("to_id"), "data")
                edges.append(conform(named, EDGE))

    if "geo" in parts:
        node(t("region"), "region", "r_regionkey", "geo:region", "r_name")
        node(t("nation"), "nation", "n_nationkey", "geo:nation", "n_name")
        edge(t("nation"), "contains", _key("region", "n_regionkey"), _key("nation", "n_nationkey"), "contained_by")
    if "org" in parts:
        node(t("supplier"), "supplier", "s_suppkey", "org:supplier", "s_name", data=_data(acctbal=F.col("s_acctbal")))
        segment = F.array(F.concat(F.lit("seg:"), F.col("c_mktsegment")))
        node(t("customer"), "customer", "c_custkey", "org:customer", "c_name", segment, _data(segment=F.col("c_mktsegment"), acctbal=F.col("c_acctbal")))
        edge(t("supplier"), "has", _key("nation", "s_nationkey"), _key("supplier", "s_suppkey"), "belongs_to")
        edge(t("customer"), "has", _key("nation", "c_nationkey"), _key("customer", "c_custkey"), "belongs_to")
    if "item" in parts:
        node(t("part"), "part", "p_partkey", "item:part", "p_name", F.array(F.concat(F.lit("brand:"), F.col("p_brand"))), _data(type=F.col("p_type"), size=F.col("p_size"), price=F.col("p_retailprice")))
    if "doc" in parts:
        marks = F.array(F.concat(F.lit("status:"), F.col("o_orderstatus")), F.concat(F.lit("prio:"), F.col("o_orderpriority")))
        node(t("orders"), "order", "o_orderkey", "doc:order", labels=marks, data=_data(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"), total=F.col("o_totalprice")))
        edge(t("orders"), "has", _key("customer", "o_custkey"), _key("order", "o_orderkey"), "belongs_to")
        if "item" in parts:
            lines = t("lineitem").select("l_orderkey", "l_partkey").distinct()
            edge(lines, "references", _key("order", "l_orderkey"), _key("part", "l_partkey"))
            edge(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "supplies", _key("supplier", "l_suppkey"), _key("part", "l_partkey"))
    if "event" in parts:
        props = F.try_parse_json("props")
        data = F.to_variant_object(F.struct(F.col("value"), F.try_variant_get(props, "$.k", "bigint").alias("k")))
        node(t("events"), "event", "event_id", F.concat(F.lit("evt:"), F.col("event_type")), data=data)
        node(t("events").select("user_id").distinct(), "user", "user_id", "org:user")
        edge(t("events"), "has", _key("user", "user_id"), _key("event", "event_id"), "belongs_to")
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges) if edges else empty(spark, EDGE)


def embeddings_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet").select(_key("vec", "vec_id").alias("node_id"), "embedding")
