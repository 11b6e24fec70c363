"""Go symbols as a graph. They come as a table that a Go type checker wrote; Spark has none of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import short_id
from ..model import both_ways, make_edges, make_nodes
from ..operators.graph import calls, enclosing, implementations

#: A symbol: its module's folder, package, kind (of go:kind), owner (a struct, interface or receiver, else null), name and place.
SYMBOL = (
    "module STRING, package STRING, kind STRING, owner STRING, name STRING, signature STRING, doc STRING, file STRING, "
    "line INT, column INT, end_line INT"
)
#: A use of a symbol: where it is, how (call, type, field or value), and what it means.
REFERENCE = "module STRING, package STRING, file STRING, line INT, column INT, kind STRING, name STRING, target_package STRING, target_kind STRING, target_owner STRING"
#: One package importing, testing or being tested for another, or a type that embeds another.
RELATION = "module STRING, kind STRING, package STRING, name STRING, target_package STRING, target_name STRING, target_kind STRING"


def package_uri(module: Column, package: Column) -> Column:
    return F.concat(F.lit("go+file://"), module, F.lit("/pkg/"), package)


def symbol_uri(module: Column, package: Column, kind: Column, owner: Column, name: Column) -> Column:
    """Methods are named by receiver, fields and interface methods below their owner, all else below its package."""
    inner = F.when(kind == "field", F.concat(F.lit("/struct/"), owner, F.lit("/field/"), name))
    inner = inner.when((kind == "imethod"), F.concat(F.lit("/interface/"), owner, F.lit("/method/"), name))
    inner = inner.when((kind == "method") & owner.isNotNull(), F.concat(F.lit("/method/"), owner, F.lit("."), name))
    return F.concat(package_uri(module, package), inner.otherwise(F.concat(F.lit("/"), kind, F.lit("/"), name)))


def symbol_graph(symbols: DataFrame, references: DataFrame, relations: DataFrame, generation: str, exported_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of SYMBOL, REFERENCE and RELATION rows.

    A kind imethod is a method of an interface. Modules contain packages, packages define symbols, structs and
    interfaces have fields and methods, methods of a struct hang on it. A struct implements each interface of any
    package, one of whose methods it has, that it has all methods of. A reference is a go:ref in its package and
    references its target; calls inside a function are one calls edge for each caller and target.
    """
    symbols = symbols.where(F.col("name").rlike(r"^\p{Lu}")) if exported_only else symbols
    c = F.col
    uri = symbol_uri(c("module"), c("package"), c("kind"), c("owner"), c("name"))
    place = F.struct("file", "line", "column", "end_line")
    exported = c("name").rlike(r"^\p{Lu}").alias("exported")
    rows = symbols.withColumns({"uri": uri, "_package": package_uri(c("module"), c("package")), "_module": F.concat(F.lit("go+file://"), "module")})
    data = F.to_variant_object(F.struct("name", "doc", "signature", c("owner").alias("receiver"), exported, place.alias("position")))
    kind = F.concat(F.lit("go:"), F.when(c("kind") == "imethod", "method").otherwise(c("kind")))
    own = rows.select(kind.alias("type"), "uri", "name", data.alias("data")).dropDuplicates(["uri"])
    where = rows.select("module", "package", "_module", "_package").unionByName(
        references.select("module", "package", F.concat(F.lit("go+file://"), "module").alias("_module"), package_uri(c("module"), c("package")).alias("_package"))
    ).distinct()
    packages = where.select(F.lit("go:package").alias("type"), c("_package").alias("uri"), F.element_at(F.split("package", "/"), -1).alias("name"), F.to_variant_object(F.struct(c("package").alias("import_path"))).alias("data"))
    modules = where.select("module", c("_module").alias("uri")).distinct().select(F.lit("go:module").alias("type"), "uri", F.element_at(F.split("module", "/"), -1).alias("name"), F.to_variant_object(F.struct("module")).alias("data"))
    used = references.withColumns({"_package": package_uri(c("module"), c("package")), "_target": symbol_uri(c("module"), c("target_package"), c("target_kind"), c("target_owner"), c("name"))})
    at = F.concat(F.lit("#ref:"), "file", F.lit(":"), c("line").cast("string"), F.lit(":"), F.coalesce("column", F.lit(0)).cast("string"))
    used = used.withColumn("uri", F.concat("_package", at))
    spot = F.struct("file", "line", "column")
    told = F.to_variant_object(F.struct("kind", "name", F.concat(F.lit("go:"), "target_kind").alias("target_type"), c("target_package").alias("target_pkg"), spot.alias("position")))
    refs = used.select(F.lit("go:ref").alias("type"), "uri", "name", told.alias("data")).dropDuplicates(["uri"])
    nodes = make_nodes(own.unionByName(packages).unionByName(modules).unionByName(refs).withColumn("generation", F.lit(generation)))

    pair = lambda df, kind, source, target: df.select(F.lit(kind).alias("type"), short_id(source).alias("from_id"), short_id(target).alias("to_id")).distinct()
    struct_of = F.concat("_package", F.when(c("kind") == "imethod", "/interface/").otherwise("/struct/"), "owner")
    inner = rows.where("owner IS NOT NULL AND kind IN ('field', 'method', 'imethod')")
    contains = both_ways(make_edges(pair(where, "contains", "_module", "_package")), "contained_by")
    defines = make_edges(pair(rows.where("kind NOT IN ('field', 'imethod')"), "defines", "_package", "uri"))
    has = both_ways(make_edges(pair(inner, "has", struct_of, "uri")), "belongs_to")
    known = nodes.select("uri")
    refer = make_edges(pair(used.join(known.select(c("uri").alias("_target")), "_target", "left_semi"), "references", "uri", "_target"))

    methods = rows.where("kind = 'method' AND owner IS NOT NULL").select(struct_of.alias("struct"), c("name").alias("method"))
    faces = rows.where("kind = 'imethod'").select(struct_of.alias("interface"), c("name").alias("method"))
    implements = make_edges(pair(implementations(methods, faces), "implements", "struct", "interface"))

    functions = rows.where("kind IN ('func', 'method') AND end_line IS NOT NULL")
    extents = functions.select("file", c("line").alias("start"), (c("end_line") + 1).alias("stop"), c("uri").alias("owner"))
    called = used.where("kind = 'call'").select("file", c("line").alias("pos"), "_target")
    inside = enclosing(extents, called.select("file", "pos").distinct()).where("owner IS NOT NULL")
    made = called.join(inside, ["file", "pos"]).join(known.select(c("uri").alias("_target")), "_target", "left_semi")
    called_edges = calls(made.select(short_id("owner").alias("caller"), short_id("_target").alias("callee")))

    source, target = package_uri(c("module"), c("package")), package_uri(c("module"), c("target_package"))
    between = [make_edges(pair(relations.where(c("kind") == k), k, source, target)) for k in ("imports", "tests")]
    embedding = relations.where("kind = 'embeds'")
    of = lambda p, n: F.concat(p, F.lit("/"), F.coalesce("target_kind", F.lit("struct")), F.lit("/"), n)
    between.append(make_edges(pair(embedding, "embeds", of(source, c("name")), of(target, c("target_name")))))
    edges = contains
    for more in (defines, has, refer, implements, called_edges, *between):
        edges = edges.unionByName(more)
    return nodes, edges.withColumn("generation", F.lit(generation))


class SymbolSource:
    """Reads symbols.parquet, references.parquet and relations.parquet of a folder that an extractor wrote."""

    name, schemes = "golang", ("go+file://",)

    def __init__(self, exported_only: bool = True):
        self.exported_only = exported_only

    def read(self, spark, uri: str, generation: str) -> tuple[DataFrame, DataFrame]:
        folder = uri.removeprefix("go+file://").rstrip("/")
        tables = [spark.read.schema(s).parquet(f"{folder}/{t}.parquet") for t, s in (("symbols", SYMBOL), ("references", REFERENCE), ("relations", RELATION))]
        return symbol_graph(*tables, generation, self.exported_only)
