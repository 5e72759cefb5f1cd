"""Bundles written from the driver's tables, one a nation with a module for each segment of its customers, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.registry import query
from weftgraph.session import materialise, shared_dir
from weftgraph.sources import bundle


def _record(message: str, **given) -> Column:
    """A struct of a message's fields, in their order; what isn't given is null."""
    return F.struct(*(c.alias(f.name) for f in bundle.FIELDS[message].values() if (c := given.get(f.name)) is not None))


#: Keys of customers and orders whose records are encoded at once, within a module.
NODE_KEYS, EDGE_KEYS = 1 << 16, 1 << 16


def _entries(modules: DataFrame) -> DataFrame:
    return modules.withColumn("entry", F.concat(F.lit("design/modules/"), F.sha2("module", 256), F.lit(".pb")))


def _bundles(x) -> DataFrame:
    c, one = F.col("c_custkey"), [F.concat(F.lit("n"), "c_nationkey").alias("snapshot_id"), F.col("c_mktsegment").alias("module")]
    name = F.concat(F.lit("c"), c)
    entry = F.struct(F.lit("W").alias("key"), F.concat(F.lit('"'), c % 9, F.lit('"')).alias("json_value"))
    place = _record("SourceOrigin", file=F.lit("a.sv"), start_line=c, start_column=F.lit(1), end_line=c, end_column=F.when(c % 2 == 0, c % 7))
    node = _record("GraphNode", id=name, kind=c % 13, label=F.when(c % 3 == 0, F.concat(F.lit("ñ"), "c_name")).otherwise(F.lit("")), definition_name=F.when(c % 4 == 0, F.lit("leaf")), parameters=F.when(c % 5 != 0, F.array(entry)), ports=F.array(_record("GraphPort", id=F.lit("p"), name=F.lit("P"), direction=c % 4, width=F.when(c % 6 != 0, c * 1000))), origins=F.when(c % 8 == 0, F.array(place)))
    customers = x.raw("customer")
    edge = _record("GraphEdge", id=F.col("o_orderkey").cast("string"), source_node=F.concat(F.lit("c"), "o_custkey"), source_port=F.lit("p"), target_node=F.concat(F.lit("c"), "o_custkey"), label=F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), width=F.col("o_orderkey") % 3)
    # A list comes in parts of some keys, however many a module has: places 0 for the module itself, then nodes, then edges.
    def parts(rows: DataFrame, key: Column, field: str, record: Column, most: int, after: int) -> DataFrame:
        of = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), record.alias("v")))), lambda r: r["v"])
        part = rows.groupBy(*one, F.floor(key / most).cast("long").alias("part")).agg(of.alias("list"))
        return part.select("snapshot_id", "module", (F.col("part") + after).alias("place"), _record("GraphSlice", **{field: F.col("list")}).alias("record"))

    owners = customers.select("c_custkey", "c_nationkey", "c_mktsegment")
    nodes = materialise(bundle.encoded(_entries(parts(customers, c, "nodes", node, NODE_KEYS, 1)), "GraphSlice"), "bundle-nodes")
    edges = materialise(bundle.encoded(_entries(parts(x.raw("orders").join(owners.withColumn("o_custkey", c), "o_custkey"), F.col("o_orderkey"), "edges", edge, EDGE_KEYS, 1 << 61)), "GraphSlice"), "bundle-edges")
    counted = owners.groupBy(*one).agg(F.count("*").alias("nodes")).join(x.raw("orders").select("o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n")).join(owners, F.col("o_custkey") == c).groupBy(*one).agg(F.sum("n").alias("edges")), ["snapshot_id", "module"], "left")
    slices = materialise(_entries(counted.withColumn("place", F.lit(0).cast("long"))), "bundle-modules")
    own = slices.select("*", _record("GraphSlice", snapshot_id=F.col("snapshot_id"), module=_record("GraphModule", id=F.col("module"), name=F.col("module"))).alias("record"))
    summary = _record("ModuleSummary", id=F.col("module"), name=F.col("module"), node_count=F.col("nodes"), edge_count=F.coalesce("edges", F.lit(0)), entry=F.col("entry"))
    top = F.min("module")
    index = slices.groupBy("snapshot_id").agg(top.alias("top"), _record("DesignIndex", schema_major=F.lit(1), schema_minor=F.lit(1), snapshot_id=F.col("snapshot_id"), top=top, modules=F.array_sort(F.collect_list(summary))).alias("record"))
    index = index.withColumns({"entry": F.lit("design/index.pb"), "place": F.lit(0).cast("long")})
    empty = lambda entry: index.select("snapshot_id", F.lit(entry).alias("entry"), "place", F.lit(b"").cast("binary").alias("payload"))
    payloads = bundle.encoded(own, "GraphSlice").union(nodes).union(edges).union(bundle.encoded(index, "DesignIndex")).union(empty("sources/index.pb")).union(empty("diagnostics.pb"))
    folder = x.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(x.spark)}/bundles-{uuid.uuid4().hex}")
    uri = folder.getFileSystem(x.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toUri().toString()
    return bundle.write_bundles(payloads.join(F.broadcast(index.select("snapshot_id", "top")), "snapshot_id"), uri)  # a row a nation


def _read(x, table: str) -> DataFrame:
    x.spark.dataSource.register(bundle.BundleSource)
    paths = ",".join(sorted(r.path for r in _bundles(x).select("path").collect()))  # one a nation
    return x.spark.read.format("design_bundle").option("table", table).option("limits", "none").load(paths)


@query("""SELECT concat('n', c_nationkey) AS snapshot_id, c_mktsegment AS module_id, concat('c', c_custkey) AS node_id, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS ord,
 coalesce((['input', 'output', 'inout', 'operator', 'mux', 'register', 'latch', 'memory', 'module', 'constant', 'primitive'])[c_custkey % 13], 'unknown') AS kind,
 CASE WHEN c_custkey % 3 = 0 THEN concat('ñ', c_name) ELSE '' END AS label, CASE WHEN c_custkey % 4 = 0 THEN 'leaf' END AS definition_name, CASE WHEN c_custkey % 5 <> 0 THEN concat('{"W":"', c_custkey % 9, '"}') ELSE '{}' END AS parameters_json FROM customer""", view=False)
def bundle_nodes(x):
    return _read(x, "nodes").drop("glyph", "attributes_json")


@query("""SELECT concat('n', c_nationkey) AS snapshot_id, c_mktsegment AS module_id, CAST(o_orderkey AS VARCHAR) AS edge_id, concat('c', c_custkey) AS source_node, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS label, o_orderkey % 3 AS width FROM orders JOIN customer ON o_custkey = c_custkey""", view=False)
def bundle_edges(x):
    return _read(x, "edges").select("snapshot_id", "module_id", "edge_id", "source_node", "label", "width")


@query("""SELECT concat('n', c_nationkey) AS snapshot_id, c_mktsegment AS name, count(DISTINCT c_custkey) AS node_count, count(o_orderkey) AS edge_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""", view=False)
def bundle_modules(x):
    return _read(x, "modules").select("snapshot_id", "name", "node_count", "edge_count")
