"""Structural netlist JSON as tables, and its import as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import connect, graph

# The netlist format.
_NET = "struct<hide_name:variant,bits:array<variant>,attributes:map<string,variant>>"
_CELL = "struct<hide_name:variant,type:string,parameters:map<string,variant>,attributes:map<string,variant>,port_directions:map<string,string>,connections:map<string,array<variant>>>"
_PORT = "struct<direction:string,bits:array<variant>>"
NETLIST = f"modules map<string, struct<attributes:map<string,variant>,parameter_default_values:map<string,variant>,ports:map<string,{_PORT}>,cells:map<string,{_CELL}>,netnames:map<string,{_NET}>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, module, m: one row per module of every netlist file; a file without modules is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", NETLIST).alias("v"))
    none = F.raise_error(F.concat(F.lit("no modules in "), "file"))
    checked = whole.withColumn("modules", F.when(F.coalesce(F.cardinality("v.modules"), F.lit(0)) == 0, none.cast(whole.select("v.modules").schema[0].dataType)).otherwise(F.col("v.modules")))
    return checked.select("file", F.explode("modules").alias("module", "m"))


def _bit(v):
    """A wire number only where the JSON token is a number, so that wire 1 and constant "1" stay apart."""
    number = F.schema_of_variant(v) == "BIGINT"
    return F.struct(F.when(number, F.try_variant_get(v, "$", "bigint")).alias("wire"), F.when(~number, F.try_variant_get(v, "$", "string")).alias("constant"))


def ports(modules: DataFrame) -> DataFrame:
    """file, module, port, direction, pos, wire, constant of the modules' own ports."""
    p = modules.select("file", "module", F.explode("m.ports").alias("port", "p"))
    return p.select("file", "module", "port", F.lower("p.direction").alias("direction"), F.posexplode("p.bits").alias("pos", "v")).select("file", "module", "port", "direction", "pos", _bit(F.col("v")).alias("b")).select("*", "b.*").drop("b")


def cells(modules: DataFrame) -> DataFrame:
    """file, module, cell, type, hidden, src, c."""
    c = modules.select("file", "module", F.explode("m.cells").alias("cell", "c"))
    return c.select("file", "module", "cell", F.col("c.type").alias("type"), F.coalesce(F.try_variant_get(F.col("c.hide_name"), "$", "int") == 1, F.lit(False)).alias("hidden"), F.try_variant_get(F.try_element_at("c.attributes", F.lit("src")), "$", "string").alias("src"), "c")


def pins(cell_rows: DataFrame) -> DataFrame:
    """file, module, cell, type, port, direction, pos, wire, constant of the cells' connections."""
    k = cell_rows.select("file", "module", "cell", "type", "c.port_directions", F.explode("c.connections").alias("port", "bits"))
    k = k.select("file", "module", "cell", "type", "port", F.lower(F.try_element_at("port_directions", F.col("port"))).alias("direction"), F.posexplode("bits").alias("pos", "v"))
    return k.select("file", "module", "cell", "type", "port", "direction", "pos", _bit(F.col("v")).alias("b")).select("*", "b.*").drop("b")


def net_names(modules: DataFrame) -> DataFrame:
    """file, module, name, hidden, wire of every named bit."""
    n = modules.select("file", "module", F.explode("m.netnames").alias("name", "n"))
    n = n.select("file", "module", scalars.display_name(F.col("name")).alias("name"), F.coalesce(F.try_variant_get(F.col("n.hide_name"), "$", "int") == 1, F.lit(False)).alias("hidden"), F.explode("n.bits").alias("v"))
    return n.select("file", "module", "name", "hidden", _bit(F.col("v"))["wire"].alias("wire")).where("wire is not null")


def buffer_aliases(cell_pins: DataFrame, cell_rows: DataFrame) -> DataFrame:
    """module, wire, canonical: wires that hidden, source-less buffers join; the least wire stands for all."""
    bufs = cell_rows.where((F.col("type") == "$buf") & F.col("hidden") & F.col("src").isNull()).select("file", "module", "cell")
    own = cell_pins.join(bufs, ["file", "module", "cell"], "left_semi").where("wire is not null")
    a, y = (own.where(F.col("port") == p).select("file", "module", "cell", "pos", F.col("wire").alias(n)) for p, n in (("A", "a"), ("Y", "y")))
    scoped = lambda c: F.concat("file", F.lit("\u0001"), "module", F.lit("\u0001"), F.lpad(F.col(c).cast("string"), 20, "0"))
    links = a.join(y, ["file", "module", "cell", "pos"]).select(scoped("a").alias("source_node"), scoped("y").alias("target_node"))
    nodes = links.select(F.col("source_node").alias("id")).union(links.select("target_node")).distinct()
    wire = lambda c: F.element_at(F.split(c, "\u0001"), -1).cast("long")
    part = lambda c, k: F.element_at(F.split(c, "\u0001"), k)
    return graph.components(links, nodes).select(part("id", 1).alias("file"), part("id", 2).alias("module"), wire("id").alias("wire"), wire("component").alias("canonical"))


def import_graph(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (module, node_id, kind, label, glyph, definition_name) and bundled edges of every module.

    Aliases are contracted, runs of constants at an input become one constant node each, the budget of driver and sink
    pairs is checked before they are joined.
    """
    c = cells(modules)
    p, k = ports(modules), pins(c)
    alias = buffer_aliases(k, c)
    bufs = c.where((F.col("type") == "$buf") & F.col("hidden") & F.col("src").isNull()).select("file", "module", "cell")
    k = k.join(bufs, ["file", "module", "cell"], "left_anti")
    canon = lambda df: df.join(alias, ["file", "module", "wire"], "left").withColumn("wire", F.coalesce("canonical", "wire")).drop("canonical")
    scope = F.struct("file", "module").alias("module")
    boundary = F.concat(F.lit("port:"), "port")
    own = canon(p).select(scope, "wire", boundary.alias("node"), "port", (F.col("direction") != "output").alias("drives"))
    cell = canon(k.where("wire is not null")).select(scope, "wire", F.concat(F.lit("cell:"), "cell").alias("node"), "port", (F.col("direction") == "output").alias("drives"))
    ends = own.union(cell)
    runs = connect.constant_runs(k.where("direction = 'input'").select(F.struct("file", "module", F.col("cell").alias("c")).alias("cell"), "port", "pos", "constant"))
    consts = runs.select(F.struct(F.col("cell.file").alias("file"), F.col("cell.module").alias("module")).alias("module"), F.concat(F.lit("cell:"), "cell.c").alias("target_node"), F.col("port").alias("target_port"), F.concat(F.lit("const:"), "cell.c", F.lit("."), "port", F.lit("."), F.col("first").cast("string")).alias("node_id"), scalars.constant_label(F.col("digits")).alias("label"), F.size("digits").cast("long").alias("width"))
    drivers, sinks = ends.where("drives").drop("drives"), ends.where("not drives").drop("drives")
    key = lambda df: df.withColumn("module", F.to_json("module"))
    bits = connect.connected_bits(connect.within_budget(key(drivers), key(sinks)), key(sinks))
    preferred = p.where("direction = 'output'").select("file", "module", "wire", F.lit(True).alias("out")).distinct()
    named = net_names(modules).join(preferred, ["file", "module", "wire"], "left").select(F.to_json(F.struct("file", "module")).alias("module"), "wire", "name", "hidden", F.coalesce("out", F.lit(False)).alias("preferred"))
    labels = connect.net_labels(named.withColumn("wire", F.struct("module", "wire"))).select(F.col("wire.module").alias("module"), F.col("wire.wire").alias("wire"), F.col("name").alias("label"))
    edges = connect.bundle(bits.join(labels, ["module", "wire"], "left").withColumn("origin", F.col("wire"))).drop("origins")
    edges = edges.unionByName(consts.select(F.to_json("module").alias("module"), F.col("node_id").alias("source_node"), F.lit("Y").alias("source_port"), "target_node", "target_port", "label", "width"))
    t = F.col("type")
    nodes = c.join(bufs, ["file", "module", "cell"], "left_anti").select(F.to_json(F.struct("file", "module")).alias("module"), F.concat(F.lit("cell:"), "cell").alias("node_id"), scalars.cell_kind(t).alias("kind"), scalars.cell_label(F.col("cell"), t).alias("label"), scalars.cell_glyph(t).alias("glyph"), scalars.cell_definition(t).alias("definition_name"))
    none = F.lit(None).cast("string")
    nodes = nodes.union(p.select(F.to_json(F.struct("file", "module")), boundary, "direction", "port", none, none).distinct())
    return nodes.union(consts.select(F.to_json("module"), "node_id", F.lit("constant"), "label", none, none)), edges


def top_modules(modules: DataFrame) -> DataFrame:
    """file, name of the tops: a true ``top`` attribute, else modules that no cell instantiates, else all."""
    flagged = modules.select("file", F.col("module").alias("name"), F.to_json(F.try_element_at("m.attributes", F.lit("top"))).alias("top")).withColumn("is_top", scalars.is_true(F.col("top")))
    used = cells(modules).select("file", F.col("type").alias("name")).distinct().withColumn("used", F.lit(True))
    ranked = flagged.join(used, ["file", "name"], "left").withColumn("rank", F.when(F.col("is_top"), 0).when(F.col("used").isNull(), 1).otherwise(2))
    return ranked.withColumn("least", F.min("rank").over(Window.partitionBy("file"))).where("rank = least").select("file", "name")
