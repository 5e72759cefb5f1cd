"""Consistency of snapshots: one table of rules, compiled into few passes.

Conditions of a table's rows are looked at in one pass, its unique keys in one shuffle, and all references to one kind of
target, from whatever tables, in one anti-join. Every violation is told, not the first one alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.schema import DIRECTIONS, LIMITS, NODE_KINDS, SEVERITIES

MODULE = ("snapshot_id", "module_id")
SNAPSHOT = ("snapshot_id",)
#: Columns that name a row of each table.
NAMES = {
    "modules": "module_id", "nodes": "node_id", "ports": "port_id", "edges": "edge_id", "groups": "group_id", "group_children": "child_node_id", "origins": "entity_id", "elab_ranges": "file",
    "files": "path", "sources": "path", "legacy_ranges": "path", "diagnostics": "ord", "manifest": "top",
}


@dataclass(frozen=True)
class Unique:
    rule: str
    table: str
    key: tuple[str, ...]
    scope: tuple[str, ...] = MODULE


@dataclass(frozen=True)
class Holds:
    rule: str
    table: str
    condition: Callable[[], Column]
    needs: tuple[str, ...]


@dataclass(frozen=True)
class Refers:
    """Columns of a table that must be the target's; rows with a null among them refer to nothing. ``given``: only where another
    reference (columns, target, its columns) holds, so that one fault isn't told twice."""

    rule: str
    table: str
    key: tuple[str, ...]
    target: str
    target_key: tuple[str, ...]
    scope: tuple[str, ...] = MODULE
    where: str = "true"
    given: tuple[tuple[str, ...], str, tuple[str, ...]] | None = None


def sound_place() -> Column:
    """Places count from 1, and the end is after the start."""
    c = F.col
    ahead = (c("end_line") > c("start_line")) | ((c("end_line") == c("start_line")) & (c("end_col") > c("start_col")))
    return (F.least("start_line", "start_col", "end_line", "end_col") > 0) & ahead


def _within(column: str, values: tuple[str, ...]) -> Callable[[], Column]:
    return lambda: F.col(column).isin(*values)


def _folder(column: str, most: int) -> Callable[[], Column]:
    return lambda: scalars.safe_path(F.col(column)) & (F.size(F.split(column, "/")) <= most)


PLACE = ("start_line", "start_col", "end_line", "end_col")
RULES = (
    Unique("duplicate module id", "modules", ("module_id",), SNAPSHOT),
    Unique("duplicate module name", "modules", ("name",), SNAPSHOT),
    Unique("duplicate module entry", "modules", ("entry",), SNAPSHOT),
    Holds("module entry path", "modules", lambda: scalars.safe_path(F.col("entry")) & F.col("entry").startswith("design/modules/") & F.col("entry").endswith(".pb"), ("entry",)),
    Refers("top without module", "manifest", ("top",), "modules", ("name",), SNAPSHOT),
    Unique("duplicate source id", "sources", ("file_id",), SNAPSHOT),
    Unique("duplicate source path", "sources", ("path",), SNAPSHOT),
    Holds("source path", "sources", _folder("path", LIMITS["hierarchy_depth"]), ("path",)),
    Holds("source size", "sources", lambda: F.octet_length("content") == F.col("size"), ("content", "size")),
    Holds("source digest", "sources", lambda: F.sha2("content", 256) == F.col("sha256"), ("content", "sha256")),
    Holds("legacy range file", "legacy_ranges", lambda: (F.coalesce("file", F.lit("")) == "") | (F.col("file") == F.col("path")), ("file", "path")),
    Holds("legacy range place", "legacy_ranges", sound_place, PLACE),
    Unique("duplicate node id", "nodes", ("node_id",)),
    Holds("node kind", "nodes", _within("kind", NODE_KINDS), ("kind",)),
    Holds("instance without definition", "nodes", lambda: (F.col("kind") != "module") | F.col("definition_name").isNotNull(), ("kind", "definition_name")),
    Refers("instance of a missing definition", "nodes", ("definition_name",), "definitions", ("name",), SNAPSHOT, where="kind = 'module'"),
    Unique("duplicate port id", "ports", ("node_id", "port_id")),
    Refers("port of a missing node", "ports", ("node_id",), "nodes", ("node_id",)),
    Holds("port direction", "ports", _within("direction", DIRECTIONS), ("direction",)),
    Holds("port width", "ports", lambda: F.coalesce("width", F.lit(0)) >= 0, ("width",)),
    Unique("duplicate edge id", "edges", ("edge_id",)),
    Holds("edge width", "edges", lambda: F.coalesce("width", F.lit(0)) >= 0, ("width",)),
    Refers("edge from a missing node", "edges", ("source_node",), "nodes", ("node_id",)),
    Refers("edge to a missing node", "edges", ("target_node",), "nodes", ("node_id",)),
    Refers("edge from a missing port", "edges", ("source_node", "source_port"), "ports", ("node_id", "port_id"), given=(("source_node",), "nodes", ("node_id",))),
    Refers("edge to a missing port", "edges", ("target_node", "target_port"), "ports", ("node_id", "port_id"), given=(("target_node",), "nodes", ("node_id",))),
    Unique("duplicate group id", "groups", ("group_id",)),
    Unique("duplicate group child", "group_children", ("group_id", "child_node_id")),
    Refers("group with a missing child", "group_children", ("child_node_id",), "nodes", ("node_id",)),
    Refers("child of a missing group", "group_children", ("group_id",), "groups", ("group_id",)),
    Unique("duplicate file id", "files", ("file_id",)),
    Unique("duplicate file path", "files", ("path",)),
    Refers("file that is no source", "files", ("file_id", "path"), "sources", ("file_id", "path"), SNAPSHOT),
    Refers("origin in an unlisted file", "origins", ("file",), "files", ("path",)),
    Refers("range in an unlisted file", "elab_ranges", ("file",), "files", ("path",)),
    Holds("range place", "elab_ranges", sound_place, PLACE),
    Holds("diagnostic severity", "diagnostics", _within("severity", SEVERITIES), ("severity",)),
)
#: Tables whose rows in one module count together, and the column of modules that tells their number, if it is there.
BUDGETS = (("nodes", ("nodes",), "node_count"), ("edges", ("edges",), "edge_count"), ("ports", ("ports",), None), ("origins", ("origins", "elab_ranges"), None), ("objects", ("nodes", "edges", "groups"), None))


def _named(df: DataFrame, table: str) -> list[Column]:
    module = F.col("module_id") if "module_id" in df.columns else F.lit(None)
    return [F.col("snapshot_id"), module.cast("string").alias("module_id"), F.col(NAMES[table]).cast("string").alias("entity")]


def _key(columns: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"})


def violations(tables: dict[str, DataFrame], rules: tuple = RULES, limits: dict[str, int] = LIMITS) -> DataFrame:
    """rule, snapshot_id, module_id, entity of every violation in the tables of a snapshot. Besides those of the schema:
    manifest (snapshot_id, top), files (what a module lists of the sources) and legacy_ranges (of a source's path); modules
    may tell their entry, node_count and edge_count. Rules about tables or columns that aren't there are left out, and budgets
    that ``limits`` doesn't name."""
    if "modules" in tables:
        m = tables["modules"]
        own = m.select("snapshot_id", "name")
        tables = tables | {"definitions": (own.union(m.select("snapshot_id", "definition_name")) if "definition_name" in m.columns else own).where("name is not null")}
    there = lambda table, columns: table in tables and set(columns) <= set(tables[table].columns)
    out = []

    for table in tables:
        own = [r for r in rules if isinstance(r, Holds) and r.table == table and there(table, r.needs)]
        if own:
            failed = F.filter(F.array(*(F.when(~F.coalesce(r.condition(), F.lit(False)), r.rule) for r in own)), lambda x: x.isNotNull())
            out.append(tables[table].select(*_named(tables[table], table), F.explode(failed).alias("rule")))
        own = [r for r in rules if isinstance(r, Unique) and r.table == table and there(table, r.key)]
        if own:
            # a key's scope is part of the key, so keys of all rules share one shuffle
            keys = F.array(*(F.struct(F.lit(r.rule).alias("rule"), _key((*r.scope, *r.key)).alias("key")) for r in own))
            rows = tables[table].select(*_named(tables[table], table), F.explode(keys).alias("k"))
            twice = rows.groupBy("k.rule", "k.key").agg(F.count("*").alias("n"), F.min(F.struct("snapshot_id", "module_id", "entity")).alias("x")).where("n > 1")
            out.append(twice.select("x.*", "rule"))

    known: dict[tuple, DataFrame] = {}

    def targets(target: str, key: tuple[str, ...], scope: tuple[str, ...]) -> DataFrame:
        if (target, key, scope) not in known:
            known[target, key, scope] = tables[target].select(_key((*scope, *key)).alias("key")).distinct()
        return known[target, key, scope]

    asked: dict[tuple, DataFrame] = {}
    for r in (r for r in rules if isinstance(r, Refers)):
        if not (there(r.table, r.key) and there(r.target, r.target_key)):
            continue
        full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in r.key))
        rows = tables[r.table].where(F.expr(r.where)).where(full)
        if r.given:
            columns, target, target_key = r.given
            rows = rows.withColumn("_given", _key((*r.scope, *columns))).join(targets(target, target_key, r.scope).withColumnRenamed("key", "_given"), "_given", "left_semi")
        rows = rows.select(*_named(tables[r.table], r.table), F.lit(r.rule).alias("rule"), _key((*r.scope, *r.key)).alias("key"))
        to = (r.target, r.target_key, r.scope)
        asked[to] = rows if to not in asked else asked[to].unionByName(rows)
    out += [rows.join(targets(*to), "key", "left_anti").drop("key") for to, rows in asked.items()]

    for name, members, told in BUDGETS:
        parts = [tables[m].select(*MODULE) for m in members if there(m, MODULE)]
        if not parts:
            continue
        sizes = reduce(DataFrame.union, parts).groupBy(*MODULE).agg(F.count("*").alias("n"))
        if name in limits:
            out.append(sizes.where(F.col("n") > limits[name]).select(*MODULE, F.col("module_id").alias("entity"), F.lit(f"too many {name}").alias("rule")))
        if told and there("modules", (told,)):
            wrong = tables["modules"].select(*MODULE, told).join(sizes, list(MODULE), "left").where(F.coalesce("n", F.lit(0)) != F.coalesce(told, F.lit(-1)))
            out.append(wrong.select(*MODULE, F.col("module_id").alias("entity"), F.lit(f"number of {name}").alias("rule")))
    return reduce(DataFrame.unionByName, out).select("rule", "snapshot_id", "module_id", "entity")
