import hashlib

import pytest

from weftgraph import schema
from weftgraph.operators import validation

SCHEMAS = {k: v for k, v in schema.TABLES.items()} | {
    "modules": schema.TABLES["modules"] + ", entry string, node_count long, edge_count long", "manifest": "snapshot_id string, top string",
    "files": "snapshot_id string, module_id string, file_id string, path string", "legacy_ranges": "snapshot_id string, path string, file string, start_line long, start_col long, end_line long, end_col long",
}


def sound():
    """Rows by table, as dicts; two snapshots that share all ids."""
    rows = {k: [] for k in SCHEMAS}
    for s in ("s1", "s2"):
        place = dict(start_line=1, start_col=1, end_line=1, end_col=2)
        rows["manifest"].append(dict(snapshot_id=s, top="top"))
        for f, text in (("f1", "module top;"), ("f2", "é")):
            rows["sources"].append(dict(snapshot_id=s, file_id=f, path=f"rtl/{f}.sv", size=len(text.encode()), sha256=hashlib.sha256(text.encode()).hexdigest(), content=text))
        rows["legacy_ranges"] += [dict(snapshot_id=s, path="rtl/f1.sv", file="", **place), dict(snapshot_id=s, path="rtl/f1.sv", file="rtl/f1.sv", **place)]
        rows["diagnostics"].append(dict(snapshot_id=s, ord=0, severity="info", message="m"))
        for m in ("m1", "m2"):
            key = dict(snapshot_id=s, module_id=m)
            rows["modules"].append(key | dict(name="top" if m == "m1" else "leaf$1", definition_name="top" if m == "m1" else "leaf", entry=f"design/modules/{m}.pb", node_count=2, edge_count=1))
            rows["nodes"] += [key | dict(node_id="a", kind="module", definition_name="leaf"), key | dict(node_id="b", kind="register")]
            rows["ports"] += [key | dict(node_id=n, port_id="p", direction="input", width=1) for n in "ab"]
            rows["edges"].append(key | dict(edge_id="e", source_node="a", source_port="p", target_node="b", target_port=None, width=1))
            rows["groups"].append(key | dict(group_id="g"))
            rows["group_children"].append(key | dict(group_id="g", child_node_id="b"))
            rows["files"].append(key | dict(file_id="f1", path="rtl/f1.sv"))
            rows["origins"].append(key | dict(entity_type="node", entity_id="a", file="rtl/f1.sv", **place))
            rows["elab_ranges"].append(key | dict(file="rtl/f1.sv", active=True, **place))
    return rows


def found(spark, rows, **limits):
    tables = {}
    for k, ddl in SCHEMAS.items():
        names = [c.split()[0] for c in ddl.split(", ")]
        tables[k] = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows[k]], ddl)
    return sorted(tuple(r) for r in validation.violations(tables, limits=schema.LIMITS | limits).collect())


def first(rows, table, **change):
    rows[table][0] |= change


def again(rows, table, **change):
    rows[table].append(rows[table][0] | change)


FAULTS = {
    "duplicate module id": lambda r: again(r, "modules", name="n", entry="design/modules/n.pb"), "duplicate module name": lambda r: again(r, "modules", module_id="n", entry="design/modules/n.pb", node_count=0, edge_count=0),
    "duplicate module entry": lambda r: again(r, "modules", module_id="n", name="n", node_count=0, edge_count=0), "module entry path": lambda r: first(r, "modules", entry="design/modules/../m.pb"), "top without module": lambda r: first(r, "manifest", top="none"),
    "duplicate source id": lambda r: again(r, "sources", path="rtl/x.sv"), "duplicate source path": lambda r: again(r, "sources", file_id="x"), "source path": lambda r: first(r, "sources", path="/rtl/f1.sv") or again(r, "sources", path="rtl/f1.sv", file_id="f1") or r["sources"][0].update(file_id="x"),
    "source size": lambda r: r["sources"][1].update(size=1), "source digest": lambda r: first(r, "sources", sha256="0"), "legacy range file": lambda r: first(r, "legacy_ranges", file="rtl/f2.sv"), "legacy range place": lambda r: first(r, "legacy_ranges", end_col=1),
    "duplicate node id": lambda r: again(r, "nodes") or r["modules"][0].update(node_count=3), "node kind": lambda r: r["nodes"][1].update(kind="gate"), "instance without definition": lambda r: first(r, "nodes", definition_name=None), "instance of a missing definition": lambda r: first(r, "nodes", definition_name="lost"),
    "duplicate port id": lambda r: again(r, "ports"), "port of a missing node": lambda r: again(r, "ports", node_id="z"), "port direction": lambda r: first(r, "ports", direction="up"), "port width": lambda r: first(r, "ports", width=-1),
    "duplicate edge id": lambda r: again(r, "edges") or r["modules"][0].update(edge_count=2), "edge width": lambda r: first(r, "edges", width=-2), "edge from a missing node": lambda r: first(r, "edges", source_node="z"), "edge to a missing node": lambda r: first(r, "edges", target_node="z"),
    "edge from a missing port": lambda r: first(r, "edges", source_port="z"), "edge to a missing port": lambda r: first(r, "edges", target_port="z"), "duplicate group id": lambda r: again(r, "groups"), "duplicate group child": lambda r: again(r, "group_children"),
    "group with a missing child": lambda r: again(r, "group_children", child_node_id="z"), "child of a missing group": lambda r: again(r, "group_children", group_id="z"), "duplicate file id": lambda r: again(r, "files", path="rtl/f2.sv") or r["files"].pop() and r["files"].append(r["files"][0] | dict(path="rtl/f2.sv")) or None,
    "duplicate file path": lambda r: again(r, "files", file_id="f2"), "file that is no source": lambda r: again(r, "files", file_id="f9", path="rtl/f9.sv"), "origin in an unlisted file": lambda r: first(r, "origins", file="rtl/f2.sv"), "range in an unlisted file": lambda r: first(r, "elab_ranges", file="rtl/f2.sv"),
    "range place": lambda r: first(r, "elab_ranges", start_line=0), "diagnostic severity": lambda r: first(r, "diagnostics", severity="hint"), "number of nodes": lambda r: first(r, "modules", node_count=3), "number of edges": lambda r: first(r, "modules", edge_count=None),
}
#: what else such a fault breaks
ALSO = {"duplicate file id": {"file that is no source"}, "duplicate file path": {"file that is no source"}}


def test_a_sound_snapshot_has_no_violations_and_budgets_count(spark):
    rows = sound()
    assert found(spark, rows) == []
    over = found(spark, rows, nodes=1, origins=1, objects=3)
    assert {x[0] for x in over} == {"too many nodes", "too many origins", "too many objects"} and len(over) == 12


def test_each_rule_tells_its_fault_and_no_other(spark):
    assert {r.rule for r in validation.RULES} <= set(FAULTS)
    # every fault in a snapshot of its own
    every = {k: [] for k in SCHEMAS}
    for name, fault in FAULTS.items():
        rows = {k: [r for r in v if r["snapshot_id"] == "s1"] for k, v in sound().items()}
        fault(rows)
        for k, v in rows.items():
            every[k] += [r | dict(snapshot_id=name) for r in v]
    told = {}
    for rule, snapshot, *_ in found(spark, every):
        told.setdefault(snapshot, set()).add(rule)
    assert {k: v - ALSO.get(k, set()) for k, v in told.items()} == {k: {k} for k in FAULTS}


def test_rules_about_absent_tables_and_columns_are_left_out(spark):
    nodes = spark.createDataFrame([("s", "m", "a", "module", None), ("s", "m", "a", "odd", None)], "snapshot_id string, module_id string, node_id string, kind string, definition_name string")
    assert sorted({x.rule for x in validation.violations({"nodes": nodes}).collect()}) == ["duplicate node id", "instance without definition", "node kind"]
    with pytest.raises(Exception):
        validation.violations({})
