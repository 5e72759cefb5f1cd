import io
import json
import zipfile

import pytest

from weftgraph.sources import diagnostics, filelist, netlist, snapshot

NETLIST = {
    "modules": {
        "leaf": {
            "attributes": {"src": "leaf.sv:1.1-9.2"},
            "ports": {"in": {"direction": "input", "bits": [2, 3]}, "out": {"direction": "output", "bits": [4, 5]}},
            "cells": {"$xor$1": {"hide_name": 1, "type": "$xor", "parameters": {}, "attributes": {"src": "leaf.sv:7.1-7.9"}, "port_directions": {"A": "input", "B": "input", "Y": "output"}, "connections": {"A": [2, 3], "B": ["1", "0"], "Y": [4, 5]}}},
            "netnames": {"in": {"hide_name": 0, "bits": [2, 3], "attributes": {}}, "out": {"hide_name": 0, "bits": [4, 5], "attributes": {}}},
        },
        "main": {
            "attributes": {"top": "1"},
            "ports": {"a": {"direction": "input", "bits": [2, 3]}, "y": {"direction": "output", "bits": [8, 9]}},
            "cells": {
                "u": {"hide_name": 0, "type": "leaf", "parameters": {}, "attributes": {}, "port_directions": {"in": "input", "out": "output"}, "connections": {"in": [2, 3], "out": [6, 7]}},
                "$buf$1": {"hide_name": 1, "type": "$buf", "parameters": {}, "attributes": {}, "port_directions": {"A": "input", "Y": "output"}, "connections": {"A": [6, 7], "Y": [8, 9]}},
            },
            "netnames": {},
        },
    }
}


def test_netlist_becomes_a_graph(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps(NETLIST))
    modules = netlist.read(spark, str(tmp_path / "n.json"))
    assert [r.name for r in netlist.top_modules(modules).collect()] == ["main"]
    nodes, edges = netlist.import_graph(modules)
    kinds = {(json.loads(r.module)["module"], r.node_id): r.kind for r in nodes.collect()}
    assert kinds == {
        ("leaf", "port:in"): "input", ("leaf", "port:out"): "output", ("leaf", "cell:$xor$1"): "operator", ("leaf", "const:$xor$1.B.0"): "constant",
        ("main", "port:a"): "input", ("main", "port:y"): "output", ("main", "cell:u"): "module",
    }
    found = {(json.loads(r.module)["module"], r.source_node, r.target_node, r.target_port, r.width, r.label) for r in edges.collect()}
    assert found == {
        ("leaf", "port:in", "cell:$xor$1", "A", 2, "in"), ("leaf", "cell:$xor$1", "port:out", "out", 2, "out"), ("leaf", "const:$xor$1.B.0", "cell:$xor$1", "B", 2, "2'b01"),
        ("main", "port:a", "cell:u", "in", 2, None), ("main", "cell:u", "port:y", "y", 2, None),
    }


def test_netlist_without_modules_is_an_error(spark, tmp_path):
    (tmp_path / "n.json").write_text("{}")
    with pytest.raises(Exception, match="no modules"):
        netlist.read(spark, str(tmp_path / "n.json")).collect()


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("", []),
        ('{"message": "m"}', [("info", "m", None, None, None, None, None)]),
        ('[{"severity": "Fatal", "message": "x", "location": "c:/a.sv:3:7"}, 5, {"no": 1}]', [("error", "x", "c:/a.sv", 3, 7, 3, 7)]),
        ('{"diagnostics": [{"level": "warn", "text": "t", "location": {"file": "f", "start": {"line": 2}, "end": {"line": 4, "column": 5}}}]}', [("warning", "t", "f", 2, 1, 4, 5)]),
        ('{"formattedMessage": "q", "sourceLocation": {"path": "p", "lineNumber": 9, "columnNumber": 8}}', [("info", "q", "p", 9, 8, 9, 8)]),
    ],
)
def test_diagnostics(spark, text, rows):
    found = diagnostics.parse(spark.createDataFrame([(text,)], "value string")).drop("ord").collect()
    assert [tuple(r) for r in found] == rows


def test_filelist_tokens():
    text = "a 'b c' # gone\n//gone\nx\\ y \"q\\\"r\" z#kept lo\\\nng"
    assert filelist.tokens_of(text) == [(1, 1, "a"), (1, 4, "b c"), (3, 1, "x y"), (3, 7, 'q"r'), (3, 13, "z#kept"), (3, 20, "long")]
    with pytest.raises(ValueError, match="quote"):
        filelist.tokens_of("'open")


def test_nested_filelists(spark):
    files = spark.createDataFrame([("p.f", "+incdir+i1+i2 +define+W=8 -F rtl/s.f --top main last.sv"), ("rtl/s.f", "one.sv -f other.f"), ("other.f", "two.sv -U OLD")], "path string, text string")
    found = filelist.arguments(filelist.expand(files, "p.f")).orderBy("place").collect()
    assert [(r.kind, r.value) for r in found] == [("include_dir", "i1"), ("include_dir", "i2"), ("define", "W=8"), ("source", "one.sv"), ("source", "two.sv"), ("undefine", "OLD"), ("top", "main"), ("source", "last.sv")]


def test_snapshot_round_trip_and_damage(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("s", "1", "a.sv", "x\n"), ("s", "2", "b.sv", "x\n")], "snapshot_id string, file_id string, path string, content string")
    rows = rows.select("snapshot_id", "file_id", "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "content")
    snapshot.write({"sources": rows}, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap/contents")).count() == 1
    assert {(r.path, r.content) for r in snapshot.read(spark, str(tmp_path / "snap"), "sources").collect()} == {("a.sv", "x\n"), ("b.sv", "x\n")}
    snapshot.write({"sources": rows.withColumn("sha256", F.lit("0"))}, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="damaged source"):
        snapshot.read(spark, str(tmp_path / "bad"), "sources").collect()


def test_archives_are_held_against_their_manifest(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a", "one")
        z.writestr("b", "two")
    (tmp_path / "x.zip").write_bytes(held.getvalue())
    entries = snapshot.archive_entries(spark, str(tmp_path / "x.zip"))
    from pyspark.sql import functions as F

    manifest = entries.where("entry = 'a'").select("archive", "entry", (F.col("size") + 1).alias("size"), "sha256").union(entries.limit(1).select("archive", F.lit("c"), "size", "sha256"))
    assert {(r.entry, r.problem) for r in snapshot.verify_entries(entries, manifest).collect()} == {("a", "size"), ("b", "undeclared"), ("c", "missing")}
