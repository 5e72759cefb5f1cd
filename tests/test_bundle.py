import hashlib
import io
import json
import zipfile

import pytest

from weftgraph.sources import bundle
from weftgraph.sources.bundle import BundleError

PLACE = dict(file="a.sv", start_line=1, start_column=2, end_line=3)
SLICE = dict(
    snapshot_id="s", module=dict(id="m1", name="top", definition_name="top"),
    nodes=[dict(id="a", kind=9, label="ü", definition_name="leaf", parameters=[dict(key="W", json_value="8"), dict(key="A", json_value='"x"')], ports=[dict(id="p", name="P", direction=1, index=0, width=300)], origins=[dict(PLACE, end_column=0), PLACE]), dict(id="b", kind=99)],
    edges=[dict(id="e", source_node="a", source_port="p", target_node="b", width=0, origins=[PLACE])], groups=[dict(id="g", name="G", child_node_ids=["a", "b"], origins=[PLACE])],
    files=[dict(id="f1", path="a.sv")], elaboration_ranges=[dict(start_line=1, start_column=1, end_line=2, end_column=1, active=True, file="a.sv")],
)
TEXT = b"module top;\n" * 40


def entries():
    digest = hashlib.sha256(TEXT).hexdigest()
    index = dict(schema_major=1, schema_minor=1, snapshot_id="s", top="top", modules=[dict(id="m1", name="top", definition_name="top", node_count=2, edge_count=1, entry="design/modules/m1.pb")])
    sources = dict(files=[dict(id="f1", path="a.sv", entry=f"sources/{digest}", sha256=digest, size=len(TEXT))])
    made = dict(diagnostics=[dict(severity=2, message="bad", origin=PLACE), dict(message="note")])
    return {"design/index.pb": bundle.encode("DesignIndex", index), "design/modules/m1.pb": bundle.encode("GraphSlice", SLICE), "sources/index.pb": bundle.encode("SourceIndex", sources), f"sources/{digest}": TEXT, "diagnostics.pb": bundle.encode("Diagnostics", made)}


def packed(**change):
    stream = io.BytesIO()
    bundle.pack(stream, "s", "top", entries() | change)
    return stream.getvalue()


def test_records_round_trip_and_unknown_fields_are_skipped():
    data = bundle.encode("GraphSlice", SLICE)
    back = bundle.decode("GraphSlice", data)
    assert bundle.encode("GraphSlice", back) == data and back["nodes"][0]["origins"] == [dict(PLACE, end_column=0), dict(PLACE, end_column=None)]
    assert back["edges"][0]["width"] == 0 and back["edges"][0]["label"] is None and back["nodes"][1]["label"] == ""
    # numbers, texts and fixed sizes of fields beyond the schema
    extra = b"\xf8\x06\x96\x01" + b"\xf2\x06\x02hi" + b"\xf9\x06" + bytes(8) + b"\xfd\x06" + bytes(4)
    assert bundle.decode("GraphSlice", extra + data + extra) == back
    assert bundle.count("GraphSlice", data) == {"nodes": 2, "objects": 4, "metadata": 2, "ports": 1, "origins": 5, "edges": 1, "groups": 1, "children": 2, "sources": 1}


@pytest.mark.parametrize("data", [b"\x0a", b"\x0a\x05ab", b"\xff" * 11, b"\x0b", b"\x02\x00", b"\x08\x01", b"\x1a\x02\x12\x00", b"\x0d" + bytes(4)])
def test_malformed_records_raise(data):
    with pytest.raises(BundleError):
        bundle.count("GraphSlice", data)


def test_budgets_are_counted_before_decoding(monkeypatch):
    monkeypatch.setattr(bundle, "decode", lambda *a: pytest.fail("decoded"))
    data = bundle.encode("GraphSlice", SLICE)
    for what, most in (("nodes", 1), ("objects", 3), ("origins", 4), ("ports", 0), ("metadata", 1), ("children", 1)):
        with pytest.raises(BundleError, match=f"too many {what}"):
            list(bundle.entry_rows("nodes", "s", "e", data, bundle.LIMITS | bundle.MORE_LIMITS | {what: most}))


def test_archives_that_are_not_sound_raise():
    def changed(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(packed())) as z, zipfile.ZipFile(out, "w") as w:
            for i in z.infolist():
                data = files.get(i.filename, z.read(i))
                if data is not None:
                    w.writestr(i, data)
            for name in files.keys() - set(z.namelist()):
                w.writestr(name, files[name])
        return out.getvalue()

    def manifest(**change):
        with zipfile.ZipFile(io.BytesIO(packed())) as z:
            return changed(**{"manifest.json": json.dumps(json.loads(z.read("manifest.json")) | change).encode()})

    assert packed() == packed()
    bad = {
        "manifest": changed(**{"manifest.json": None}), "malformed": changed(**{"manifest.json": b"[]"}), "entries": changed(more=b"x"), "version 2": manifest(formatVersion={"major": 2, "minor": 0}), "feature": manifest(features=["x"]), "required": manifest(top=None),
        "different": changed(**{"diagnostics.pb": None}), "size": changed(**{"diagnostics.pb": b"other"}), "name": packed(**{"../up": b""}), "ratio": packed(**{"sources/x": bytes(1 << 20)}),
    }
    for why, data in bad.items():
        with pytest.raises(BundleError), zipfile.ZipFile(io.BytesIO(data)) as z:
            bundle.directory(z, why)
    with zipfile.ZipFile(io.BytesIO(manifest(formatVersion={"major": 1, "minor": 7}))) as z:
        assert bundle.directory(z, "newer")[0]["top"] == "top"


@pytest.fixture(scope="module")
def reader(spark):
    spark.dataSource.register(bundle.BundleSource)
    return lambda path, table: spark.read.format("design_bundle").option("table", table).load(path)


def test_every_table_of_a_bundle(reader, tmp_path):
    (tmp_path / "a.bundle").write_bytes(packed())
    rows = {t: [tuple(r) for r in reader(f"{tmp_path}/a.bundle", t).collect()] for t in bundle.SCHEMAS}
    digest = hashlib.sha256(TEXT).hexdigest()
    assert rows["nodes"] == [("s", "m1", "a", 0, "module", "ü", None, "leaf", '{"A":"x","W":8}', "{}"), ("s", "m1", "b", 1, "unknown", "", None, None, "{}", "{}")]
    assert rows["ports"] == [("s", "m1", "a", "p", 0, "P", "input", 0, None, 300)] and rows["edges"] == [("s", "m1", "e", 0, "a", "p", "b", None, None, 0, None, None)]
    assert rows["groups"] == [("s", "m1", "g", "G", "", "{}")] and rows["group_children"] == [("s", "m1", "g", "a"), ("s", "m1", "g", "b")]
    assert rows["origins"][:2] == [("s", "m1", "node", "a", 0, "a.sv", 1, 2, 3, 0), ("s", "m1", "node", "a", 1, "a.sv", 1, 2, 3, None)] and len(rows["origins"]) == 4
    assert rows["elab_ranges"] == [("s", "m1", "a.sv", 1, 1, 2, 1, True)] and rows["files"] == [("s", "m1", "f1", "a.sv")]
    assert rows["modules"] == [("s", "m1", "top", "", "top", None, None, "design/modules/m1.pb", 2, 1)] and rows["sources"] == [("s", "f1", "a.sv", digest, len(TEXT))]
    assert [(r[1], bytes(r[3])) for r in rows["contents"]] == [(digest, TEXT)] and rows["manifest"][0][:2] == ("s", "top")
    assert rows["diagnostics"] == [("s", 0, "error", "bad", "a.sv", 1, 2, 3, None), ("s", 1, "info", "note", None, None, None, None, None)]


def test_an_entry_with_another_digest_raises(reader, tmp_path):
    data = packed()
    path = tmp_path / "b.bundle"
    path.write_bytes(data.replace(b"module top;", b"module tap;") if b"module top;" in data else data)
    at = data.index(bundle.encode("GraphSlice", SLICE)[:20])
    path.write_bytes(data[: at + 12] + b"?" + data[at + 13 :])
    with pytest.raises(Exception, match="BundleError|CRC"):
        reader(str(path), "nodes").collect()


def test_entries_come_in_parts_and_rows_one_at_a_time(spark, tmp_path, monkeypatch):
    edges = [dict(id=f"e{i}", source_node="a", target_node="b") for i in range(6)]
    parts = [bundle.encode("GraphSlice", p) for p in (dict(snapshot_id="s", module=dict(id="m1", name="top")), dict(edges=edges[:4]), dict(edges=edges[4:]))]
    rows = [("s", "top", "design/modules/m1.pb", i, p) for i, p in enumerate(parts)] + [("s", "top", e, 0, b"") for e in ("design/index.pb", "sources/index.pb", "diagnostics.pb")]
    entries = spark.createDataFrame(rows[::-1], "snapshot_id string, top string, entry string, place long, payload binary")
    (found,) = bundle.write_bundles(entries, f"file://{tmp_path}/out").collect()
    spark.dataSource.register(bundle.BundleSource)
    got = spark.read.format("design_bundle").option("table", "edges").load(found.path).orderBy("ord").collect()
    assert [(r.edge_id, r.ord) for r in got] == [(f"e{i}", i) for i in range(6)]
    data, seen, decode = b"".join(parts), [], bundle.decode
    with pytest.raises(BundleError, match="too many edges"):
        list(bundle.entry_rows("edges", "s", "e", data, {"edges": 5}))
    monkeypatch.setattr(bundle, "decode", lambda m, *a, **k: seen.append(m) or decode(m, *a, **k))
    assert next(bundle.entry_rows("edges", "s", "e", data, {}))[2] == "e0" and seen.count("GraphEdge") == 1
