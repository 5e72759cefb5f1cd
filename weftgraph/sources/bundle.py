"""Design bundles: ZIP archives of a manifest, module records, sources and diagnostics, as a data source of Spark.

``spark.dataSource.register(BundleSource)``, then ``spark.read.format("design_bundle").option("table", "nodes").load(path)``. Planning reads
the directory and the manifest of each archive, by ranged reads, and makes a partition of every entry that the table needs, so
modules are decoded apart. An entry is held against its declared size and digest, and what it holds is counted
before anything of it is built.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from weftgraph.schema import LIMITS, TABLES
from weftgraph.session import materialise

# The record format. Fields in the order of their numbers; * is a list, ? may be absent.
MESSAGES = {
    "JsonEntry": "key:string json_value:string",
    "SourceOrigin": "file:string start_line:uint start_column:uint end_line:uint end_column:uint?",
    "SourceElaborationRange": "start_line:uint start_column:uint end_line:uint end_column:uint active:bool file:string",
    "GraphPort": "id:string name:string direction:uint index:uint? role:string? width:uint?",
    "GraphNode": "id:string kind:uint label:string definition_name:string? parameters:JsonEntry* attributes:JsonEntry* ports:GraphPort* origins:SourceOrigin*",
    "GraphEdge": "id:string source_node:string source_port:string? target_node:string target_port:string? label:string? width:uint? signal_type:string? origins:SourceOrigin*",
    "GraphModule": "id:string name:string instance_path:string definition_name:string parameters:JsonEntry* attributes:JsonEntry*",
    "GraphGroup": "id:string name:string definition_name:string parameters:JsonEntry* origins:SourceOrigin* child_node_ids:string*",
    "SourceFileRef": "id:string path:string",
    "GraphSlice": "snapshot_id:string module:GraphModule? nodes:GraphNode* edges:GraphEdge* groups:GraphGroup* files:SourceFileRef* elaboration_ranges:SourceElaborationRange*",
    "ModuleSummary": "id:string name:string definition_name:string instance_path:string node_count:uint edge_count:uint entry:string",
    "DesignIndex": "schema_major:uint schema_minor:uint snapshot_id:string top:string tops:string* modules:ModuleSummary*",
    "SourceFile": "id:string path:string entry:string sha256:string size:uint elaboration_ranges:SourceElaborationRange*",
    "SourceIndex": "files:SourceFile*",
    "Diagnostic": "severity:uint message:string origin:SourceOrigin?",
    "Diagnostics": "diagnostics:Diagnostic*",
}
NODE_KINDS = ("unknown", "input", "output", "inout", "operator", "mux", "register", "latch", "memory", "module", "constant", "primitive")
DIRECTIONS = ("unknown", "input", "output", "inout")
SEVERITIES = ("info", "warning", "error")
MAJOR, FEATURES = 1, ("debugArtifacts",)
MANIFEST, MANIFEST_BYTES = "manifest.json", 1 << 20
#: What lists count for, beside objects; and the limits that only archives have.
COUNTED = {"nodes": "nodes", "edges": "edges", "groups": "groups", "files": "sources", "elaboration_ranges": "origins", "origins": "origins", "ports": "ports", "parameters": "metadata", "attributes": "metadata", "child_node_ids": "children", "modules": "modules", "tops": "modules", "diagnostics": "diagnostics"}
MORE_LIMITS = {"groups": 50_000, "metadata": 500_000, "children": LIMITS["nodes"], "diagnostics": 100_000, "string_bytes": 4 << 20}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    many: bool
    maybe: bool


FIELDS = {m: {i: Field(*re.match(r"(\w+):(\w+)", f).groups(), f.endswith("*"), f.endswith("?")) for i, f in enumerate(text.split(), 1)} for m, text in MESSAGES.items()}


class BundleError(ValueError):
    pass


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BundleError("a record ends within a number, or a number is too long")
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value & (1 << 64) - 1, at
        shift += 7


def wire(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """field number, wire type, value of a record's fields."""
    at, end = 0, len(data)
    while at < end:
        tag, at = (data[at], at + 1) if data[at] < 128 else _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = (data[at], at + 1) if at < end and data[at] < 128 else _varint(data, at)
        elif kind in (1, 2, 5):
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = (data[at], at + 1) if at < end and data[at] < 128 else _varint(data, at)
            value, at = data[at : at + size], at + size
            if at > end:
                raise BundleError("a record ends within a field")
        else:
            raise BundleError(f"wire type {kind}")
        if not number:
            raise BundleError("field number 0")
        yield number, kind, value


def count(message: str, data: bytes, budget: dict[str, int] | None = None, limits: dict[str, int] | None = None) -> dict[str, int]:
    """How many of what COUNTED names a record holds, without building it; past a limit it raises at once."""
    budget, limits = {} if budget is None else budget, LIMITS | MORE_LIMITS if limits is None else limits
    for number, kind, value in wire(data):
        f = FIELDS[message].get(number)
        if f is None:
            continue
        if (kind == 0) != (f.kind in ("uint", "bool")) or kind in (1, 5):
            raise BundleError(f"{message}.{f.name} has wire type {kind}")
        for what in [COUNTED.get(f.name)] * (f.many and f.name in COUNTED) + ["objects"] * (f.many and f.name in ("nodes", "edges", "groups")):
            budget[what] = budget.get(what, 0) + 1
            if budget[what] > limits.get(what, budget[what]):
                raise BundleError(f"too many {what}: over {limits[what]}")
        if f.kind == "string":
            if len(value) > limits.get("string_bytes", len(value)):
                raise BundleError(f"{message}.{f.name} is too long")
        elif f.kind in FIELDS:
            count(f.kind, value, budget, limits)
    return budget


def decode(message: str, data: bytes, lists: bool = True) -> dict:
    """A record as a dict; of a single field that comes twice the last one counts, fields that aren't known are skipped. Its own lists
    may be left empty."""
    out = {f.name: [] if f.many else None if f.maybe else {"string": "", "bool": False}.get(f.kind, 0) for f in FIELDS[message].values()}
    for number, _, value in wire(data):
        f = FIELDS[message].get(number)
        if f is None or (f.many and not lists):
            continue
        if f.kind == "string":
            try:
                value = value.decode()
            except UnicodeDecodeError:
                raise BundleError(f"{message}.{f.name} is no UTF-8") from None
        elif f.kind == "bool":
            value = bool(value)
        elif f.kind in FIELDS:
            value = decode(f.kind, value)
        if f.many:
            out[f.name].append(value)
        else:
            out[f.name] = value
    return out


class Parts:
    """A record by field, like what ``decode`` gives, but the records of a list are decoded one at a time, when they are asked for."""

    def __init__(self, message: str, data: bytes):
        self.data, self.single = data, decode(message, data, lists=False)
        self.numbers = {f.name: (i, f.kind) for i, f in FIELDS[message].items() if f.many and f.kind in FIELDS}

    def __getitem__(self, name: str):
        if name not in self.numbers:
            return self.single[name]
        number, kind = self.numbers[name]
        return (decode(kind, value) for n, _, value in wire(self.data) if n == number)


def encode(message: str, record: dict) -> bytes:
    """The bytes of a record: fields by number, what equals its default left out unless it may be absent."""

    def number(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    out = bytearray()
    for i, f in FIELDS[message].items():
        for v in (record.get(f.name) or []) if f.many else [record.get(f.name)]:
            if v is None or (not f.many and not f.maybe and not v):
                continue
            if f.kind in ("uint", "bool"):
                out += number(i << 3) + number(int(v))
            else:
                data = v.encode() if f.kind == "string" else encode(f.kind, v)
                out += number(i << 3 | 2) + number(len(data)) + data
    return bytes(out)


def _json_object(entries: list[dict]) -> str:
    pairs = {}
    for e in entries:
        json.loads(e["json_value"])  # a value that is no JSON raises
        pairs[e["key"]] = e["json_value"]
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in sorted(pairs.items())) + "}"


def _place(o: dict | None) -> tuple:
    return (o["file"], o["start_line"], o["start_column"], o["end_line"], o["end_column"]) if o else (None,) * 5


def _name(values: tuple[str, ...], n: int, other: str) -> str:
    return values[n] if n < len(values) else other


def slice_rows(s: dict, table: str) -> Iterator[tuple]:
    """Rows of a table from a module's record."""
    if s["module"] is None:
        raise BundleError("a module record without module")
    key = s["snapshot_id"], s["module"]["id"]
    if table == "nodes":
        for i, n in enumerate(s["nodes"]):
            yield *key, n["id"], i, _name(NODE_KINDS, n["kind"], "unknown"), n["label"], None, n["definition_name"], _json_object(n["parameters"]), _json_object(n["attributes"])
    elif table == "ports":
        for n in s["nodes"]:
            for i, p in enumerate(n["ports"]):
                yield *key, n["id"], p["id"], i, p["name"], _name(DIRECTIONS, p["direction"], "unknown"), p["index"], p["role"], p["width"]
    elif table == "edges":
        for i, e in enumerate(s["edges"]):
            yield *key, e["id"], i, e["source_node"], e["source_port"], e["target_node"], e["target_port"], e["label"], e["width"], e["signal_type"], None
    elif table == "groups":
        for g in s["groups"]:
            yield *key, g["id"], g["name"], g["definition_name"], _json_object(g["parameters"])
    elif table == "group_children":
        for g in s["groups"]:
            for c in g["child_node_ids"]:
                yield *key, g["id"], c
    elif table == "origins":
        for kind in ("node", "edge", "group"):
            for entity in s[f"{kind}s"]:
                for i, o in enumerate(entity["origins"]):
                    yield *key, kind, entity["id"], i, *_place(o)
    elif table == "elab_ranges":
        for r in s["elaboration_ranges"]:
            yield *key, *_place(r), r["active"]
    elif table == "files":
        for f in s["files"]:
            yield *key, f["id"], f["path"]


#: Tables by the kind of entry that holds them; ``contents`` are the sources' texts by digest.
SCHEMAS = {k: TABLES[k] for k in ("nodes", "ports", "edges", "groups", "group_children", "origins", "elab_ranges", "diagnostics")} | {
    "modules": TABLES["modules"] + ", entry string, node_count long, edge_count long", "files": "snapshot_id string, module_id string, file_id string, path string",
    "sources": "snapshot_id string, file_id string, path string, sha256 string, size long", "contents": "snapshot_id string, sha256 string, size long, content binary", "manifest": "snapshot_id string, top string, archive string, minor long, entries long",
}
OF_SLICES = ("nodes", "ports", "edges", "groups", "group_children", "origins", "elab_ranges", "files")


def entry_rows(table: str, snapshot: str, entry: str, data: bytes, limits: dict[str, int] | None = None) -> Iterator[tuple]:
    message = "GraphSlice" if table in OF_SLICES else {"modules": "DesignIndex", "sources": "SourceIndex", "diagnostics": "Diagnostics"}.get(table)
    if message is None:
        yield snapshot, hashlib.sha256(data).hexdigest(), len(data), data
        return
    count(message, data, limits=limits)
    if table in OF_SLICES:
        yield from slice_rows(Parts(message, data), table)
        return
    record = decode(message, data)
    if table == "modules":
        if record["schema_major"] != MAJOR or record["snapshot_id"] != snapshot:
            raise BundleError("the design index is of another snapshot or version")
        for m in record["modules"]:
            yield snapshot, m["id"], m["name"], m["instance_path"], m["definition_name"], None, None, m["entry"], m["node_count"], m["edge_count"]
    elif table == "sources":
        for f in record["files"]:
            yield snapshot, f["id"], f["path"], f["sha256"], f["size"]
    else:
        for i, d in enumerate(record["diagnostics"]):
            yield snapshot, i, _name(SEVERITIES, d["severity"], "info"), d["message"], *_place(d["origin"])


def _sound(name: str) -> bool:
    return bool(name) and "\\" not in name and "\0" not in name and all(p not in ("", ".", "..") for p in name.split("/"))


def directory(z: zipfile.ZipFile, name: str, limits: dict[str, int] | None = None) -> tuple[dict, dict[str, zipfile.ZipInfo]]:
    """Manifest and entries of an archive, after all that can be said without reading an entry: names, sizes, ratio, version,
    features, compression, and that manifest and archive have the same entries."""
    infos, limits = {i.filename: i for i in z.infolist()}, LIMITS if limits is None else limits
    limit = lambda what: limits.get(what, float("inf"))

    def check(sound: bool, why: str) -> None:
        if not sound:
            raise BundleError(f"{name}: {why}")

    check(len(infos) == len(z.infolist()), "an entry's name is repeated")
    check(len(infos) <= limit("archive_entries"), "too many entries")
    check(sum(i.file_size for i in infos.values()) <= limit("archive_bytes"), "the archive is too large")
    for i in infos.values():
        check(_sound(i.filename), f"entry name {i.filename!r}")
        check(i.file_size <= limit("archive_entry_bytes") and i.file_size <= LIMITS["archive_ratio"] * max(1, i.compress_size), f"size of entry {i.filename}")
        check(i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED), f"compression of entry {i.filename}")
    check(MANIFEST in infos and infos[MANIFEST].file_size <= MANIFEST_BYTES, "no manifest, or one that is too large")
    try:
        m = json.loads(z.read(MANIFEST))
        version, declared = m["formatVersion"], {e["path"]: e for e in m["entries"]}
        told = {p: (e["size"], e["sha256"], e["compression"]) for p, e in declared.items()}
        check(int(version["major"]) == MAJOR, f"format version {version['major']}")
        check(set(m.get("features") or ()) <= set(FEATURES), "a feature that isn't known")
        check(len(told) == len(m["entries"]), "the manifest repeats an entry")
        check(set(told) | {MANIFEST} == set(infos), "manifest and archive have different entries")
        check(all(m[k] in told for k in ("designIndex", "sourceIndex", "diagnostics")) and isinstance(m["snapshotId"], str) and isinstance(m["top"], str), "a required entry is missing")
    except (KeyError, TypeError, ValueError) as e:
        raise e if isinstance(e, BundleError) else BundleError(f"{name}: the manifest is malformed ({e!r})") from None
    for path, (size, _, compression) in told.items():
        check(infos[path].file_size == size, f"size of entry {path}")
        check(compression == {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflate"}[infos[path].compress_type], f"compression of entry {path}")
    return m, infos


def _open(uri: str) -> zipfile.ZipFile:
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    try:
        return zipfile.ZipFile(system.open_input_file(path))
    except zipfile.BadZipFile as e:
        raise BundleError(f"{uri}: {e}") from None


@dataclass
class EntryPartition(InputPartition):
    archive: str
    snapshot: str
    entry: str | None
    size: int
    sha256: str
    row: tuple | None = None


class BundleReader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, limits: dict[str, int] | None = None):
        self.paths, self.table, self.limits = paths, table, limits

    def partitions(self) -> list[EntryPartition]:
        out = []
        for archive in self.paths:
            with _open(archive) as z:
                m, _ = directory(z, archive, self.limits)
            declared = {e["path"]: e for e in m["entries"]}
            if self.table == "manifest":
                out.append(EntryPartition(archive, m["snapshotId"], None, 0, "", (m["snapshotId"], m["top"], archive, int(m["formatVersion"]["minor"]), len(declared))))
                continue
            whole = {"modules": m["designIndex"], "sources": m["sourceIndex"], "diagnostics": m["diagnostics"]}.get(self.table)
            folder = "design/modules/" if self.table in OF_SLICES else "sources/"
            names = [whole] if whole else sorted(p for p in declared if p.startswith(folder) and p not in (m["designIndex"], m["sourceIndex"]))
            out += [EntryPartition(archive, m["snapshotId"], p, declared[p]["size"], declared[p]["sha256"]) for p in names]
        # Spark plans at least one partition
        return out or [EntryPartition("", "", None, 0, "")]

    def read(self, partition: EntryPartition) -> Iterator[tuple]:
        if partition.entry is None:
            yield from [partition.row] if partition.row else []
            return
        with _open(partition.archive) as z:
            data = z.read(partition.entry)
        if len(data) != partition.size or hashlib.sha256(data).hexdigest() != partition.sha256:
            raise BundleError(f"{partition.archive}: size or digest of entry {partition.entry}")
        try:
            yield from entry_rows(self.table, partition.snapshot, partition.entry, data, self.limits)
        except BundleError as e:
            raise BundleError(f"{partition.archive}, entry {partition.entry}: {e}") from None


class BundleSource(DataSource):
    """Options: ``path`` (URIs, or paths that all workers see; several are parted by commas), ``table`` (of SCHEMAS) and ``limits``
    (``none``: no budgets of sizes and counts)."""

    @classmethod
    def name(cls) -> str:
        return "design_bundle"

    def schema(self) -> str:
        table = self.options.get("table", "nodes")
        if table not in SCHEMAS:
            raise BundleError(f"no table {table}")
        return SCHEMAS[table]

    def reader(self, schema: StructType) -> BundleReader:
        paths = [p if "://" in p or p.startswith("file:") else f"file://{p}" for p in self.options["path"].split(",") if p]
        return BundleReader(paths, self.options.get("table", "nodes"), {} if self.options.get("limits") == "none" else None)


def _stored(entry: str) -> bool:
    return entry.endswith(".pb") or entry == MANIFEST


def _info(entry: str) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0))
    info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_STORED if _stored(entry) else zipfile.ZIP_DEFLATED, 0o644 << 16, 3
    return info


def _manifest(snapshot: str, top: str, told: list[dict]) -> bytes:
    manifest = {"formatVersion": {"major": MAJOR, "minor": 1}, "producer": {"name": "weftgraph", "version": "1"}, "snapshotId": snapshot, "top": top, "designIndex": "design/index.pb", "sourceIndex": "sources/index.pb", "diagnostics": "diagnostics.pb", "features": [], "entries": told}
    return json.dumps(manifest, separators=(",", ":")).encode()


def pack(stream, snapshot: str, top: str, entries: dict[str, bytes]) -> None:
    """An archive of entries by name, with its manifest; equal entries give equal bytes."""
    told = [{"path": p, "size": len(d), "sha256": hashlib.sha256(d).hexdigest(), "compression": "stored" if _stored(p) else "deflate"} for p, d in sorted(entries.items())]
    with zipfile.ZipFile(stream, "w") as z:
        for p, d in [(MANIFEST, _manifest(snapshot, top, told)), *sorted(entries.items())]:
            z.writestr(_info(p), d)


def encoded(records: DataFrame, message: str) -> DataFrame:
    """Rows (snapshot_id, entry, place, record: a struct of some of the message's fields) as snapshot_id, entry, place, payload. The
    payloads of an entry make its record, so its lists may come in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.record_batch({"snapshot_id": [row["snapshot_id"]], "entry": [row["entry"]], "place": pa.array([row["place"]], pa.int64()), "payload": pa.array([encode(message, row["record"])], pa.binary())})

    return records.select("snapshot_id", "entry", "place", "record").mapInArrow(run, "snapshot_id string, entry string, place long, payload binary")


class Draft:
    """A file that is written in a row, with its digest."""

    def __init__(self, stream):
        self.stream, self.digest = stream, hashlib.sha256()

    def write(self, data) -> int:
        self.digest.update(data)
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        pass


def write_bundles(entries: DataFrame, folder: str) -> DataFrame:
    """Write an archive for each snapshot below a shared folder (a URI): snapshot_id, path. Rows are snapshot_id, top, entry, place,
    payload; an entry is its payloads by place, so it may come in parts, and a task holds no entry as a whole. A file gets its name,
    made of its digest, when it is whole."""

    def archive(rows: Iterator[dict]) -> tuple[str, str]:
        first = next(rows)
        system, below = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(below, recursive=True)
        draft, told = f".{uuid.uuid4().hex}", []
        with system.open_output_stream(f"{below}/{draft}", compression=None) as stream:
            out = Draft(stream)
            with zipfile.ZipFile(out, "w") as z:
                for entry, parts in groupby(chain([first], rows), lambda r: r["entry"]):
                    digest, size = hashlib.sha256(), 0
                    with z.open(_info(entry), "w", force_zip64=True) as f:
                        for r in parts:
                            digest.update(r["payload"])
                            size += len(r["payload"])
                            f.write(r["payload"])
                    told.append({"path": entry, "size": size, "sha256": digest.hexdigest(), "compression": "stored" if _stored(entry) else "deflate"})
                z.writestr(_info(MANIFEST), _manifest(first["snapshot_id"], first["top"], told))
        name = f"{out.digest.hexdigest()}.bundle"
        system.move(f"{below}/{draft}", f"{below}/{name}")
        return first["snapshot_id"], f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
        for _, own in groupby(rows, lambda r: r["snapshot_id"]):
            snapshot, path = archive(own)
            yield pa.record_batch({"snapshot_id": [snapshot], "path": [path]})

    ordered = entries.select("snapshot_id", "top", "entry", "place", "payload").repartition("snapshot_id").sortWithinPartitions("snapshot_id", "entry", "place")
    return materialise(ordered.mapInArrow(run, "snapshot_id string, path string"), "bundles")
