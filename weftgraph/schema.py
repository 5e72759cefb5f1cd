"""Row types of a snapshot, value domains and limits."""

from __future__ import annotations

from pyspark.sql.types import StructType

# The columns of a snapshot's tables, the value domains and the default limits.
TABLES = {
    "modules": "snapshot_id string, module_id string, name string, instance_path string, definition_name string, parameters_json string, attributes_json string",
    "nodes": "snapshot_id string, module_id string, node_id string, ord long, kind string, label string, glyph string, definition_name string, parameters_json string, attributes_json string",
    "ports": "snapshot_id string, module_id string, node_id string, port_id string, ord long, name string, direction string, index long, role string, width long",
    "edges": "snapshot_id string, module_id string, edge_id string, ord long, source_node string, source_port string, target_node string, target_port string, label string, width long, signal_type string, role string",
    "groups": "snapshot_id string, module_id string, group_id string, name string, definition_name string, parameters_json string",
    "group_children": "snapshot_id string, module_id string, group_id string, child_node_id string",
    "origins": "snapshot_id string, module_id string, entity_type string, entity_id string, ord long, file string, start_line long, start_col long, end_line long, end_col long",
    "elab_ranges": "snapshot_id string, module_id string, file string, start_line long, start_col long, end_line long, end_col long, active boolean",
    "sources": "snapshot_id string, file_id string, path string, sha256 string, size long, content string",
    "diagnostics": "snapshot_id string, ord long, severity string, message string, file string, start_line long, start_col long, end_line long, end_col long",
}
NODE_KINDS = ("input", "output", "inout", "module", "operator", "register", "memory", "constant", "primitive", "mux", "latch", "unknown")
DIRECTIONS = ("input", "output", "inout", "unknown")
SEVERITIES = ("error", "warning", "info")
LIMITS = {
    "modules": 50_000, "sources": 50_000, "nodes": 50_000, "edges": 100_000, "ports": 250_000, "origins": 500_000, "objects": 150_000,
    "endpoint_pairs": 1_000_000, "candidates_per_node": 32, "diff_edits": 100_000, "mapped_sources": 64, "hierarchy_pairs": 512, "hierarchy_depth": 64,
    "archive_bytes": 1 << 30, "archive_entry_bytes": 64 << 20, "archive_entries": 100_004, "archive_ratio": 200,
    "constant_bits": 65_536, "decimal_bits": 4_096,
}


def table(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
