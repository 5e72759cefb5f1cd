"""Queries that compare the two fixture snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import diff, graph, matching
from weftgraph.plans.fixtures import Fixture
from weftgraph.plans.registry import query
from weftgraph.session import materialise


def _matches(x: Fixture) -> DataFrame:
    return matching.conservative(x.graph("ref"), x.graph("cand"), x.line_map())


def _paired(x: Fixture, m: DataFrame | None = None) -> DataFrame:
    r, c = x.graph("ref"), x.graph("cand")
    m = _matches(x) if m is None else m
    ports = diff.port_status(r.ports, c.ports, diff.pair_ports(r.ports, c.ports, m), m)
    return diff.pair_nodes(r.nodes, c.nodes, m, ports)


def _edges(x: Fixture, m: DataFrame | None = None) -> DataFrame:
    r, c = x.graph("ref"), x.graph("cand")
    m = _matches(x) if m is None else m
    return diff.pair_edges(r.edges, c.edges, m, diff.pair_ports(r.ports, c.ports, m))


@query("SELECT scope, kind, status, coalesce(method, 'none') AS method, count(*) AS n FROM paired GROUP BY ALL", modules=True)
def compare_summary(x):
    return _paired(x).groupBy("scope", F.coalesce("cand", "ref")["kind"].alias("kind"), "status", F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"))


@query("SELECT scope, ref_id, cand_id FROM exact", modules=True)
def exact_id_match(x):
    return matching.exact_id(x.graph("ref").nodes, x.graph("cand").nodes)


@query("SELECT scope, ref_id, cand_id FROM named", modules=True)
def unique_key_match(x):
    return _matches(x).where("method = 'named'").select("scope", "ref_id", "cand_id")


@query("SELECT scope, ref_id, cand_id FROM sourced", modules=True)
def source_matches(x):
    return _matches(x).where("method = 'source'").select("scope", "ref_id", "cand_id")


@query("SELECT scope, ref_id, cand_id, score FROM matches WHERE method = 'structural'", modules=True)
def structural_matches(x):
    return _matches(x).where("method = 'structural'").select("scope", "ref_id", "cand_id", "score")


@query("""SELECT 'ref' AS side, scope, id, kind FROM rn n WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.scope = n.scope AND m.ref_id = n.id)
 UNION ALL SELECT 'cand', scope, id, kind FROM cn n WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.scope = n.scope AND m.cand_id = n.id)""", modules=True)
def unmatched_residue(x):
    m = _matches(x)
    own = lambda n, s: matching.residue(n, m, s).select(F.lit(s).alias("side"), "scope", "id", "kind")
    return own(x.graph("ref").nodes, "ref").union(own(x.graph("cand").nodes, "cand"))


@query("SELECT scope, ref_id, cand_id, status FROM paired", modules=True)
def diff_status(x):
    return _paired(x).select("scope", "ref_id", "cand_id", "status")


@query("SELECT scope, ref_id, cand_id, kind, label, glyph, definition_name, parameters_json, method, status FROM paired", modules=True)
def union_nodes(x):
    return diff.union_nodes(_paired(x))


@query("SELECT scope, ref_edge, cand_edge, method, status FROM edge_paired", modules=True)
def edge_pairing(x):
    return _edges(x).select("scope", "ref_edge", "cand_edge", "method", "status")


@query("SELECT scope, coalesce(cand_edge, ref_edge) AS id, label, width, signal_type, status FROM edge_paired", modules=True)
def union_edges(x):
    side = F.coalesce("cand", "ref")
    return _edges(x).select("scope", F.coalesce("cand_edge", "ref_edge").alias("id"), *[side[c].alias(c) for c in ("label", "width", "signal_type")], "status")


@query("SELECT status, count(*) AS n FROM (SELECT status FROM paired UNION ALL SELECT status FROM edge_paired) GROUP BY status", modules=True)
def diff_counts(x):
    m = _matches(x)
    return diff.diff_counts([_paired(x, m), _edges(x, m)])


@query("""SELECT p, n_ref, n_cand, round(p / greatest(n_ref, n_cand), 6) AS ratio, p / greatest(n_ref, n_cand) < 0.2 AS low FROM
(SELECT (SELECT count(*) FROM matches) AS p, (SELECT count(*) FROM rn) AS n_ref, (SELECT count(*) FROM cn) AS n_cand)""", modules=True)
def overlap_ratio(x):
    return diff.overlap_ratio(_matches(x), x.graph("ref").nodes, x.graph("cand").nodes).select(F.col("paired").alias("p"), "n_ref", "n_cand", F.round("ratio", 6).alias("ratio"), "low")


@query("SELECT scope, ref_id, cand_id, ref_port, cand_port, CAST(CASE WHEN ref_port = cand_port THEN 0 WHEN ref_port = 'A' THEN 1 ELSE 2 END AS INTEGER) AS stage FROM port_pairs", modules=True)
def port_pairing(x):
    r, c = x.graph("ref"), x.graph("cand")
    return diff.pair_ports(r.ports, c.ports, _matches(x)).drop("equal")


@query("SELECT scope, ref_id, ref_port, cand_port, status FROM port_pairs", modules=True)
def port_status(x):
    r, c, m = x.graph("ref"), x.graph("cand"), _matches(x)
    return diff.port_status(r.ports, c.ports, diff.pair_ports(r.ports, c.ports, m), m).drop("cand_id")


@query("""WITH g AS (SELECT n_nationkey AS k, concat('group:', n_nationkey) AS ref_group, concat(CASE WHEN n_nationkey % 5 = 0 THEN 'group:v2-' ELSE 'group:' END, n_nationkey) AS cand_group FROM nation)
SELECT 'top' AS scope, ref_group, cand_group, CASE WHEN k % 5 = 0 THEN 'named' ELSE 'exact' END AS method,
 CASE WHEN k % 6 = 1 OR k % 7 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = k AND c_custkey % 10 = 1) THEN 'modified' ELSE 'unchanged' END AS status FROM g
UNION ALL SELECT 'aux', CASE WHEN k % 4 <> 3 THEN ref_group END, cand_group, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 5 = 0 THEN 'named' ELSE 'exact' END, CASE WHEN k % 4 = 3 THEN 'added' ELSE 'unchanged' END FROM g""", view=False)
def group_pairing(x):
    return diff.pair_groups(x.groups("ref"), x.groups("cand"), x.children("ref"), x.children("cand"), _matches(x))


@query("SELECT scope, ref_id, cand_id, kind, label, glyph, definition_name, parameters_json, cand_id IS NOT NULL AS present FROM paired", modules=True)
def side_projection(x):
    return diff.side_projection(_paired(x), "cand")


@query("SELECT status, count(*) AS n, sum(CASE WHEN method = 'named' THEN 1 ELSE 0 END)::BIGINT AS named FROM paired WHERE status IN ('added', 'removed', 'modified') GROUP BY status", modules=True)
def status_visibility(x):
    return diff.visible(_paired(x), ("added", "removed", "modified")).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("method") == "named", F.lit(False))).alias("named"))


@query("""SELECT DISTINCT id FROM (
 SELECT coalesce(cand_id, ref_id) AS id FROM paired WHERE status <> 'unchanged' AND scope = 'top'
 UNION ALL SELECT e.t FROM ce e JOIN edge_paired x ON x.scope = e.scope AND x.cand_edge = e.id AND x.status = 'unchanged' JOIN paired p ON p.scope = e.scope AND p.cand_id = e.s AND p.status <> 'unchanged' WHERE e.scope = 'top'
 UNION ALL SELECT e.s FROM ce e JOIN edge_paired x ON x.scope = e.scope AND x.cand_edge = e.id AND x.status = 'unchanged' JOIN paired p ON p.scope = e.scope AND p.cand_id = e.t AND p.status <> 'unchanged' WHERE e.scope = 'top'
 UNION ALL SELECT unnest([e.s, e.t]) FROM ce e JOIN edge_paired x ON x.scope = e.scope AND x.cand_edge = e.id AND x.status <> 'unchanged' WHERE e.scope = 'top'
 UNION ALL SELECT unnest([e.s, e.t]) FROM re e JOIN edge_paired x ON x.scope = e.scope AND x.ref_edge = e.id AND x.status = 'removed' WHERE e.scope = 'top')""", modules=True)
def changes_only_context(x):
    m = _matches(x)
    e = materialise(_edges(x, m).where("scope = 'top'"), "edge-pairs")
    own = lambda side: x.graph(side).edges.where("scope = 'top'")
    ends = own("cand").join(e.where("cand_edge is not null").select(F.col("cand_edge").alias("id"), "status"), "id").select("source_node", "target_node", "status")
    gone = own("ref").join(e.where("status = 'removed'").select(F.col("ref_edge").alias("id"), "status"), "id").select("source_node", "target_node", "status")
    nodes = materialise(_paired(x, m).where("scope = 'top'").select(F.coalesce("cand_id", "ref_id").alias("id"), "status"), "node-pairs")
    return diff.changes_only(nodes, ends.union(gone))


@query("""SELECT scope, ref_id, cand_id, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.75 THEN 'medium' ELSE 'low' END AS band, method FROM matches""", modules=True)
def confidence_band(x):
    return _matches(x).select("scope", "ref_id", "cand_id", scalars.confidence_band(F.col("score")).alias("band"), "method")


@query("""SELECT i.id, CASE WHEN c.id IS NULL THEN 'none' ELSE 'contains' END AS state FROM (SELECT DISTINCT parent_id AS id FROM cand_nodes WHERE parent_id IS NOT NULL) i LEFT JOIN (
 WITH RECURSIVE up AS (SELECT n.id, n.parent_id FROM cand_nodes n JOIN paired p ON p.cand_id = n.id AND p.scope = 'top' WHERE p.status <> 'unchanged' UNION SELECT n.id, n.parent_id FROM up JOIN cand_nodes n ON n.id = up.parent_id) SELECT DISTINCT id FROM up) c USING (id)""", modules=True)
def hierarchy_change_rollup(x):
    changed = _paired(x).where("cand_id is not null and scope = 'top'").select(F.col("cand_id").alias("id"), (F.col("status") != "unchanged").alias("changed"))
    # A node without a pair has no change of its own, but its parent is an inner node all the same.
    nodes = x.cand_nodes().join(changed, "id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    return graph.change_rollup(nodes, 4)


@query("""SELECT id, method, score, n_weak FROM (SELECT p.parent_id AS id, CASE WHEN count(m.ref_id) FILTER (m.method = 'named') > 0 THEN 'heuristic' ELSE 'exact' END AS method,
 round(CASE WHEN count(m.ref_id) FILTER (m.method = 'named') > 0 THEN 0.98 ELSE 1.0 END, 6)::DOUBLE AS score, count(DISTINCT m.ref_id) FILTER (m.method = 'named') AS n_weak
 FROM ref_nodes p JOIN matches m ON m.ref_id = p.id AND m.scope = 'top' WHERE p.parent_id LIKE 'nation:%' GROUP BY 1)""", modules=True)
def confidence_propagation(x):
    m = _matches(x).where("scope = 'top'").join(x.ref_nodes().select(F.col("id").alias("ref_id"), "parent_id"), "ref_id").where(F.col("parent_id").startswith("nation:"))
    deps = m.select(F.col("parent_id").alias("id"), F.col("ref_id").alias("dep_id"), F.col("score").alias("dep_score"), F.when(F.col("method") == "named", "heuristic").otherwise(F.col("method")).alias("dep_method"))
    out = matching.with_dependencies(deps.select("id").distinct().select("id", F.lit("exact").alias("method"), F.lit(1.0).alias("score")), deps)
    return out.select("id", "method", F.round("score", 6).alias("score"), "n_weak")


_CUST = "SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s, c_nationkey AS nk, CAST(floor(c_acctbal) AS BIGINT) AS b FROM customer"


@query(f"""SELECT ref_id, cand_id, score FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, cand_id) AS a, row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, ref_id) AS b2 FROM (
 SELECT concat('customer:', c.k) AS ref_id, concat('supplier:', s.s_suppkey) AS cand_id, round(1.0 / (1 + abs(c.b - CAST(floor(s.s_acctbal) AS BIGINT)) / 100.0), 6)::DOUBLE AS score FROM ({_CUST}) c JOIN supplier s ON c.nk = s.s_nationkey) WHERE score >= 0.65) WHERE a = 1 AND b2 = 1""", view=False)
def mutual_max(x):
    c, s = x.raw("customer"), x.raw("supplier")
    met = c.join(s, c["c_nationkey"] == s["s_nationkey"])
    score = F.round(1.0 / (1 + F.abs(F.floor("c_acctbal") - F.floor("s_acctbal")) / 100.0), 6)
    return matching.mutual_maximum(met.select(F.concat(F.lit("customer:"), "c_custkey").alias("ref_id"), F.concat(F.lit("supplier:"), "s_suppkey").alias("cand_id"), score.alias("score")))


@query("""SELECT concat('customer:', c_custkey) AS ref_id, concat('supplier:', s_suppkey) AS cand_id, d AS pre_score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d DESC, concat('supplier:', s_suppkey)) AS r FROM (
 SELECT c_custkey, s_suppkey, CAST((c_custkey * 7 + s_suppkey * 13) % 101 AS DOUBLE) AS d FROM customer JOIN supplier ON c_nationkey = s_nationkey)) WHERE r <= 4""", view=False)
def topk_candidates(x):
    met = x.raw("customer").join(x.raw("supplier"), F.col("c_nationkey") == F.col("s_nationkey"))
    pairs = met.select(F.concat(F.lit("customer:"), "c_custkey").alias("ref_id"), F.concat(F.lit("supplier:"), "s_suppkey").alias("cand_id"), ((F.col("c_custkey") * 7 + F.col("s_suppkey") * 13) % 101).cast("double").alias("pre_score"))
    return matching.top_candidates(pairs, 4)


@query("""SELECT r.id AS ref_id, c.id AS cand_id FROM (SELECT concat('customer:', c_custkey) AS id, c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY concat('customer:', c_custkey)) - 1 AS o FROM customer) r
 JOIN (SELECT concat('supplier:', s_suppkey) AS id, s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY concat('supplier:', s_suppkey)) - 1 AS pos, count(*) OVER (PARTITION BY s_nationkey) AS size FROM supplier) c
 USING (k) WHERE (pos - (o * 3) % size + size) % size < 3""", view=False)
def rotating_page(x):
    ref = x.raw("customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.col("c_nationkey").alias("key"))
    cand = x.raw("supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("key"))
    return matching.rotating_page(ref, cand, "key", 3)
