"""Queries of what a workspace shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import display, ids, scalars
from weftgraph.operators import fuzzy, graph, workspace
from weftgraph.plans.compare import _paired
from weftgraph.plans.registry import query


@query("""WITH r AS (SELECT event_id % 25 AS module, concat(event_type, '.sv') AS file, event_id AS line FROM events WHERE event_id % 25 % 3 <> 0), a AS (SELECT n_nationkey AS module, t AS path FROM nation, (SELECT DISTINCT concat(event_type, '.sv') AS t FROM events))
SELECT a.module, a.path, r.line AS start_line FROM a JOIN r ON r.module = a.module AND r.file = a.path WHERE a.module % 3 <> 0 UNION ALL SELECT module, path, 1 FROM a WHERE module % 3 = 0""", view=False)
def ranges_for_source(x):
    e, k = x.raw("events"), F.col("event_id")
    span = [F.lit(1).alias("start_col"), F.lit(9).alias("end_line"), F.lit(1).alias("end_col"), F.lit(True).alias("active")]
    types = e.select(F.concat("event_type", F.lit(".sv")).alias("path")).distinct()
    modules = x.raw("nation").select(F.col("n_nationkey").cast("long").alias("module"), (F.col("n_nationkey") % 3 != 0).alias("has_ranges"))
    asked = modules.select("module").withColumn("one", F.lit(1)).join(types.withColumn("one", F.lit(1)), "one")  # 25 modules
    ranges = e.select((k % 25).alias("module"), F.concat(F.lit("./"), "event_type", F.lit(".sv")).alias("file"), k.alias("start_line"), *span)
    return workspace.ranges_for_source(asked, modules, ranges, types.select("path", F.lit(1).cast("long").alias("start_line"), *span)).select("module", "path", "start_line")


@query("SELECT doc_id AS id, coalesce(source, 'none') AS file FROM documents", view=False)
def legacy_ranges(x):
    d = x.raw("documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("none")).alias("path"))
    return workspace.legacy_ranges(d.withColumn("file", F.when(F.col("id") % 2 == 0, F.col("path")).when(F.col("id") % 3 == 0, ""))).select("id", "file")


@query("""WITH r AS (SELECT o_custkey % 40 AS module, o_orderpriority AS file, o_orderkey AS line FROM orders) SELECT DISTINCT n_nationkey AS module, concat('f:', p) AS file_id, p AS path FROM
 (SELECT n_nationkey, n_name AS p FROM nation UNION ALL SELECT n_nationkey, file FROM nation JOIN r ON r.module = n_nationkey WHERE file <> '5-LOW')""", view=False)
def attach_ranges(x):
    n = x.raw("nation").select(F.col("n_nationkey").cast("long").alias("module"), F.concat(F.lit("f:"), "n_name").alias("file_id"), F.col("n_name").alias("path"))
    ranges = x.raw("orders").select((F.col("o_custkey") % 40).alias("module"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("start_line"))
    sources = x.raw("orders").where("o_orderpriority <> '5-LOW'").select(F.concat(F.lit("f:"), "o_orderpriority").alias("file_id"), F.col("o_orderpriority").alias("path")).distinct()
    return workspace.attach_ranges(n, ranges, n, sources)[1]


_RELATED = """('top.sv','rtl/top.sv'),('rtl/top.sv','rtl/top.sv'),('./rtl/top.sv','rtl/top.sv'),('alu.sv','rtl/alu.sv'),('alu.sv','sim/alu.sv'),('/x/rtl/top.sv','rtl/top.sv'),('/x/rtl/top.sv','sim/tb.sv'),('gone.sv','rtl/top.sv'),('old/tb.sv','sim/tb.sv'),('sim/alu.sv','rtl/alu.sv')"""


@query(f"""WITH a AS (SELECT replace(source, '.sv', concat(n_nationkey, '.sv')) AS source, replace(selected, '.sv', concat(n_nationkey, '.sv')) AS selected FROM nation, (VALUES {_RELATED}) v(source, selected)),
i AS (SELECT replace(p, '.sv', concat(n_nationkey, '.sv')) AS p FROM nation, (VALUES ('rtl/top.sv'), ('rtl/alu.sv'), ('sim/alu.sv'), ('sim/tb.sv')) v(p)),
h AS (SELECT source, selected, ltrim(source, './') AS s, list(DISTINCT p) FILTER (p IS NOT NULL) AS ps FROM (SELECT a.*, i.p FROM a LEFT JOIN i ON i.p = regexp_replace(source, '^\\./', '') OR ends_with(i.p, '/' || regexp_replace(source, '^\\./', '')) OR ends_with(source, '/' || i.p)) GROUP BY ALL)
SELECT source, selected, CASE WHEN regexp_replace(source, '^\\./', '') = selected THEN 'match' WHEN len(ps) = 1 THEN CASE WHEN ps[1] = selected THEN 'match' ELSE 'other' END WHEN ends_with(selected, '/' || source) OR string_split(source, '/')[-1] = string_split(selected, '/')[-1] THEN 'unknown' ELSE 'other' END AS relation FROM h""", view=False)
def path_relation(x):
    rows = [tuple(v.strip("'") for v in r.strip("()").split(",")) for r in _RELATED.split("),(")]
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("selected")) for a, b in rows])).alias("v")
    of = lambda c: F.replace(F.col(c), F.lit(".sv"), F.concat("n_nationkey", F.lit(".sv"))).alias(c.split(".")[-1])
    asked = x.raw("nation").select("n_nationkey", pair).select(of("v.source"), of("v.selected"))
    paths = x.raw("nation").select("n_nationkey", F.explode(F.array(*map(F.lit, ("rtl/top.sv", "rtl/alu.sv", "sim/alu.sv", "sim/tb.sv")))).alias("path")).select(of("path"))
    return workspace.path_relation(asked, paths)


@query("""SELECT DISTINCT c_nationkey AS module, concat('f:', c_mktsegment) AS file_id, concat('src/', c_mktsegment) AS path FROM customer WHERE c_mktsegment <> 'BUILDING'""", view=False)
def correlate_origins(x):
    c = x.raw("customer").select(F.col("c_nationkey").alias("module"), F.concat(F.lit("/build/"), "c_mktsegment").alias("file"), F.col("c_custkey").alias("start_line"))
    known = x.raw("customer").where("c_mktsegment <> 'BUILDING'").select("c_mktsegment").distinct()
    spelled = known.select(F.concat(F.lit("/build/"), "c_mktsegment").alias("spelling"), F.concat(F.lit("f:"), "c_mktsegment").alias("file_id"), F.concat(F.lit("src/"), "c_mktsegment").alias("path"))
    return workspace.correlate_origins(c, c.select("module", "file").limit(0), spelled)[1]


@query("SELECT concat('src/', n_name, '.sv') AS path, list_sort(list(DISTINCT c_custkey % 50)) AS lines FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 4 <> 1 GROUP BY n_name", view=False)
def referenced_lines(x):
    n = x.raw("nation").select("n_nationkey", "n_name")
    origins = x.raw("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lit("./")).otherwise(F.lit("/w/src/")), "n_name", F.lit(".sv")).alias("file"), (F.col("c_custkey") % 50).alias("start_line"))
    sources = n.where("n_nationkey % 4 <> 1").select(F.concat(F.lit("src/"), "n_name", F.lit(".sv")).alias("path"))
    return workspace.referenced_lines(origins, sources)


@query("SELECT concat('a/../src/./', p_partkey, '/', p_name) AS path, concat('src/', p_partkey, '/', p_name) AS relative FROM part", view=False)
def project_paths(x):
    return workspace.outside_root(x.raw("part").select(F.concat(F.lit("a/../src/./"), "p_partkey", F.lit("/"), "p_name").alias("path")), "/work/project")


@query("SELECT c_nationkey AS project, c_mktsegment AS name, min({'file': concat('f', s_suppkey % 3), 'line': s_suppkey, 'col': 1}).line AS line FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 7 = s_suppkey % 7 WHERE c_custkey % 7 < 2 GROUP BY 1, 2", view=False)
def ineffective_defines(x):
    c = x.raw("customer").where("c_custkey % 7 < 2").select(F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 7).alias("r")).distinct()
    u = x.raw("supplier").select(F.col("s_nationkey").alias("project"), (F.col("s_suppkey") % 7).alias("r"), F.concat(F.lit("f"), F.col("s_suppkey") % 3).alias("file"), F.col("s_suppkey").alias("line"), F.lit(1).alias("col"))
    undefined = u.join(c.select("project", "name", "r"), ["project", "r"]).select("project", "name", "file", "line", "col")
    return workspace.ineffective_defines(c.select("project", "name").distinct(), undefined).select("project", "name", "line")


@query("""SELECT n_nationkey AS project, CASE WHEN EXISTS (SELECT 1 FROM events WHERE user_id % 25 = n_nationkey AND event_id % 40 = 3) THEN 'errors' ELSE 'ready' END AS status,
 coalesce((SELECT list_sort(list(s_name)) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 3 <> 0), []) AS parameters FROM nation""", view=False)
def project_status(x):
    projects = x.raw("nation").select(F.col("n_nationkey").alias("project"))
    said = x.raw("events").select((F.col("user_id") % 25).cast("int").alias("project"), F.when(F.col("event_id") % 40 == 3, "error").otherwise("warning").alias("severity"))
    given = x.raw("supplier").select(F.col("s_nationkey").alias("project"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, "1").alias("value"))
    return workspace.project_status(projects, said, given)


@query("""SELECT n_nationkey AS module, CASE n_nationkey % 4 WHEN 0 THEN concat('rtl/m', n_nationkey, '.sv') WHEN 1 THEN concat('own/', n_nationkey, '.sv') WHEN 2 THEN 'rtl/m2.sv' ELSE 'rtl/m0.sv' END AS path FROM nation""", view=False)
def first_source(x):
    k = F.col("n_nationkey")
    modules = x.raw("nation").select(k.alias("module"))
    # Remainder 0: its origin names a project file; 1: only own files; 2: an origin that names a project file; 3: nothing.
    origins = x.raw("nation").where("n_nationkey % 4 in (0, 2)").select(k.alias("module"), F.lit(0).alias("ord"), F.when(k % 4 == 0, F.concat(F.lit("m"), k, F.lit(".sv"))).otherwise(F.lit("/x/rtl/m2.sv")).alias("file"))
    own = x.raw("nation").where("n_nationkey % 4 = 1").select(k.alias("module"), F.lit(0).alias("ord"), F.concat(F.lit("own/"), k, F.lit(".sv")).alias("path"))
    tree = x.raw("nation").select(k.alias("ord"), F.concat(F.lit("rtl/m"), k, F.lit(".sv")).alias("path")).union(x.spark.range(1).select(F.lit(-1), F.lit("README.md")))
    return workspace.first_source(modules, origins, own, tree)


@query("""SELECT coalesce(r.id, c.id) AS instance, r.d AS ref_module, c.d AS cand_module, r.id IS NOT NULL AS ref_present, c.id IS NOT NULL AS cand_present FROM (SELECT id, definition_name AS d FROM ref_nodes WHERE kind = 'module') r FULL JOIN (SELECT id, definition_name AS d FROM cand_nodes WHERE kind = 'module') c ON r.id = c.id""")
def child_pairs(x):
    own = lambda n: n.where("kind = 'module'").select(F.col("id").alias("instance"), F.col("definition_name").alias("module"))
    return workspace.child_pairs(own(x.ref_nodes()), own(x.cand_nodes())).drop("scope")


@query("""SELECT coalesce(r.k, c.k) AS id, CASE WHEN c.k IS NULL THEN 'removed' WHEN r.k IS NULL THEN 'added' WHEN r.n = c.n AND coalesce(json_extract_string(r.p, '$.B'), '') = coalesce(json_extract_string(c.p, '$.B'), '') THEN 'unchanged' ELSE 'modified' END AS status FROM
 (SELECT n_nationkey AS k, n_name AS n, CASE WHEN n_nationkey % 2 = 0 THEN '{}' WHEN n_nationkey % 3 = 0 THEN '{"B": 2, "A": 1}' END AS p FROM nation WHERE n_nationkey % 7 <> 1) r FULL JOIN (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN lower(n_name) ELSE n_name END AS n, CASE WHEN n_nationkey % 3 = 0 THEN '{"A":1,"B":2}' WHEN n_nationkey % 4 = 1 THEN '{"B":2,"A":1}' END AS p FROM nation WHERE n_nationkey % 6 <> 2) c ON r.k = c.k""", view=False)
def top_status(x):
    k, n = F.col("n_nationkey"), F.col("n_name")
    side = lambda name, p, s: F.struct(name.alias("name"), F.lit("d").alias("definition_name"), p.alias("parameters_json")).alias(s)
    r = x.raw("nation").where("n_nationkey % 7 <> 1").select(k.alias("id"), side(n, F.when(k % 2 == 0, "{}").when(k % 3 == 0, '{"B": 2, "A": 1}'), "ref"))
    c = x.raw("nation").where("n_nationkey % 6 <> 2").select(k.alias("id"), side(F.when(k % 5 == 0, F.lower(n)).otherwise(n), F.when(k % 3 == 0, '{"A":1,"B":2}').when(k % 4 == 1, '{"B":2,"A":1}'), "cand"))
    return workspace.top_status(r.join(c, "id", "full_outer")).select("id", "status")


@query("SELECT count(DISTINCT (c_mktsegment, c_nationkey % 5, c_custkey % 3 = 0)) AS keys, count(*) AS pairs FROM customer", view=False)
def pair_keys(x):
    c, k = x.raw("customer"), F.col("c_custkey")
    side = lambda there: F.when(there, F.struct(F.lit("s").alias("snapshot_id"), (F.col("c_nationkey") % 5).cast("string").alias("module_id"), F.col("c_mktsegment").alias("definition_name"), F.when(k % 2 == 0, "{}").alias("parameters_json"), F.lit("n").alias("name")))
    return c.select(workspace.pair_key("conservative", side(F.lit(True)), side(k % 3 != 0)).alias("key")).agg(F.count_distinct("key").alias("keys"), F.count("*").alias("pairs"))


@query("""WITH i AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey END AS r, CASE WHEN c_custkey % 13 = 0 AND c_custkey % 11 <> 0 THEN NULL ELSE c_custkey END AS c, c_custkey % 5 = 0 AS m FROM customer)
SELECT k AS id, CASE WHEN r IS NULL THEN 'added' WHEN c IS NULL THEN 'removed' WHEN m OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND o_orderstatus = 'P') THEN 'modified' ELSE 'unchanged' END AS status FROM i""", view=False)
def group_status(x):
    k = F.col("c_custkey")
    inst = x.raw("customer").select(k.alias("id"), F.when(k % 11 != 0, k).alias("ref_id"), F.when((k % 13 != 0) | (k % 11 == 0), k).alias("cand_id"), F.when(k % 5 == 0, "modified").otherwise("unchanged").alias("status"))
    inner = x.raw("orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "added").otherwise("unchanged").alias("status"))
    return workspace.group_status(inst, inner)


_OVERLAY = """'cmp:node:' || url_encode(concat('[', coalesce('"' || ref_id || '"', 'null'), ',', coalesce('"' || cand_id || '"', 'null'), ']'))"""


@query(f"""WITH p AS (SELECT scope, ref_id, cand_id, {_OVERLAY} AS overlay FROM paired) SELECT e.scope, e.id, s.overlay AS source_node, t.overlay AS target_node FROM ce e JOIN p s ON s.scope = e.scope AND s.cand_id = e.s JOIN p t ON t.scope = e.scope AND t.cand_id = e.t""", modules=True)
def overlay_edges(x):
    index = workspace.overlay_index(_paired(x), "cand")
    return workspace.remap_edges(x.graph("cand").edges, index)


@query(f"""SELECT {_OVERLAY} AS overlay, CASE WHEN cand_id IS NOT NULL THEN 'cand' ELSE 'ref' END AS side, coalesce(cand_id, ref_id) AS id, {_OVERLAY} AS again FROM paired WHERE scope = 'top'""", modules=True)
def selection_carry_over(x):
    p = _paired(x).where("scope = 'top'").select("scope", "ref_id", "cand_id")
    chosen = p.select(ids.overlay_id("node", F.col("ref_id"), F.col("cand_id")).alias("overlay"))
    original = workspace.original_selection(chosen, p)
    back = workspace.overlay_selection(original.select("side", "id"), p).withColumnRenamed("overlay", "again")
    return original.join(back, ["side", "id"])


@query("""WITH i AS (SELECT concat(source, '/', doc_id, '.txt') AS path, CASE WHEN doc_id % 5 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM documents WHERE source IS NOT NULL)
SELECT DISTINCT '' AS parent, string_split(path, '/')[1] AS name, false AS is_file, NULL AS status FROM i UNION ALL SELECT string_split(path, '/')[1], string_split(path, '/')[2], true, status FROM i""", view=False)
def status_tree(x):
    s = x.sources().where("path is not null").select(F.col("path").alias("ref_path"), F.when(F.col("doc_id") % 2 == 0, F.col("path")).alias("cand_path"), F.when(F.col("doc_id") % 5 == 0, "modified").otherwise("unchanged").alias("status"))
    return workspace.status_tree(s)


@query(f"""WITH b AS (SELECT p.scope, {_OVERLAY} AS overlay, r, c FROM paired p LEFT JOIN rn r ON r.scope = p.scope AND r.id = p.ref_id LEFT JOIN cn c ON c.scope = p.scope AND c.id = p.cand_id)
SELECT scope, overlay, field, before, after FROM (SELECT scope, overlay, 'kind' AS field, r.kind AS before, c.kind AS after FROM b UNION ALL SELECT scope, overlay, 'label', r.label, c.label FROM b UNION ALL SELECT scope, overlay, 'glyph', r.glyph, c.glyph FROM b
 UNION ALL SELECT scope, overlay, 'definition_name', r.definition_name, c.definition_name FROM b UNION ALL SELECT scope, overlay, 'parameters_json', r.parameters_json, c.parameters_json FROM b WHERE r.id IS NULL OR c.id IS NULL OR coalesce(regexp_extract(r.parameters_json, '[0-9]+"'), '') <> coalesce(regexp_extract(c.parameters_json, '[0-9]+"'), '')) WHERE before IS DISTINCT FROM after""", modules=True)
def entity_presentation(x):
    return workspace.presentation(_paired(x))


@query("""WITH l AS (SELECT concat('sup/', s_nationkey, '.sv') AS path, s_suppkey AS k FROM supplier), m AS (SELECT * FROM l WHERE k % 16 <> 13)
SELECT r.k AS ref, c.k AS cand, round(CASE WHEN r.k % 16 <> 13 THEN 1.0 / (1 + abs(r.k - c.k) / 20.0) ELSE coalesce((SELECT 1.0 / (1 + abs(greatest(1, n.k + 3 + r.k - n.k) - (c.k + 3)) / 20.0) FROM m n WHERE n.path = r.path LIMIT 1), 0) END, 6)::DOUBLE AS score FROM l r JOIN l c ON r.path = c.path""", view=False)
def source_scores(x):
    g, h = x.graph("ref"), x.graph("cand")
    r, c = g.origins.select("scope", F.col("id").alias("ref_id"), "file"), h.origins.select("scope", F.col("id").alias("cand_id"), "file")
    scored = fuzzy.source_scores_by_key(r, c, ["scope", "file"], fuzzy.source_targets(g, x.line_map(), "ref"), fuzzy.source_targets(h, x.line_map(), "cand"))
    number = lambda c: F.element_at(F.split(c, ":"), -1).cast("long")
    return scored.select(number("ref_id").alias("ref"), number("cand_id").alias("cand"), F.round("source", 6).alias("score"))


_BAGS = "(SELECT p_partkey AS id, [p_partkey % 3, p_size % 2] AS a, [p_size % 3, p_partkey % 2] AS b FROM part)"


@query(f"""WITH t AS (SELECT id, unnest([0, 1]) AS i, a, b FROM {_BAGS}), s AS (SELECT id, CASE WHEN a[1] = b[1] AND a[2] = b[2] THEN 2 WHEN a[1] = b[2] AND a[2] = b[1] THEN 2 WHEN a[1] IN (b[1], b[2]) OR a[2] IN (b[1], b[2]) THEN 1 ELSE 0 END AS n FROM {_BAGS})
SELECT id, round(0.75 * 1 + 0.25 * n / (4 - n), 6)::DOUBLE AS ports, round((CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END + n / (4 - n)) / 2, 6)::DOUBLE AS widths FROM s""", view=False)
def port_and_width_scores(x):
    k, z = F.col("p_partkey"), F.col("p_size").cast("long")
    port = lambda i: F.struct(F.lit("input").alias("direction"), F.lit("data").alias("role"), i.cast("string").alias("index"))
    rows = x.raw("part").select(k.alias("id"), F.array(port(k % 3), port(z % 2)).alias("a"), F.array(port(z % 3), port(k % 2)).alias("b"))
    text = lambda c, f: F.transform(c, f)
    pair, token, width = (lambda p: F.concat_ws("|", p["direction"], p["role"])), (lambda p: F.concat_ws("|", p["direction"], p["role"], p["index"])), (lambda p: p["index"])
    score = scalars.port_score(text("a", pair), text("b", pair), text("a", token), text("b", token))
    wide = scalars.width_score(F.lit("{}"), F.when(k % 2 == 0, "{}").otherwise('{"W":1}'), text("a", width), text("b", width))
    return rows.withColumn("p_partkey", F.col("id")).select("id", F.round(score, 6).alias("ports"), F.round(wide, 6).alias("widths"))


@query("""WITH RECURSIVE c AS (SELECT id, parent_id, CASE WHEN id LIKE 'order:%' THEN CASE k % 90 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END ELSE 0 END AS code FROM (SELECT id, parent_id, CAST(string_split(id, ':')[2] AS BIGINT) AS k FROM ref_nodes)),
up AS (SELECT id AS top, code FROM c UNION ALL SELECT c.parent_id, up.code FROM up JOIN c ON c.id = up.top WHERE c.parent_id IS NOT NULL)
SELECT top AS id, CASE max(code) WHEN 2 THEN 'contains' WHEN 1 THEN 'unknown' ELSE 'none' END AS state FROM up WHERE top IN (SELECT parent_id FROM ref_nodes WHERE parent_id IS NOT NULL) GROUP BY 1""")
def hierarchy_unknown(x):
    k = F.element_at(F.split("id", ":"), 2).cast("long") % 90
    order = F.col("id").startswith("order:")
    changed = F.when(order & (k == 4), F.lit(None).cast("boolean")).otherwise(order & (k == 5))
    return graph.change_rollup(x.ref_nodes().withColumn("changed", changed), 4)


@query("""WITH e AS (SELECT n_nationkey AS r, c_custkey % 97 = 5 AS f, c_custkey % 31 = 7 AS u FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT c_nationkey, o_orderkey % 997 = 3, o_orderkey % 499 = 9 FROM customer JOIN orders ON o_custkey = c_custkey),
n AS (SELECT r, count(*) AS n, bool_or(f) AS f, bool_or(u) AS u FROM e GROUP BY r), c AS (SELECT n_nationkey AS r, count(c_custkey) AS n, coalesce(bool_or(c_custkey % 97 = 5), false) AS f FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT r AS root, CASE WHEN c.f AND c.n + 1 <= 512 THEN 'found' WHEN c.n + 1 > 512 THEN 'unknown' WHEN n.n + 1 > 512 THEN 'unknown' WHEN n.f THEN 'found' WHEN n.u THEN 'unknown' ELSE 'absent' END AS state FROM c JOIN n USING (r)""", view=False)
def reachable_evidence(x):
    name = lambda t, k: F.concat(F.lit(f"{t}:"), F.col(k))
    roots = x.raw("nation").select(name("n", "n_nationkey").alias("root"))
    children = x.raw("customer").select(name("n", "c_nationkey").alias("module"), name("c", "c_custkey").alias("child")).union(x.raw("orders").select(name("c", "o_custkey"), name("o", "o_orderkey")))
    state = lambda found, unknown: F.when(found, "found").when(unknown, "unknown").otherwise("absent").alias("state")
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    evidence = x.raw("nation").select(name("n", "n_nationkey").alias("module"), F.lit("absent").alias("state")).union(x.raw("customer").select(name("c", "c_custkey"), state(c % 97 == 5, c % 31 == 7))).union(x.raw("orders").select(name("o", "o_orderkey"), state(o % 997 == 3, o % 499 == 9)))
    return graph.reachable_evidence(roots, children, evidence).select(F.split("root", ":")[1].cast("int").alias("root"), "state")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '2a' WHEN 2 THEN concat('{"a":[', p_size, ',"x"]}') WHEN 3 THEN 'true' ELSE 'null' END AS shown FROM part""", view=False)
def formatted_values(x):
    z, k = F.col("p_size"), F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lit('"'), F.bin("p_size"), F.lit('"'))).when(k % 5 == 1, F.lit('"2a"')).when(k % 5 == 2, F.concat(F.lit('{"a": ['), z, F.lit(', "x"]}'))).when(k % 5 == 3, F.lit("true")).otherwise(F.lit("null"))
    return x.raw("part").select(k.alias("id"), display.format_json(text).alias("shown"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'assign' WHEN 1 THEN 'e' WHEN 2 THEN '<<' ELSE concat('net', p_partkey) END AS token FROM part""", view=False)
def source_tokens(x):
    k = F.col("p_partkey")
    # assign netK = b << 2; selected: the first word, a letter of the name, the operator, the end of the name.
    text = F.concat(F.lit("// head\n  ASSIGN net"), k, F.lit("    b << 2;"))
    at = lambda *v: F.when(k % 4 == 0, v[0]).when(k % 4 == 1, v[1]).when(k % 4 == 2, v[2]).otherwise(v[3])
    end = F.lit(13) + F.length(k.cast("string"))
    start = at(F.lit(3), F.lit(11), end + 6, end)
    return x.raw("part").select(k.alias("id"), display.source_token(text, F.lit(2), start.cast("int"), F.lit(2), at(F.lit(9), F.lit(11), end + 8, end).cast("int")).alias("token"))
