"""Queries of what a viewer shows, of netlist clean-up rules, match scores and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import fuzzy, connect, diff, matching, presentation, provenance
from weftgraph.plans.registry import query
from weftgraph.plans.scalar_queries import _pick, _pick_sql
from weftgraph.streaming import sessions


@query("""WITH RECURSIVE e AS (SELECT e.*, CAST(substring(target_node, 6) AS BIGINT) AS p, CAST(substring(source_node, 7) AS BIGINT) AS o FROM ref_edges e),
c AS (SELECT *, CASE WHEN p % 19 = 0 THEN 'clock' WHEN p % 17 = 0 THEN 'reset' WHEN p % 13 = 0 THEN 'clock' END AS role FROM e)
SELECT DISTINCT role || ':' || source_node || ':' || n AS key, n AS name, role FROM (SELECT *, CASE WHEN p % 19 = 0 AND p % 17 <> 0 AND p % 13 = 0 THEN 'sys_clk' WHEN p % 17 = 0 THEN 'RST_N' WHEN p % 13 = 0 THEN 'sys_clk' ELSE id END AS n FROM c WHERE role IS NOT NULL)""")
def control_signals(x):
    p = F.expr("cast(substring(target_node, 6) as bigint)")
    none = F.lit(None).cast("string")
    edges = x.ref_edges().select(
        F.xxhash64("id").alias("ord"), "id", "source_node", none.alias("source_port"), "target_node", none.alias("target_port"),
        F.when(p % 17 == 0, "RST_N").when(p % 13 == 0, "sys_clk").alias("label"), F.when(p % 19 == 0, "clock").alias("role"),
    )
    return presentation.control_signals(edges, x.ref_nodes(), x.ports("ref"))


@query("""SELECT CASE WHEN n_nationkey % 2 = 0 THEN concat('e:nation:', n_nationkey, '>customer:', c_custkey) WHEN n_regionkey % 2 = 1 THEN concat('e:region:', n_regionkey, '>nation:', n_nationkey) ELSE concat('e:root>region:', n_regionkey) END AS payload,
 'root' AS source_node, concat('customer:', c_custkey) AS target_node FROM customer JOIN nation ON c_nationkey = n_nationkey""", view=False)
def flat_boundaries(x):
    # Nations go last, so their kind decides first; regions with an odd key are outputs.
    n = x.ref_nodes().where("kind = 'module' and not startswith(id, 'supplier')")
    key = F.expr("cast(split_part(id, ':', 2) as bigint)")
    edges = n.select(F.concat(F.lit("e:"), F.coalesce("parent_id", F.lit("root")), F.lit(">"), "id").alias("id"), F.coalesce("parent_id", F.lit("root")).alias("source_node"), F.lit(None).cast("string").alias("source_port"), F.col("id").alias("target_node"), F.lit(None).cast("string").alias("target_port"))
    bounds = n.where("not startswith(id, 'customer')").select("id", F.when(F.col("id").startswith("nation"), F.when(key % 2 == 0, "output").otherwise("input")).otherwise(F.when(key % 2 == 1, "output").otherwise("input")).alias("kind"), (key + F.when(F.col("id").startswith("nation"), 1000).otherwise(0)).alias("ord"))
    return presentation.flat_boundaries(edges, bounds).select("payload", "source_node", "target_node")


@query("""SELECT id, CASE WHEN v = 0 AND NOT u THEN '12''b0' ELSE '12''b' || (CASE WHEN u THEN 'xxxx' ELSE '0000' END) || right(bin, 8) END AS bin,
 CASE WHEN u THEN '12''hx' || lpad(lower(to_hex(v)), 2, '0') WHEN v = 0 THEN '12''h0' ELSE '12''h0' || lpad(lower(to_hex(v)), 2, '0') END AS hex,
 CASE WHEN u THEN '12''bxxxx' || right(bin, 8) ELSE concat('12''d', v) END AS dec
 FROM (SELECT p_partkey AS id, p_partkey % 256 AS v, p_partkey % 3 = 0 AS u, concat('00000000', bin(p_partkey % 256)) AS bin FROM part)""", view=False)
def constant_formats(x):
    v = F.lpad(F.bin(F.col("p_partkey") % 256), 8, F.lit("0"))
    lit = F.concat(F.lit("12'B"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("?X_xx"), v)).otherwise(v))
    return x.raw("part").select(F.col("p_partkey").alias("id"), *(presentation.constant_literal(lit, r).alias(n) for r, n in (("binary", "bin"), ("hex", "hex"), ("decimal", "dec"))))


_SETTINGS = ("parameter", "define", "undefine", "define")


@query(f"""WITH a AS (SELECT event_id AS ord, {_pick_sql(_SETTINGS, "event_id")} AS kind, concat('N', user_id) AS name, CASE WHEN event_id % 4 <> 2 THEN concat(event_type, '=', event_id) END AS value FROM events WHERE event_id % 10 <> 0),
o AS (SELECT kind, name, max(value) AS value FROM (SELECT CASE event_id % 30 WHEN 0 THEN 'parameter' WHEN 10 THEN 'define' ELSE 'undefine' END AS kind, concat('N', user_id) AS name, CASE WHEN event_id % 30 < 20 THEN concat('v', event_id) END AS value FROM events WHERE event_id % 10 = 0) GROUP BY ALL),
f AS (SELECT kind, name, arg_min(struct_pack(v := value), ord).v AS value FROM a GROUP BY ALL),
p AS (SELECT 'parameter' AS kind, name, coalesce(o.value, f.value) AS value FROM (SELECT * FROM f WHERE kind = 'parameter') f FULL JOIN (SELECT * FROM o WHERE kind = 'parameter') o USING (name)),
d AS (SELECT name, value FROM f WHERE kind = 'define' AND name NOT IN (SELECT name FROM f WHERE kind = 'undefine') AND name NOT IN (SELECT name FROM o WHERE kind = 'define') UNION ALL SELECT name, value FROM o WHERE kind = 'define'),
u AS (SELECT name FROM f WHERE kind = 'undefine' AND name NOT IN (SELECT name FROM o WHERE kind = 'define') UNION SELECT name FROM o WHERE kind = 'undefine')
SELECT * FROM p UNION ALL SELECT 'define', name, value FROM d WHERE name NOT IN (SELECT name FROM o WHERE kind = 'undefine') UNION ALL SELECT 'undefine', name, NULL FROM u""", view=False)
def effective_settings(x):
    e, name = x.raw("events"), F.concat(F.lit("N"), "user_id")
    own = e.where("event_id % 10 <> 0").withColumn("kind", _pick(_SETTINGS, "event_id"))
    args = own.select(F.col("event_id").alias("ord"), "kind", F.when(F.col("kind") == "undefine", name).otherwise(F.concat(name, F.lit("="), "event_type", F.lit("="), F.col("event_id").cast("string"))).alias("value"))
    k = F.col("event_id") % 30
    over = e.where("event_id % 10 = 0").select(F.when(k == 0, "parameter").when(k == 10, "define").otherwise("undefine").alias("kind"), name.alias("name"), F.when(k < 20, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("value"))
    return presentation.effective_settings(args, over)


@query("SELECT concat('customer:', c_custkey) AS id, concat_ws('.', r_name || '.' || n.n_name, CASE WHEN c_custkey % 3 = 0 THEN g.n_name END, c_name) AS path FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN region ON n.n_regionkey = r_regionkey JOIN nation g ON g.n_nationkey = c_nationkey", view=False)
def instance_paths(x):
    up = x.raw("nation").join(x.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.concat_ws(".", "r_name", "n_name").alias("path"))
    held = x.children("ref").join(x.groups("ref"), ["scope", "group_id"]).where("cast(split_part(child_node_id, ':', 2) as bigint) % 3 = 0").select("child_node_id", "name")
    return presentation.instance_paths(x.ref_nodes().where("startswith(id, 'customer')"), up, held)


@query("""SELECT DISTINCT m.cand_id AS anchor, n.kind, n.id FROM (SELECT scope, s AS near, t AS id FROM re UNION ALL SELECT scope, t, s FROM re) e JOIN exact m ON m.scope = e.scope AND m.ref_id = e.near JOIN rn n ON n.scope = e.scope AND n.id = e.id
 WHERE e.scope = 'top' AND NOT EXISTS (SELECT 1 FROM exact t WHERE t.scope = e.scope AND t.ref_id = e.id)""", modules=True)
def shared_neighbours(x):
    r, c = x.graph("ref"), x.graph("cand")
    m = matching.exact_id(r.nodes, c.nodes).where("scope = 'top'").select(F.col("ref_id").alias("id"), F.col("cand_id").alias("partner"))
    return presentation.shared_neighbours(r.edges.where("scope = 'top'"), r.nodes.where("scope = 'top'"), m)


@query("SELECT concat('part:', p_partkey) AS id, 'input|data|0,input|data|1,output|data|' AS signature FROM part", view=False)
def port_signatures(x):
    return matching.port_signatures(x.ports("cand")).drop("scope")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", view=False)
def dead_cells(x):
    k = F.col("p_partkey")
    cells = x.raw("part").select(k.alias("cell"), F.when(k % 2 == 0, "$logic_not").otherwise("$not").alias("type"), F.lit(True).alias("hidden"), (k % 3 == 0).alias("has_source"))
    read = x.raw("lineitem").where("l_quantity > 45").select((F.col("l_partkey") * 10).alias("wire")).distinct()
    return connect.dead_cells(cells, read, x.raw("part").select(k.alias("cell"), (k * 10).alias("wire"))).select(F.col("cell").alias("id"))


def _registers(x):
    k = F.col("p_partkey")
    q = F.array(k * 10, k * 10 + 1, k * 10 + 2, k * 10 + 3)
    # Remainders 1 and 2 read own bits at another place, 3 at the same place, the rest none; 7 has no register, 11 unequal lengths.
    d = F.when(k % 5 == 1, F.array(-k - 1, k * 10, k * 10 + 1, k * 10 + 2)).when(k % 5 == 2, F.array(k * 10 + 3, -k - 1, -k - 1, -k - 1)).when(k % 5 == 3, q).otherwise(F.array(-k - 1, -k - 1, -k - 1, -k - 1))
    parameters = F.create_map(F.lit("WIDTH"), F.when(k % 2 == 0, "00000100").otherwise("4"), F.lit("ARST_VALUE"), F.when(k % 3 == 0, "01xz").otherwise("0101010"))
    return x.raw("part").select(k.alias("cell"), F.when(k % 7 == 0, "$add").otherwise("$adff").alias("type"), F.when(k % 11 == 0, F.slice(d, 1, 3)).otherwise(d).alias("d"), q.alias("q"), parameters.alias("parameters"))


@query("SELECT p_partkey AS cell, 4 AS stages FROM part WHERE p_partkey % 5 IN (1, 2) AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0", view=False)
def shift_registers(x):
    return connect.shift_register_stages(_registers(x))


@query("""SELECT p_partkey AS cell, CAST(s AS INTEGER) AS stage, p_partkey * 10 + s AS q, CASE WHEN p_partkey % 2 = 0 THEN '00000001' ELSE '1' END AS width, CASE WHEN p_partkey % 3 = 0 THEN substring('01xz', 4 - s, 1) ELSE '0101010' END AS reset
 FROM part, range(4) t(s) WHERE p_partkey % 5 IN (1, 2) AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 UNION ALL SELECT p_partkey, NULL, p_partkey * 10, CASE WHEN p_partkey % 2 = 0 THEN '00000100' ELSE '4' END, CASE WHEN p_partkey % 3 = 0 THEN '01xz' ELSE '0101010' END
 FROM part WHERE NOT (p_partkey % 5 IN (1, 2) AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0)""", view=False)
def split_registers(x):
    return connect.split_registers(_registers(x)).select("cell", "stage", F.col("q")[0].alias("q"), F.col("parameters")["WIDTH"].alias("width"), F.col("parameters")["ARST_VALUE"].alias("reset"))


@query("""SELECT token, CASE WHEN state = 'building' THEN CASE WHEN tries <= 1 THEN 'queued' ELSE 'failed' END ELSE state END AS state FROM (SELECT user_id AS token, arg_max(s, (ts, s)) AS state, count(*) FILTER (s = 'building') AS tries FROM (SELECT *, (['queued', 'building', 'ready', 'failed'])[event_id % 4 + 1] AS s FROM events) GROUP BY user_id)""", view=False)
def recovered_sessions(x):
    e = x.raw("events").select(F.col("user_id").alias("token"), _pick(sessions.STATES, "event_id").alias("state"), "ts")
    return sessions.recovered(sessions.current(e)).select("token", "state")


@query("""SELECT token FROM (SELECT user_id AS token, arg_max(s, (ts, s)) AS state, max(ts) AS since FROM (SELECT *, (['queued', 'building', 'ready', 'failed'])[event_id % 4 + 1] AS s FROM events) GROUP BY user_id) WHERE state IN ('ready', 'failed') AND since + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""", view=False)
def expired_sessions(x):
    e = x.raw("events").select(F.col("user_id").alias("token"), _pick(sessions.STATES, "event_id").alias("state"), "ts")
    now = x.raw("events").agg(F.max("ts").alias("now"))  # one row
    return sessions.expired(sessions.current(e).join(now), F.col("now"), 86_400).select("token")


@query()
def heuristic_matches(x):
    r, c = x.graph("ref"), x.graph("cand")
    return fuzzy.heuristic(r, c, matching.conservative(r, c, x.line_map()), x.line_map()).select("scope", "ref_id", "cand_id", F.round("score", 6).alias("score"))


@query("""SELECT id, round(CASE WHEN u = 0 THEN 1 ELSE s / u END, 6)::DOUBLE AS score FROM
 (SELECT p_partkey AS id, least(p_partkey % 4, p_size % 4) + least(p_partkey % 3, p_size % 3) AS s, greatest(p_partkey % 4, p_size % 4) + greatest(p_partkey % 3, p_size % 3) AS u FROM part)""", view=False)
def multiset_scores(x):
    bag = lambda c: F.concat(F.array_repeat(F.lit("in"), (F.col(c) % 4).cast("int")), F.array_repeat(F.lit("out"), (F.col(c) % 3).cast("int")))
    return x.raw("part").select(F.col("p_partkey").alias("id"), F.round(scalars.multiset_similarity(bag("p_partkey"), bag("p_size")), 6).alias("score"))


@query("""SELECT p_partkey AS id, round(.5 * s + .3 * m + .2 * t, 9)::DOUBLE AS pre, round(.35 * s + .25 * m + .15 * t + .2 * n + .05 * w, 9)::DOUBLE AS final FROM
 (SELECT *, .25 + .35 * l + .2 * (p_partkey % 2) + .2 * n AS m FROM (SELECT p_partkey, (p_partkey % 11) / 10.0 AS l, (p_partkey % 7) / 6.0 AS n, p_size / 50.0 AS s, (p_size % 5) / 4.0 AS t, (p_size % 3) / 2.0 AS w FROM part))""", view=False)
def match_scores(x):
    k, z = F.col("p_partkey"), F.col("p_size")
    n, s, t, w = k % 7 / 6, z / 50, z % 5 / 4, z % 3 / 2
    m = scalars.semantic_score(k % 11 / 10, (k % 2).cast("double"), n)
    return x.raw("part").select(k.alias("id"), F.round(scalars.pre_score(s, m, t), 9).alias("pre"), F.round(scalars.final_score(s, m, t, n, w), 9).alias("final"))


_GLYPHS = ("&&", "|", "~^", "!", "+")


@query(f"""SELECT p_partkey AS id, CASE g WHEN '&&' THEN 'and' WHEN '|' THEN 'or' WHEN '~^' THEN 'xnor' WHEN '!' THEN 'not' END AS gate, CASE WHEN p_partkey % 2 = 0 THEN 'logic[3:0]' ELSE 'logic' END AS type,
 p_partkey % 3 = 0 AND p_partkey % 4 <> 0 AS low, p_partkey % 5 <> 0 AS identifier FROM (SELECT *, {_pick_sql(_GLYPHS, "p_partkey")} AS g FROM part)""", view=False)
def symbol_rules(x):
    k = F.col("p_partkey")
    params = F.concat(F.lit('{"ARST_POLARITY": "'), F.when(k % 4 == 0, "0001").otherwise("0000"), F.lit('"}'))
    return x.raw("part").select(
        k.alias("id"), scalars.gate_class(_pick(_GLYPHS, "p_partkey")).alias("gate"), scalars.signal_type(F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(" logic[3:0]"))).otherwise(F.lit("logic"))).alias("type"),
        scalars.is_active_low_reset(F.when(k % 3 == 0, "reset").otherwise("clock"), F.lit("arst"), params).alias("low"), scalars.valid_identifier(F.concat(F.when(k % 5 == 0, "9").otherwise("_"), F.lit("a$"), k.cast("string"))).alias("identifier"),
    )


@query("""WITH h AS (SELECT concat('f', c_nationkey) AS path, c_custkey AS s, c_custkey + c_custkey % 4 AS e FROM customer), o AS (SELECT DISTINCT concat('f', s_nationkey) AS path, s_suppkey * 3 AS s, s_suppkey * 3 + 2 AS e FROM supplier)
SELECT s AS hunk, path, path IN ('f1', 'f2', 'f3') AND NOT EXISTS (SELECT 1 FROM o WHERE o.path = h.path AND o.s <= h.e AND o.e >= h.s) AS source_only FROM h""", view=False)
def hunk_classes(x):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    hunks = x.raw("customer").select(F.concat(F.lit("f"), "c_nationkey").alias("path"), k.alias("start"), (k + k % 4).alias("end"), k.alias("id"))
    origins = x.raw("supplier").select(F.concat(F.lit("f"), "s_nationkey").alias("path"), (s * 3).alias("start"), (s * 3 + 2).alias("end"), s.alias("id"))
    evidence = x.raw("nation").where("n_nationkey % 8 < 4").select(F.concat(F.lit("f"), "n_nationkey").alias("path"), F.when(F.col("n_nationkey").isin(1, 2, 3), "absent").otherwise("found").alias("state"))
    return provenance.classify_hunks(hunks, origins, evidence)


@query("""WITH e AS (SELECT doc_id AS d, 1 + doc_id % 40 AS l, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, source AS f FROM documents WHERE source IS NOT NULL),
s AS (SELECT event_id AS selection, source AS f, 1 + event_id % 40 AS l FROM events JOIN documents ON doc_id = event_id % 100 WHERE source IS NOT NULL)
SELECT concat(selection, '/', s.f) AS selection, min(d) AS entity FROM s JOIN e ON e.f = s.f AND e.l = s.l GROUP BY selection, s.f""", view=False)
def cross_probe(x):
    own = x.raw("documents").where("source is not null")
    line = lambda c: F.col(c) % 40 + 1
    none = F.lit(None).cast("string")
    entities = own.select(F.col("doc_id").alias("entity"), F.lit("node").alias("type"), F.lit("operator").alias("kind"), none.alias("glyph"), F.col("source").alias("file"), line("doc_id").alias("start_line"), F.lit(1).alias("start_col"), line("doc_id").alias("end_line"), F.lit(9).alias("end_col"), F.array(F.lit("a")).alias("terms"), F.col("doc_id").alias("ord"))
    files = own.select(F.col("doc_id").alias("at"), F.col("source").alias("file"))
    picks = x.raw("events").withColumn("at", F.col("event_id") % 100).join(files, "at").select(F.concat_ws("/", F.col("event_id").cast("string"), "file").alias("selection"), "file", line("event_id").alias("line"), F.lit(2).alias("col"), line("event_id").alias("end_line"), F.lit(4).alias("end_col"), none.alias("token"))
    return provenance.cross_probe(picks, entities).select("selection", "entity")


@query("""SELECT user_id AS token, arg_max(s, (ts, s)) AS state, count(*) FILTER (s = 'building') AS tries FROM (SELECT *, (['queued', 'building', 'ready', 'failed'])[event_id % 4 + 1] AS s FROM events) GROUP BY user_id""", view=False)
def session_states(x):
    e = x.raw("events").select(F.col("user_id").alias("token"), _pick(sessions.STATES, "event_id").alias("state"), "ts")
    return sessions.current(e).select("token", "state", "tries")


@query("SELECT status, count(*) AS n FROM paired WHERE status IN ('added', 'removed') GROUP BY status", modules=True)
def visible_one_sided(x):
    r, c = x.graph("ref"), x.graph("cand")
    return diff.visible(diff.pair_nodes(r.nodes, c.nodes, matching.conservative(r, c, x.line_map())), ("added", "removed")).groupBy("status").agg(F.count("*").alias("n"))
