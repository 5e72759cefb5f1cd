"""Queries of expanded comparisons: the world holds regions, a region its nations, a nation its customers.

The tables may hold any number of customers, so these queries set no budgets of objects and ports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import expansion, hierarchy
from weftgraph.operators.expansion import EDGE, SCHEMAS, Comparison
from weftgraph.plans.fixtures import Fixture
from weftgraph.plans.registry import query


def _sides(name: Column, ref: Column, cand: Column) -> dict[str, Column]:
    return {"id": F.concat(F.lit("u:"), name), "ref_id": F.when(ref, F.concat(F.lit("r:"), name)), "cand_id": F.when(cand, F.concat(F.lit("c:"), name)), "status": F.when(~cand, "removed").when(~ref, "added").otherwise("unchanged")}


class Hierarchy:
    """Comparisons of the world (scope w), its regions (r:K) and nations (n:K). Nations with K % 5 = 2 are gone, customers come and
    go by their number, in every fourth nation the input is another node on each side, in every third it is a heuristic match."""

    def __init__(self, x: Fixture):
        self.x = x
        t, k = F.lit(True), F.col("n_nationkey")
        self.regions = x.raw("region").select(F.lit("w").alias("scope"), F.col("r_regionkey").cast("string").alias("key"), F.concat(F.lit("r:"), "r_regionkey").alias("child"), t.alias("ref"), t.alias("cand"))
        self.nations = x.raw("nation").select(F.concat(F.lit("r:"), "n_regionkey").alias("scope"), k.cast("string").alias("key"), F.concat(F.lit("n:"), "n_nationkey").alias("child"), t.alias("ref"), (k % 5 != 2).alias("cand"), k.alias("k"))
        c = F.col("c_custkey")
        own = x.raw("customer").join(self.nations.select(F.col("k").alias("c_nationkey"), F.col("child").alias("scope"), F.col("cand").alias("there")), "c_nationkey")
        # a customer of a nation that is gone is gone too
        self.customers = own.select("scope", c.cast("string").alias("key"), ((c % 13 != 0) | ~F.col("there")).alias("ref"), ((c % 11 != 0) & F.col("there")).alias("cand")).where("ref or cand")
        self.links = self.regions.select("scope", F.concat(F.lit("u:i"), "key").alias("id"), "child").union(self.nations.select("scope", F.concat(F.lit("u:i"), "key"), "child"))

    def comparison(self) -> Comparison:
        match = lambda ref, cand, heuristic=F.lit(False): {"method": F.when(ref & cand, F.when(heuristic, "heuristic").otherwise("exact")), "score": F.when(ref & cand, F.when(heuristic, 0.6).otherwise(1.0))}
        n = lambda text: F.lit(text)

        def node(rows: DataFrame, name: Column, kind: str, label: Column, definition: Column | None = None, heuristic: Column = F.lit(False)) -> DataFrame:
            ref, cand = F.col("ref"), F.col("cand")
            both = _sides(name, ref, cand) | match(ref, cand, heuristic) | {"kind": F.lit(kind), "label": label, "definition_name": F.lit(None).cast("string") if definition is None else definition}
            side = {f"{s}_{f}": F.when(F.col(s), v) for s in ("ref", "cand") for f, v in (("kind", F.lit(kind)), ("label", label))}
            return rows.select("scope", *((both | side)[c].alias(c) for c in (p.split()[0] for p in SCHEMAS["nodes"].split(", ")) if c != "scope"))

        def port(rows: DataFrame, node_name: Column, name: str, ref_name: Column | None = None, cand_name: Column | None = None) -> DataFrame:
            ref, cand = F.col("ref"), F.col("cand")
            at, own = _sides(node_name, ref, cand), _sides(F.concat(node_name, F.lit(f".{name}")), ref, cand)
            made = {"node_id": at["id"], "id": own["id"], "status": own["status"], "ref_node": at["ref_id"], "cand_node": at["cand_id"], "ref_port": own["ref_id"], "cand_port": own["cand_id"], "ref_name": F.when(ref, F.lit(name) if ref_name is None else ref_name), "cand_name": F.when(cand, F.lit(name) if cand_name is None else cand_name)} | match(ref, cand)
            return rows.select("scope", *(made[c].alias(c) for c in (p.split()[0] for p in SCHEMAS["ports"].split(", ")) if c != "scope"))

        def edge(rows: DataFrame, name: Column, source: tuple[Column, str], target: tuple[Column, str]) -> DataFrame:
            ref, cand = F.col("ref"), F.col("cand")
            one = lambda s: F.when(F.col(s), F.struct(*(F.concat(F.lit(f"{s[0]}:"), v).alias(f) for f, v in (("id", name), ("source_node", source[0]), ("source_port", F.concat(source[0], F.lit(f".{source[1]}"))), ("target_node", target[0]), ("target_port", F.concat(target[0], F.lit(f".{target[1]}"))))))).cast(EDGE).alias(s)
            own = _sides(name, ref, cand) | match(ref, cand)
            return rows.select("scope", own["id"].alias("id"), own["status"].alias("status"), own["method"].alias("method"), own["score"].alias("score"), one("ref"), one("cand"))

        # every scope has an input and an output; a nation's may be swapped
        t = F.lit(True)
        outer = self.regions.select("scope", t.alias("ref"), t.alias("cand")).distinct().union(self.nations.select("scope", t, t).distinct())
        inner = self.nations.select(F.col("child").alias("scope"), "ref", "cand", "k")
        swapped = F.col("k") % 4 == 1
        inst = F.concat(F.lit("i"), "key")
        held = self.regions.union(self.nations.drop("k"))
        cust = F.concat(F.lit("c"), "key")
        every = outer.union(inner.drop("k"))
        nodes = node(outer, n("a"), "input", F.lit("a")).union(node(inner, n("a"), "input", F.lit("one"), heuristic=F.col("k") % 3 == 0)).union(node(inner, n("z"), "input", F.lit("two"))).union(node(every, n("y"), "output", F.lit("y")))
        nodes = nodes.union(node(held, inst, "module", inst, F.col("child"))).union(node(self.customers, cust, "register", cust))
        ports = port(outer, n("a"), "a").union(port(inner, n("a"), "a", F.lit("a"), F.when(swapped, "z").otherwise("a"))).union(port(inner, n("z"), "z", F.lit("z"), F.when(swapped, "a").otherwise("z"))).union(port(every, n("y"), "y"))
        ports = ports.union(port(held, inst, "a")).union(port(held, inst, "y")).union(port(self.customers, cust, "d"))
        edges = edge(held, F.concat(F.lit("x"), "key"), (n("a"), "a"), (inst, "a")).union(edge(held, F.concat(F.lit("o"), "key"), (inst, "y"), (n("y"), "y"))).union(edge(self.customers, F.concat(F.lit("e"), "key"), (n("a"), "a"), (cust, "d")))
        # customers of a nation are a group
        group = lambda rows, name: rows.select("scope", *(_sides(name, F.col("ref"), F.col("cand"))[c].alias(c) for c in ("id", "status")), *(match(F.col("ref"), F.col("cand"))[c].alias(c) for c in ("method", "score")), *(_sides(name, F.col("ref"), F.col("cand"))[c].alias(c) for c in ("ref_id", "cand_id")), F.lit("all").alias("name"), F.lit("d").alias("definition_name"))
        groups = group(inner, n("g"))
        member = lambda side, letter: self.customers.where(F.col(side) if side != "union" else t).select("scope", F.lit("u:g").alias("group_id"), F.lit(side).alias("side"), F.concat(F.lit(f"{letter}:c"), "key").alias("node_id"))
        return Comparison(nodes, ports, edges, groups, member("ref", "r").union(member("cand", "c")).union(member("union", "u"))).written()


_IN = "concat('cmp:projection:', url_encode(concat('[\"', {0}, '\",\"', {1}, '\"]')))".format
_H = """h AS (SELECT n_nationkey AS k, concat('r:', n_regionkey) AS scope, n_regionkey AS r, n_nationkey % 5 <> 2 AS there, concat('u:i', n_nationkey) AS i FROM nation),
c AS (SELECT *, (ck % 13 <> 0 OR NOT there) AS rf, (ck % 11 <> 0 AND there) AS cd FROM (SELECT h.*, c_custkey AS ck FROM customer JOIN h ON c_nationkey = k)), cu AS (SELECT *, CASE WHEN NOT cd THEN 'removed' WHEN NOT rf THEN 'added' ELSE 'unchanged' END AS status FROM c WHERE rf OR cd)"""


@query(f"""WITH {_H}, e AS (
SELECT scope, concat('u:o', k) AS id, CASE WHEN there THEN 'unchanged' ELSE 'removed' END AS status, CASE WHEN there THEN 'exact' END AS method, CASE WHEN there THEN 1.0::DOUBLE END AS score, {_IN("concat('r:i', k)", "'r:y'")} AS ref_source, 'r:y' AS ref_target FROM h
UNION ALL SELECT scope, concat('u:x', k), CASE WHEN there THEN 'unchanged' ELSE 'removed' END, CASE WHEN there AND k % 3 = 0 THEN 'heuristic' WHEN there THEN 'exact' END, CASE WHEN there AND k % 3 = 0 THEN 0.6 WHEN there THEN 1.0 END, 'r:a', {_IN("concat('r:i', k)", "'r:a'")} FROM h WHERE NOT (there AND k % 4 = 1)
UNION ALL SELECT scope, {_IN("concat('u:x', k)", "'reference-endpoint'")}, 'removed', NULL, NULL, 'r:a', {_IN("concat('r:i', k)", "'r:a'")} FROM h WHERE there AND k % 4 = 1
UNION ALL SELECT scope, {_IN("concat('u:x', k)", "'candidate-endpoint'")}, 'added', NULL, NULL, NULL, NULL FROM h WHERE there AND k % 4 = 1
UNION ALL SELECT scope, {_IN("i", "concat('u:e', ck)")}, status, CASE WHEN rf AND cd THEN 'exact' END, CASE WHEN rf AND cd THEN 1.0 END, CASE WHEN rf THEN {_IN("concat('r:i', k)", "'r:a'")} END, CASE WHEN rf THEN {_IN("concat('r:i', k)", "concat('r:c', ck)")} END FROM cu)
SELECT * FROM e""", view=False)
def expanded_edges(x):
    h = Hierarchy(x)
    found = expansion.expand(h.comparison(), h.links.where("scope <> 'w'"), limits={})
    return found.edges.where("scope like 'r:%'").select("scope", "id", "status", "method", "score", F.col("ref.source_node").alias("ref_source"), F.col("ref.target_node").alias("ref_target"))


@query(f"""WITH {_H}, n AS (SELECT k, scope, i, there, k % 3 = 0 AND there AS weak, bool_or(coalesce(status, 'unchanged') <> 'unchanged') AS changed FROM (SELECT h.*, cu.status FROM h LEFT JOIN cu ON cu.k = h.k) GROUP BY ALL)
SELECT scope, i AS id, CASE WHEN NOT there THEN 'removed' WHEN changed THEN 'modified' ELSE 'unchanged' END AS status, CASE WHEN weak THEN 'heuristic' WHEN there THEN 'exact' END AS method, CASE WHEN weak THEN 0.6::DOUBLE WHEN there THEN 1.0 END AS score FROM n
UNION ALL SELECT scope, {_IN("i", "'u:g'")}, CASE WHEN there THEN 'unchanged' ELSE 'removed' END, CASE WHEN there THEN 'exact' END, CASE WHEN there THEN 1.0 END FROM n""", view=False)
def expanded_groups(x):
    h = Hierarchy(x)
    found = expansion.expand(h.comparison(), h.links.where("scope <> 'w'"), limits={})
    return found.groups.where("scope like 'r:%'").select("scope", "id", "status", "method", "score")


@query(f"""WITH {_H}, n AS (SELECT {_IN("concat('u:i', r)", _IN("i", "concat('u:c', ck)"))} AS id, status FROM cu UNION ALL SELECT {_IN("concat('u:i', r)", _IN("i", "x"))}, CASE WHEN there THEN 'unchanged' ELSE 'removed' END FROM h, (VALUES ('u:a'), ('u:z'), ('u:y')) v(x)
UNION ALL SELECT {_IN("concat('u:i', r_regionkey)", "x")}, 'unchanged' FROM region, (VALUES ('u:a'), ('u:y')) v(x) UNION ALL SELECT x, 'unchanged' FROM (VALUES ('u:a'), ('u:y')) v(x))
SELECT id, status FROM n""", view=False)
def flattened_nodes(x):
    h = Hierarchy(x)
    return expansion.flatten(h.comparison(), h.links, limits={}).nodes.where("scope = 'w'").select("id", "status")


@query("""WITH ns AS (SELECT DISTINCT n_regionkey AS r, c_nationkey AS k, c_mktsegment AS s FROM customer JOIN nation ON n_nationkey = c_nationkey),
sp AS (SELECT DISTINCT c_mktsegment AS s, o_orderpriority AS p, CASE WHEN o_orderpriority LIKE '5%' THEN 1 ELSE 0 END AS code FROM orders JOIN customer ON o_custkey = c_custkey WHERE ascii(c_mktsegment) % 2 = 0),
sc AS (SELECT s, max(greatest(CASE WHEN s = 'MACHINERY' THEN 1 ELSE 0 END, coalesce(code, 0))) AS code FROM (SELECT DISTINCT s FROM ns) LEFT JOIN sp USING (s) GROUP BY s),
nc AS (SELECT n_regionkey AS r, n_nationkey AS k, max(greatest(CASE WHEN n_nationkey % 7 = 3 THEN 2 ELSE 0 END, coalesce(code, 0))) AS code FROM nation LEFT JOIN ns ON ns.k = n_nationkey LEFT JOIN sc USING (s) GROUP BY ALL),
i AS (SELECT r AS root, concat('r:', r) AS pair, concat('n', k) AS instance, code FROM nc UNION ALL SELECT r, concat('n:', k), concat('s', s), code FROM ns JOIN sc USING (s) UNION ALL SELECT DISTINCT r, concat('s:', s), concat('p', p), code FROM ns JOIN sp USING (s))
SELECT concat('root', root) AS root, pair, instance, CASE code WHEN 2 THEN 'contains' WHEN 1 THEN 'unknown' ELSE 'none' END AS state FROM i""", view=False)
def pair_change_index(x):
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    nations, customers = x.raw("nation"), x.raw("customer")
    segments = customers.select(text("n:", "c_nationkey").alias("pair"), text("s", "c_mktsegment").alias("instance"), text("s:", "c_mktsegment").alias("child")).distinct()
    orders = x.raw("orders").join(customers.where(F.ascii("c_mktsegment") % 2 == 0), F.col("o_custkey") == F.col("c_custkey")).select(text("s:", "c_mktsegment"), text("p", "o_orderpriority"), text("p:", "o_orderpriority")).distinct()
    children = nations.select(text("r:", "n_regionkey").alias("pair"), text("n", "n_nationkey").alias("instance"), text("n:", "n_nationkey").alias("child")).union(segments).union(orders)
    no = F.lit(False)
    pairs = x.raw("region").select(text("r:", "r_regionkey").alias("pair"), no.alias("changed")).union(nations.select(text("n:", "n_nationkey"), F.col("n_nationkey") % 7 == 3))
    pairs = pairs.union(customers.select(text("s:", "c_mktsegment"), F.when(F.col("c_mktsegment") != "MACHINERY", no)).distinct()).union(x.raw("orders").select(text("p:", "o_orderpriority"), F.when(~F.col("o_orderpriority").startswith("5"), no)).distinct())
    roots = x.raw("region").select(text("root", "r_regionkey").alias("root"), text("r:", "r_regionkey").alias("pair"))
    return hierarchy.change_index(roots, pairs, children)[0]
