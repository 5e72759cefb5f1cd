"""Expanding instances of a comparison by the comparisons of their modules, all instances of all module pairs at once.

A comparison is five tables over many module pairs (scopes). ``ref`` and ``cand`` are the sides; an object that one side lacks has
null there. ``method`` and ``score`` tell how sides were matched.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import ids
from weftgraph.schema import LIMITS
from weftgraph.session import materialise

SIDES = ("ref", "cand")
EDGE = "struct<id:string,source_node:string,source_port:string,target_node:string,target_port:string>"
SCHEMAS = {
    "nodes": "scope string, id string, status string, method string, score double, ref_id string, cand_id string, kind string, label string, definition_name string, ref_kind string, cand_kind string, ref_label string, cand_label string",
    "ports": "scope string, node_id string, id string, status string, method string, score double, ref_node string, cand_node string, ref_port string, cand_port string, ref_name string, cand_name string",
    "edges": f"scope string, id string, status string, method string, score double, ref {EDGE}, cand {EDGE}",
    "groups": "scope string, id string, status string, method string, score double, ref_id string, cand_id string, name string, definition_name string",
    "children": "scope string, group_id string, side string, node_id string",
}


@dataclass
class Comparison:
    """Tables of SCHEMAS. ``children``: members of groups, on the sides ``ref``, ``cand`` and ``union`` (overlay ids)."""

    nodes: DataFrame
    ports: DataFrame
    edges: DataFrame
    groups: DataFrame
    children: DataFrame

    def written(self) -> Comparison:
        return Comparison(*(materialise(getattr(self, f.name), f"comparison-{f.name}") for f in fields(self)))


def _raise(condition: Column, value: Column, *text: Column | str, kind: str = "string") -> Column:
    words = [F.lit(t) if isinstance(t, str) else F.coalesce(t, F.lit("?")) for t in text]
    return F.when(condition, F.raise_error(F.concat(*words)).cast(kind)).otherwise(value)


def _instances(c: Comparison, plan: DataFrame) -> DataFrame:
    """The plan's rows (scope, id, child) with their node; an instance that can't be expanded raises an error."""
    found = plan.select("scope", "id", "child").join(c.nodes, ["scope", "id"], "left")
    bad = (F.col("ref_id").isNull() & F.col("cand_id").isNull()) | ~F.coalesce(F.col("kind") == "module", F.lit(False)) | F.col("definition_name").isNull()
    found = found.withColumn("child", _raise(bad, F.col("child"), F.coalesce("label", "id"), " is not an expandable module instance"))
    # an instance that one side lacks needs a child that this side lacks too
    own = lambda df, test: df.where(test).select(F.col("scope").alias("child")).distinct()
    for side in SIDES:
        full = own(c.nodes, F.col(f"{side}_id").isNotNull()).union(own(c.edges, F.col(side).isNotNull())).union(own(c.groups, F.col(f"{side}_id").isNotNull())).distinct().withColumn("full", F.lit(True))
        found = found.join(full, "child", "left")
        found = found.withColumn("id", _raise(F.col(f"{side}_id").isNull() & F.col("full").isNotNull(), F.col("id"), "an instance without a side cannot expand a child that has it: ", F.col("id"))).drop("full")
    return found


def _within_budget(c: Comparison, inst: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The instances, after comparing how many objects and ports each scope would have with the limits (none where not named)."""
    if not limits:
        return inst
    count = lambda df: df.groupBy("scope").agg(F.count("*").alias("n"))
    objects = count(c.nodes.select("scope").union(c.edges.select("scope")).union(c.groups.select("scope"))).withColumnRenamed("n", "objects")
    sizes = objects.join(count(c.ports).withColumnRenamed("n", "ports"), "scope", "full_outer").fillna(0)
    inner = inst.join(sizes.withColumnRenamed("scope", "child"), "child", "left").groupBy("scope").agg(F.sum(F.coalesce("objects", F.lit(0))).alias("more_objects"), F.sum(F.coalesce("ports", F.lit(0))).alias("more_ports"))
    total = inner.join(sizes, "scope")
    for what in (w for w in ("objects", "ports") if w in limits):
        n = F.col(what) + F.col(f"more_{what}")
        total = total.withColumn("scope", _raise(n > limits[what], F.col("scope"), "comparison projection of ", F.col("scope"), " would have ", n.cast("string"), f" {what}, exceeding budget {limits[what]}"))
    return inst.join(total.select("scope"), "scope")


def _weakest(dependencies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, weak: least score of the heuristic ones of dependencies (keys, method, score)."""
    return dependencies.where("method = 'heuristic'").groupBy(*keys).agg(F.min("score").alias("weak"))


def _with_weak(rows: DataFrame, applies: Column) -> DataFrame:
    """Method and score of rows with ``weak`` (null: no heuristic dependency): a match is no surer than what it depends on."""
    hit = applies & F.col("method").isNotNull() & F.col("weak").isNotNull()
    return rows.withColumns({"method": F.when(hit, "heuristic").otherwise(F.col("method")), "score": F.when(hit, F.least("score", "weak")).otherwise(F.col("score"))}).drop("weak")


def _boundary(c: Comparison, side: str) -> DataFrame:
    """child, incoming, name, node, port: a module's boundary on one side by port name, or by the label of a node with one port that
    is called otherwise. Nodes outside groups come first. Of several ``port`` is null."""
    kind, label = F.col(f"{side}_kind"), F.col(f"{side}_label")
    own = c.nodes.where(F.col(f"{side}_id").isNotNull() & kind.isin("input", "output", "inout")).select("scope", F.col(f"{side}_id").alias("node"), kind.alias("kind"), label.alias("label"))
    ports = c.ports.where(F.col(f"{side}_port").isNotNull()).select("scope", F.col(f"{side}_node").alias("node"), F.col(f"{side}_port").alias("port"), F.col(f"{side}_name").alias("name"))
    held = own.join(ports, ["scope", "node"])
    alone = held.groupBy("scope", "node", "kind", "label").agg(F.count("*").alias("n"), F.min("port").alias("port"), F.bool_or(F.col("name") == F.col("label")).alias("named"))
    by_label = alone.where("n = 1 and not coalesce(named, false)").select("scope", "node", "kind", "port", F.col("label").alias("name"))
    every = held.select("scope", "node", "kind", "port", "name").unionByName(by_label)
    grouped = c.children.where(F.col("side") == side).select("scope", F.col("node_id").alias("node"), F.lit(1).alias("grouped")).distinct()
    ways = F.when(F.col("kind") == "inout", F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("kind") == "input"))
    every = every.join(grouped, ["scope", "node"], "left").select(F.col("scope").alias("child"), F.explode(ways).alias("incoming"), "name", F.coalesce("grouped", F.lit(0)).alias("grouped"), "node", "port")
    per = every.groupBy("child", "incoming", "name", "grouped").agg(F.min(F.struct("node", "port")).alias("hit"), F.count("*").alias("n"))
    return per.groupBy("child", "incoming", "name").agg(F.min_by(F.struct("hit", "n"), "grouped").alias("x")).select("child", "incoming", F.col("name").alias("wanted"), "x.hit", (F.col("x.n") > 1).alias("ambiguous"))


def _rewired(c: Comparison, inst: DataFrame, side: str, limits_to: DataFrame) -> DataFrame:
    """scope, id and the side's edge with the ends that were at an expanded instance moved to the child's boundary."""
    edges = c.edges.join(limits_to, "scope", "left_semi").where(F.col(side).isNotNull()).select("scope", "id", F.col(side).alias("e"))
    at = inst.where(F.col(f"{side}_id").isNotNull()).select("scope", "child", F.col(f"{side}_id").alias("node"), "label")
    ports = c.ports.where(F.col(f"{side}_port").isNotNull()).select("scope", F.col(f"{side}_node").alias("node"), F.col(f"{side}_port").alias("port"), F.col(f"{side}_name").alias("wanted"))
    owned = at.join(ports, ["scope", "node"])
    by_name = owned.groupBy("scope", "child", "node", "label", F.col("wanted").alias("key")).agg(F.min_by("wanted", "port").alias("wanted"), F.lit(1).alias("order"))
    keyed = owned.select("scope", "child", "node", "label", F.col("port").alias("key"), "wanted", F.lit(0).alias("order")).unionByName(by_name)
    keyed = keyed.groupBy("scope", "child", "node", "label", "key").agg(F.min_by("wanted", "order").alias("wanted"))
    bounds = _boundary(c, side)
    ends = {}
    for end, incoming in (("source", False), ("target", True)):
        node, port = F.col(f"e.{end}_node"), F.col(f"e.{end}_port")
        here = edges.select("scope", "id", node.alias("node"), port.alias("key")).join(at.drop("label"), ["scope", "node"])
        met = here.join(keyed.drop("child"), ["scope", "node", "key"], "left").join(bounds.where(F.col("incoming") == incoming), ["child", "wanted"], "left")
        what = "input" if incoming else "output"
        whole = F.col("hit.node")
        whole = _raise(F.col("wanted").isNull(), whole, "edge ", F.col("id"), " references missing port ", F.col("key"))
        inner = F.when(F.col("wanted").isNotNull() & F.col("hit").isNull(), F.raise_error(F.concat(F.lit("cannot expand: no " + what + " "), F.col("wanted"))).cast("string")).when(F.coalesce("ambiguous", F.lit(False)), F.raise_error(F.concat(F.lit("cannot expand: ambiguous " + what + " "), F.col("wanted"))).cast("string")).otherwise(whole)
        ends[end] = met.select("scope", "id", F.struct(ids.inner_id(F.col("node"), inner).alias("node"), ids.inner_id(F.col("node"), F.col("hit.port")).alias("port")).alias(end))
    out = edges.join(ends["source"], ["scope", "id"], "left").join(ends["target"], ["scope", "id"], "left")
    moved = [F.when(F.col(end).isNotNull(), F.col(f"{end}.{part}")).otherwise(F.col(f"e.{end}_{part}")).alias(f"{end}_{part}") for end in ("source", "target") for part in ("node", "port")]
    return out.select("scope", "id", F.struct(F.col("e.id").alias("id"), *moved).alias(side))


def _ends(edges: DataFrame, side: str, nodes: DataFrame, ports: DataFrame) -> DataFrame:
    """scope, id, ``over`` (ends in the union) and ``weak`` of a side's edges; an end without node or port raises an error."""
    out = edges.withColumns({f"{end}_{k[0]}": F.col(f"{side}.{end}_{k}") for end in ("source", "target") for k in ("node", "port")})
    for end in ("source", "target"):
        known = nodes.where(F.col(f"{side}_id").isNotNull()).select("scope", F.col(f"{side}_id").alias(f"{end}_n"), F.struct(F.col("id").alias("over"), "method", "score").alias(f"{end}_node"))
        slots = ports.where(F.col(f"{side}_port").isNotNull()).select("scope", F.col(f"{side}_node").alias(f"{end}_n"), F.col(f"{side}_port").alias(f"{end}_p"), F.struct(F.col("id").alias("over"), "method", "score").alias(f"{end}_port"))
        out = out.join(known, ["scope", f"{end}_n"], "left").join(slots, ["scope", f"{end}_n", f"{end}_p"], "left")
    over = []
    for end in ("source", "target"):
        over.append(_raise(F.col(f"{end}_node").isNull(), F.col(f"{end}_node.over"), "edge ", F.col("id"), f" references an unknown {end} node").alias(f"{end}_node"))
        over.append(_raise(F.col(f"{side}.{end}_port").isNotNull() & F.col(f"{end}_port").isNull(), F.col(f"{end}_port.over"), "edge ", F.col("id"), f" references an unknown {end} port").alias(f"{end}_port"))
    weak = F.least(*(F.when(F.col(f"{h}.method") == "heuristic", F.col(f"{h}.score")) for h in ("source_node", "source_port", "target_node", "target_port")))
    return out.select("scope", "id", side, F.struct(*over).alias(f"{side}_over"), weak.alias(f"{side}_weak"))


def expand(c: Comparison, plan: DataFrame, limits: dict[str, int] | None = None) -> Comparison:
    """The comparison with the instances of the plan (scope, id of the node, child: scope of its compared module) replaced by
    their child's contents. Scopes outside the plan stay.

    Ids of the child's objects are scoped by the instance on their side. Edges at an instance move to the child's boundary; where the
    sides then end at different objects, the edge becomes a removed and an added one. An instance turns into a group. What was
    matched with the help of a heuristic match becomes heuristic itself, with no larger score. ``limits``: those of the schema where
    left out; an empty dict sets none.
    """
    limits = limits if limits is not None else {"objects": LIMITS["objects"], "ports": LIMITS["ports"]}
    inst = materialise(_within_budget(c, _instances(c, plan), limits), "expansion-instances")
    touched = inst.select("scope").distinct()
    # side by side with the child's rows: the instance's overlay id and its ids on both sides
    into = inst.select(F.col("scope").alias("to"), F.col("child").alias("scope"), F.col("id").alias("at"), F.col("ref_id").alias("at_ref"), F.col("cand_id").alias("at_cand"))
    inner = lambda name: getattr(c, name).join(into, "scope").drop("scope").withColumnRenamed("to", "scope")
    in_ = lambda side, column: ids.inner_id(F.col(f"at_{side}"), F.col(column)).alias(column)
    own = lambda column: ids.inner_id(F.col("at"), F.col(column)).alias(column)
    fixed = {"nodes": (["id"], ["ref_id"], ["cand_id"]), "ports": (["node_id", "id"], ["ref_node", "ref_port"], ["cand_node", "cand_port"]), "groups": (["id"], ["ref_id"], ["cand_id"])}

    def moved(name: str) -> DataFrame:
        over, ref, cand = fixed[name]
        made = {**{x: own(x) for x in over}, **{x: in_("ref", x) for x in ref}, **{x: in_("cand", x) for x in cand}}
        rows = inner(name)
        return rows.select(*(made.get(x, F.col(x)) for x in getattr(c, name).columns))

    child_nodes, child_ports, child_groups = moved("nodes"), moved("ports"), moved("groups")
    gone = inst.select("scope", "id")
    nodes = materialise(c.nodes.join(gone, ["scope", "id"], "left_anti").unionByName(child_nodes), "expansion-nodes")
    ports = materialise(c.ports.join(gone.withColumnRenamed("id", "node_id"), ["scope", "node_id"], "left_anti").unionByName(child_ports), "expansion-ports")

    # edges of the parents
    sides = {}
    for side in SIDES:
        sides[side] = materialise(_ends(_rewired(c, inst, side, touched), side, nodes.join(touched, "scope", "left_semi"), ports.join(touched, "scope", "left_semi")), f"expansion-{side}-edges")
    base = c.edges.join(touched, "scope", "left_semi").drop("ref", "cand").join(sides["ref"], ["scope", "id"], "left").join(sides["cand"], ["scope", "id"], "left")
    both = F.col("ref").isNotNull() & F.col("cand").isNotNull()
    split = both & ~F.col("ref_over").eqNullSafe(F.col("cand_over"))
    columns = c.edges.columns
    none = F.lit(None)
    half = lambda side, word, tail: base.where(split).select("scope", ids.inner_id(F.col("id"), F.lit(tail)).alias("id"), F.lit(word).alias("status"), none.cast("string").alias("method"), none.cast("double").alias("score"), *((F.col(s) if s == side else none.cast(EDGE)).alias(s) for s in SIDES))
    kept = _with_weak(base.where(~split).withColumn("weak", F.least("ref_weak", "cand_weak")), both).select(*columns)
    wire = lambda side: F.when(F.col(side).isNotNull() & F.col(f"at_{side}").isNotNull(), F.struct(*(ids.inner_id(F.col(f"at_{side}"), F.col(f"{side}.{f}")).alias(f) for f in ("id", "source_node", "source_port", "target_node", "target_port")))).alias(side)
    child_edges = inner("edges").select("scope", own("id"), "status", "method", "score", wire("ref"), wire("cand"))
    others = c.edges.join(touched, "scope", "left_anti")
    edges = others.unionByName(kept).unionByName(half("ref", "removed", "reference-endpoint")).unionByName(half("cand", "added", "candidate-endpoint")).unionByName(child_edges)

    # groups: members that were an instance become the child's nodes; the instance itself becomes a group
    side_id = {"ref": "ref_id", "cand": "cand_id", "union": "id"}
    pick = lambda df, side, name: df.where(F.col(side_id[side]).isNotNull()).select("scope", F.lit(side).alias("side"), F.col(side_id[side]).alias(name))
    whole = inner("nodes")
    filled = None
    for side, key in side_id.items():
        at = "at" if side == "union" else f"at_{side}"
        rows = whole.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select("scope", F.lit(side).alias("side"), F.col("at").alias("instance"), F.col(at).alias("was"), ids.inner_id(F.col(at), F.col(key)).alias("node_id"))
        filled = rows if filled is None else filled.union(rows)
    filled = materialise(filled, "expansion-members")
    was = pick(inst, "ref", "node_id").union(pick(inst, "cand", "node_id")).union(pick(inst, "union", "node_id"))
    stay = c.children.join(was, ["scope", "side", "node_id"], "left_anti")
    swapped = c.children.join(was, ["scope", "side", "node_id"]).withColumnRenamed("node_id", "was").join(filled, ["scope", "side", "was"]).select("scope", "group_id", "side", "node_id")
    side_of = lambda side: F.col("at") if side == "union" else F.col(f"at_{side}")
    scoped_member = F.when(F.col("side") == "ref", ids.inner_id(side_of("ref"), F.col("node_id"))).when(F.col("side") == "cand", ids.inner_id(side_of("cand"), F.col("node_id"))).otherwise(ids.inner_id(side_of("union"), F.col("node_id")))
    child_members = inner("children").select("scope", ids.inner_id(F.col("at"), F.col("group_id")).alias("group_id"), "side", scoped_member.alias("node_id"))
    made = filled.select("scope", F.col("instance").alias("group_id"), "side", "node_id")
    children = materialise(stay.select("scope", "group_id", "side", "node_id").unionByName(swapped).unionByName(child_members).unionByName(made).distinct(), "expansion-children")

    # what an expansion depends on: every match of the child
    matched = None
    for name in ("nodes", "ports", "edges", "groups"):
        rows = getattr(c, name).select(F.col("scope").alias("child"), "status", "method", "score")
        matched = rows if matched is None else matched.unionByName(rows)
    about = matched.groupBy("child").agg(F.min(F.when(F.col("method") == "heuristic", F.col("score"))).alias("weak"), F.bool_or(F.col("status") != "unchanged").alias("changed"))
    known = materialise(inst.join(about, "child", "left"), "expansion-known")

    held = c.children.where("side = 'union'").join(known.select("scope", F.col("id").alias("node_id"), "weak"), ["scope", "node_id"]).groupBy("scope", F.col("group_id").alias("id")).agg(F.min("weak").alias("weak"))
    hit = c.children.join(was, ["scope", "side", "node_id"], "left_semi").select("scope", F.col("group_id").alias("id")).distinct()
    over = None
    for side in SIDES:
        index = nodes.where(F.col(f"{side}_id").isNotNull()).select("scope", F.col(f"{side}_id").alias("node_id"), F.col("id").alias("over"))
        rows = children.where(F.col("side") == side).join(hit.withColumnRenamed("id", "group_id"), ["scope", "group_id"], "left_semi").join(index, ["scope", "node_id"], "left")
        rows = rows.select("scope", F.col("group_id").alias("id"), F.lit(side).alias("side"), _raise(F.col("over").isNull(), F.col("over"), "group ", F.col("group_id"), " references an unknown node").alias("over"))
        over = rows if over is None else over.union(rows)
    # equal sets: no member is on one side alone
    odd = over.groupBy("scope", "id", "over").agg(F.count_distinct("side").alias("n")).where("n = 1").select("scope", "id", F.lit(True).alias("differs")).distinct()
    parents = c.groups.join(held, ["scope", "id"], "left").join(odd, ["scope", "id"], "left")
    differs = F.coalesce("differs", F.lit(False)) & (F.col("status") == "unchanged") & F.col("ref_id").isNotNull() & F.col("cand_id").isNotNull()
    parents = _with_weak(parents.withColumn("status", F.when(differs, "modified").otherwise(F.col("status"))), F.lit(True)).select(*c.groups.columns)
    state = F.when(F.col("ref_id").isNull(), "added").when(F.col("cand_id").isNull(), "removed").when((F.col("status") != "unchanged") | F.coalesce("changed", F.lit(False)), "modified").otherwise("unchanged")
    synthetic = _with_weak(known.withColumn("status", state), F.col("ref_id").isNotNull() & F.col("cand_id").isNotNull()).select("scope", "id", "status", "method", "score", "ref_id", "cand_id", F.col("label").alias("name"), "definition_name")
    groups = parents.unionByName(child_groups).unionByName(synthetic)
    return Comparison(nodes, ports, materialise(edges, "expansion-edges"), materialise(groups, "expansion-groups"), children)


def flatten(c: Comparison, links: DataFrame, limits: dict[str, int] | None = None) -> Comparison:
    """Every scope with all its instances (links: scope, id, child) expanded, and theirs: from the scopes without instances upwards,
    each module pair once, however many instances share it. Module pairs that hold themselves raise an error."""
    left = materialise(links.select("scope", "id", "child"), "flatten-links")
    for _ in range(LIMITS["hierarchy_depth"] + 1):
        if left.isEmpty():
            return c
        waiting = left.select(F.col("scope").alias("child")).distinct()
        blocked = left.join(waiting, "child", "left_semi").select("scope").distinct()
        ready = materialise(left.join(blocked, "scope", "left_anti"), "flatten-ready")
        if ready.isEmpty():
            break
        c = expand(c, ready, limits)
        left = materialise(left.join(ready.select("scope").distinct(), "scope", "left_anti"), "flatten-links")
    raise ValueError(f"module pairs hold themselves, or nest deeper than {LIMITS['hierarchy_depth']} levels")
