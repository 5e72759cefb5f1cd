"""Diff classification, pairing of ports, edges and groups, and union graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import ids
from weftgraph.operators.matching import MATCH, met_once, scoped, unique_keys
from weftgraph.session import materialise, shuffled

# The fields that decide whether a matched pair is modified.
NODE_FIELDS = ("kind", "label", "glyph", "definition_name", "parameters_json")
PORT_FIELDS = ("name", "direction", "index", "role", "width")
EDGE_FIELDS = ("label", "width", "signal_type", "role")
GROUP_KEY, GROUP_FIELDS = ("name", "definition_name"), ("name", "definition_name", "parameters_json")


def _field(df: DataFrame, name: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None).cast("string")).alias(name)


def status(present_ref: Column, present_cand: Column, equal: Column) -> Column:
    return F.when(~present_cand, "removed").when(~present_ref, "added").when(equal, "unchanged").otherwise("modified")


def same_fields(ref: DataFrame, cand: DataFrame) -> Column:
    """Whether the structs ref and cand of these frames agree in every field; parameters by value, and none is as good as absent."""
    names = ref.schema["ref"].dataType.names
    if names != cand.schema["cand"].dataType.names:
        raise ValueError(f"the sides have different fields: {names}, {cand.schema['cand'].dataType.names}")
    equal = F.col("ref").isNotNull() & F.col("cand").isNotNull()
    for f in names:
        a, b = F.col(f"ref.{f}"), F.col(f"cand.{f}")
        equal = equal & (ids.same_parameters(a, b) if f == "parameters_json" else a.eqNullSafe(b))
    return equal


def pair_nodes(ref: DataFrame, cand: DataFrame, matches: DataFrame, ports: DataFrame | None = None, fields: tuple[str, ...] = NODE_FIELDS) -> DataFrame:
    """scope, ref_id, cand_id, ref, cand (structs of the fields, null for a missing side), method, score, status: one row per
    union object. A pair with a changed port (ports: scope, ref_id, cand_id, status) is modified too."""
    own = lambda df: [c for c in fields if c in df.columns]
    r = scoped(ref).select("scope", F.col("id").alias("ref_id"), F.struct(*own(ref)).alias("ref"))
    c = scoped(cand).select("scope", F.col("id").alias("cand_id"), F.struct(*own(cand)).alias("cand"))
    both = r.join(shuffled(scoped(matches)), ["scope", "ref_id"], "left").join(c, ["scope", "cand_id"], "full_outer")
    equal = same_fields(r, c)
    if ports is not None:
        changed = ports.where("status <> 'unchanged'").select(*MATCH).distinct().withColumn("port_changed", F.lit(True))
        both = both.join(shuffled(changed), MATCH, "left")
        equal = equal & F.col("port_changed").isNull()
    return both.select(*MATCH, "ref", "cand", "method", "score", status(F.col("ref").isNotNull(), F.col("cand").isNotNull(), equal).alias("status"))


def union_nodes(paired: DataFrame) -> DataFrame:
    """Union graph's nodes: the candidate's payload wins; overlay key is the pair of ids."""
    side = F.coalesce("cand", "ref")
    return paired.select(*MATCH, *[side[c].alias(c) for c in paired.schema["ref"].dataType.names], "method", "status")


def diff_counts(paired: list[DataFrame], top_changed: bool = False) -> DataFrame:
    """Objects by status over nodes, edges and groups; a changed top module adds one to modified."""
    every = paired[0].select("status")
    for p in paired[1:]:
        every = every.union(p.select("status"))
    counts = every.groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("n", F.col("n") + F.when(F.lit(top_changed) & (F.col("status") == "modified"), 1).otherwise(0))


def overlap_ratio(matches: DataFrame, ref: DataFrame, cand: DataFrame, least: float = 0.2) -> DataFrame:
    """ratio (paired nodes over the larger side) and whether it is low."""
    sizes = [df.agg(F.count("*").alias(n)) for df, n in ((matches, "paired"), (ref, "n_ref"), (cand, "n_cand"))]
    one = sizes[0].join(sizes[1]).join(sizes[2])  # three single rows
    ratio = F.when(F.greatest("n_ref", "n_cand") == 0, F.lit(1.0)).otherwise(F.col("paired") / F.greatest("n_ref", "n_cand"))
    return one.select("paired", "n_ref", "n_cand", ratio.alias("ratio"), (ratio < least).alias("low"))


def pair_ports(ref_ports: DataFrame, cand_ports: DataFrame, matches: DataFrame) -> DataFrame:
    """Ports of matched nodes by id, then unique (name, direction, role, index), then unique (direction, role, index).

    Returns scope, ref_id, cand_id (the node pair), ref_port, cand_port, stage, equal (all fields agree).
    """
    pair = scoped(matches).select(*MATCH)

    def own(ports: DataFrame, side: str) -> DataFrame:
        held = scoped(ports).select("scope", F.col("node_id").alias(f"{side}_id"), F.col("port_id").alias("id"), *[F.col(c) for c in PORT_FIELDS])
        return held.join(shuffled(pair), ["scope", f"{side}_id"])

    r, c, found = own(ref_ports, "ref"), own(cand_ports, "cand"), None
    for stage, fields in enumerate((("id",), ("name", "direction", "role", "index"), ("direction", "role", "index"))):
        keyed = lambda df: df.select("scope", "id", *PORT_FIELDS, F.struct("ref_id", "cand_id", *fields).alias("key"))  # noqa: B023, E731
        met = met_once(keyed(r), keyed(c))
        equal = lambda f: F.col(f"r.{f}").eqNullSafe(F.col(f"c.{f}"))
        same = equal(PORT_FIELDS[0])
        for f in PORT_FIELDS[1:]:
            same = same & equal(f)
        new = met.select("scope", F.col("key.ref_id").alias("ref_id"), F.col("key.cand_id").alias("cand_id"), F.col("r.id").alias("ref_port"), F.col("c.id").alias("cand_port"), F.lit(stage).alias("stage"), same.alias("equal"))
        new = materialise(new, "ports")  # both residues and the result read it
        found = new if found is None else found.union(new)
        r, c = (df.join(shuffled(new.select(*MATCH, F.col(s).alias("id"))), [*MATCH, "id"], "left_anti") for df, s in ((r, "ref_port"), (c, "cand_port")))
    return found


def port_status(ref_ports: DataFrame, cand_ports: DataFrame, pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """scope, ref_id, cand_id, ref_port, cand_port, status of all ports of matched nodes."""
    pair = scoped(matches).select(*MATCH)

    def alone(ports: DataFrame, side: str, word: str) -> DataFrame:
        own = scoped(ports).select("scope", F.col("node_id").alias(f"{side}_id"), F.col("port_id").alias(f"{side}_port")).join(shuffled(pair), ["scope", f"{side}_id"])
        rest = own.join(shuffled(pairs.select(*MATCH, f"{side}_port")), [*MATCH, f"{side}_port"], "left_anti")
        none = F.lit(None).cast("string")
        return rest.select(*MATCH, (F.col("ref_port") if side == "ref" else none).alias("ref_port"), (F.col("cand_port") if side == "cand" else none).alias("cand_port"), F.lit(word).alias("status"))

    met = pairs.select(*MATCH, "ref_port", "cand_port", F.when(F.col("equal"), "unchanged").otherwise("modified").alias("status"))
    return met.union(alone(ref_ports, "ref", "removed")).union(alone(cand_ports, "cand", "added"))


def pair_edges(ref_edges: DataFrame, cand_edges: DataFrame, matches: DataFrame, ports: DataFrame | None = None) -> DataFrame:
    """Edges by equal id and mapped ends, then by mapped ends that one edge alone has on each side.

    Ends are nodes and ports (ports: pairs of the matched nodes' ports); an end without a partner is its side's own. Returns
    scope, ref_edge, cand_edge, method, ref, cand (structs of the payload), status.
    """
    own = scoped(matches).select(*MATCH)
    fields = [c for c in EDGE_FIELDS if c in ref_edges.columns]
    end = lambda known, name: F.struct(known.isNull().alias("alone"), F.coalesce(known, name).alias("n"))

    def mapped(edges: DataFrame, side: str) -> DataFrame:
        out, ends = scoped(edges), []
        for e in ("source", "target"):
            node, port = f"{e}_node", f"{e}_port"
            if side == "cand":
                ends += [end(F.col(node), F.col(node)), end(F.coalesce(F.col(port), F.lit("")) if port in edges.columns else F.lit(""), F.lit(""))]
                continue
            out = out.join(shuffled(own.select("scope", F.col("ref_id").alias(node), F.col("cand_id").alias(f"{e}_to"))), ["scope", node], "left")
            to_port = F.lit("")
            if port in edges.columns:
                if ports is not None:
                    known = ports.select("scope", F.col("ref_id").alias(node), F.col("ref_port").alias(port), F.col("cand_port").alias(f"{e}_port_to"))
                    out = out.join(shuffled(known), ["scope", node, port], "left")
                    to_port = F.when(F.col(port).isNull(), F.lit("")).otherwise(F.col(f"{e}_port_to"))
                else:
                    to_port = F.coalesce(F.col(port), F.lit(""))
            ends += [end(F.col(f"{e}_to"), F.col(node)), end(to_port, F.coalesce(F.col(port), F.lit("")) if port in edges.columns else F.lit(""))]
        return out.select("scope", "id", *fields, F.struct(*[x.alias(f"e{i}") for i, x in enumerate(ends)]).alias("ends"))

    r, c = materialise(mapped(ref_edges, "ref"), "ref-edges"), materialise(mapped(cand_edges, "cand"), "cand-edges")
    row = lambda df, n: df.select("scope", "id", "ends", F.struct("id", *fields).alias(n))
    exact = materialise(row(r, "r").join(row(c, "c"), ["scope", "id", "ends"]).select("scope", "id", "r", "c"), "exact-edges")
    rest = lambda df: df.join(shuffled(exact.select("scope", "id")), ["scope", "id"], "left_anti").withColumnRenamed("ends", "key")
    a, b = rest(r), rest(c)
    ended = met_once(a, b).select("scope", "r", "c")
    both = exact.select("scope", "r", "c", F.lit("exact").alias("method")).union(ended.select("scope", "r", "c", F.lit("structural").alias("method")))
    both = materialise(both, "edge-pairs")
    kind = {n: both.schema[n].dataType for n in ("r", "c")}
    none = F.lit(None)

    def alone(df: DataFrame, n: str, other: str) -> DataFrame:
        left = df.join(shuffled(both.select("scope", F.col(f"{n}.id").alias("id"))), ["scope", "id"], "left_anti").select("scope", F.struct("id", *fields).alias(n))
        return left.select("scope", *[(F.col(x) if x == n else none.cast(kind[x])).alias(x) for x in ("r", "c")], none.cast("string").alias("method"))

    full = both.union(alone(a, "r", "c")).union(alone(b, "c", "r"))
    equal = F.lit(True)
    for f in fields:
        equal = equal & F.col(f"r.{f}").eqNullSafe(F.col(f"c.{f}"))
    return full.select("scope", F.col("r.id").alias("ref_edge"), F.col("c.id").alias("cand_edge"), "method", F.col("r").alias("ref"), F.col("c").alias("cand"), status(F.col("r").isNotNull(), F.col("c").isNotNull(), equal).alias("status"))


def pair_groups(ref_groups: DataFrame, cand_groups: DataFrame, ref_children: DataFrame, cand_children: DataFrame, matches: DataFrame) -> DataFrame:
    """scope, ref_group, cand_group, method, status: groups by id, then by (name, definition) that one group of each side has.

    Modified if name, definition, parameters or the set of children differ; children of the reference count as what they
    are matched with. Groups and children (and matches) without a scope are those of one module pair.
    """
    rg, cg, rk, ck = map(scoped, (ref_groups, cand_groups, ref_children, cand_children))
    exact = rg.select("scope", F.col("group_id").alias("ref_id")).join(cg.select("scope", F.col("group_id").alias("ref_id")), ["scope", "ref_id"]).select("scope", "ref_id", F.col("ref_id").alias("cand_id"))
    key = F.to_json(F.struct(*GROUP_KEY), {"ignoreNullFields": "false"}).alias("key")
    rest = lambda g: g.select("scope", F.col("group_id").alias("id"), key).join(exact.select("scope", F.col("ref_id").alias("id")), ["scope", "id"], "left_anti")
    named = unique_keys(rest(rg), rest(cg))
    pairs = exact.withColumn("method", F.lit("exact")).unionByName(named.withColumn("method", F.lit("named")))
    # A child without a match can't be any child of the other side: the first letter tells them apart.
    found = scoped(matches).select("scope", F.col("ref_id").alias("child_node_id"), F.concat(F.lit("="), "cand_id").alias("to"))
    kids = lambda df, kid: df.groupBy("scope", "group_id").agg(F.array_sort(F.collect_set(kid)).alias("kids"))
    mapped = kids(rk.join(found, ["scope", "child_node_id"], "left"), F.coalesce("to", F.concat(F.lit("-"), "child_node_id")))
    own = kids(ck, F.concat(F.lit("="), "child_node_id"))
    side = lambda g, k, s: g.join(k, ["scope", "group_id"], "left").select("scope", F.col("group_id").alias(f"{s}_id"), F.struct(*[_field(g, f) for f in GROUP_FIELDS], F.coalesce("kids", F.array().cast("array<string>")).alias("kids")).alias(s))
    r, c = side(rg, mapped, "ref"), side(cg, own, "cand")
    full = r.join(pairs, ["scope", "ref_id"], "left").join(c, ["scope", "cand_id"], "full_outer")
    return full.select("scope", F.col("ref_id").alias("ref_group"), F.col("cand_id").alias("cand_group"), "method", status(F.col("ref").isNotNull(), F.col("cand").isNotNull(), same_fields(r, c)).alias("status"))


def side_projection(paired: DataFrame, side: str) -> DataFrame:
    """Union objects with the chosen side's payload where it has one, and whether it has."""
    other = "cand" if side == "ref" else "ref"
    own = F.coalesce(side, other)
    return paired.select(*MATCH, *[own[c].alias(c) for c in paired.schema[side].dataType.names], F.col(side).isNotNull().alias("present"))


def changes_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids to show: changed nodes, ends of changed edges, and nodes one unchanged edge away from a changed node."""
    changed = nodes.where("status <> 'unchanged'").select("id")
    ends = lambda e: e.select(F.col("source_node").alias("id")).union(e.select(F.col("target_node").alias("id")))
    same = edges.where("status = 'unchanged'")
    near = same.join(changed.withColumnRenamed("id", "source_node"), "source_node", "left_semi").select(F.col("target_node").alias("id")).union(
        same.join(changed.withColumnRenamed("id", "target_node"), "target_node", "left_semi").select(F.col("source_node").alias("id"))
    )
    return changed.union(ends(edges.where("status <> 'unchanged'"))).union(near).distinct()


def visible(paired: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    return paired.where(F.col("status").isin(*statuses))
