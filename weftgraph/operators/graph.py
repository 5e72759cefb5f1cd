"""Selection, neighbourhoods, integrity, hierarchy and components of one snapshot's graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schema import LIMITS
from weftgraph.session import materialise


def select_slice(modules: DataFrame, requests: DataFrame) -> DataFrame:
    """request, module_id of requests (request, module_id, instance_path, module_name).

    A module id that is given decides alone, also where it misses. Else the instance path decides if it hits, else the
    module name if one is given, else the first top.
    """
    by = lambda df, column, on, rank: df.select("request", F.col(column).alias(on)).join(modules.select(F.col("module_id").alias("found"), F.col(on)), on).select("request", F.lit(rank).alias("rank"), "found")
    open_ = requests.where("module_id is null")
    tops = modules.where("is_top").agg(F.min("module_id").alias("found"))  # one row
    hits = [
        requests.where("module_id is not null").select("request", F.col("module_id").alias("wanted")).join(modules.select(F.col("module_id").alias("found")), F.col("wanted") == F.col("found")).select("request", F.lit(0).alias("rank"), "found"),
        by(open_.where("instance_path is not null"), "instance_path", "instance_path", 1),
        by(open_.where("module_name is not null"), "module_name", "name", 2),
        open_.where("module_name is null").select("request", F.lit(3).alias("rank")).join(tops).select("request", "rank", "found"),
    ]
    return reduce(DataFrame.union, hits).groupBy("request").agg(F.min(F.struct("rank", "found")).alias("x")).select("request", F.col("x.found").alias("module_id"), F.col("x.rank").alias("rank"))


def definition_lookup(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """wanted, module_id: a module of that name, else the first by name whose definition is that."""
    hits = wanted.join(modules.select("module_id", F.col("name").alias("wanted"), F.col("name").alias("n"), F.lit(0).alias("rank")), "wanted").unionByName(
        wanted.join(modules.select("module_id", F.col("definition_name").alias("wanted"), F.col("name").alias("n"), F.lit(1).alias("rank")), "wanted")
    )
    return hits.groupBy("wanted").agg(F.min_by("module_id", F.struct("rank", "n", "module_id")).alias("module_id"))


def inferred_tops(modules: DataFrame, instances: DataFrame) -> DataFrame:
    """Modules with is_top; else modules that no instance (definition_name) names; else all. Sorted by name at the sink."""
    unused = modules.join(instances.select(F.col("definition_name").alias("name")).distinct(), "name", "left_anti")
    tagged = modules.where("is_top").select("name", F.lit(0).alias("rank")).union(unused.select("name", F.lit(1))).union(modules.select("name", F.lit(2)))
    least = tagged.agg(F.min("rank").alias("rank"))
    return tagged.join(least, "rank").select("name").distinct()


def one_hop(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that touch the selected nodes (id), and the ids of the nodes and of those edges' ends."""
    touched = reduce(DataFrame.unionByName, [edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi") for end in ("source_node", "target_node")]).select(edges.columns).distinct()
    ids = nodes.select("id").union(touched.select("source_node")).union(touched.select("target_node")).distinct()
    return touched, ids


def fan_counts(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """id, fan_in, fan_out; a self-loop counts in both. ``parts`` is the number of tasks that count, if it is given."""
    end = lambda node, i, o: F.struct(F.col(node).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select(F.inline(F.array(end("source_node", 0, 1), end("target_node", 1, 0))))
    ends = ends.repartition(parts, "id") if parts else ends
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge id, end and node id of edge ends that no node has."""
    ends = edges.select("id", F.lit("source").alias("end"), F.col("source_node").alias("node_id")).union(edges.select("id", F.lit("target"), "target_node"))
    return ends.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("id", "end", "node_id")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side; empty if the sets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def violations(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """rule, id of every violation: dangling ends, repeated ids, unknown kinds, negative widths."""
    rows = [
        dangling(edges, nodes).select(F.concat(F.lit("dangling_"), "end").alias("rule"), "id"),
        duplicates(nodes, "id").select(F.lit("duplicate_node"), "id"),
        duplicates(edges, "id").select(F.lit("duplicate_edge"), "id"),
        nodes.where(~F.col("kind").isin(*kinds)).select(F.lit("unknown_kind"), "id"),
        edges.where("width < 0").select(F.lit("negative_width"), "id"),
    ]
    return reduce(DataFrame.union, rows)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component (smallest id reachable over undirected edges) of every node.

    Smallest neighbour label, then the label's label, until nothing changes; each round is a table in the shared folder.
    """
    both = materialise(edges.select(F.col("source_node").alias("id"), F.col("target_node").alias("other")).union(edges.select("target_node", "source_node")).distinct(), "both-ways")
    labels = materialise(nodes.select("id", F.col("id").alias("label")).distinct(), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = step.join(step.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", "old", F.col("up").alias("label"))
        labels = materialise(jump, "labels")
        if labels.where("old <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.select("id", "label")


def flatten_hierarchy(nodes: DataFrame, depth: int) -> DataFrame:
    """id, path, level of the nodes (id, parent_id, label) within ``depth`` levels of the roots; one join a level."""
    level = nodes.where("parent_id is null").select("id", F.col("label").alias("path"), F.lit(0).alias("level"))
    out = level
    for k in range(1, depth + 1):
        level = nodes.join(level.select(F.col("id").alias("parent_id"), F.col("path").alias("up")), "parent_id").select("id", F.concat_ws(".", "up", "label").alias("path"), F.lit(k).alias("level"))
        out = out.union(level)
    return out


def descendant_counts(nodes: DataFrame, depth: int) -> DataFrame:
    """id, n (nodes below) of every node that has any; pairs of ancestor and node by one join a level."""
    pairs = nodes.where("parent_id is not null").select(F.col("parent_id").alias("top"), "id")
    out = pairs
    for _ in range(depth - 1):
        pairs = pairs.join(nodes.where("parent_id is not null").select(F.col("parent_id").alias("id"), F.col("id").alias("below")), "id").select("top", F.col("below").alias("id"))
        out = out.union(pairs)
    return out.groupBy("top").agg(F.count("*").alias("n")).withColumnRenamed("top", "id")


def expand_instances(nodes: DataFrame, edges: DataFrame, instances: DataFrame, inner_nodes: DataFrame, inner_edges: DataFrame, boundary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace instances (id, definition) by their definitions' graphs.

    Inner ids get the instance's id as a prefix. An edge end at an instance's port goes to the boundary node
    (definition, port, direction, node_id) of that port: input for arriving, output for leaving edges; an end without one
    is an error.
    """
    kept = nodes.join(instances.select("id"), "id", "left_anti").select("id", "kind", "label")
    inner = instances.join(inner_nodes.withColumnRenamed("id", "child"), "definition").select(F.concat_ws("/", "id", "child").alias("id"), "kind", "label")
    new_edges = instances.withColumnRenamed("id", "inst").join(inner_edges, "definition").select(F.concat_ws("/", "inst", "id").alias("id"), F.concat_ws("/", "inst", "source_node").alias("source_node"), F.lit(None).cast("string").alias("source_port"), F.concat_ws("/", "inst", "target_node").alias("target_node"), F.lit(None).cast("string").alias("target_port"))
    out = edges.select("id", "source_node", "source_port", "target_node", "target_port")
    for end, direction in (("source", "output"), ("target", "input")):
        doors = instances.join(boundary.where(F.col("direction") == direction), "definition").select(F.col("id").alias(f"{end}_node"), F.col("port").alias(f"{end}_port"), F.concat_ws("/", "id", "node_id").alias("door"))
        met = out.join(instances.select(F.col("id").alias(f"{end}_node"), F.lit(True).alias("hit")), f"{end}_node", "left").join(doors, [f"{end}_node", f"{end}_port"], "left")
        lost = F.raise_error(F.concat(F.lit("no boundary node for "), f"{end}_node", F.lit(" "), F.coalesce(f"{end}_port", F.lit("?"))))
        met = met.withColumn("door", F.when(F.col("hit") & F.col("door").isNull(), lost.cast("string")).otherwise(F.col("door")))
        out = met.withColumn(f"{end}_node", F.coalesce("door", f"{end}_node")).withColumn(f"{end}_port", F.when(F.col("door").isNull(), F.col(f"{end}_port"))).select("id", "source_node", "source_port", "target_node", "target_port")
    return kept.union(inner).distinct(), out.union(new_edges).distinct()


def group_parents(children: DataFrame) -> DataFrame:
    """group_id, parent: the smallest group that holds all its nodes and is larger, or is an id prefix; ties by id."""
    sizes = children.groupBy("group_id").agg(F.count("*").alias("size"))
    shared = children.join(children.withColumnRenamed("group_id", "parent"), "child_node_id").where("group_id <> parent").groupBy("group_id", "parent").agg(F.count("*").alias("shared"))
    met = shared.join(sizes, "group_id").join(sizes.select(F.col("group_id").alias("parent"), F.col("size").alias("parent_size")), "parent")
    prefix = F.col("group_id").startswith(F.concat("parent", F.lit("/")))
    held = met.where((F.col("shared") == F.col("size")) & ((F.col("parent_size") > F.col("size")) | prefix))
    best = Window.partitionBy("group_id").orderBy("parent_size", "parent")
    return held.withColumn("n", F.row_number().over(best)).where("n = 1").select("group_id", "parent")


def change_rollup(nodes: DataFrame, depth: int) -> DataFrame:
    """id, state of every inner node, bottom-up by level: contains if it or any node below has changed, else unknown if the change
    of any of them is not known (null), else none."""
    nodes = nodes.withColumn("code", F.when(F.col("changed").isNull(), 1).when(F.col("changed"), 2).otherwise(0))
    level = nodes.select(F.col("id").alias("top"), "code")
    out = level
    parents = nodes.select("id", "parent_id").where("parent_id is not null")
    for _ in range(depth):
        level = level.join(parents.select(F.col("id").alias("top"), F.col("parent_id").alias("up")), "top").groupBy("up").agg(F.max("code").alias("code")).withColumnRenamed("up", "top")
        out = out.union(level)
    inner = parents.select(F.col("parent_id").alias("top")).distinct()
    found = out.join(inner, "top", "left_semi").groupBy("top").agg(F.max("code").alias("code"))
    return found.select(F.col("top").alias("id"), F.when(F.col("code") == 2, "contains").when(F.col("code") == 1, "unknown").otherwise("none").alias("state"))


def reachable_evidence(roots: DataFrame, children: DataFrame, evidence: DataFrame, most_pairs: int = LIMITS["hierarchy_pairs"], most_levels: int = LIMITS["hierarchy_depth"]) -> DataFrame:
    """root, state of each root: found if its own or any definition below it (module, child) has evidence (module, state); else
    unknown if any of these is unknown or missing from the evidence, or if there are more definitions below than ``most_pairs``
    or levels than ``most_levels``; else absent.

    Breadth first over distinct definitions, all roots in the same rounds; a root that has found evidence, or would exceed a
    limit with its next level, goes no further. Each level is a table in the shared folder.
    """
    level = materialise(roots.select("root", F.col("root").alias("module")), "evidence-level")
    seen, said = level, None
    for _ in range(most_levels):
        state = F.when(F.max(F.coalesce(F.col("state") == "found", F.lit(False))), 2).when(F.max(F.coalesce(F.col("state") != "absent", F.lit(True))), 1).otherwise(0)
        own = level.join(evidence.select("module", "state"), "module", "left").groupBy("root").agg(state.alias("code"))
        said = own if said is None else said.union(own)
        said = materialise(said.groupBy("root").agg(F.max("code").alias("code")), "evidence-said")
        going = level.join(said.where("code < 2").select("root"), "root", "left_semi")
        nxt = going.join(children.select("module", "child"), "module").select("root", F.col("child").alias("module")).distinct().join(seen, ["root", "module"], "left_anti")
        nxt = materialise(nxt, "evidence-level")
        if nxt.isEmpty():
            break
        sizes = seen.union(nxt).groupBy("root").agg(F.count("*").alias("n"))
        over = nxt.select("root").distinct().join(sizes.where(F.col("n") > most_pairs).select("root"), "root", "left_semi")
        said = materialise(said.union(over.select("root", F.lit(1))), "evidence-said")
        level = materialise(nxt.join(over, "root", "left_anti"), "evidence-level")
        seen = materialise(seen.union(level), "evidence-seen")
    else:
        said = said.union(level.select("root", F.lit(1)).distinct())
    last = said.groupBy("root").agg(F.max("code").alias("code"))
    return last.select("root", F.when(F.col("code") == 2, "found").when(F.col("code") == 1, "unknown").otherwise("absent").alias("state"))
