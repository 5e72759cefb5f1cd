"""One-to-one matching of two snapshots' objects, stage by stage on what earlier stages left.

Every table carries ``scope``, the pair of modules it belongs to (a constant where it is left out), and every key includes it,
so all module pairs of a comparison go through the same stages at once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.session import materialise, shared_dir, shuffled

# Scores of the certain stages, and the least score of a heuristic match.
SCORES = {"exact": 1.0, "named": 0.98, "source": 0.95, "structural": 0.9}
LEAST_SCORE = 0.65
#: Words of 64 bits (a power of two) that hold the hashes of unmatched nodes.
WORDS = 1 << 20
NODE = ["scope", "id"]
MATCH = ["scope", "ref_id", "cand_id"]


@dataclass
class Graph:
    """One side of a comparison: nodes (id, kind, label, glyph, definition_name, parameters_json), ports (node_id, port_id, name,
    direction, role, index, width), edges (id, source_node, source_port, target_node, target_port, ...), origins (id, file, line)."""

    nodes: DataFrame
    ports: DataFrame | None = None
    edges: DataFrame | None = None
    origins: DataFrame | None = None


def scoped(df: DataFrame) -> DataFrame:
    return df if "scope" in df.columns else df.withColumn("scope", F.lit(""))


def _or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def residue(nodes: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Nodes of one side (``ref`` or ``cand``) without a match."""
    return scoped(nodes).join(shuffled(scoped(matches).select("scope", F.col(f"{side}_id").alias("id"))), NODE, "left_anti")


def exact_id(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Equal id and kind; operators also need an equal glyph (their label, where they have none)."""
    shown = lambda df, n: scoped(df).select("scope", "id", "kind", F.coalesce(_or_null(df, "glyph"), F.col("label")).alias(n))
    met = shown(ref, "r").join(shown(cand, "c"), ["scope", "id", "kind"])
    return met.where((F.col("kind") != "operator") | F.col("r").eqNullSafe(F.col("c"))).select("scope", F.col("id").alias("ref_id"), F.col("id").alias("cand_id"))


def met_once(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """scope, key, r, c of the keys that one id holds on each side; frames (scope, id, key, ...), r and c hold all but key."""

    def side(df: DataFrame, own: str, other: str, like: DataFrame) -> DataFrame:
        row = lambda d: F.struct("id", *[c for c in d.columns if c not in ("scope", "id", "key")])
        none = F.lit(None).cast(like.select(row(like).alias("x")).schema["x"].dataType)
        return df.where("key is not null").select("scope", "key", row(df).alias(own), none.alias(other)).select("scope", "key", "r", "c")

    both = side(ref, "r", "c", cand).union(side(cand, "c", "r", ref))
    held = both.groupBy("scope", "key").agg(F.min("r").alias("r"), F.max("r.id").alias("r2"), F.min("c").alias("c"), F.max("c.id").alias("c2"))
    return held.where("r.id = r2 and c.id = c2").drop("r2", "c2")


def unique_keys(ref_keys: DataFrame, cand_keys: DataFrame) -> DataFrame:
    """Match by keys: frames (id, key), several keys an id allowed.

    A key counts if one id holds it on each side; an id is matched if all its counting keys lead to one partner, which
    leads back to it alone.
    """
    own = lambda df: scoped(df).select("scope", "id", "key")
    pairs = met_once(own(ref_keys), own(cand_keys)).select("scope", F.col("r.id").alias("ref_id"), F.col("c.id").alias("cand_id")).distinct()
    n = lambda side: F.count("*").over(Window.partitionBy("scope", side))
    return pairs.withColumns({"a": n("ref_id"), "b": n("cand_id")}).where("a = 1 and b = 1").select(*MATCH)


def port_token(prefix: str = "") -> Column:
    """Structure of a port: direction, role, index."""
    c = lambda n: F.col(f"{prefix}{n}")
    return F.concat_ws("|", c("direction"), F.coalesce(c("role"), F.lit("")), F.coalesce(c("index").cast("string"), F.lit("")))


def port_signatures(ports: DataFrame) -> DataFrame:
    """id, signature: the sorted (direction, role, index) of a node's ports; names and widths don't count."""
    tokens = F.array_join(F.array_sort(F.collect_list(port_token())), ",")
    return scoped(ports).groupBy("scope", F.col("node_id").alias("id")).agg(tokens.alias("signature"))


def signed(graph: Graph) -> DataFrame:
    """The graph's nodes with their port signature; nodes without ports have an empty one."""
    nodes = scoped(graph.nodes)
    if graph.ports is None or "signature" in nodes.columns:
        return nodes if "signature" in nodes.columns else nodes.withColumn("signature", F.lit(""))
    return nodes.join(shuffled(port_signatures(graph.ports)), NODE, "left").withColumn("signature", F.coalesce("signature", F.lit("")))


def named_keys(nodes: DataFrame) -> DataFrame:
    """(id, key): label, definition and signature of modules; kind, label and signature of boundary nodes."""
    definition = F.when(F.col("kind") == "module", F.col("definition_name"))
    own = scoped(nodes).where(F.col("kind").isin("module", "input", "output", "inout"))
    return own.select("scope", "id", F.struct("kind", "label", definition.alias("d"), F.coalesce(_or_null(nodes, "signature"), F.lit("")).alias("s")).alias("key"))


def source_keys(nodes: DataFrame, origins: DataFrame, line_map: DataFrame, side: str) -> DataFrame:
    """(id, key) of nodes by (kind, signature, candidate path, candidate line).

    Reference places go through the line map (ref_path, ref_line, cand_path, cand_line); candidate ones count in mapped files.
    """
    place = scoped(origins).select("scope", "id", scalars.normal_path(F.col("file")).alias("path"), F.col("line").cast("long").alias("line"))
    own = scoped(nodes).join(place, NODE)
    if side == "ref":
        to = line_map.select(scalars.normal_path(F.col("ref_path")).alias("path"), F.col("ref_line").alias("line"), scalars.normal_path(F.col("cand_path")).alias("to_path"), F.col("cand_line").alias("to_line"))
        own = own.join(to, ["path", "line"])
    else:
        own = own.join(line_map.select(scalars.normal_path(F.col("cand_path")).alias("path")).distinct(), "path", "left_semi").withColumns({"to_path": F.col("path"), "to_line": F.col("line")})
    return own.select("scope", "id", F.struct("kind", F.coalesce(_or_null(nodes, "signature"), F.lit("")).alias("s"), "to_path", F.col("to_line").cast("long").alias("l")).alias("key"))


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that may have an end among ``nodes`` (scope, id): every edge that has one, and few others.

    The hashes of the nodes are bits of at most ``WORDS`` words, whatever the size of the tables; these are broadcast, so that
    edges between other nodes are dropped where they are read and never shuffled.
    """
    hashed = lambda node: F.xxhash64("scope", node)
    word = lambda node: hashed(node).bitwiseAND(F.lit(WORDS - 1))
    bit = lambda node: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed(node), 58).cast("int"))
    held = materialise(nodes.select(word("id").alias("word"), bit("id").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), "open-words")
    out, hit = edges, F.lit(False)
    for end in ("source", "target"):
        own = F.broadcast(held.select(F.col("word").alias(f"{end}_word"), F.col("bits").alias(f"{end}_bits")))
        out = out.withColumn(f"{end}_word", word(f"{end}_node")).join(own, f"{end}_word", "left")
        hit = hit | F.coalesce(F.col(f"{end}_bits").bitwiseAND(bit(f"{end}_node")) != 0, F.lit(False))
    return out.where(hit).select(edges.columns)


def ended(graph: Graph) -> DataFrame:
    """scope, id, source_node, s_token, target_node, t_token: edges with the structure of the ports at both ends; columns that end
    in _sig stay, and edges without an id have none."""
    edges = scoped(graph.edges)
    kept, own = [c for c in edges.columns if c.endswith("_sig")], ["scope", *[c for c in edges.columns if c == "id"]]
    out = edges.select(*own, "source_node", _or_null(edges, "source_port").alias("source_port"), "target_node", _or_null(edges, "target_port").alias("target_port"), *kept)
    for end, token in (("source", "s_token"), ("target", "t_token")):
        if graph.ports is None:
            out = out.withColumn(token, F.lit(None).cast("string"))
        else:
            ports = scoped(graph.ports).select("scope", F.col("node_id").alias(f"{end}_node"), F.col("port_id").alias(f"{end}_port"), port_token().alias(token))
            out = out.join(shuffled(ports), ["scope", f"{end}_node", f"{end}_port"], "left")
    return out.select(*own, "source_node", "s_token", "target_node", "t_token", *kept)


def neighbour_tokens(ends: DataFrame, partner: DataFrame) -> DataFrame:
    """scope, id, token: direction, candidate id of the neighbour's match (scope, id, pair) and both ports, for every incident
    edge with a matched far end; a self-loop gives one of each direction."""
    known = partner.select("scope", "id", "pair")
    part = lambda own, far, a, b, word: ends.join(shuffled(known.withColumnRenamed("id", far)), ["scope", far]).select("scope", F.col(own).alias("id"), F.struct(F.lit(word).alias("dir"), "pair", F.col(a).alias("own"), F.col(b).alias("far")).alias("token"))
    return part("source_node", "target_node", "s_token", "t_token", "out").union(part("target_node", "source_node", "t_token", "s_token", "in"))


# Four sums of 32-bit halves of two hashes, and a count: a multiset's hash that grows by addition.
_SUMS = [f"h{k}" for k in range(5)]


def _token_hashes(tokens: DataFrame) -> DataFrame:
    """Tokens (side, scope, id, sig, token) as summands."""
    low, high = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)), lambda c: F.shiftrightunsigned(c, 32)
    a, b = F.xxhash64("token"), F.xxhash64(F.lit(7), "token")
    return tokens.select("side", "scope", "id", "sig", low(a).alias("h0"), high(a).alias("h1"), low(b).alias("h2"), high(b).alias("h3"), F.lit(1).cast("long").alias("h4"))


def structural_fixpoint(ref: Graph, cand: Graph, matches: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """Structural matches: kind, glyph, port signature and the multiset of (direction, matched neighbour, ports) agree, and one
    unmatched node alone holds them on each side. Synchronous rounds until one finds nothing; at ``most_rounds`` an error.

    The state holds a hash of the tokens of every unmatched node next to a match. A round reads it, takes the keys held once
    on both sides, and adds the tokens that the new matches give to their unmatched neighbours; edges without an unmatched end
    are left out from the start. Each round is a table in the shared folder, and all modules go through the same rounds.
    """
    spark, folder = matches.sparkSession, f"{shared_dir(matches.sparkSession)}/structural-{uuid.uuid4().hex}"
    matches = scoped(matches)
    live, state = None, None
    for side, graph, own in (("ref", ref, "ref_id"), ("cand", cand, "cand_id")):
        known = matches.select("scope", F.col(own).alias("id"), F.col("cand_id").alias("pair"))
        nodes = signed(Graph(residue(graph.nodes, matches, side), graph.ports))
        open_nodes = nodes.select("scope", "id", F.xxhash64("kind", F.coalesce(_or_null(nodes, "glyph"), F.lit("")), "signature").alias("sig"))
        open_nodes = materialise(open_nodes, "open-nodes")
        # only edges with an unmatched end go on to the ports, and only their ends
        ends = scoped(graph.edges)
        ends = touching(ends.select(*[c for c in ("scope", "source_node", "source_port", "target_node", "target_port") if c in ends.columns]), open_nodes)
        for end in ("source", "target"):
            ends = ends.join(shuffled(open_nodes.select("scope", F.col("id").alias(f"{end}_node"), F.col("sig").alias(f"{end}_sig"))), ["scope", f"{end}_node"], "left")
        live_ends = Graph(graph.nodes, graph.ports, materialise(ends.where("source_sig is not null or target_sig is not null"), "open-edges"))
        ends = materialise(ended(live_ends).withColumn("side", F.lit(side)), "live-edges")
        hashed = _token_hashes(neighbour_tokens(ends, known).join(shuffled(open_nodes), NODE).withColumn("side", F.lit(side)))
        live = ends if live is None else live.unionByName(ends)
        state = hashed if state is None else state.unionByName(hashed)
    keys = ["side", "scope", "id", "sig"]
    sums = [F.sum(h).alias(h) for h in _SUMS]
    state = materialise(state.groupBy(*keys).agg(*sums), "structural-state")
    for k in range(most_rounds):
        one = state.groupBy("scope", "sig", *_SUMS).agg(*[f(F.when(F.col("side") == s, F.col("id"))).alias(f"{s}{i}") for s in ("ref", "cand") for i, f in enumerate((F.min, F.max))])
        one.where("ref0 = ref1 and cand0 = cand1").select("scope", F.col("ref0").alias("ref_id"), F.col("cand0").alias("cand_id")).write.parquet(f"{folder}/round={k}")
        new = spark.read.schema("scope string, ref_id string, cand_id string").parquet(f"{folder}/round={k}")
        if new.isEmpty():
            break
        done = new.select(F.lit("ref").alias("side"), "scope", F.col("ref_id").alias("id"), F.col("cand_id").alias("pair")).union(new.select(F.lit("cand"), "scope", "cand_id", "cand_id"))
        part = lambda own, far, a, b, word: live.where(f"{own}_sig is not null").join(done.withColumnRenamed("id", f"{far}_node"), ["side", "scope", f"{far}_node"]).select("side", "scope", F.col(f"{own}_node").alias("id"), F.col(f"{own}_sig").alias("sig"), F.struct(F.lit(word).alias("dir"), "pair", F.col(a).alias("own"), F.col(b).alias("far")).alias("token"))  # noqa: B023, E731
        added = part("source", "target", "s_token", "t_token", "out").union(part("target", "source", "t_token", "s_token", "in"))
        grown = state.unionByName(_token_hashes(added)).groupBy(*keys).agg(*sums)
        taken = spark.read.option("basePath", folder).schema("scope string, ref_id string, cand_id string").parquet(folder)
        gone = taken.select(F.lit("ref").alias("side"), "scope", F.col("ref_id").alias("id")).union(taken.select(F.lit("cand"), "scope", "cand_id"))
        state = materialise(grown.join(gone, ["side", "scope", "id"], "left_anti"), "structural-state")
    else:
        raise RuntimeError(f"structural matching did not end in {most_rounds} rounds")
    return spark.read.option("basePath", folder).schema("scope string, ref_id string, cand_id string").parquet(folder).select(*MATCH)


def conservative(ref: Graph, cand: Graph, line_map: DataFrame | None = None) -> DataFrame:
    """scope, ref_id, cand_id, method, score of the certain stages: exact id, names, mapped source places, structure.

    Each stage works on what the stages before it left, and writes its own matches alone; port signatures are made of nodes
    without an exact match.
    """
    tag = lambda df, m: materialise(df.select(*MATCH, F.lit(m).alias("method"), F.lit(SCORES[m]).alias("score")), m)
    found = tag(exact_id(ref.nodes, cand.nodes), "exact")
    a, b = (materialise(signed(Graph(residue(g.nodes, found, s), g.ports)), f"{s}-nodes") for g, s in ((ref, "ref"), (cand, "cand")))
    new = tag(unique_keys(named_keys(a), named_keys(b)), "named")
    found = found.union(new)
    if line_map is not None and ref.origins is not None and cand.origins is not None:
        a, b = residue(a, new, "ref"), residue(b, new, "cand")
        new = tag(unique_keys(source_keys(a, ref.origins, line_map, "ref"), source_keys(b, cand.origins, line_map, "cand")), "source")
        found = found.union(new)
    if ref.edges is not None and cand.edges is not None:
        a, b = residue(a, new, "ref"), residue(b, new, "cand")
        taken = structural_fixpoint(Graph(a, ref.ports, ref.edges), Graph(b, cand.ports, cand.edges), found)
        found = found.union(taken.select(*MATCH, F.lit("structural").alias("method"), F.lit(SCORES["structural"]).alias("score")))
    return found


def mutual_maximum(pairs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Pairs (ref_id, cand_id, score) that are best for both ends; ties go to the smaller partner id, both ways."""
    for_ref = Window.partitionBy("ref_id").orderBy(F.desc("score"), "cand_id")
    for_cand = Window.partitionBy("cand_id").orderBy(F.desc("score"), "ref_id")
    own = pairs.where(F.col("score") >= least)
    return own.withColumns({"a": F.row_number().over(for_ref), "b": F.row_number().over(for_cand)}).where("a = 1 and b = 1").drop("a", "b")


def greedy_assignment(pairs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """One-to-one pairs of every scope in the order score descending, ref id, cand id.

    Each round takes the pairs that come first in that order for both of their ends, which the greedy order would also
    take, and removes their ends' other pairs; it ends when no pair is left.
    """
    left, taken = materialise(scoped(pairs).where(F.col("score") >= least).select(*MATCH, "score"), "pairs"), None
    while True:
        order = [F.desc("score"), F.asc("ref_id"), F.asc("cand_id")]
        first = lambda side: F.row_number().over(Window.partitionBy("scope", side).orderBy(*order))  # noqa: B023, E731
        best = materialise(left.withColumns({"a": first("ref_id"), "b": first("cand_id")}).where("a = 1 and b = 1").drop("a", "b"), "best")
        if best.isEmpty():
            break
        taken = best if taken is None else materialise(taken.unionByName(best), "taken")
        left = materialise(left.join(best.select("scope", "ref_id"), ["scope", "ref_id"], "left_anti").join(best.select("scope", "cand_id"), ["scope", "cand_id"], "left_anti"), "pairs")
    return taken if taken is not None else left.limit(0)


def top_candidates(pairs: DataFrame, k: int = 32) -> DataFrame:
    """The k best candidates of each reference node by pre_score, strategy, id."""
    order = Window.partitionBy("ref_id").orderBy(F.desc("pre_score"), *([F.col("strategy")] if "strategy" in pairs.columns else []), "cand_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rotating_page(ref: DataFrame, cand: DataFrame, key: str, k: int) -> DataFrame:
    """For each reference node a page of k candidates of its key's bucket, starting at (its ordinal * k) mod size."""
    place = cand.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("id")) - 1)
    sizes = cand.groupBy(key).agg(F.count("*").alias("size"))
    turn = ref.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("id")) - 1).join(sizes, key)
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(k).cast("long"), F.col("size")) - 1))
    asked = turn.select(F.col("id").alias("ref_id"), key, "ordinal", "size", step.alias("step")).withColumn("pos", (F.col("ordinal") * k + F.col("step")) % F.col("size"))
    return asked.join(place.select(F.col("id").alias("cand_id"), key, F.col("pos").cast("long").alias("pos")), [key, "pos"]).select("ref_id", "cand_id")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs whose score is the largest of both of their ends; ties stay."""
    best = lambda side: F.max("score").over(Window.partitionBy("scope", side))
    return scoped(pairs).withColumns({"x": best("ref_id"), "y": best("cand_id")}).where("score = x and score = y").drop("x", "y")


def with_dependencies(entities: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Method heuristic and least score where a dependency (id, dep_score, dep_method) of an entity is heuristic."""
    weak = dependencies.where("dep_method = 'heuristic'").groupBy("id").agg(F.min("dep_score").alias("weakest"), F.countDistinct("dep_id").alias("n_weak"))
    joined = entities.join(weak, "id", "left")
    return joined.select("id", F.when(F.col("weakest").isNotNull(), "heuristic").otherwise(F.col("method")).alias("method"), F.least("score", "weakest").alias("score"), F.coalesce("n_weak", F.lit(0)).alias("n_weak"))
