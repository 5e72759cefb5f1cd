import json
from collections import Counter
from urllib.parse import quote

import pytest

from weftgraph.operators import expansion
from weftgraph.operators.expansion import SCHEMAS, Comparison

SAFE = "!'()*~-._"


def inner(a, b):
    return "cmp:projection:" + quote(json.dumps([a, b], separators=(",", ":"), ensure_ascii=False), safe=SAFE)


class Made:
    """Rows of a comparison, by hand: objects are named alike on all sides, with a letter before them."""

    def __init__(self):
        self.rows = {k: [] for k in SCHEMAS}

    def node(self, scope, name, kind, ports=(), sides="rc", status="unchanged", method="exact", score=1.0, label=None, port_method="exact", names=None):
        r, c = (f"r-{name}" if "r" in sides else None), (f"c-{name}" if "c" in sides else None)
        word = status if sides == "rc" else "removed" if r else "added"
        met = (method, score) if sides == "rc" else (None, None)
        label = label or name
        definition = name if kind == "module" else None
        self.rows["nodes"].append((scope, f"u-{name}", word, *met, r, c, kind, label, definition, kind if r else None, kind if c else None, label if r else None, label if c else None))
        for p in ports:
            a, b = (names or {}).get(p, (p, p))
            rp, cp = r and f"r-{name}-{p}", c and f"c-{name}-{p}"
            self.rows["ports"].append((scope, f"u-{name}", f"u-{name}-{p}", word, port_method if met[0] else None, met[1], r, c, rp, cp, a if r else None, b if c else None))
        return self

    def edge(self, scope, name, source, target, sides="rc", status="unchanged", method="structural", score=0.9):
        """source, target: (node, port)."""
        one = lambda s: (f"{s}-{name}", f"{s}-{source[0]}", f"{s}-{source[0]}-{source[1]}", f"{s}-{target[0]}", f"{s}-{target[0]}-{target[1]}") if s in sides else None
        met = (method, score) if sides == "rc" else (None, None)
        self.rows["edges"].append((scope, f"u-{name}", status if sides == "rc" else "removed" if sides == "r" else "added", *met, one("r"), one("c")))
        return self

    def group(self, scope, name, members, sides="rc", status="unchanged"):
        met = ("exact", 1.0) if sides == "rc" else (None, None)
        self.rows["groups"].append((scope, f"u-{name}", status, *met, f"r-{name}" if "r" in sides else None, f"c-{name}" if "c" in sides else None, name, "d"))
        self.rows["children"] += [(scope, f"u-{name}", {"r": "ref", "c": "cand", "u": "union"}[s], f"{s}-{m}") for s in sides + "u" for m in members]
        return self

    def build(self, spark):
        return Comparison(*(spark.createDataFrame(self.rows[k], SCHEMAS[k]) for k in SCHEMAS))


def top(made, scope="top", sides="rc", name="inst", also=("out",), **more):
    made.node(scope, "in", "input", ["Y"], sides).node(scope, name, "module", ["a", "y"], sides, **more).node(scope, "out", "output", ["A"], sides)
    return made.edge(scope, "incoming", ("in", "Y"), (name, "a"), sides).edge(scope, "outgoing", (name, "y"), ("out", "A"), sides).group(scope, "enclosing", [name, *also], sides, "unchanged" if sides == "rc" else "removed" if sides == "r" else "added")


def child(made, scope="child", sides="rc", **more):
    made.node(scope, "pa", "input", ["Y"], sides, label="a", **more).node(scope, "reg", "register", ["D", "Q"], sides).node(scope, "py", "output", ["A"], sides, label="y")
    made.edge(scope, "e1", ("pa", "Y"), ("reg", "D"), sides).edge(scope, "e2", ("reg", "Q"), ("py", "A"), sides)
    return made.group(scope, "cluster", ["reg"], sides)


def expanded(spark, made, plan=(("top", "u-inst", "child"),), **limits):
    return expansion.expand(made.build(spark), spark.createDataFrame(plan, "scope string, id string, child string"), limits or None)


def by_id(df, scope="top"):
    rows = [r for r in df.collect() if r.scope == scope]
    assert max(Counter(r.id for r in rows).values()) == 1
    return {r.id: r for r in rows}


def test_a_matched_instance_becomes_a_group_of_its_scoped_child(spark):
    c = expanded(spark, child(top(Made())))
    nodes, edges, groups = by_id(c.nodes), by_id(c.edges), by_id(c.groups)
    assert set(nodes) == {"u-in", "u-out", *(inner("u-inst", f"u-{n}") for n in ("pa", "reg", "py"))}
    pa = nodes[inner("u-inst", "u-pa")]
    assert (pa.ref_id, pa.cand_id, pa.status) == (inner("r-inst", "r-pa"), inner("c-inst", "c-pa"), "unchanged")
    into = edges["u-incoming"]
    assert tuple(into.ref) == ("r-incoming", "r-in", "r-in-Y", inner("r-inst", "r-pa"), inner("r-inst", "r-pa-Y")) and into.cand.target_port == inner("c-inst", "c-pa-Y")
    assert edges["u-outgoing"].ref.source_node == inner("r-inst", "r-py")
    assert edges[inner("u-inst", "u-e1")].cand.id == inner("c-inst", "c-e1") and len(edges) == 4
    assert groups["u-inst"].status == "unchanged" and (groups["u-inst"].ref_id, groups["u-inst"].cand_id, groups["u-inst"].method) == ("r-inst", "c-inst", "exact")
    assert groups[inner("u-inst", "u-cluster")].ref_id == inner("r-inst", "r-cluster") and groups["u-enclosing"].status == "unchanged"
    members = {(r.group_id, r.side): set() for r in c.children.collect() if r.scope == "top"}
    for r in c.children.collect():
        if r.scope == "top":
            members[r.group_id, r.side].add(r.node_id)
    assert members["u-inst", "ref"] == {inner("r-inst", f"r-{n}") for n in ("pa", "reg", "py")}
    assert members["u-enclosing", "cand"] == {"c-out"} | {inner("c-inst", f"c-{n}") for n in ("pa", "reg", "py")}
    assert members["u-enclosing", "union"] == {"u-out"} | {inner("u-inst", f"u-{n}") for n in ("pa", "reg", "py")}
    assert {r.id for r in c.ports.collect() if r.scope == "top"} == {"u-in-Y", "u-out-A", *(inner("u-inst", f"u-{p}") for p in ("pa-Y", "reg-D", "reg-Q", "py-A"))}
    # the child's own comparison stays
    assert len(by_id(c.nodes, "child")) == 3


@pytest.mark.parametrize("sides, word", [("r", "removed"), ("c", "added")])
def test_one_sided_instances_need_an_empty_peer(spark, sides, word):
    c = expanded(spark, child(top(Made(), sides=sides), sides=sides))
    assert {r.status for r in by_id(c.nodes).values()} == {word} and by_id(c.groups)["u-inst"].status == word
    assert by_id(c.edges)["u-incoming"].status == word
    with pytest.raises(Exception, match="cannot expand a child that has it"):
        expanded(spark, child(top(Made(), sides=sides))).groups.collect()


def test_an_edge_whose_ends_part_is_removed_and_added(spark):
    # each side's boundary a is another node of the child
    made = top(Made())
    made.node("child", "p1", "input", ["Y"], label="one", names={"Y": ("a", "z")}).node("child", "p2", "input", ["Y"], label="two", names={"Y": ("z", "a")}).node("child", "py", "output", ["A"], label="y")
    c = expanded(spark, made)
    edges = by_id(c.edges)
    a, b = edges[inner("u-incoming", "reference-endpoint")], edges[inner("u-incoming", "candidate-endpoint")]
    assert (a.status, b.status, a.cand, b.ref, a.method) == ("removed", "added", None, None, None) and "u-incoming" not in edges
    assert a.ref.target_node == inner("r-inst", "r-p1") and b.cand.target_node == inner("c-inst", "c-p2")


def test_changes_and_heuristic_matches_pass_on(spark):
    c = expanded(spark, child(top(Made()), method="heuristic", score=0.6))
    edges, groups = by_id(c.edges), by_id(c.groups)
    assert (edges["u-incoming"].method, edges["u-incoming"].score) == ("heuristic", 0.6) and edges["u-outgoing"].method == "structural"
    assert {(groups[g].method, groups[g].score, groups[g].status) for g in ("u-inst", "u-enclosing")} == {("heuristic", 0.6, "unchanged")}
    assert groups[inner("u-inst", "u-cluster")].method == "exact"
    made = child(top(Made()))
    made.node("child", "new", "register", sides="c")
    groups = by_id(expanded(spark, made).groups)
    assert groups["u-inst"].status == groups["u-enclosing"].status == "modified"


def test_ungrouped_boundaries_come_first_and_others_raise(spark):
    made = child(top(Made())).node("child", "hidden", "input", ["Y"], label="a").group("child", "deep", ["hidden"])
    assert by_id(expanded(spark, made).edges)["u-incoming"].ref.target_node == inner("r-inst", "r-pa")
    made = child(top(Made())).node("child", "second", "input", ["Y"], label="a")
    with pytest.raises(Exception, match="ambiguous input a"):
        expanded(spark, made)
    made = top(Made()).node("child", "py", "output", ["A"], label="y")
    with pytest.raises(Exception, match="no input a"):
        expanded(spark, made)
    with pytest.raises(Exception, match="not an expandable"):
        expanded(spark, child(top(Made())), plan=[("top", "u-in", "child")])
    with pytest.raises(Exception, match="8 ports, exceeding budget 6|objects, exceeding budget 4"):
        expanded(spark, child(top(Made())), objects=4, ports=99)


def test_shared_children_are_flattened_once_and_loops_raise(spark):
    made = child(top(top(Made()), scope="mid", also=()), scope="leaf")
    # top holds mid, which holds leaf; the instance's ports must be mid's boundary
    made.rows["nodes"] = [(r[0], *r[1:8], {"in": "a", "out": "y"}.get(r[8], r[8]) if r[0] == "mid" else r[8], r[9], *r[10:12], *(({"in": "a", "out": "y"}.get(x, x) if r[0] == "mid" else x) for x in r[12:])) for r in made.rows["nodes"]]
    made.node("top", "again", "module", ["a", "y"])
    links = [("top", "u-inst", "mid"), ("top", "u-again", "mid"), ("mid", "u-inst", "leaf")]
    frame = lambda rows: spark.createDataFrame(rows, "scope string, id string, child string")
    c = expansion.flatten(made.build(spark), frame(links))
    nodes = by_id(c.nodes)
    deep = inner("u-inst", inner("u-inst", "u-reg"))
    assert nodes[deep].ref_id == inner("r-inst", inner("r-inst", "r-reg")) and inner("u-again", inner("u-inst", "u-reg")) in nodes and len(nodes) == 2 + 2 * 5
    assert by_id(c.edges)["u-incoming"].ref.target_node == inner("r-inst", "r-in")
    assert {"u-inst", "u-again", inner("u-inst", "u-inst"), inner("u-again", inner("u-inst", "u-cluster"))} <= set(by_id(c.groups))
    with pytest.raises(ValueError, match="hold themselves"):
        expansion.flatten(made.build(spark), frame([("mid", "u-inst", "mid")]))
