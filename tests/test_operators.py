import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions.linediff import matching_lines
from weftgraph.operators import connect, diff, fuzzy, graph, matching, provenance
from weftgraph.streaming import sessions


def chain(spark, p, n):
    nodes = spark.createDataFrame([(f"{p}{i}", "register", f"{p}{i}") for i in range(n)], "id string, kind string, label string")
    edges = spark.createDataFrame([(f"{p}e{i}", f"{p}{i}", f"{p}{i + 1}") for i in range(n - 1)], "id string, source_node string, target_node string")
    return matching.Graph(nodes, None, edges)


def test_structural_fixpoint_walks_a_chain(spark):
    n = 12
    seed = spark.createDataFrame([("a0", "b0")], "ref_id string, cand_id string")
    found = matching.structural_fixpoint(chain(spark, "a", n), chain(spark, "b", n), seed)
    assert {(r.ref_id, r.cand_id) for r in found.collect()} == {(f"a{i}", f"b{i}") for i in range(1, n)}
    with pytest.raises(RuntimeError):
        matching.structural_fixpoint(chain(spark, "a", n), chain(spark, "b", n), seed, most_rounds=2)


def plain_structural(ref, cand, matches):
    """Synchronous rounds over dictionaries: nodes {id: (kind, glyph, signature)}, edges (source, target, s token, t token)."""
    pair = {("r", a): b for a, b in matches} | {("c", b): b for _, b in matches}
    found = set()
    while True:
        keys = {}
        for side, (nodes, edges) in (("r", ref), ("c", cand)):
            for i, own in nodes.items():
                if (side, i) in pair:
                    continue
                toks = sorted([("out", pair[side, t], x, y) for s, t, x, y in edges if s == i and (side, t) in pair] + [("in", pair[side, s], y, x) for s, t, x, y in edges if t == i and (side, s) in pair])
                if toks:
                    keys.setdefault((own, tuple(toks)), {}).setdefault(side, []).append(i)
        new = {(v["r"][0], v["c"][0]) for v in keys.values() if len(v.get("r", ())) == len(v.get("c", ())) == 1}
        if not new:
            return found
        found |= new
        for a, b in new:
            pair["r", a] = pair["c", b] = b


def test_structural_matches_of_random_graphs_with_parallel_edges_and_loops(spark):
    r = random.Random(6)
    n, kinds = 40, ["register", "mux"]
    kind = [r.choice(kinds) for _ in range(n)]
    wires = [(r.randrange(n), r.randrange(n), r.choice("AB"), r.choice("AB")) for _ in range(90)]
    shuffled = list(range(n))
    r.shuffle(shuffled)

    def graph(p, name):
        nodes = spark.createDataFrame([(f"{p}{name[i]}", kind[i], "x") for i in range(n)], "id string, kind string, label string")
        ports = spark.createDataFrame([(f"{p}{name[i]}", f"{p}{q}", q, "inout", q.lower(), None, 1) for i in range(n) for q in "AB"], "node_id string, port_id string, name string, direction string, role string, index long, width long")
        edges = spark.createDataFrame([(f"{p}{k}", f"{p}{name[s]}", p + x, f"{p}{name[t]}", p + y) for k, (s, t, x, y) in enumerate(wires)], "id string, source_node string, source_port string, target_node string, target_port string")
        plain = {f"{p}{name[i]}": kind[i] for i in range(n)}, [(f"{p}{name[s]}", f"{p}{name[t]}", x, y) for s, t, x, y in wires]
        return matching.Graph(nodes, ports, edges), plain

    (ref, plain_ref), (cand, plain_cand) = graph("a", list(range(n))), graph("b", shuffled)
    seed = [(f"a{i}", f"b{shuffled[i]}") for i in range(6)]
    want = plain_structural(plain_ref, plain_cand, seed)
    assert len(want) > 15
    found = matching.structural_fixpoint(ref, cand, spark.createDataFrame(seed, "ref_id string, cand_id string"))
    assert {(x.ref_id, x.cand_id) for x in found.collect()} == want


def test_parallel_edges_of_equal_graphs_are_unchanged(spark):
    edges = spark.createDataFrame([("e1", "a", "b", 1), ("e2", "a", "b", 1), ("e3", "b", "b", 2)], "id string, source_node string, target_node string, width long")
    same = spark.createDataFrame([("a", "a"), ("b", "b")], "ref_id string, cand_id string")
    assert {(r.ref_edge, r.status, r.method) for r in diff.pair_edges(edges, edges, same).collect()} == {("e1", "unchanged", "exact"), ("e2", "unchanged", "exact"), ("e3", "unchanged", "exact")}
    other = edges.withColumn("id", F.concat(F.lit("x"), "id"))
    assert sorted((r.ref_edge or r.cand_edge, r.status) for r in diff.pair_edges(edges, other, same).collect()) == [("e1", "removed"), ("e2", "removed"), ("e3", "unchanged"), ("xe1", "added"), ("xe2", "added")]


def test_heuristic_matches_renamed_nodes_and_every_one_of_a_tied_bucket(spark):
    schema = "id string, kind string, label string, definition_name string"
    rows = lambda p, tail: [(f"{p}{i}", "module", f"stage_{'abcdefgh'[i % 8] * 3}{i}_{tail}", "cell") for i in range(20)]
    ref, cand = (spark.createDataFrame(rows(p, t), schema) for p, t in (("r", "old"), ("c", "new")))
    origin = lambda p: spark.createDataFrame([(f"{p}{i}", "f.sv", 10 * i) for i in range(20)], "id string, file string, line long")
    lines = spark.createDataFrame([("./f.sv", i, "f.sv", i) for i in range(0, 200, 10)], "ref_path string, ref_line long, cand_path string, cand_line long")
    none = spark.createDataFrame([], "ref_id string, cand_id string")
    found = fuzzy.heuristic(matching.Graph(ref, origins=origin("r")), matching.Graph(cand, origins=origin("c")), none, lines)
    assert {(x.ref_id, x.cand_id) for x in found.collect()} == {(f"r{i}", f"c{i}") for i in range(20)}
    tied = lambda p: matching.Graph(spark.createDataFrame([(f"{p}{i:03}", "register", "same", "same") for i in range(40)], schema), origins=spark.createDataFrame([(f"{p}{i:03}", "f.sv", 1) for i in range(40)], "id string, file string, line long"))
    found = fuzzy.heuristic(tied("r"), tied("c"), none, lines.limit(1).union(spark.createDataFrame([("f.sv", 1, "f.sv", 1)], lines.schema)))
    assert found.count() == found.select("cand_id").distinct().count() == 40


def plain_sources(ref, cand, k):
    """The k nearest candidates of each reference place in its file."""
    out = set()
    for i, path, line in ref:
        near = sorted({(abs(line - at), j) for j, p, at in cand if p == path})
        seen = []
        for _, j in near:
            if j not in seen:
                seen.append(j)
        out |= {(i, j) for j in seen[:k]}
    return out


def test_source_pool_is_the_nearest_by_line(spark):
    r = random.Random(9)
    ref = [(f"r{i}", r.choice("pq"), r.randrange(60)) for i in range(30)]
    cand = [(f"c{i:02}", r.choice("pq"), r.randrange(60)) for i in range(90)]
    places = lambda rows: spark.createDataFrame(rows, "id string, path string, line long").withColumn("scope", F.lit(""))
    kinds = lambda rows: places(rows).select("scope", "id", F.lit("mux").alias("kind"))
    found = fuzzy.source_pool(kinds(ref), kinds(cand), places(ref), places(cand))
    assert {(x.ref_id, x.cand_id) for x in found.collect()} == plain_sources(ref, cand, fuzzy.K)


def test_nearest_lines_match_brute_force(spark):
    r = random.Random(3)
    asked, mapped = [(r.choice("ab"), r.randrange(50)) for _ in range(40)], sorted({(r.choice("ab"), r.randrange(50)) for _ in range(30)})
    a, m = spark.createDataFrame(asked, "key string, line long").distinct(), spark.createDataFrame(mapped, "key string, at long")
    for k in (1, 3):
        want = {(key, line, at) for key, line in asked for at in sorted((x for y, x in mapped if y == key), key=lambda x: (abs(line - x), x))[:k]}
        assert {(x.key, x.line, x.at) for x in provenance.nearest_line(a, m, k).collect()} == want


def test_unique_keys_need_one_partner_over_all_keys(spark):
    keys = lambda rows: spark.createDataFrame(rows, "id string, key string")
    found = matching.unique_keys(keys([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("d", "4")]), keys([("x", "1"), ("y", "2"), ("z", "3"), ("w", "4")]))
    assert [(r.ref_id, r.cand_id) for r in found.collect()] == [("b", "z")]


def test_greedy_assignment_is_the_sequential_one(spark):
    r = random.Random(3)
    pairs = [(f"r{r.randrange(8)}", f"c{r.randrange(8)}", r.choice([0.7, 0.8, 0.9])) for _ in range(40)]
    pairs = list({(a, b): (a, b, s) for a, b, s in pairs}.values())
    used, want = set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    found = matching.greedy_assignment(spark.createDataFrame(pairs, "ref_id string, cand_id string, score double"))
    assert {(x.ref_id, x.cand_id) for x in found.collect()} == want


def test_empty_graphs_give_empty_results(spark):
    nodes = spark.createDataFrame([], "id string, kind string, label string, definition_name string, parent_id string, width long")
    edges = spark.createDataFrame([], "id string, source_node string, target_node string, width long")
    assert matching.conservative(matching.Graph(nodes, edges=edges), matching.Graph(nodes, edges=edges)).count() == 0
    assert graph.components(edges, nodes).count() == graph.fan_counts(edges).count() == graph.dangling(edges, nodes).count() == 0


def test_shift_register_and_dead_cells(spark):
    regs = spark.createDataFrame([("s", "$dff", [9, 1, 2], [1, 2, 3]), ("p", "$dff", [7, 8], [5, 6]), ("m", "$mux", [9, 1, 2], [1, 2, 3])], "cell string, type string, d array<long>, q array<long>")
    assert [tuple(r) for r in connect.shift_register_stages(regs).collect()] == [("s", 3)]
    cells = spark.createDataFrame([("dead", "$logic_not", True, False), ("read", "$logic_not", True, False), ("kept", "$logic_not", False, False)], "cell string, type string, hidden boolean, has_source boolean")
    outputs = spark.createDataFrame([("dead", 1), ("read", 2), ("kept", 3)], "cell string, wire long")
    assert [r.cell for r in connect.dead_cells(cells, spark.createDataFrame([(2,)], "wire long"), outputs).collect()] == ["dead"]


def test_cross_probe_prefers_exact_overlap_and_follows_ranges(spark):
    sel = spark.createDataFrame(
        [("s", "f", 3, 5, 3, 8, "q"), ("off", "f", 20, 1, 20, 2, None), ("in", "f", 32, 5, 32, 6, None)], "selection string, file string, line int, col int, end_line int, end_col int, token string"
    )
    ent = spark.createDataFrame(
        [
            ("wide", "node", "operator", None, "f", 1, 1, 9, 1, ["z"], 0), ("near", "node", "input", None, "f", 3, 1, 3, 4, ["q"], 1), ("hit", "edge", None, None, "f", 3, 5, 3, 7, ["q"], 2),
            ("line", "node", "operator", None, "f", 32, 8, 32, 9, ["a"], 3), ("far", "node", "operator", None, "f", 34, 1, 34, 2, ["a"], 4),
        ], "entity string, type string, kind string, glyph string, file string, start_line int, start_col int, end_line int, end_col int, terms array<string>, ord int",
    )
    ranges = spark.createDataFrame([("f", 18, 1, 25, 1, False), ("f", 30, 1, 40, 1, True), ("f", 32, 1, 32, 7, True)], "file string, start_line int, start_col int, end_line int, end_col int, active boolean")
    assert {(r.selection, r.entity) for r in provenance.cross_probe(sel, ent, ranges).collect()} == {("s", "hit"), ("in", "line")}
    assert provenance.cross_probe(sel, ent.limit(0), ranges).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_matching_lines_are_a_longest_common_subsequence(a, b):
    pairs = matching_lines(a, b)
    assert all(a[i - 1] == b[j - 1] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(pairs) == best[-1][-1]


def test_a_pair_beyond_the_edit_limit_is_named(spark):
    pairs = spark.createDataFrame([("a", "1\n2\n3", "1\n3"), ("b", "x\ny", "u\nv"), ("c", "q", "q")], "key string, ref_text string, cand_text string")
    found = {tuple(r) for r in provenance.mapped_lines(pairs, 2).collect()}
    assert found == {("a", 1, 1, "mapped"), ("a", 3, 2, "mapped"), ("b", None, None, "limit"), ("c", 1, 1, "mapped")}
    assert matching_lines(["a"] * 3000 + ["b"] * 3000, ["b"] * 3000 + ["a"] * 3000) is not None


def test_sessions_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", "queued", at(0)), ("a", "building", at(1)), ("a", "ready", at(2)), ("b", "building", at(1)), ("c", "building", at(1)), ("c", "building", at(3))]
    spark.createDataFrame(rows, "token string, state string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("token string, state string, ts timestamp").parquet(str(tmp_path / "in"))
    q = sessions.current(stream).writeStream.outputMode("complete").format("memory").queryName("sessions_now").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    now = spark.table("sessions_now")
    assert {(r.token, r.state) for r in sessions.recovered(now).collect()} == {("a", "ready"), ("b", "queued"), ("c", "failed")}
    assert [r.token for r in sessions.expired(now, F.lit(at(9)), 60).collect()] == ["a"]
