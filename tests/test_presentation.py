import random
from collections import Counter

from pyspark.sql import functions as F

from weftgraph.operators import presentation


def spliced_one_by_one(edges, boundaries):
    """(payload, source, target) after removing boundaries in their order."""
    now = [(e, s, t) for e, s, t in edges]
    for b, kind, _ in sorted(boundaries, key=lambda x: x[2]):
        into = [e for e in now if e[2] == b and e[1] != b]
        out = [e for e in now if e[1] == b and e[2] != b]
        now = [e for e in now if b not in e[1:]] + [((o if kind == "output" else i)[0], i[1], o[2]) for i in into for o in out]
    return Counter(now)


def test_flat_boundaries_equal_sequential_removal(spark):
    r = random.Random(11)
    cases = []
    for case in range(6):
        nodes = [f"{case}n{i}" for i in range(7)]
        cases.append(([(f"{case}e{i}", r.choice(nodes), r.choice(nodes)) for i in range(9)], [(n, r.choice(("input", "output", "inout")), o) for o, n in zip(r.sample(range(99), 4), nodes)]))
    edges = spark.createDataFrame([(e, s, None, t, None) for es, _ in cases for e, s, t in es], "id string, source_node string, source_port string, target_node string, target_port string")
    bounds = spark.createDataFrame([(b, k, o) for _, bs in cases for b, k, o in bs], "id string, kind string, ord long")
    found = presentation.flat_boundaries(edges, bounds).collect()
    assert Counter((x.payload, x.source_node, x.target_node) for x in found) == sum((spliced_one_by_one(*c) for c in cases), Counter())
    assert len({x.id for x in found}) == len(found)
    assert presentation.flat_boundaries(edges, bounds.limit(0)).count() == edges.count()


def test_constant_literals(spark):
    wide = "1" * 70 + "0"
    rows = {
        "8'b0101": ("8'b00000101", "8'h05", "8'd5"), "4'b0": ("4'b0", "4'h0", "4'd0"), "6'bx": ("6'bx", "6'hx", "6'dx"), "8'B?XxX_1010": ("8'bxxxx1010", "8'hxa", "8'bxxxx1010"),
        "8'bzzzz_zz01": ("8'bzzzzzz01", "8'bzzzzzz01", "8'bzzzzzz01"), f"71'b{wide}": (f"71'b{wide}", f"71'h{int(wide, 2):018x}", f"71'd{int(wide, 2)}"),
        "2'b111": ("2'b111",) * 3, "0'b1": ("0'b1",) * 3, "7": ("7",) * 3, "": ("",) * 3, "3'b1": ("3'b001", "3'h1", "3'd1"),
    }
    df = spark.createDataFrame([(k,) for k in rows] + [(None,)], "v string")
    found = df.select("v", *(presentation.constant_literal(F.col("v"), r).alias(r) for r in ("binary", "hex", "decimal"))).collect()
    assert {x.v: (x.binary, x.hex, x.decimal) for x in found} == rows | {None: (None, None, None)}


def test_effective_settings_follow_precedence(spark):
    args = spark.createDataFrame([(0, "define", "A=1"), (1, "define", "A=2"), (2, "define", "B"), (3, "undefine", "B"), (4, "parameter", "W=4"), (5, "undefine", "C"), (6, "define", "D=a=b")], "ord long, kind string, value string")
    over = spark.createDataFrame([("parameter", "W", "8"), ("define", "C", None), ("undefine", "A", None)], "kind string, name string, value string")
    found = {tuple(x) for x in presentation.effective_settings(args, over).collect()}
    assert found == {("undefine", "A", None), ("undefine", "B", None), ("parameter", "W", "8"), ("define", "C", None), ("define", "D", "a=b")}


def test_control_signals_keep_the_last_of_a_key(spark):
    edges = spark.createDataFrame([(0, "e0", "a", "p", "b", "q", None, None), (1, "e1", "a", None, "c", None, "nRST", None), (2, "e2", "d", None, "c", None, "x", "clock"), (3, "e3", "d", None, "c", None, None, None)], "ord long, id string, source_node string, source_port string, target_node string, target_port string, label string, role string")
    nodes = spark.createDataFrame([("a", "src"), ("b", "clk_target"), ("c", "reset_target"), ("d", "data")], "id string, label string")
    ports = spark.createDataFrame([("a", "p", "O"), ("b", "q", "CLK")], "node_id string, port_id string, name string")
    assert {tuple(x) for x in presentation.control_signals(edges, nodes, ports).collect()} == {("clock:a:CLK", "CLK", "clock"), ("reset:a:nRST", "nRST", "reset"), ("clock:d:x", "x", "clock")}
