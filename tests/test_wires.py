import random
from collections import Counter

from weftgraph.plans.catalog import QUERIES


def test_every_wire_takes_part(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(1, 30), r.randrange(1, 12), r.randrange(1, 220), r.choice("ARN")) for _ in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    ends = {f: [(w, f"order:{o}", p) for o, p, w, flag in rows if flag == f] for f in "AR"}
    bits = [(w % 97, w, d, s) for w, d, p in ends["A"] for v, s, q in ends["R"] if w == v and (d, p) != (s, q)]
    assert any(w % 5 for _, w, _, _ in bits)
    found = {name: QUERIES[name](spark, str(tmp_path)).collect() for name in ("connect_driver_sink", "edge_bundling", "pair_budget")}
    assert {tuple(row)[:4]: row.n for row in found["connect_driver_sink"]} == Counter(bits)
    bundles = {}
    for m, w, d, s in bits:
        bundles.setdefault((m, d, s), []).append(w)
    assert {tuple(row)[:3]: (row.width, row.first_wire) for row in found["edge_bundling"]} == {k: (len(w), min(w)) for k, w in bundles.items()}
    pairs = Counter(w % 97 for w, _, _ in ends["A"] for v, _, _ in ends["R"] if w == v)
    assert {row.module: row.pairs for row in found["pair_budget"]} == pairs
