"""Operators whose pairs outgrow their tables: no grouping of all pairs, and nothing worked out again and again."""

import random

from pyspark.sql import functions as F

from weftgraph.operators import connect, presentation, provenance


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_overlap_equals_brute_force_and_tells_each_pair_once(spark):
    r = random.Random(5)
    ranges = lambda n, ids: [(r.choice("xy"), a, a + r.choice([0, 1, 70, 300]), r.randrange(ids)) for a in (r.randrange(900) for _ in range(n))]
    kind = "path string, start long, end long, id long"
    for ids in (40, 10**9):  # ids with several rows, and none
        h, o = ranges(80, ids), ranges(80, ids)
        found = [tuple(x) for x in provenance.line_overlap(spark.createDataFrame(h + h[:5], kind), spark.createDataFrame(o, kind)).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {(i, j) for p, a, b, i in h for q, c, d, j in o if p == q and a <= d and b >= c}


def test_counts_of_connections_are_those_of_the_connected_bits(spark):
    r = random.Random(6)
    side = lambda n: spark.createDataFrame([(r.randrange(2), r.randrange(3), r.choice("abc"), r.randrange(3)) for _ in range(n)], "module long, wire long, node string, port long")
    d, s = side(40), side(40)
    keys = ["module", "wire", "source_node", "target_node"]
    want = connect.connected_bits(d, s).groupBy(*keys).agg(F.count("*").alias("n"))
    assert sorted(connect.connected_counts(d, s).select(*keys, "n").collect()) == sorted(want.collect())


def test_a_literal_is_read_once(spark):
    for radix in ("binary", "hex", "decimal"):
        shown = plan(spark.createDataFrame([("8'b01",)], "x string").select(presentation.constant_literal(F.col("x"), radix)))
        assert shown.count("regexp_extract(") <= 16, radix  # the decimal digits are made beside the rest
