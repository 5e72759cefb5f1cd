"""Tables that grow with the design stay out of the driver, however small their files are."""

import pytest

from weftgraph.operators import diff, matching


@pytest.fixture
def sides(spark, tmp_path):
    """A graph of many ports in small files, and matches of all its nodes."""
    node = "concat('part:', id)"
    nodes = spark.range(2000).selectExpr(f"{node} as id", "'operator' as kind", "'p' as label")
    edges = spark.range(1999).selectExpr("concat('e', id) as id", f"{node} as source_node", "'y' as source_port", "concat('part:', id + 1) as target_node", "'a' as target_port", "1L as width")
    ports = spark.range(2000).selectExpr(f"{node} as node_id", "explode(array('a', 'y')) as port_id").selectExpr("*", "port_id as name", "'input' as direction", "'data' as role", "null as index", "1L as width")
    matches = spark.range(2000).selectExpr(f"{node} as ref_id", f"{node} as cand_id", "'exact' as method", "1.0D as score")
    read = {}
    for name, rows in {"nodes": nodes, "edges": edges, "ports": ports, "matches": matches}.items():
        rows.selectExpr("*").withColumn("scope", matching.F.lit("")).write.parquet(f"{tmp_path}/{name}")
        read[name] = spark.read.parquet(f"{tmp_path}/{name}")
    return matching.Graph(read["nodes"], read["ports"], read["edges"]), read["matches"]


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_ports_and_matches_are_never_broadcast(sides):
    g, m = sides
    assert broadcasts(matching.signed(g)) == 0
    assert broadcasts(matching.ended(g)) == 0
    assert broadcasts(matching.residue(g.nodes, m, "ref")) == 0
    pairs = diff.pair_ports(g.ports, g.ports, m)
    assert pairs.count() == 4000
    status = diff.port_status(g.ports, g.ports, pairs, m)
    assert broadcasts(status) == 0
    assert broadcasts(diff.pair_nodes(g.nodes, g.nodes, m, status)) == 0
    edges = diff.pair_edges(g.edges, g.edges, m, pairs)
    assert broadcasts(edges) == 0 and edges.where("status = 'unchanged'").count() == 1999
