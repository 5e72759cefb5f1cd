"""Edges without an unmatched end are dropped where they are read."""

from pyspark.sql import functions as F

from weftgraph.operators import matching
from weftgraph.plans.fixtures import Fixture

NULLS = "if(id % 7 = 0, null, concat('n', id))"


def test_edges_of_unmatched_nodes_stay_and_others_are_not_shuffled(spark):
    edges = spark.range(20000).selectExpr("'' as scope", f"{NULLS} as source_node", "concat('n', id + 1) as target_node").repartition(3)
    nodes = spark.range(0, 20000, 100).selectExpr("'' as scope", "concat('n', id) as id")
    kept = matching.touching(edges, nodes)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 0
    open_ends = nodes.select("id")
    both = lambda df: df.join(open_ends.withColumnRenamed("id", "source_node"), "source_node", "left_semi").select("source_node", "target_node").union(df.join(open_ends.withColumnRenamed("id", "target_node"), "target_node", "left_semi").select("source_node", "target_node")).distinct()
    wanted = both(edges)
    assert wanted.exceptAll(both(kept)).isEmpty() and wanted.count() > 300
    assert kept.count() < wanted.count() * 1.1 and kept.exceptAll(edges).isEmpty()


def test_edges_that_do_not_move_do_not_meet_in_one_task(spark, tmp_path):
    """Of the candidate's edges, only those of every 11th part look up another part."""
    fixed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in fixed}
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        edges = Fixture(spark, "/root/testdata/sf0.01").graph("cand").edges.where("scope = 'top'")
        sizes = [r.n for r in edges.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes) < sum(sizes) / 2
