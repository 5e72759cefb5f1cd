from weftgraph import session
from weftgraph.plans import catalog


def test_tasks_of_fan_counts_grow_with_the_rows(spark, monkeypatch):
    want = sorted(map(tuple, catalog.QUERIES["fan_counts"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    found = catalog.QUERIES["fan_counts"](spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert f", {-(-lines // 100)}), REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == want
