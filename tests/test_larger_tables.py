"""Queries over tables that a scale of the fixtures doesn't give: their results equal their SQL there too."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def differing(spark, name, folder):
    """Rows of the query that its SQL lacks, and the other way round."""
    out = f"{folder}/{name}-out"
    __spark_entry__.queries()[name](spark, str(folder)).write.parquet(out)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    db.execute(f"create table found as select * from '{out}/*.parquet'")
    db.execute(f"create table wanted as {__spark_entry__.oracle_sql()[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in db.execute("describe found").fetchall())
    one = lambda a, b: db.execute(f"select count(*) from (select {columns} from {a} except all select {columns} from {b})").fetchone()[0]
    return one("found", "wanted"), one("wanted", "found"), db.execute("select count(*) from wanted").fetchone()[0] > 0


def written(spark, folder, **changed):
    for t in TABLES:
        rows = spark.read.parquet(f"{DATA}/{t}.parquet")
        changed.get(t, lambda r: r)(rows).coalesce(1).write.parquet(f"{folder}/{t}.parquet")


@pytest.mark.parametrize("name", ["snapshot_violations"])
def test_no_budget_of_rows_adds_to_the_planted_faults(spark, tmp_path, monkeypatch, name):
    from weftgraph import schema

    written(spark, tmp_path)
    for what in ("nodes", "edges", "ports", "origins", "objects"):
        monkeypatch.setitem(schema.LIMITS, what, 1)
    assert differing(spark, name, tmp_path) == (0, 0, True)


def test_a_parent_whose_children_have_no_pair_is_still_an_inner_node(spark, tmp_path):
    """All orders of customer 7 are those that the candidate's module graph renames."""
    order = F.col("o_orderkey")
    written(spark, tmp_path, orders=lambda r: r.withColumn("o_custkey", F.when(order % 50 == 13, 7).when(F.col("o_custkey") == 7, 8).otherwise(F.col("o_custkey")).cast("long")))
    assert differing(spark, "hierarchy_change_rollup", tmp_path) == (0, 0, True)


@pytest.mark.parametrize("name", ["flattened_nodes", "expanded_edges", "expanded_groups"])
def test_no_budget_of_objects_stops_an_expansion(spark, tmp_path, monkeypatch, name):
    from weftgraph import schema

    written(spark, tmp_path)
    for what in ("objects", "ports"):
        monkeypatch.setitem(schema.LIMITS, what, 1)
    assert differing(spark, name, tmp_path) == (0, 0, True)
