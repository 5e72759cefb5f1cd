"""Which instances of a compared hierarchy contain changes, over the graph of distinct module pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schema import LIMITS
from weftgraph.session import materialise


def state_of(code: Column) -> Column:
    return F.when(code == 2, "contains").when(code == 1, "unknown").otherwise("none")


def reachable_pairs(roots: DataFrame, children: DataFrame, most: int) -> DataFrame:
    """root, pair, level, inside: the module pairs below each root (root, pair), breadth first and each once. ``inside``: among
    the first ``most`` by level and name; a root that has more goes no further than the level that exceeds it."""
    seen = materialise(roots.select("root", "pair", F.lit(0).alias("level")).distinct(), "pairs-seen")
    front = seen
    for level in range(1, LIMITS["hierarchy_depth"] + 1):
        open_ = seen.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("root")
        step = front.join(open_, "root", "left_semi").join(children.select("pair", "child"), "pair").where("child is not null").select("root", F.col("child").alias("pair")).distinct()
        front = materialise(step.join(seen, ["root", "pair"], "left_anti").select("root", "pair", F.lit(level).alias("level")), "pairs-level")
        if front.isEmpty():
            break
        seen = materialise(seen.union(front), "pairs-seen")
    # at most one level beyond the budget, so a root's pairs are few
    order = Window.partitionBy("root").orderBy("level", "pair")
    return seen.withColumn("inside", F.row_number().over(order) <= most)


def change_index(roots: DataFrame, pairs: DataFrame, children: DataFrame, most: int = LIMITS["hierarchy_pairs"]) -> tuple[DataFrame, DataFrame]:
    """States of all instances below the roots, and of the roots.

    pairs: pair, changed (null: not known) of the compared modules; children: pair, instance, child (pair; null if it can't be loaded)
    of instances that both sides have. An instance ``contains`` changes if its child's pair or any below has changed; else it is
    ``unknown`` if any of these isn't known, isn't compared, lies beyond the budget of pairs or holds itself; else ``none``.
    The first frame has root, pair, instance, state, the second root, state, complete.

    From the leaves upwards, each pair is worked out once, when all its children are, however many instances share it. What never
    becomes ready holds itself or something that does; there changes spread until nothing is new.
    """
    reach = materialise(reachable_pairs(roots, children, most), "pairs-reach")
    known = F.when(~F.col("inside") | F.col("changed").isNull(), 1).when(F.col("changed"), 2).otherwise(0)
    own = materialise(reach.join(pairs.select("pair", "changed"), "pair", "left").select("root", "pair", "inside", known.alias("own")), "pairs-own")
    links = own.where("inside").select("root", "pair").join(children.select("pair", "child"), "pair").select("root", "pair", "child").distinct()
    lost = links.where("child is null").select("root", "pair").distinct().withColumn("lost", F.lit(1))
    links = materialise(links.where("child is not null"), "pairs-links")
    left = materialise(own.join(lost, ["root", "pair"], "left").select("root", "pair", F.greatest("own", F.coalesce("lost", F.lit(0))).alias("code")), "pairs-left")
    done = None
    for _ in range(LIMITS["hierarchy_depth"] + 2):
        waits = links.join(left.select("root", F.col("pair").alias("child")), ["root", "child"], "left_semi").select("root", "pair").distinct()
        ready = left.join(waits, ["root", "pair"], "left_anti")
        if done is not None:
            below = links.join(done.select("root", F.col("pair").alias("child"), F.col("code").alias("below")), ["root", "child"]).groupBy("root", "pair").agg(F.max("below").alias("below"))
            ready = ready.join(below, ["root", "pair"], "left").select("root", "pair", F.greatest("code", F.coalesce("below", F.lit(0))).alias("code"))
        ready = materialise(ready, "pairs-ready")
        if ready.isEmpty():
            break
        done = ready if done is None else materialise(done.union(ready), "pairs-done")
        left = materialise(left.join(ready, ["root", "pair"], "left_anti"), "pairs-left")
    looped = left.withColumn("code", F.greatest("code", F.lit(1)))
    codes = looped if done is None else done.union(looped)
    codes = materialise(codes, "pairs-codes")
    if not left.isEmpty():
        while True:
            up = links.join(codes.select("root", F.col("pair").alias("child"), "code"), ["root", "child"]).groupBy("root", "pair").agg(F.max("code").alias("up"))
            moved = materialise(codes.join(up, ["root", "pair"], "left").select("root", "pair", F.greatest("code", F.coalesce("up", F.lit(0))).alias("code"), (F.col("up") > F.col("code")).alias("moved")), "pairs-codes")
            codes = moved.select("root", "pair", "code")
            if moved.where("moved").isEmpty():
                break
    inside = own.where("inside").select("root", "pair")
    shown = inside.join(children.select("pair", "instance", "child"), "pair").join(codes.select("root", F.col("pair").alias("child"), "code"), ["root", "child"], "left")
    instances = shown.select("root", "pair", "instance", state_of(F.coalesce("code", F.lit(1))).alias("state"))
    gaps = own.where("own = 1").select("root").union(lost.select("root")).union(left.select("root")).distinct().withColumn("gap", F.lit(True))
    top = roots.select("root", "pair").distinct().join(codes, ["root", "pair"]).groupBy("root").agg(F.max("code").alias("code")).join(gaps, "root", "left")
    return instances, top.select("root", state_of(F.col("code")).alias("state"), F.col("gap").isNull().alias("complete"))
