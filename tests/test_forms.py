"""Aggressive matching compares equal fields once, and reads both graphs once for all rounds."""

import random

from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import fuzzy
from weftgraph.operators.matching import Graph


def test_prepared_forms_give_the_same_similarities(spark):
    r = random.Random(3)
    word = lambda: r.choice([None, "", "a", "#1", "Ab#", "aa", "".join(r.choice("aAb_1#") for _ in range(r.randrange(9)))])
    bag = lambda: [r.choice(["x", "x#1", "", "y"]) for _ in range(r.randrange(5))]
    rows = spark.createDataFrame([(word(), word(), bag(), bag()) for _ in range(300)], "a string, b string, s array<string>, t array<string>")
    grams = lambda c: scalars.numbered(scalars.bigrams(scalars.plain(F.col(c))))
    given = scalars.plain_similarity(F.col("a"), F.col("b"), scalars.plain(F.col("a")), scalars.plain(F.col("b")), grams("a"), grams("b"))
    wrong = rows.where((given != scalars.string_similarity(F.col("a"), F.col("b"))) | (scalars.numbered_similarity(scalars.numbered(F.col("s")), scalars.numbered(F.col("t"))) != scalars.multiset_similarity(F.col("s"), F.col("t"))))
    assert wrong.count() == 0 and rows.where(given.between(0.01, 0.99)).count() > 5


def test_equal_fields_are_compared_once_and_graphs_are_read_once(spark, monkeypatch):
    side = lambda prefix: Graph(spark.range(60).selectExpr(f"concat('{prefix}', id) as id", "'' as scope", "'operator' as kind", "'+' as glyph", "cast(null as string) as definition_name", "cast(null as string) as parameters_json", "concat('l', id % 3) as label"))
    sizes, calls = {}, []
    written, read = fuzzy.materialise, fuzzy.features

    def kept(df, label):
        out = written(df, label)
        sizes.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(fuzzy, "materialise", kept)
    monkeypatch.setattr(fuzzy, "features", lambda g: calls.append(1) or read(g))
    fuzzy.heuristic(side("r"), side("c"), spark.createDataFrame([], "scope string, ref_id string, cand_id string"))
    assert sizes["pool"][0] > 300 and sizes["evidence"][0] <= 9
    assert len(calls) == 2 and len(sizes["scored"]) >= 1
