import pandas as pd
import xxhash

from weftgraph.llm import simhash


def plain_fingerprint(text, k=3):
    tokens = [w for w in (text or "").encode().lower().split()]
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(fps)):
        for y in range(x):
            if (fps[x][1] ^ fps[y][1]).bit_count() <= 3:
                parent[root(x)] = root(y)
    low = {}
    for x, (i, _) in enumerate(fps):
        low[root(x)] = min(low.get(root(x), i), i)
    return sorted((i, f"{fp:016x}", low[root(x)]) for x, (i, fp) in enumerate(fps))


def result(spark, rows):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]), "doc_id long, text string")
    return sorted(map(tuple, simhash.op10(df).collect()))


def test_matches_brute_force_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows) == brute(rows)


def test_nulls_empty_short_long_and_repeated_rows(spark):
    rows = [(7, None), (3, ""), (4, " \t\n"), (9, "One"), (10, "one"), (11, "one two"), (12, "x y z " * 40000), (12, "x y z " * 40000), (13, "É a b c")]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert simhash.op10(spark.createDataFrame([], "doc_id long, text string, fp string")).count() == 0


def test_chains_of_links_reach_the_smallest_id(spark):
    import random

    from pyspark.sql import functions as F

    r, fp, fps = random.Random(1), 0x123456789ABCDEF, []
    for _ in range(60):
        fps.append(fp)
        for b in r.sample(range(63), 3):
            fp ^= 1 << b
    ids = list(range(60))
    r.shuffle(ids)
    nodes = spark.createDataFrame(list(zip(ids, fps, strict=True)), "first long, fp long")
    labels = simhash.components(simhash.star_links(nodes))
    assert labels.agg(F.count("id"), F.max("label")).first()[:] == (60, 0)
