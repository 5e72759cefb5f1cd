import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import ann


def brute(rows, queries, k=5):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for qi, q in ok:
        if qi in queries:
            scored = sorted((-(float((q * v).sum()) / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), i) for i, v in ok if i != qi and len(v) == len(q))
            out[qi] = [(i, -s) for s, i in scored[:k]]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_the_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    plain = [(r.vec_id, r.embedding) for r in rows.collect()]
    want, got = brute(plain, {i for i, _ in plain if i % 50 == 0}), result(ann.op1(rows))
    assert want.keys() == got.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    exact = {q: dict(brute(plain, {q}, 10**6)[q]) for q in list(want)[:5]}
    assert all(abs(exact[q][i] - s) < 1e-12 for q in exact for i, s in got[q])


def test_unusable_vectors_copies_ties_and_widths(spark):
    r = np.random.default_rng(3)
    v = lambda n=8: r.normal(size=n).astype(np.float32).tolist()
    hot = v()
    rows = [(i, hot if i % 3 == 0 else v()) for i in range(300)] + [(400, None), (450, []), (500, [0.0] * 8), (550, [1.0, None] * 4), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (700, v(3)), (701, v(3)), (750, v(5)), (None, v())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as width", "2 as block", "'x' as vector")
    want = brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0})
    got = result(ann.op1(df))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}


def test_estimates_stay_within_their_bounds():
    r = np.random.default_rng(4)
    vectors = r.normal(size=(4000, 64)).astype(np.float32)
    codes, scalars = ann.encode(vectors)
    q = ann.unit(r.normal(size=(1, 64)))[0]
    found, error = ann.estimate(q @ ann.rotation(64), codes, scalars)
    assert (np.abs(found - ann.unit(vectors) @ q) <= error).mean() > 0.99


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.op1(empty).agg(F.count("*")).first()[0] == 0
