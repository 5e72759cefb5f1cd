import math

import numpy as np
import pytest

from weftgraph.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, width int, x string"


def brute(rows, k=16):
    """(vec_id, component) -> n, deviation, |whitened|, explained, in plain numpy over one width."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    y = fit - np.array(total) / n
    v = y.T @ y / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    out = []
    for i, x in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
        w = (np.array(x) - np.array(total) / n) @ axes / np.sqrt(e)
        out += [(i, c + 1, n, dev, abs(w[c]), e[c] / np.trace(v)) for c in range(len(e))]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def close(found, want):
    found = sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r)[:4] for r in found] == [r[:4] for r in want]
    assert np.allclose([abs(r.whitened) for r in found], [r[4] for r in want], rtol=1e-7, atol=1e-8)
    assert np.allclose([r.explained for r in found], [r[5] for r in want], rtol=1e-9)
    assert all(r.identity_error < 1e-9 for r in found)


@pytest.mark.parametrize("tile", [None, 7])
def test_equals_plain_numpy_on_the_whole_table(spark, tile):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(5)
    close(whitening.whiten(rows, tile=tile).collect(), brute([(r.vec_id, r.embedding) for r in rows.collect()]))


def test_rows_that_take_no_part_ties_and_clashing_columns(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=5).tolist()) for i in range(40)]
    rows += [(3, rows[3][1]), (None, rows[7][1]), (90, None), (91, []), (92, [1.0, None, 2.0, 0.0, 1.0]), (93, [math.nan] * 5), (94, [1.0, math.inf, 0.0, 0.0, 0.0])]
    rows = [(i, v if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    close(whitening.op13(df).collect(), brute(rows))
    assert whitening.op13(df.where("false")).count() == 0


def test_no_variance_other_widths_and_far_entries(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, ""), (3, [1.0, 0.0, 0.0], 0, ""), (4, [2.0, 0.0, 0.0], 0, "")], SCHEMA)
    found = {(r.vec_id, r.component): r for r in whitening.op13(df).collect()}
    assert len(found) == 10 and found[1, 1].n == 1 and found[1, 1].deviation == 0 and found[1, 1].whitened is None and found[1, 1].explained is None
    assert found[3, 1].n == 2 and found[3, 1].deviation == 64**2 and abs(found[3, 1].whitened) == pytest.approx(1) and found[3, 1].explained == 1.0
    assert found[3, 2].explained == 0.0 and found[3, 2].whitened is None
    far = spark.createDataFrame([(1, [1e30, 0.0], 0, ""), (2, [-1e30, 1.0], 0, ""), (3, [0.0, 0.5], 0, "")], SCHEMA)
    assert all(r.deviation is None or r.vec_id == 3 for r in whitening.op13(far).collect())


def test_products_are_exact_and_wrapped_deviations_too():
    r = np.random.default_rng(1)
    a, b = r.integers(-(1 << 25), 1 << 25, (300, 3)), r.integers(-(1 << 25), 1 << 25, (300, 4))
    assert whitening.product(a, b, 1 << 25).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b.T] for p in a.T]
    x = r.integers(0, 1 << 21, (200, 6)) + 1_000_000
    model = whitening.Model(1 << 11, [int(s) << 3 for s in x[:256].sum(axis=0)], np.eye(6), np.ones(6), [None] * 6)
    want = [sum((model.n * int(v) - s) ** 2 for v, s in zip(row, model.total, strict=True)) for row in x]
    assert model.deviations(x, model.centred(x)) == [w if w < 1 << 63 else None for w in want] and None in [w if w < 1 << 63 else None for w in want]
