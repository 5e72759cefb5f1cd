import hashlib
import random

import numpy as np
import pytest

from weftgraph.llm import suffixes


def brute(rows, width=50):
    """First id of every string by a dictionary over all windows."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - width + 1):
                w = b[p : p + width]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - width + 1):
                if first[b[p : p + width]] < i:
                    gone[p : p + width] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "'x' as row")
    return sorted(map(tuple, suffixes.op9(df).collect()), key=str)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows) == brute(rows)


def test_shared_passages_boundaries_and_periodic_texts(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdeé ñ") for _ in range(n))
    passages = [word(n) for n in (48, 49, 50, 51, 70, 200)]
    rows = [(i, "".join(r.choice([word(r.randrange(1, 60)), r.choice(passages)]) for _ in range(r.randrange(8)))) for i in range(150)]
    rows += [(200, "ab" * 500), (201, "ab" * 300), (202, "a" * 400), (203, "a" * 49), (204, "a" * 50), (205, "a" * 51 + "b")]
    rows += [(300, passages[5]), (300, passages[5]), (301, passages[5]), (302, None), (303, ""), (None, passages[5]), (-1, passages[4])]
    r.shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_bad_width(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.op9(empty).count() == 0
    with pytest.raises(ValueError):
        suffixes.removal(empty, 16)


def test_multikey_order():
    r = np.random.default_rng(1)
    words = r.integers(0, 3, (500, 5)).astype(np.uint64)
    assert [tuple(x) for x in words[suffixes.multikey_order(words)]] == sorted(map(tuple, words))
    wide = r.integers(0, 4, (30000, 7)).astype(np.uint64)
    wide[::3] = wide[0]
    assert [tuple(x) for x in wide[suffixes.multikey_order(wide)]] == sorted(map(tuple, wide))


def test_windows_of_one_prefix_lie_on_both_sides_of_a_boundary(spark, monkeypatch):
    """So many splitters that suffixes with the same 16 leading bytes go to several buckets."""
    monkeypatch.setattr(suffixes, "CHUNK", 256)
    monkeypatch.setattr(suffixes, "SUFFIX_BUCKET", 64)
    r = random.Random(8)
    rows = [(i, "the very same sixteen bytes and more " * r.randrange(1, 4) + "".join(r.choice("xyz") for _ in range(r.randrange(40)))) for i in range(120)]
    assert result(spark, rows) == brute(rows)
    suffix = np.frombuffer(b"".join(b"a" * 20 + bytes([98 + i % 5]) * 30 for i in range(50)), np.uint8).reshape(50, 50)
    splitters = np.array([b"a" * 20 + b"c" * 30, b"a" * 20 + b"e" * 30], "S50")
    row, bucket, bits = suffixes.destinations(suffix, np.full(50, (1 << 35) - 1, np.uint64), splitters)
    assert set(bucket.tolist()) == {0, 1, 2} and (np.diff(bucket) >= 0).all()
    total = np.zeros(50, np.uint64)
    np.add.at(total, row, bits)
    assert (total == (1 << 35) - 1).all()
