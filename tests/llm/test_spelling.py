import random
import re
import zlib
from collections import Counter

import pytest

from weftgraph.llm import spelling

FOLD = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if doc_id is not None and h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def neighbours(words):
    """Words near each word, by deleting each letter of every word: another way than the operator's."""
    holes = {}
    for w in words:
        for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(d, set()).add(w)
    return {w: {o for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for o in holes[d] if one_edit(w, o)} for w in words}


def expected(rows):
    n = counted(rows)
    near = neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("hot", [spelling.HOT, 2])
def test_equals_brute_force_on_the_whole_table(spark, hot):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)
    assert found(spelling.variants(docs, hot=hot)) == want


@pytest.mark.parametrize("hot", [48, 1])
def test_every_pair_of_crowded_words(spark, hot):
    r = random.Random(3)
    words = {"".join(r.choice("ab") for _ in range(k)) for k in (1, 2, 3, 7, 8, 9) for _ in range(120)} | {"aaaaaaaé", "aaaaaaa÷", "ÿ" * 7, "ÿ" * 8}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = [frozenset((p.x, p.y)) for p in spelling.near(df, hot).collect()]
    near = neighbours(words)
    assert sorted(map(sorted, pairs)) == sorted(map(sorted, {frozenset((w, o)) for w in words for o in near[w]}))


def test_chains_ties_nulls_long_runs_and_clashing_columns(spark):
    long = "x" * 3000
    texts = ["colours " * 400, "colourz " * 30, "coulourz " * 2, "colourb colourb", "Écoles! École7écoless", "ÉCOLESS écoless", "écoless", f"{long} {long} {long}y {long}y", "short words only", "", None, "colour×s colour÷s colour×s"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "colours colours"), (3, texts[3])]
    df = spark.createDataFrame([(i, t, 1, "w", "k") for i, t in rows], "doc_id long, text string, n int, word string, key string")
    assert found(spelling.op12(df)) == expected(rows)
    assert spelling.op12(df.where("false")).count() == 0
