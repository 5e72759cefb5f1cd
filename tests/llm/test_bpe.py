import base64
import random

import public_tokenizers
import pytest
import tiktoken

from weftgraph.llm import bpe


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(5)
    yield from ["", " ", "\n\n  x", "a" * 5000, "-" * 3000 + "=" * 777, "日本語👍🏽 ñandú \t x", "<|endoftext|> it's"]
    yield "".join(r.choice("abcdef") for _ in range(8000))
    yield "".join(r.choice("aeinrst") for _ in range(4000))
    yield "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2000), r.randrange(0x1F300, 0x1F600)])) for _ in range(5000))


def test_same_ids_as_the_library(reference):
    coder = bpe.coder(bpe.ranks_bytes(), public_tokenizers.PATTERN)
    for text in odd_texts():
        ids = coder.encode(text)
        assert [int(i) for i in ids.split()] == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_documents_round_trip(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    rows = bpe.encode_documents(docs).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert [int(i) for i in row.ids.split()] == reference.encode_ordinary(texts[row.doc_id] or "")
        assert bytes(row.decoded).decode() == texts[row.doc_id]


def test_null_empty_and_clashing_columns(spark):
    rows = [(1, None, "q"), (2, "", "q"), (2, "", "q"), (None, "a b", "q")]
    out = bpe.op5(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted(r.n_tokens for r in out) == [0, 0, 0, 2]
    assert bpe.op5(spark.createDataFrame([], "doc_id long, text string")).count() == 0
