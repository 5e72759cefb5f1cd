import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import tokenfile


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_of_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, tokenfile.op8(docs).collect())) == expected(rows, library)


def test_null_empty_and_odd_texts(spark, library):
    ends = "<|endoftext|>"
    rows = [(2, ends), (3, f"a {ends} b{ends}{ends}\n{ends} c"), (4, "<|endoftext |> <|endoftext|"), (5, None), (1, ""), (9, "  \n\n it's <|endoftext|> 日本 ñ ½ \x85x"), (7, "ab " * 70000), (None, "lost"), (-3, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as part")
    assert sorted(map(tuple, tokenfile.op8(df).collect()), key=lambda r: r[1]) == expected(rows, library)
    assert tokenfile.op8(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lengths_are_limited_and_complete():
    r = np.random.default_rng(2)
    for n, longest in ((2, 3), (30, 5), (3000, 14), (50257, 18)):
        counts = (r.pareto(0.3, n) * 3 + 1).clip(max=1e12).astype(np.int64)
        lengths = tokenfile.code_lengths(counts, longest)
        assert lengths.max() <= longest and lengths.min() >= 1
        assert sum(0.5 ** lengths.astype(float)) == 1
    lengths = tokenfile.code_lengths(np.array([0, 5, 0]))
    assert lengths.tolist() == [0, 1, 0]


def test_blocks_decode_from_checkpoints():
    r = np.random.default_rng(3)
    ids = [np.minimum(r.geometric(0.01, n), 900) for n in (0, 1, 127, 128, 129, 5000)]
    lengths = tokenfile.code_lengths(np.bincount(np.concatenate(ids), minlength=901), 12)
    codes = tokenfile.canonical_codes(lengths)
    packed = [tokenfile.encode_block(i, lengths, codes) for i in ids]
    got = tokenfile.Decoder(lengths).decode([p for p, _ in packed], [c for _, c in packed], [len(i) for i in ids])
    assert all((a == b).all() for a, b in zip(ids, got, strict=True))


def test_file_is_read_from_its_folder_alone(spark, library, tmp_path):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(300)]
    folder = f"{tmp_path}/file"
    assert tokenfile.write_token_file(spark.createDataFrame(rows, "doc_id long, text string"), folder) is None
    got = tokenfile.read_token_file(spark.newSession(), folder).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got] == expected(rows, library)
    assert [library.decode(np.frombuffer(bytes(r.ids), "<u4")[:-1].tolist()) for r in got] == [t for _, t in rows]


def test_added_tokens_that_strip_go_whole_to_the_library(library):
    from tokenizers import AddedToken

    own = Tokenizer.from_str(library.to_str())
    own.add_tokens([AddedToken("<x>", lstrip=True), AddedToken("<yy>", normalized=False)])
    encoder = tokenfile.PieceEncoder(own.to_str())
    texts = ["a  <x> b", "c<yy>d <yy>", "<|endoftext|><x>", "e"]
    got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts, 2)]
    assert got == [[*own.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_frequent_pieces_stay_in_the_memo_however_long_they_are(library, monkeypatch):
    monkeypatch.setattr(tokenfile, "MEMO", 50)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = tokenfile.PieceEncoder(f.read())
    asked, tokenize = [], encoder.pieces.tokenize
    encoder.pieces.tokenize = lambda shown: asked.append(shown) or tokenize(shown)
    texts = [f"extraordinarily new{i} pieceé{i}" for i in range(2000)]
    got = [i for t in texts for i in encoder.encode([t], 2)]
    assert asked.count("extraordinarily") == 1 and len(encoder.pieces) + len(encoder.pieces.old) <= 100
    assert got == [np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u2").tobytes() for t in texts]
