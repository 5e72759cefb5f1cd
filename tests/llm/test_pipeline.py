import public_tokenizers
import tiktoken

from weftgraph.llm.bpe import ranks_bytes
from weftgraph.llm.common import materialise


def test_stages_keep_columns_and_decide(spark, tmp_path):
    corpus_pipeline = __import__("corpus_pipeline")
    base = [f"the quick number {i} walks over plain roads near water and meets friend {i * 7} again today with letter {i * 13} in hand" for i in range(8)]
    item = "a train leaves the old station at 40 km per hour and later stops beside the long river bridge for 15 minutes"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s", 0), (21, "12345 --", "en", "s", 0), (22, None, "en", "s", 0)]
    rows += [(23, "before it all " + item.replace("40", "95").replace("15", "8") + " and after", "en", "s", 0), (24, "my password = hunter2secret9 is here among other plain words of text", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, docs = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        docs = out
        seen[name] = {r.doc_id: r.text for r in out.collect()}
    assert set(seen["language"]) == {*range(8), 20, 23, 24}
    assert set(seen["near_duplicates"]) == {*range(8), 23, 24}
    assert set(seen["benchmark_passages"]) == {*range(8), 24}
    assert "hunter2" not in seen["secrets"][24] and "[SECRET]" in seen["secrets"][24]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, ranks_bytes().splitlines())}, special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in last} == {k: len(encoding.encode_ordinary(t)) for k, t in seen["secrets"].items()}
