import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import langid, toxicity
from weftgraph.llm.common import held_out

WORDS = {"aa": "kala mato suri nelo pika", "bb": "thren golst wurk shund flirg"}


def _docs(spark, n=400, bad=()):
    r = random.Random(5)
    rows = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        words = r.choices(WORDS[lang].split(), k=r.randint(4, 60)) + (["vileword"] if i in bad else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), lang if i % 11 else None, "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language_of_held_out_rows(spark):
    docs = _docs(spark)
    found = langid.op4(docs)
    wrong = found.where("held_out").join(docs.where("lang is not null"), "doc_id").where("lang_pred <> lang").count()
    assert wrong == 0
    assert found.count() == docs.count()
    assert found.where("score < 0 or score > 1").isEmpty()


def test_language_defined_cases(spark):
    odd = spark.createDataFrame([(900, None, "aa", 1), (901, "", "aa", 2), (902, "123 --", "bb", 3), (None, "kala mato", None, 4), (903, "kala mato " * 20000, None, 5), (903, "kala", None, 6)], "doc_id long, text string, lang string, score int")
    model = langid.fit(_docs(spark))
    rows = langid.predict(odd, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in rows) == [(0, "aa"), (900, "und"), (901, "und"), (902, "und"), (903, "aa"), (903, "aa")]
    assert langid.keep_known(odd, model).columns == odd.columns
    nothing = langid.op4(odd.limit(0).drop("score"))
    assert nothing.count() == 0
    unlabelled = langid.op4(odd.drop("score").withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_toxicity_learns_a_word_and_keeps_clean_rows(spark):
    bad = set(range(0, 400, 5)) | set(range(1, 400, 10))
    docs = _docs(spark, bad=bad)
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(400)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: (r.held_out, r.predicted) for r in toxicity.op7(docs, labels).collect()}
    own = [(i in bad, p == 1) for i, (h, p) in found.items() if h]
    assert sum(a == b for a, b in own) >= 0.95 * len(own)


def test_toxicity_without_labels_and_with_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", None, None), (3, "!!!", None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.score) for r in toxicity.op7(docs, labels).collect()} == {(1, 0.0), (2, 0.0), (3, 0.0)}


def test_held_out_rows_are_a_fifth(spark):
    n = spark.range(5000).where(held_out("id")).count()
    assert n == pytest.approx(1000, rel=0.15)


@pytest.mark.parametrize("share", [1e-9, 1e-12, 1e-15])
def test_samples_of_tiny_shares_follow_a_63_bit_hash(spark, share):
    """Of rows with chosen hashes, exactly those under the share's threshold are taken, however small it is."""
    from weftgraph.llm.common import sample_rows, sampled

    ids = spark.range(200_000).withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 1))
    low = ids.orderBy("h").first()
    assert [r.id for r in sampled(ids, "id", 1, 2**63 // (low.h + 2**20)).collect()] == [low.id]
    rows = int(1 / share)
    assert sampled(ids, "id", 1, rows).count() == ids.where(F.col("h") <= int(2.0**63 / rows)).count()
    with pytest.raises(RuntimeError):
        sample_rows(ids.drop("h"), "id", 1, 10**15)


def test_a_sample_is_bounded_however_often_an_id_repeats(spark):
    from weftgraph.llm.common import sample_rows

    same = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), "id")
    assert len(sample_rows(same, "doc_id", 10, 5)) == 20
    docs = _docs(spark, bad=set(range(0, 400, 3)))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)] * 2, "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs.union(docs), labels, sample_docs=100).net is not None
    assert langid.fit(docs.union(docs), sample_docs=50).languages == ["aa", "bb"]


def test_toxicity_learns_from_every_labelled_row_in_shards(spark, monkeypatch):
    """More rows than the sample there once was, and several shards that share what they learn."""
    many = spark.range(9000).selectExpr("id as doc_id", "concat('kala mato ', id) as text", "'aa' as lang", "'s' as source")
    labels = spark.range(9000).selectExpr("id as doc_id", "1 as quality", "cast(id % 2 as int) as toxic")
    rows = toxicity.learned_rows(many, labels, toxicity.WordLanguages([], None), None)
    assert rows.count() == labels.where(~held_out("doc_id")).count() > 6000
    assert rows.select("shard").distinct().count() == 1
    monkeypatch.setattr(toxicity, "SHARD", 160)
    monkeypatch.setattr(toxicity, "ROUNDS", 40)  # shards so small take a step or two a round
    bad = set(range(0, 400, 5)) | set(range(1, 400, 10))
    docs = _docs(spark, bad=bad)
    found = {r.doc_id: (r.held_out, r.predicted) for r in toxicity.op7(docs, spark.createDataFrame([(i, 1, int(i in bad)) for i in range(400)], "doc_id long, quality int, toxic int")).collect()}
    own = [(i in bad, p == 1) for i, (h, p) in found.items() if h]
    assert sum(a == b for a, b in own) >= 0.9 * len(own)


def test_languages_of_words(spark):
    model = toxicity.word_languages(_docs(spark))
    assert model.predict([toxicity.packed(t) for t in ("kala mato", "golst wurk", "")]) == ["aa", "bb", None]


def test_likely_rows_hold_all_that_are_asked_for(spark):
    from weftgraph.llm.common import likely

    rows = spark.range(50_000).withColumnRenamed("id", "doc_id").withColumn("n", F.col("doc_id") % 3)
    asked = rows.where("doc_id % 100 = 7").select("doc_id")
    found = likely(rows, asked, "doc_id")
    assert asked.exceptAll(found.select("doc_id")).isEmpty() and found.count() < 600 and found.columns == rows.columns
