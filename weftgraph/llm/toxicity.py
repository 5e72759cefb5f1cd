"""Toxicity by a convolutional text classifier over hashed words, with thresholds calibrated by language.

Every word has two hashed embeddings, of its whole form and of its first four letters, which add up. Filters 1, 2 and
3 words wide run over windows of 128 words that overlap by two; maxima pool over the whole text. The network learns from the
whole text of every labelled row outside the held-out fifth: rows are dealt into shards of about ``SHARD``, and in each of
``ROUNDS`` rounds every shard trains from the common parameters, which then move by the mean of the shards that changed them
(``convtext.train_rounds``). A quarter of these rows, by a hash of their ids, is kept from training and sets, for each language,
the logit at which F1 is best, from counts of rows by language and logit in steps of 1/``STEPS``; a language's own logit and the
one of all languages are weighed by its number of toxic texts against ``SHRINK``, so a language of few labelled texts is
calibrated too. A text's language is read from its words, by their counts in all rows with a lang outside the held-out fifth.
Scores are shifted so that this logit becomes 0.5. Labels, lang, source and doc_id are never inputs of a score, and whole texts
are scored.

Defined cases: null and word-less texts score what the network gives an empty window; without labels every score is 0; of
repeated labels of a doc_id the largest counts, of repeated texts the last in order; a null doc_id is not held out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import held_out, likely, map_slices, materialise, sampled, slices
from weftgraph.llm.convtext import ConvText, train_rounds

LENGTH, OVERLAP = 128, 2
SLOTS = 1 << 15
STEM = 4
SHARD, ROUNDS = 8192, 6
#: Steps of a unit of log-odds in the counts that cuts are made of, and the largest log-odds told apart.
STEPS, MOST = 256, 100
#: Toxic texts at which a language's own cut weighs as much as the common one.
SHRINK = 20
WORDS = re.compile(r"[^\W_]+").findall
MEMO = 300_000


class Hashed(dict):
    """Word to its two hashed slots, packed; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        whole, stem = (zlib.crc32(w.encode("utf-8", "surrogatepass")) % SLOTS for w in (word, word[:STEM]))
        self[word] = whole | stem << 16
        return self[word]


_memo = Hashed()


def packed(text: str | None) -> np.ndarray:
    """Both slots of every word."""
    return np.array([_memo[w] for w in WORDS(text.lower())] if text else [], np.uint32)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Window matrix (2, windows, LENGTH) of packed texts and each text's first window."""
    step, rows, counts = LENGTH - OVERLAP, [], []
    for words in texts:
        n = max(1, -(-(len(words) - OVERLAP) // step))
        row = np.full((n - 1) * step + LENGTH, SLOTS | SLOTS << 16, np.int64)
        row[: len(words)] = words
        rows.append(np.lib.stride_tricks.sliding_window_view(row, LENGTH)[::step])
        counts.append(n)
    both = np.concatenate(rows) if rows else np.zeros((0, LENGTH), np.int64)
    return np.stack([both & 0xFFFF, both >> 16]).astype(np.int32), np.cumsum(counts) - np.array(counts, np.int64)


class WordLanguages:
    """Reads a text's language from the counts of its words' slots in texts of known language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        """``counts`` (languages, slots); a word that a language lacks counts as half a one there."""
        self.names = names
        self.logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).T if names else None

    def predict(self, texts: list[np.ndarray]) -> list[str | None]:
        """None for a text without words."""
        if not self.names:
            return [None] * len(texts)
        return [self.names[int(self.logs[t & 0xFFFF].sum(axis=0).argmax())] if len(t) else None for t in texts]


def word_languages(docs: DataFrame) -> WordLanguages:
    """From all rows outside the held-out fifth; every task sends a row a language and slot at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for rows in slices(batches):
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(SLOTS, np.int64))
                own += np.bincount(packed(text) & 0xFFFF, minlength=SLOTS)
        for lang, own in counts.items():
            held = np.flatnonzero(own)
            yield pa.record_batch({"lang": pa.array([lang] * len(held), pa.string()), "slot": pa.array(held.astype(np.int32)), "n": pa.array(own[held])})

    own = docs.where(~F.coalesce(held_out("doc_id"), F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    rows = own.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(names), SLOTS), np.int64)
    at = {n: i for i, n in enumerate(names)}
    counts[[at[n] for n in rows.column("lang").to_pylist()], rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return WordLanguages(names, counts)


class ToxicityModel:
    def __init__(self, net: ConvText | None, languages: WordLanguages, cuts: dict[str, float], cut: float):
        self.net, self.languages, self.cuts, self.cut = net, languages, cuts, cut

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log-odds of the network for packed texts."""
        ids, first = windows(texts)
        z = self.net.logits(self.net.pool(self.net.features(ids)[0], first))
        return (z[:, 1] - z[:, 0]).astype(float)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts or self.net is None:
            return np.zeros(len(texts))
        words = [packed(t) for t in texts]
        cut = np.array([self.cuts.get(n, self.cut) for n in self.languages.predict(words)])
        return 1 / (1 + np.exp(-np.clip(self.raw(words) - cut, -500, 500)))


def best_cut(step: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> float:
    """Log-odds between two neighbouring steps at which F1 is best, from the rows and toxic rows of each step."""
    at, place = np.unique(step, return_inverse=True)
    at, n, hits = at[::-1], np.bincount(place, rows)[::-1].cumsum(), np.bincount(place, toxic)[::-1].cumsum()
    k = int((2 * hits / (n + hits[-1])).argmax())
    return float(at[k] + at[min(k + 1, len(at) - 1)]) / (2 * STEPS)


def learned_rows(docs: DataFrame, labels: DataFrame, languages: WordLanguages, sample_docs: int | None) -> DataFrame:
    """shard, toxic, calibrates, lang (of those that calibrate), words (packed): one row a labelled document, shards side by side."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = materialise(marks.where(~held_out("doc_id")), "marks")
    eligible = marks.count()
    if sample_docs is not None:
        marks = sampled(marks, "doc_id", sample_docs, eligible)
    # Only labelled texts are shuffled.
    own = likely(docs.where("text is not null").select("doc_id", "text"), marks, "doc_id").join(marks, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    mix, shards = F.shiftrightunsigned(F.xxhash64("doc_id"), 1), max(1, -(-eligible // SHARD))
    own = own.select((mix % shards).cast("int").alias("shard"), mix.alias("mix"), "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 3).alias("calibrates"), "text")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [packed(t) for t in batch.column(4).to_pylist()]
        found = languages.predict(words)
        return pa.record_batch({**{c: batch.column(c) for c in ("shard", "mix", "toxic", "calibrates")}, "lang": pa.array(found, pa.string()), "words": pa.array([w.tobytes() for w in words], pa.binary())})

    rows = map_slices(own, kernel, "shard int, mix long, toxic int, calibrates boolean, lang string, words binary", rows=128)
    return materialise(rows.repartition(shards, "shard").sortWithinPartitions("shard", "mix").drop("mix"), "learned-rows")


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int | None = None) -> ToxicityModel:
    """Learns from all labelled rows; a caller may ask for about ``sample_docs`` of them."""
    languages = word_languages(docs)
    rows = learned_rows(docs, labels, languages, sample_docs)
    sizes = {r.toxic: r.n for r in rows.where("not calibrates").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel(None, languages, {}, 0.0)
    weight = {t: 0.5 * sum(sizes.values()) / n for t, n in sizes.items()}

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        toxic = batch.column(1).to_pylist()
        ids, first = windows([np.frombuffer(w, np.uint32) for w in batch.column(2).to_pylist()])
        return ids, first, np.array(toxic, np.int64), np.array([weight[t] for t in toxic], np.float32)

    net = ConvText([SLOTS, SLOTS], dim=8, widths=(1, 2, 3), filters=8, classes=2)
    train_rounds(net, rows.where("not calibrates").select("shard", "toxic", "words"), read, ROUNDS)
    model = ToxicityModel(net, languages, {}, 0.0)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        odds = model.raw([np.frombuffer(w, np.uint32) for w in batch.column(2).to_pylist()])
        return pa.record_batch({"lang": batch.column(0), "toxic": batch.column(1), "step": pa.array(np.floor(np.clip(odds, -MOST, MOST) * STEPS).astype(np.int32))})

    told = map_slices(rows.where("calibrates").select("lang", "toxic", "words"), kernel, "lang string, toxic int, step int", rows=128)
    # At most a row a language and step.
    found = told.groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()
    if not any(r.toxic for r in found):
        return model
    cut = lambda own: best_cut(*(np.array([r[c] for r in own]) for c in ("step", "n", "toxic")))
    model.cut = cut(found)
    for name in sorted({r.lang for r in found if r.lang is not None}):
        own = [r for r in found if r.lang == name]
        n = sum(r.toxic for r in own)
        if 0 < n < sum(r.n for r in own):
            model.cuts[name] = (n * cut(own) + SHRINK * model.cut) / (n + SHRINK)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": batch.column(0), "score": pa.array(model.scores(batch.column(1).to_pylist()))})

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, score double", rows=128)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
