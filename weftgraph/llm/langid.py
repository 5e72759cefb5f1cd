"""Language ID by a byte convolutional network.

The network reads windows of 256 bytes: byte embeddings, filters 2, 3 and 4 bytes wide, max pooling, softmax. It is
trained in numpy on the driver from a bounded sample of labelled rows (about ``SAMPLE_DOCS`` documents, never over twice as
many, ``SAMPLE_WINDOWS`` windows each, from anywhere in the text); rows whose crc32(doc_id) mod 5 is 0, null languages and null texts are never
learned from. Prediction covers every byte of every text: full windows side by side, the last one ending with the text.
A text's probabilities are the mean of its windows'.

A filtering stage rejects what is ``und`` and what scores below ``least``, which lies a third of the way from chance to the
score that ``SURE`` of the rightly read sample texts reach: texts that read like no language in particular.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled row every text is
``und``, and a filtering stage keeps all texts with a letter; texts shorter than a window are padded; a null doc_id is never
learned from and not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import held_out, map_slices, sample_rows
from weftgraph.llm.convtext import ConvText

LENGTH = 256
PAD = 256
SAMPLE_DOCS = 2400
SAMPLE_WINDOWS = 4
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
SURE = 0.995


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Window matrix (1, windows, LENGTH) of byte values and each text's first window."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // LENGTH))
    first = np.cumsum(counts) - counts
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.minimum((np.arange(counts.sum()) - first[owner]) * LENGTH, np.maximum(sizes[owner] - LENGTH, 0))
    base = np.cumsum(sizes) - sizes
    ids = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[base[owner] + start].astype(np.int16)
    for i in np.flatnonzero(sizes < LENGTH):
        ids[first[i], sizes[i] :] = PAD
    return ids[None], first


class LanguageModel:
    def __init__(self, languages: list[str], net: ConvText | None):
        self.languages, self.net, self.least = languages, net, 0.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        own = [i for i, t in enumerate(texts) if self.languages and t and LETTER.search(t)]
        if own:
            p = self.distribution([texts[i].encode() for i in own])
            for i, k, s in zip(own, p.argmax(axis=1), p.max(axis=1), strict=True):
                names[i], scores[i] = self.languages[k], min(1.0, float(s))
        return names, scores

    def distribution(self, texts: list[bytes]) -> np.ndarray:
        if self.net is None:
            return np.ones((len(texts), 1))
        ids, first = windows(texts)
        p = self.net.probabilities(self.net.features(ids)[0])
        return np.add.reduceat(p, first, axis=0) / np.diff(np.append(first, len(p)))[:, None]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    own = own.where(~F.coalesce(held_out("doc_id"), F.lit(True)) & F.col("lang").isNotNull())
    eligible, own = own.count(), own.where(F.length("text") > 0)
    places = [F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - LENGTH, F.lit(1))) + 1).cast("int"), F.lit(LENGTH)) for k in range(SAMPLE_WINDOWS)]
    rows = sorted(map(tuple, sample_rows(own.select("doc_id", "lang", F.array(*places).alias("cuts")), "doc_id", sample_docs, eligible)))
    languages = sorted({r[1] for r in rows})
    if len(languages) < 2:
        return LanguageModel(languages, None)
    pieces, labels = [], []
    for _, name, cuts in rows:
        for cut in cuts if len(cuts[0]) >= LENGTH else cuts[:1]:
            pieces.append(cut.encode()[:LENGTH])
            labels.append(languages.index(name))
            if len(pieces) % 4 == 0:  # short texts occur too
                pieces.append(cut.encode()[: 24 + 13 * (len(pieces) % 8)])
                labels.append(labels[-1])
    labels = np.array(labels)
    ids, first = windows(pieces)
    share = np.bincount(labels, minlength=len(languages)) / len(labels)
    net = ConvText([PAD], dim=6, widths=(2, 3, 4), filters=12, classes=len(languages))
    net.train(ids, first, labels, (1 / (len(languages) * share[labels])).astype(np.float32), epochs=3, rate=0.008)
    model = LanguageModel(languages, net)
    names, scores = model.predict([cuts[0] for _, _, cuts in rows])
    right = [s for n, s, (_, name, _) in zip(names, scores, rows, strict=True) if n == name]
    if right:
        model.least = (2 / len(languages) + float(np.quantile(right, 1 - SURE))) / 3
    return model


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, one row per input row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = model.predict(batch.column(1).to_pylist())
        return pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), kernel, "doc_id long, lang_pred string, score double", rows=128)


def op4(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs)).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: LanguageModel, least: float | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows whose language is determined with a score of ``least`` or more (the model's own, if none is given), with all their
    columns; a null ``lang`` becomes the language found."""
    schema, at, to = docs.schema, docs.columns.index(text), docs.columns.index(lang)
    least = model.least if least is None else least

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        if not model.languages:
            return batch.filter(pa.array([bool(t and LETTER.search(t)) for t in texts], pa.bool_()))
        names, scores = model.predict(texts)
        filled = pa.array([n if known is None else known for n, known in zip(names, batch.column(to).to_pylist(), strict=True)], batch.schema.field(to).type)
        batch = batch.set_column(to, batch.schema.field(to), filled)
        return batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return map_slices(docs, kernel, schema, rows=128)
