"""Token ids in blocks of canonical length-limited Huffman code.

File format: a folder with three tables in Parquet, which alone suffice to read the ids back.

- ``blocks``: one row per block of whole documents, in ascending doc_id order (``part``, then ``block``): ``doc_ids`` and
  ``counts`` (ids per document, end id included), ``before`` (ids of the part's earlier blocks), ``payload`` (codes, most
  significant bit first, padded to 32-bit words) and ``checkpoints`` (bit offset of every ``stride``-th id, unsigned 64-bit
  little-endian);
- ``parts``: ``part`` and ``ahead``, the ids of all earlier parts;
- ``code``: one row with ``lengths`` (a byte per id; the code is canonical, so the lengths alone describe it) and
  ``stride``. It is written last, so a folder without it is an unfinished file.

A block decodes without its neighbours, and every checkpoint is an entry point: the decoder runs over all checkpoints at
once, with one table lookup per id.

The tokenizers library's model encodes each distinct piece of the texts once per worker memo; pieces are what its own byte-level
pre-tokenizer would cut, and added tokens (``<|endoftext|>``) are cut out before, as the library does, so a text's ids are
those of encoding it whole.

Defined cases: null is the empty text (its only id is the end id); rows with a null doc_id come first; repeated rows
stay; an empty table gives no block.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import materialise, shared_dir, slices, total_bytes
from weftgraph.llm.pretokens import splitter

END = 2
STRIDE = 128
BLOCK_IDS = 1 << 16
LONGEST = 18
PART_BYTES = 8 << 20
#: New pieces in a worker's memo after which those go that were not asked for meanwhile, and the longest piece that it keeps.
MEMO, LONG = 400_000, 64


class Pieces(dict):
    """Packed ids by piece, made when a piece is first asked for, by the library's own model: what its byte-level pre-tokenizer
    hands to the model is the piece with a character for each byte.

    Entries are of two ages: whenever there are ``most`` young ones, these become the old ones, and old ones are young again when
    they are asked for; so what comes often stays, however long it is.
    """

    def __init__(self, library, kind: str, most: int):
        self.tokenize, self.kind, self.most, self.old = library.model.tokenize, kind, most, {}
        plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
        self.shown = dict(zip(plain + [b for b in range(256) if b not in plain], [*plain, *range(256, 512)], strict=False))

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array(self.kind, [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.shown))]).tobytes()
        if len(piece) <= LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of whole texts as packed little-endian unsigned integers."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.find = {2: "H", 4: "I"}[self.width], splitter()
        added = self.library.get_added_tokens_decoder()
        plain = {i: t for i, t in added.items() if not (t.single_word or t.lstrip or t.rstrip or t.normalized)}
        # Texts with other added tokens go to the library whole; those with plain ones are cut there, longest first.
        alternatives = lambda tokens: "|".join(re.escape(t.content) for t in sorted(tokens, key=lambda t: -len(t.content))) or "(?!)"
        self.cut, self.whole = re.compile(f"({alternatives(plain.values())})"), re.compile(alternatives(t for i, t in added.items() if i not in plain))
        self.any_whole = len(plain) < len(added)
        self.fixed = {t.content: array(self.kind, [i]).tobytes() for i, t in plain.items()}
        self.pieces = Pieces(self.library, self.kind, MEMO)

    def _ids(self, text: str) -> bytes:
        if self.any_whole and self.whole.search(text):
            return array(self.kind, self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        get = self.pieces.__getitem__
        if not self.cut.search(text):
            return b"".join(map(get, self.find(text)))
        return b"".join(self.fixed[part] if at % 2 else b"".join(map(get, self.find(part))) for at, part in enumerate(self.cut.split(text)))

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        last = array(self.kind, [end]).tobytes()
        return [(self._ids(t) if t else b"") + last for t in texts]


_encoders: dict[int, PieceEncoder] = {}


def _encoder(model: str) -> PieceEncoder:
    key = zlib.crc32(model.encode())
    if key not in _encoders:
        _encoders[key] = PieceEncoder(model)
    return _encoders[key]


def token_blocks(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", end: int = END) -> tuple[DataFrame, int]:
    """Uncompressed blocks in order (part, block, before, doc_ids, counts, packed ids) and the bytes of a packed id."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, a few MB
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Parts grow with the root of the size, and so do the cuts that the driver holds: 30,000 parts at 100 TB.
    parts = max(16, round(8 * (total_bytes(own, "text") / PART_BYTES) ** 0.5))
    found = own.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = np.unique(np.array(found, np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in slices(batches, 128):
            ids = encoder.encode(batch.column(1).to_pylist(), end)
            keys = np.array([-(2**63) if k is None else k for k in batch.column(0).to_pylist()], np.int64)
            yield pa.record_batch({"part": pa.array(np.searchsorted(cuts, keys, side="left").astype(np.int32)), "doc_id": batch.column(0), "ids": pa.array(ids, pa.binary())})

    dealt = own.mapInArrow(encode, "part int, doc_id long, ids binary").repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "ids")
    width = _encoder(model.value).width

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, held, size = None, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            counts = [len(i) // width for _, i in held]
            return pa.record_batch({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "before": pa.array([before], pa.int64()), "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())), "ids": pa.array([b"".join(i for _, i in held)], pa.binary())})

        for batch in slices(batches):
            for p, d, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (p != part or size >= BLOCK_IDS * width):
                    yield flush()
                    block, before, held, size = block + 1, before + size // width, [], 0
                if p != part:
                    part, block, before = p, 0, 0
                held.append((d, i))
                size += len(i)
        if held:
            yield flush()

    return dealt.mapInArrow(pack, "part int, block int, before long, doc_ids array<long>, counts array<long>, ids binary"), width


def id_counts(blocks: DataFrame, width: int) -> dict[int, int]:
    """Global count of every id; at most one row per id of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, 16):
            for ids in batch.column(0):
                here = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                if len(here) > len(total):
                    total = np.concatenate((total, np.zeros(len(here) - len(total), np.int64)))
                total[: len(here)] += here
        own = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(own.astype(np.int64)), "n": pa.array(total[own])})

    rows = blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in rows}


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package merge); zero counts have no code."""
    lengths, own = np.zeros(len(counts), np.uint8), np.flatnonzero(counts)
    if len(own) < 2:
        lengths[own] = 1
        return lengths
    longest = max(longest, int(len(own) - 1).bit_length())
    order = own[np.argsort(counts[own], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        both = np.concatenate((leaves, packages))
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(leaves))
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes of the lengths: shorter first, equal lengths by id."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        code <<= n - before
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code, before = code + len(own), n
    return codes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and checkpoints."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word, room = at >> 5, 64 - (at & 31) - n
    frame = codes[ids] << room.astype(np.uint64)
    size = int((ends[-1] + 31) // 32) if len(ids) else 0
    # Bits of different codes never overlap, so sums are unions; below 2**53 they are exact in doubles.
    words = np.bincount(word, (frame >> np.uint64(32)).astype(float), size + 1) + np.bincount(word + 1, (frame & np.uint64(0xFFFFFFFF)).astype(float), size + 1)[: size + 1] if len(ids) else np.zeros(1)
    return words[:size].astype(">u4").tobytes(), at[::STRIDE].astype("<u8").tobytes()


class Decoder:
    def __init__(self, lengths: np.ndarray, stride: int = STRIDE):
        self.stride = stride
        self.bits = int(lengths.max(initial=1))
        self.symbol, self.length = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.int64)
        own = np.flatnonzero(lengths)
        order = own[np.lexsort((own, lengths[own]))]
        spans = 1 << (self.bits - lengths[order].astype(np.int64))
        filled = int(spans.sum())
        self.symbol[:filled], self.length[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)

    def decode(self, payloads: list[bytes], checkpoints: list[bytes], sizes: list[int]) -> list[np.ndarray]:
        """Ids of several blocks; every checkpoint of all of them decodes in step."""
        starts = [np.frombuffer(c, "<u8").astype(np.int64) for c in checkpoints]
        bases = np.cumsum([0, *map(len, payloads)])[:-1] * 8
        tail = bytes(4 * (2 + self.stride * self.bits // 32 + 1))
        words = np.frombuffer(b"".join(payloads) + tail, ">u4").astype(np.uint64)
        at = np.concatenate([s + b for s, b in zip(starts, bases, strict=True)])
        out = np.empty((len(at), self.stride), np.uint32)
        limit = len(words) - 2
        for k in range(self.stride):
            word = np.minimum(at >> 5, limit)
            frame = words[word] << np.uint64(32) | words[word + 1]
            peek = (frame >> (64 - self.bits - (at & 31)).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)
            out[:, k] = self.symbol[peek]
            at = at + self.length[peek]
        lanes, found = 0, []
        for s, n in zip(starts, sizes, strict=True):
            found.append(out[lanes : lanes + len(s)].reshape(-1)[:n])
            lanes += len(s)
        return found


def write_token_file(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Write the documents' ids into a new folder, in the format above."""
    spark = docs.sparkSession
    blocks, width = token_blocks(docs, path)
    blocks = materialise(blocks, "token-blocks")
    counts = id_counts(blocks, width)
    dense = np.zeros(max(counts, default=0) + 1, np.int64)
    for i, n in counts.items():
        dense[i] = n
    lengths = code_lengths(dense)
    code = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # one entry per id of the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            packed = [encode_block(np.frombuffer(i.as_buffer(), f"<u{width}"), *code.value) for i in batch.column("ids")]
            fixed = {c: batch.column(c) for c in ("part", "block", "before", "doc_ids", "counts")}
            yield pa.record_batch(fixed | {"payload": pa.array([p for p, _ in packed], pa.binary()), "checkpoints": pa.array([c for _, c in packed], pa.binary())})

    blocks.mapInArrow(encode, "part int, block int, before long, doc_ids array<long>, counts array<long>, payload binary, checkpoints binary").write.parquet(f"{folder}/blocks")
    written = spark.read.parquet(f"{folder}/blocks")
    sizes = written.groupBy("part").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n"))
    _ahead(sizes).write.parquet(f"{folder}/parts")
    spark.createDataFrame([(bytearray(lengths.tobytes()), STRIDE)], "lengths binary, stride int").write.parquet(f"{folder}/code")


def _ahead(sizes: DataFrame) -> DataFrame:
    """part, ahead: sums of the earlier parts, within groups of parts and then over the groups. The driver sees a sum per
    group, and there are as many groups as parts in one."""
    sizes = materialise(sizes, "part-sizes")
    group = F.floor(F.col("part") / max(1, round(sizes.count() ** 0.5))).cast("int")
    totals = dict(map(tuple, sizes.groupBy(group.alias("g")).agg(F.sum("n")).collect()))
    keys = sorted(totals)
    earlier = np.cumsum([0, *(totals[k] for k in keys)]).tolist()
    base = sizes.sparkSession.createDataFrame(list(zip(keys, earlier, strict=False)), "g int, base long")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("g", group).select("g", "part", inside.alias("inside")).join(base, "g").select("part", (F.col("inside") + F.col("base")).alias("ahead"))


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (packed little-endian unsigned 32-bit) of every document, from the folder alone."""
    code = spark.read.parquet(f"{folder}/code").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(bytes(code.lengths), np.uint8), code.stride))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(*shared.value)
        for batch in slices(batches, 16):
            rows = batch.to_pydict()
            blocks = decoder.decode(rows["payload"], rows["checkpoints"], [sum(c) for c in rows["counts"]])
            for before, doc_ids, counts, ids in zip(rows["before"], rows["doc_ids"], rows["counts"], blocks, strict=True):
                ends = np.cumsum(counts)
                starts, raw = ends - counts, ids.astype("<u4").tobytes()
                yield pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts + before), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())})

    placed = spark.read.parquet(f"{folder}/blocks").join(spark.read.parquet(f"{folder}/parts"), "part")
    placed = placed.select((F.col("before") + F.col("ahead")).alias("before"), "doc_ids", "counts", "payload", "checkpoints")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op8(docs: DataFrame, path: str | None = None) -> DataFrame:
    folder = f"{shared_dir(docs.sparkSession)}/token-file-{uuid.uuid4().hex}"
    write_token_file(docs, folder, path)
    found = read_token_file(docs.sparkSession, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
