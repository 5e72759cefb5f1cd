"""Removing repeated byte strings with a distributed, sparse suffix array.

Every ``width``-byte string of a document that also starts in a document with a smaller id is removed. A suffix array
over every byte of the corpus would multiply it by the suffix length, so the array is sparse and exact all the same:

* Anchors. A position is an anchor if the hash of its 16 bytes is the least of some ``width``-byte window. Every window
  holds one, equal windows hold it at equal places, and one byte in about eighteen is an anchor.
* Shared anchors. Chunks of documents send 32-bit values of their distinct anchors to hash buckets; a bucket returns one
  bit a value: does any other document have it? This only filters, so collisions cost work but no result. A window goes
  on if its anchor is shared.
* Suffixes. For each such anchor, its suffix (``width`` bytes) and the bytes before it travel to the bucket that sampled
  splitters give for the suffix. Windows that repeat inside a chunk are decided there, so a passage that very many documents
  share sends about one suffix a chunk.
* Boundaries. Splitters are whole suffixes, so a range of very many suffixes with the same leading bytes is cut as finely as
  these differ at all. A window is compared in the bucket where the part of the suffix that lies inside the window would
  sort first: equal windows agree there, and a suffix whose windows belong to several buckets goes to each of them, with its
  share of the windows.
* Sorting. A bucket sorts suffixes by multikey quicksort on 8-byte words, likewise the reversed left contexts, and reads
  classes of equal windows off the two arrays of common prefixes; a window is removed if its class has a smaller id.

Chunks grow with the root of the corpus, which balances the number and the size of the messages between them.

Defined cases: null is the empty text; texts shorter than ``width`` are kept; rows with a null id are kept and remove
nothing; rows of the same id don't remove from each other; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import slices, total_bytes

WIDTH = 50
GRAM = 16
#: Least bytes of a chunk, of what a hash bucket and what a suffix bucket stand for; bytes sampled for splitters.
CHUNK, HASH_BUCKET, SUFFIX_BUCKET, SAMPLE = 4 << 20, 16 << 20, 8 << 20, 4 << 20
#: Least number of chunks.
CHUNKS = 64
#: Bytes that anchors are found in at once.
PIECE = 1 << 19
#: Rows from which a range of suffixes is partitioned; smaller ones are sorted word by word.
LEAF = 4096
OUTSIDE = 0xFF  # a byte that UTF-8 never has


def _hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 16 bytes from each position."""
    n = len(data) - GRAM + 1
    words = np.ndarray((n + 8,), "<u8", data, strides=(1,)).copy()
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += words[8:]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``size`` neighbours, by doubling."""
    op, have = (np.minimum if least else np.maximum), 1
    while have < size:
        step = min(have, size - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


class Anchors:
    """Anchors of several documents laid end to end."""

    def __init__(self, texts: list[bytes], width: int):
        self.width, self.room = width, width - GRAM + 1
        sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(self.data)
        self.at, self.hash, self.least = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        if n < width:
            return
        h = _hashes(self.data)
        short = (h >> np.uint64(32)).astype(np.uint32)
        self.valid = np.ones(n - width + 1, bool)
        for end in self.ends.tolist():  # windows that cross the end of a document
            self.valid[max(0, end - width + 1) : end] = False
        least = _sliding(short, self.room, True)
        self.least = np.where(self.valid, least, 0)
        pad = np.zeros(self.room - 1, np.uint32)
        most = _sliding(np.concatenate((pad, self.least, pad)), self.room, False)
        within = np.concatenate((self.valid, np.zeros(self.room - 1, bool)))
        self.at = np.flatnonzero((most == short) & _any_before(within, self.room))
        self.hash = h[self.at]
        self.short = short[self.at]

    @property
    def doc(self) -> np.ndarray:
        return np.searchsorted(self.ends, self.at, side="right")

    def masks(self, shared: np.ndarray) -> np.ndarray:
        """For each anchor the windows, as bits of their distance before it, that it stands for if it is shared."""
        out = np.zeros(len(self.at), np.uint64)
        for j in range(self.room):
            p = self.at - j
            own = np.flatnonzero(shared & (p >= 0) & (p < len(self.valid)))
            q = p[own]
            good = self.valid[q] & (self.least[q] == self.short[own])
            out[own[good]] |= np.uint64(1 << j)
        return out

    def contexts(self, own: np.ndarray) -> np.ndarray:
        """Bytes from room - 1 before to width after each anchor; OUTSIDE beyond its document."""
        before = self.room - 1
        padded = np.concatenate((np.full(before, OUTSIDE, np.uint8), self.data, np.full(self.width, OUTSIDE, np.uint8)))
        at, doc = self.at[own], self.doc[own]
        found = np.lib.stride_tricks.sliding_window_view(padded, before + self.width)[at].copy()
        place = np.arange(-before, self.width)
        found[place < (self.starts[doc] - at)[:, None]] = OUTSIDE
        found[place >= (self.ends[doc] - at)[:, None]] = OUTSIDE
        return found


def _any_before(flags: np.ndarray, size: int) -> np.ndarray:
    """Whether any of the ``size`` positions up to each one is set."""
    total = np.cumsum(np.concatenate((np.zeros(size, np.int32), flags)), dtype=np.int32)
    return total[size:] > total[:-size]


def _pieces(table: pa.Table) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Row keys, ids and texts of a chunk in an order that doesn't depend on the shuffle, a few MB at a time."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("row", "doc_id", "data")), strict=True))
    held, size = [], 0
    for row in rows:
        if held and size + len(row[2]) > PIECE:
            yield tuple(map(list, zip(*held, strict=True)))
            held, size = [], 0
        held.append(row)
        size += len(row[2])
    if held:
        yield tuple(map(list, zip(*held, strict=True)))


class ChunkAnchors:
    """Anchors of a whole chunk and their distinct values by hash bucket."""

    def __init__(self, table: pa.Table, width: int, buckets: int):
        self.pieces = [(rows, np.array(ids, np.int64), Anchors(texts, width)) for rows, ids, texts in _pieces(table)]
        h = np.concatenate([a.hash for _, _, a in self.pieces])
        docs = np.concatenate([ids[a.doc] for _, ids, a in self.pieces])
        # The bucket above 32 bits of the rest of the hash.
        key = (h % np.uint64(buckets)) << np.uint64(32) | (h // np.uint64(buckets) & np.uint64(0xFFFFFFFF))
        self.values, self.inverse = np.unique(key, return_inverse=True)
        low, high = np.full(len(self.values), 2**63 - 1), np.full(len(self.values), -(2**63))
        np.minimum.at(low, self.inverse, docs)
        np.maximum.at(high, self.inverse, docs)
        self.many = low < high
        self.bucket = (self.values >> np.uint64(32)).astype(np.int64)

    def runs(self) -> Iterator[tuple[int, int, int]]:
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1)) if len(self.bucket) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(self.bucket[a]), a, b


def _leaf_order(words: np.ndarray) -> np.ndarray:
    """Order of a few rows by their words; each pass sorts only the rows that all earlier words leave tied."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.zeros(len(words), bool)
    if len(words) > 1:
        same = words[order[1:], 0] == words[order[:-1], 0]
        group = np.concatenate(([0], np.cumsum(~same)))
        for d in range(1, words.shape[1]):
            tied[:] = False
            tied[1:] |= same
            tied[:-1] |= same
            own = np.flatnonzero(tied)
            if not len(own):
                break
            rows = order[own]
            order[own] = rows[np.lexsort((words[rows, d], group[own]))]
            same = same & (words[order[1:], d] == words[order[:-1], d])
            group = np.concatenate(([0], np.cumsum(~same)))
    return order


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows by their words: multikey quicksort. A range is partitioned by one word into the rows below, at and
    above a pivot; those at it go on with the next word."""
    order, todo = np.arange(len(words)), [(0, len(words), 0)]
    while todo:
        a, b, d = todo.pop()
        if b - a < 2 or d == words.shape[1]:
            continue
        rows = order[a:b]
        if b - a <= LEAF:
            order[a:b] = rows[_leaf_order(words[rows, d:])]
            continue
        key = words[rows, d]
        some = np.sort(key[:: len(key) // 63])
        pivot = some[len(some) // 2]
        below, at = key < pivot, key == pivot
        low, high = a + int(below.sum()), b - int((key > pivot).sum())
        order[a:b] = np.concatenate((rows[below], rows[at], rows[key > pivot]))
        todo += [(a, low, d), (low, high, d + 1), (high, b, d)]
    return order


def _words(chars: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(chars), -(-chars.shape[1] // 8) * 8), np.uint8)
    wide[:, : chars.shape[1]] = chars
    return wide.view(">u8").astype(np.uint64)


def _common(chars: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in order; 0 for the first."""
    out = np.zeros(len(chars), np.int64)
    for a in range(1, len(chars), 1 << 16):
        b = min(len(chars), a + (1 << 16))
        differs = chars[order[a:b]] != chars[order[a - 1 : b - 1]]
        out[a:b] = np.where(differs.any(axis=1), differs.argmax(axis=1), chars.shape[1])
    return out


def repeats(contexts: np.ndarray, docs: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """Of each context's windows (bits of ``masks``), those that also lie in a document with a smaller id."""
    out = np.zeros(len(docs), np.uint64)
    if len(docs) < 2:
        return out
    before = width - GRAM
    right, left = contexts[:, before:], contexts[:, before - 1 :: -1] if before else contexts[:, :0]
    order_r = multikey_order(_words(right))
    common_r = _common(right, order_r)
    # Rows that share no anchor with a neighbour are done.
    mates = common_r >= GRAM
    mates[:-1] |= mates[1:].copy()
    order_r, common_r = order_r[mates], common_r[mates]
    if len(order_r) < 2:
        return out
    rows = np.sort(order_r)
    place = np.empty(len(docs), np.int64)
    place[rows] = np.arange(len(rows))
    left, docs_r, masks_r = left[rows], docs[rows], masks[rows]
    order_l = multikey_order(_words(left))
    common_l = _common(left, order_l)
    rank = place[order_r]
    class_r, class_l, found = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), np.zeros(len(rows), np.uint64)
    for j in range(width - GRAM + 1):
        bit = np.uint64(1 << j)
        own = np.flatnonzero(masks_r & bit)
        if len(own) < 2:
            continue
        class_r[rank] = np.cumsum(common_r < width - j)
        class_l[order_l] = np.cumsum(common_l < j)
        window = class_r[own] * (len(rows) + 1) + class_l[own]
        sort = np.lexsort((docs_r[own], window))
        w, d = window[sort], docs_r[own][sort]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        low = np.repeat(d[first], np.diff(np.append(first, len(w))))
        found[own[sort[d > low]]] |= bit
    out[rows] = found
    return out


def _squeezed(raw: bytes) -> bytes:
    """Size, then zstd: what travels is sorted numbers and prose."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _expanded(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def _packed(rows: np.ndarray, at: np.ndarray, masks: np.ndarray) -> bytes:
    return _squeezed(rows.astype("<i8").tobytes() + at.astype("<i8").tobytes() + masks.astype("<u8").tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(_expanded(blob), "<u8").reshape(3, -1)


def _strings(chars: np.ndarray, length: int | None = None, fill: int = 0) -> np.ndarray:
    """Rows as byte strings; from ``length`` on they are filled up."""
    own = np.ascontiguousarray(chars) if length is None else chars.copy()
    if length is not None:
        own[:, length:] = fill
    return own.view(f"S{own.shape[1]}").ravel()


def destinations(suffixes: np.ndarray, masks: np.ndarray, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and windows (bits of the row's mask) for each bucket that a suffix goes to, ordered by bucket."""
    width = suffixes.shape[1]
    if not len(masks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = lambda length, fill, rows=slice(None): np.searchsorted(splitters, _strings(suffixes[rows], length, fill), side="right")
    low = place(GRAM, 0)
    apart = np.flatnonzero(low != place(GRAM, 0xFF))
    alone = np.setdiff1d(np.arange(len(masks)), apart, assume_unique=True)
    rows, buckets, bits = [alone], [low[alone]], [masks[alone]]
    for j in range(width - GRAM + 1):
        own = apart[(masks[apart] >> np.uint64(j)) & np.uint64(1) == 1]
        rows.append(own)
        buckets.append(place(width - j, 0, own))
        bits.append(np.full(len(own), 1 << j, np.uint64))
    row, bucket, bit = np.concatenate(rows), np.concatenate(buckets), np.concatenate(bits)
    order = np.lexsort((row, bucket))
    row, bucket, bit = row[order], bucket[order], bit[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
    return row[first], bucket[first], np.bitwise_or.reduceat(bit, first)


def sampled_splitters(own: DataFrame, total: int, buckets: int, width: int) -> np.ndarray:
    """Suffixes of sampled anchors that cut them into ``buckets`` like parts; a sample of at most about SAMPLE bytes of text."""
    share = min(1.0, SAMPLE / max(1, total))

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a = Anchors(batch.column(0).to_pylist(), width)
            yield pa.record_batch({"suffixes": pa.array([a.contexts(np.arange(len(a.at)))[:, width - GRAM :].tobytes()], pa.binary())})

    sample = own.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("data")
    found = np.sort(np.frombuffer(b"".join(bytes(r.suffixes) for r in sample.mapInArrow(leading, "suffixes binary").collect()), f"S{width}"))
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets]) if len(found) else found


def removal(docs: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, spans (start, end) of the removed runs in order, kept (the remaining bytes), one row per input row."""
    if not GRAM < width < GRAM + 64:
        raise ValueError(f"width must lie between {GRAM + 1} and {GRAM + 63}")
    total = total_bytes(docs, text)
    side = max(CHUNK, math.isqrt(512 * total))
    chunks, hash_buckets = max(CHUNKS, -(-total // side)), max(16, -(-total // max(HASH_BUCKET, side)))
    parts = max(16, -(-total // max(SUFFIX_BUCKET, side)))
    all_rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")).withColumn("row", F.xxhash64("doc_id", "data"))
    # At most SAMPLE / 18 suffixes, whatever the corpus.
    splitters = docs.sparkSession.sparkContext.broadcast(sampled_splitters(all_rows.where("doc_id is not null"), total, parts, width))
    laid = all_rows.withColumn("chunk", F.pmod("row", F.lit(chunks))).repartition(min(chunks, parts * 4), "chunk")
    ided = lambda t: t.filter(pc.is_valid(t.column("doc_id")))

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        table = ided(table)
        out = {"bucket": [], "chunk": [], "values": [], "many": []}
        if table.num_rows:
            own = ChunkAnchors(table, width, hash_buckets)
            for bucket, a, b in own.runs():
                out["bucket"].append(bucket)
                out["chunk"].append(key[0].as_py())
                out["values"].append((own.values[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
                out["many"].append(np.packbits(own.many[a:b]).tobytes())
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "chunk": pa.array(out["chunk"], pa.int64()), "values": pa.array(out["values"], pa.binary()), "many": pa.array(out["many"], pa.binary())})

    def share_out(key: tuple, table: pa.Table) -> pa.Table:
        values = [np.frombuffer(v, "<u4") for v in table.column("values").to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(v)).astype(bool) for m, v in zip(table.column("many").to_pylist(), values, strict=True)]
        every, n = np.unique(np.concatenate(values), return_counts=True)
        shared = every[n > 1]
        chunk, bits = [], []
        for c, v, m in zip(table.column("chunk").to_pylist(), values, many, strict=True):
            hit = m | (shared[np.minimum(np.searchsorted(shared, v), len(shared) - 1)] == v if len(shared) else False)
            if hit.any():
                chunk.append(c)
                bits.append(np.packbits(hit).tobytes())
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(chunk), pa.int64()), "bits": pa.array(bits, pa.binary())})

    def suffixes(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"bucket": [], "chunk": [], "found": [], "sent": []}
        table = ided(table)
        if table.num_rows and answers.num_rows:
            own = ChunkAnchors(table, width, hash_buckets)
            bits, shared = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True)), np.zeros(len(own.values), bool)
            for bucket, a, b in own.runs():
                if bucket in bits:
                    shared[a:b] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a)
            shared, done, got = shared[own.inverse], 0, []
            for rows, ids, a in own.pieces:
                masks = a.masks(shared[done : done + len(a.at)])
                done += len(a.at)
                hits = np.flatnonzero(masks)
                doc = a.doc[hits]
                got.append((a.contexts(hits), np.array(rows, np.int64)[doc], ids[doc], a.at[hits] - a.starts[doc], masks[hits]))
            contexts, rows, ids, at, masks = (np.concatenate(x) for x in zip(*got, strict=True))
            local = repeats(contexts, ids, masks, width)
            hits, rest = np.flatnonzero(local), masks & ~local
            if len(hits):
                out["bucket"].append(key[0].as_py() % (len(splitters.value) + 1))
                out["found"].append(_packed(rows[hits], at[hits], local[hits]))
                out["sent"].append(None)
            left = np.flatnonzero(rest)
            row, bucket, share = destinations(contexts[left][:, width - GRAM :], rest[left], splitters.value)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(left) else []
            for x, y in zip(cuts, cuts[1:], strict=False):
                pick = left[row[x:y]]
                out["bucket"].append(int(bucket[x]))
                out["found"].append(_packed(rows[pick], at[pick], share[x:y]))
                out["sent"].append(_squeezed(ids[pick].astype("<i8").tobytes() + contexts[pick].tobytes()))
            out["chunk"] = [key[0].as_py()] * len(out["bucket"])
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), "chunk": pa.array(out["chunk"], pa.int64()), "found": pa.array(out["found"], pa.binary()), "sent": pa.array(out["sent"], pa.binary())})

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "found", "sent")), strict=True))
        chunk, found = [c for c, _, s in rows if s is None], [f for _, f, s in rows if s is None]
        asked = [(c, _unpacked(f), _expanded(s)) for c, f, s in rows if s is not None]
        if asked:
            sizes = [f.shape[1] for _, f, _ in asked]
            ids = np.concatenate([np.frombuffer(s, "<i8", n) for (_, _, s), n in zip(asked, sizes, strict=True)])
            contexts = np.concatenate([np.frombuffer(s, np.uint8, offset=8 * n).reshape(n, -1) for (_, _, s), n in zip(asked, sizes, strict=True)])
            hit = repeats(contexts, ids, np.concatenate([f[2] for _, f, _ in asked]), width)
            done = 0
            for (c, f, _), n in zip(asked, sizes, strict=True):
                own = hit[done : done + n]
                done += n
                pick = np.flatnonzero(own)
                if len(pick):
                    chunk.append(c)
                    found.append(_packed(f[0, pick].view("<i8"), f[1, pick].view("<i8"), own[pick]))
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "found": pa.array(found, pa.binary())})

    def remove(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        out = {"doc_id": table.column("doc_id").combine_chunks(), "n_bytes": [], "spans": [], "kept": []}
        hits = np.concatenate([_unpacked(f) for f in found.column("found").to_pylist()] or [np.zeros((3, 0), np.uint64)], axis=1)
        hits = hits[:, np.argsort(hits[0].view(np.int64), kind="stable")]
        rows, at, masks = hits[0].view(np.int64), hits[1].view(np.int64), hits[2]
        for row, data in zip(table.column("row").to_pylist(), table.column("data").to_pylist(), strict=True):
            a, b = np.searchsorted(rows, row, "left"), np.searchsorted(rows, row, "right")
            edges = np.zeros((0, 2), np.int64)
            if b > a:
                starts = np.zeros(len(data) + 1, np.int32)
                for j in range(width - GRAM + 1):
                    starts[at[a:b][(masks[a:b] >> np.uint64(j)) & np.uint64(1) == 1] - j] = 1
                total_starts = np.concatenate((np.zeros(width, np.int32), np.cumsum(starts[:-1], dtype=np.int32)))
                covered = total_starts[width:] > total_starts[:-width]
                edges = np.flatnonzero(np.diff(covered, prepend=False, append=False)).reshape(-1, 2)
                data_kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
            else:
                data_kept = data
            out["n_bytes"].append(len(data))
            out["spans"].append(edges.tolist())
            out["kept"].append(data_kept)
        return pa.table({"doc_id": out["doc_id"], "n_bytes": pa.array(out["n_bytes"], pa.int64()), "spans": pa.array(out["spans"], pa.list_(pa.list_(pa.int64()))), "kept": pa.array(out["kept"], pa.binary())})

    by_chunk = lambda df: df.groupBy("chunk")
    shared = by_chunk(laid).applyInArrow(sketch, "bucket long, chunk long, values binary, many binary").repartition(hash_buckets, "bucket").groupBy("bucket").applyInArrow(share_out, "chunk long, bucket long, bits binary")
    sent = by_chunk(laid).cogroup(by_chunk(shared)).applyInArrow(suffixes, "bucket long, chunk long, found binary, sent binary")
    found = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(compare, "chunk long, found binary")
    return by_chunk(laid).cogroup(by_chunk(found)).applyInArrow(remove, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")


def op9(docs: DataFrame) -> DataFrame:
    found = removal(docs)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
