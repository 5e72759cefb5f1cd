"""SimHash near-duplicates with pivot distance tables.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Two fingerprints link at
``max_bits`` or fewer differing bits. The search works on distinct fingerprints only:

1. every fingerprint carries its Hamming distances to 16 fixed reference fingerprints (the pivot table), computed once;
2. fingerprints meet where 2 of 5 parts of their bits agree, which any pair at 3 or fewer differing bits does. A meeting
   that holds over ``HOT`` of all fingerprints is dealt into pivot cells: ranges of the distances to the first
   ``CELL_PIVOTS`` pivots, each widened by ``max_bits``, so that a pair that may link still meets in one of them;
3. inside a meeting, sorted by the first distance, |d(x, p) - d(y, p)| <= d(x, y) discards every pair whose largest
   coordinate difference exceeds ``max_bits``; survivors are verified by their differing bits;
4. a meeting returns a spanning star of each of its connected pieces (at most n - 1 links for n fingerprints, never all
   pairs), and the stars are joined into components by label propagation with pointer jumping.

A fingerprint of very many rows is one node of this search; its rows get their component by a broadcast of such
fingerprints alone, of which there are at most a thousand.

Defined cases: null and white-space texts have fingerprint zero and link like any other; fewer words than the shingle
size give one shingle of all words; equal texts share a fingerprint; repeated rows stay as rows; a null id is never a
component id unless all ids of its group are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import join_unique, map_slices, materialise

SEED = 42
BITS = 64
PIVOTS = 16
#: Share of all fingerprints (and least number) from which a meeting is dealt into cells of that many pivots and distances.
HOT, HOT_LEAST, CELL_PIVOTS, CELL = 1e-4, 256, 4, 8
#: Meetings up to this size are compared all at once; larger ones one by one.
SMALL = 64
#: Shingles hashed before their bits are counted.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned fingerprint of one text."""
    tokens = (text or "").encode().lower().split()  # bytes.lower: A-Z only; bytes.split: 0x20 and 0x09-0x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    n = len(tokens) - k + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        spans = zip(starts[at : at + m].tolist(), ends[at + k - 1 : at + k - 1 + m].tolist(), strict=True)
        ones += set_bits(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, m))
    return majority(ones, n)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of some hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes by their set bits."""
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of hashes that are worked out already."""
    return majority(sum((set_bits(hashes[at : at + CHUNK]) for at in range(0, len(hashes), CHUNK)), np.zeros(BITS, np.int64)), len(hashes))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), one row per input row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))})

    return map_slices(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), kernel, "doc_id long, fp long")


def _pivots() -> list[int]:
    """Reference fingerprints: hashes of small numbers, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED)).view(np.int64)) for i in range(PIVOTS)]


def _masks(max_bits: int) -> list[int]:
    """Bit masks of which every pair within ``max_bits`` agrees on at least one: any two of ``max_bits + 2`` parts."""
    edges = [round(i * BITS / (max_bits + 2)) for i in range(max_bits + 3)]
    parts = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in combinations(parts, 2)]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """Adds c0 and c1: sixteen distances to the pivots, one byte each."""

    def packed(pivots: list[int]):
        return sum((F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i) for i, p in enumerate(pivots)), F.lit(0).cast("long"))

    pivots = _pivots()
    # The byte of a distance never exceeds 64, so the sum of shifted bytes cannot overflow.
    return nodes.withColumns({"c0": packed(pivots[:8]), "c1": packed(pivots[8:])})


def stars(ids: np.ndarray, fps: np.ndarray, coords: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (id, smallest id of its piece) of the fingerprints that link; breadth first over what is left."""
    order = np.argsort(coords[:, 0], kind="stable")
    ids, fps, coords = ids[order], fps[order], coords[order]
    left = np.arange(len(fps))
    out_a, out_b = [], []
    while len(left) > 1:
        piece, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            first = coords[left, 0]
            lo, hi = np.searchsorted(first, [coords[x, 0] - max_bits, coords[x, 0] + max_bits + 1])
            near = left[lo:hi]
            near = near[np.abs(coords[near] - coords[x]).max(axis=1, initial=0) <= max_bits]
            hits = near[np.bitwise_count(fps[near] ^ fps[x]) <= max_bits]
            if len(hits):
                left = left[~np.isin(left, hits, assume_unique=True)]
                queue.extend(hits)
                piece.extend(hits)
        if len(piece) > 1:
            members = ids[piece]
            low = members.min()
            members = members[members != low]
            out_a.append(members)
            out_b.append(np.full(len(members), low))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def meeting_links(starts: np.ndarray, ids: np.ndarray, fps: np.ndarray, coords: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of several meetings, which begin at ``starts`` and are sorted by their first coordinate."""
    ends = np.append(starts[1:], len(ids))
    sizes = ends - starts
    end = np.repeat(ends, sizes)
    linked = sizes > SMALL
    small = np.flatnonzero(np.repeat(~linked, sizes))
    for lag in range(1, SMALL):
        small = small[small + lag < end[small]]
        if not len(small):
            break
        near = small[coords[small + lag, 0] - coords[small, 0] <= max_bits]
        near = near[np.abs(coords[near + lag] - coords[near]).max(axis=1, initial=0) <= max_bits]
        near = near[np.bitwise_count(fps[near + lag] ^ fps[near]) <= max_bits]
        linked[np.searchsorted(starts, near, "right") - 1] = True
    found = [stars(ids[x:y], fps[x:y], coords[x:y], max_bits) for x, y in zip(starts[linked].tolist(), ends[linked].tolist(), strict=True)]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *(f[0] for f in found)]), np.concatenate([empty, *(f[1] for f in found)])


def _cells(max_bits: int) -> Column:
    """For a row in a hot meeting, the numbers of its pivot cells; one cell otherwise."""

    def extended(cells: Column, both: Column) -> Column:
        return F.flatten(F.transform(cells, lambda c: F.transform(both, lambda x: c * 16 + x + 1)))

    cells = F.array(F.lit(0))
    for i in range(CELL_PIVOTS):
        d = F.shiftrightunsigned("c0", 8 * i).bitwiseAND(F.lit(255)).cast("int")
        own = F.floor(d / CELL).cast("int")
        # A pair across an edge meets in the lower cell.
        both = F.when(d % CELL < max_bits, F.array(own, own - 1)).otherwise(F.array(own))
        cells = extended(cells, both)
    return F.when(F.col("hot"), cells).otherwise(F.array(F.lit(0)))


def star_links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) with a > b between the ``first`` ids of distinct fingerprints; their components are those of all links."""
    spread = pivot_table(nodes).select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(max_bits)])).alias("t", "key"), "first", "fp", "c0", "c1")
    least = max(HOT_LEAST, int(nodes.count() * HOT))
    # At most 1 / HOT meetings for each mask.
    hot = spread.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > least).select("t", "key", F.lit(True).alias("hot"))
    spread = spread.join(F.broadcast(hot), ["t", "key"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    spread = spread.select("t", "key", F.explode(_cells(max_bits)).alias("cell"), "first", "fp", "c0", "c1", F.col("c0").bitwiseAND(F.lit(255)).alias("d"))
    met = spread.repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell", "d").drop("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns of the meeting that the next batch may go on with

        def links(rows: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            coords = np.stack(rows[5:7], axis=1).view(np.uint8).reshape(-1, PIVOTS).astype(np.int16)
            a, b = meeting_links(starts, rows[3], rows[4].view(np.uint64), coords, max_bits)
            return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate((h, c)) for h, c in zip(held, batch.columns, strict=True)] if held else [np.asarray(c) for c in batch.columns]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in rows[:3]], axis=0)))
            starts = np.flatnonzero(new)
            cut = starts[-1]
            if cut:
                yield links([c[:cut] for c in rows], starts[:-1])
            held = [c[cut:] for c in rows]
        if held:
            yield links(held, np.zeros(1, np.int64))

    return met.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable over the links, itself included) of every linked id.

    Each round takes the smallest label among neighbours, then the label's own label; rounds grow with the logarithm of
    a component's diameter. Every round is a table in the shared folder; ids and labels that very many links share are joined
    by broadcast.
    """
    links = materialise(links, "links")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = join_unique(both, labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = materialise(step, "labels")
        # A label is an id with links of its own.
        jump = join_unique(step, step.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", "old", F.col("up").alias("label"))
        jump = materialise(jump, "labels")
        if jump.where(F.col("old") != F.col("label")).isEmpty():
            return jump.select("id", "label")
        labels = jump.select("id", "label")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of ``max_bits`` or fewer bits)."""
    prints = materialise(fingerprints(docs, text, doc_id, words), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = components(star_links(nodes.where("first is not null"), max_bits))
    named = nodes.join(labels.withColumnRenamed("id", "first"), "first", "left").select("fp", F.coalesce("label", "first").alias("component_id"))
    return join_unique(prints, materialise(named, "named-fingerprints"), "fp").select("doc_id", "fp", "component_id")


def op10(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
