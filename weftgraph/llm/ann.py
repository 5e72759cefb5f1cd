"""Nearest neighbours by cosine over randomly rotated one-bit codes.

Each unit vector is padded to ``EXPAND`` times its width and rotated by a seeded orthogonal matrix. Its code is the signs,
packed; its correction scalar is the inner product of the rotated vector with its own code. A query's rotated vector is
quantised to ``PLANES`` bit planes, so inner products with codes are sums of bit counts; divided by the correction
scalar they estimate the cosine. Errors stay, but for a chance that ``WIDENESS`` sets, within
WIDENESS * sqrt(1 - c * c) / (c * sqrt(bits - 1)) plus the quantisation error. In every block of rows the k-th largest
lower bound decides: only vectors whose upper bound reaches it are measured exactly, in doubles, on the original vectors.

All rows are indexed. The stated query set meets every block of rows, in blocks of at most about ``ASK_ROWS`` queries, so a
task holds one block of each: rows are dealt by a hash of their id, so
a vector that very many rows share loads all blocks alike, and a block keeps the k + 1 smallest ids of equal vectors
(no other can be among the k nearest).

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, take no part; vectors of
different widths never meet; ties go to the smaller id; rows with the query's id are its own; of rows with one id among
the queries the least vector is the query; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAREST = 5
EXPAND = 4
PLANES = 6
WIDENESS = 3.0
SEED = 20
BLOCK_ROWS = (4096, 262_144)  # least and most rows of a block
ASK_ROWS = 65_536


@functools.lru_cache(maxsize=4)
def rotation(width: int) -> np.ndarray:
    """(width, bits): the rows of an orthogonal matrix that padded vectors touch."""
    bits = -(-EXPAND * width // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(SEED + width).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:width]


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # no overflow of squares
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs (n, words) and correction scalars (n)."""
    turned = unit(vectors) @ rotation(vectors.shape[1])
    codes = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return codes, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimate(query: np.ndarray, codes: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of one rotated unit query with all codes, and their error bounds."""
    bits = len(query)
    low = query.min()
    unit_step = max((query.max() - low) / ((1 << PLANES) - 1), 1e-300)
    levels = np.rint((query - low) / unit_step).astype(np.int64)
    dot = np.zeros(len(codes), np.int64)
    for b in range(PLANES):
        plane = np.packbits((levels >> b & 1).astype(bool), bitorder="little").view(np.uint64)
        dot += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << b
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    # sum of +-q over the code's signs, from the sum over its set bits
    signed = 2 * (low * ones + unit_step * dot) - query.sum()
    found = signed / (np.sqrt(bits) * scalars)
    error = WIDENESS * (np.sqrt(np.maximum(1 - scalars**2, 0) / (bits - 1)) + unit_step / np.sqrt(12)) / scalars
    return found, error


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row in doubles, so that equal vectors score equally wherever they lie."""
    q, v = query.astype(np.float64), vectors.astype(np.float64)
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, scalars: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, id, score) of each query's k nearest rows of a block."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, same = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, same))
    first = np.flatnonzero(np.diff(same[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    own = order[place <= k]
    vectors, ids, codes, scalars = vectors[own], ids[own], codes[own], scalars[own]
    turned, out = unit(queries) @ rotation(queries.shape[1]), []
    for query, q, query_id in zip(queries, turned, query_ids.tolist(), strict=True):
        found, error = estimate(q, codes, scalars)
        other = ids != query_id
        lower = np.where(other, found - error, -np.inf)
        least = np.partition(lower, -k)[-k] if len(lower) > k else -np.inf
        near = np.flatnonzero(other & (found + error >= least))
        exact = cosines(query, vectors[near])
        best = np.lexsort((ids[near], -exact))[:k]
        out += [(query_id, int(ids[near[i]]), float(exact[i])) for i in best]
    return out


def _usable(vector: Column) -> Column:
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _kind(rows: DataFrame, vector: str) -> str:
    """Floats stay floats; any other numbers are measured as doubles."""
    return "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"


def index(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, width, vector, code (packed words), scalar of every usable row."""
    kind = _kind(rows, vector)
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    own = own.where(F.col("vec_id").isNotNull() & F.coalesce(_usable(F.col("vector")), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            widths = np.diff(lists.offsets.to_numpy())
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                vectors = part.column(1).flatten().to_numpy().reshape(-1, width)
                codes, scalars = encode(vectors)
                yield pa.record_batch({"vec_id": part.column(0), "width": pa.array(np.full(len(vectors), width, np.int32)), "vector": part.column(1), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "scalar": pa.array(scalars)})

    return own.mapInArrow(run, f"vec_id long, width int, vector {kind}, code binary, scalar double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = NEAREST, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows."""
    count = rows.count()
    blocks = max(16, -(-count // min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], count // 256))))
    coded = index(rows, vector, vec_id).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast(_kind(rows, vector)).alias("query"))
    asked = asked.where(F.col("query_id").isNotNull() & F.coalesce(_usable(F.col("query")), F.lit(False))).groupBy("query_id").agg(F.min("query").alias("query"))
    asks = max(1, -(-queries.count() // ASK_ROWS))
    asked = asked.withColumn("ask", F.pmod(F.xxhash64("query_id"), F.lit(asks)).cast("int"))
    asked = asked.select("query_id", "query", F.size("query").alias("width"), "ask", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    coded = coded.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))

    def search(key: tuple, data: pa.Table, ask: pa.Table) -> pa.Table:
        width, found = key[0].as_py(), []
        if data.num_rows and ask.num_rows:
            stack = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, width)
            vectors, ids = stack(data, "vector"), data.column("vec_id").to_numpy()
            codes = np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)
            found = search_block(stack(ask, "query"), ask.column("query_id").to_numpy(), vectors, ids, codes, data.column("scalar").to_numpy(), k)
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    met = coded.groupBy("width", "block", "ask").cogroup(asked.groupBy("width", "block", "ask")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(rows: DataFrame) -> DataFrame:
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
