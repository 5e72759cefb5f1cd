"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import materialise, shared_dir  # noqa: F401  (re-exported for the operators)

#: Rows handed to a Python kernel at once; whole texts, so a slice stays small in bytes too.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a whole column; sizes partitions and buckets, never decides what is processed."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first().n


def join_unique(left: DataFrame, right: DataFrame, key: str, share: float = 1e-3, least: int = 64) -> DataFrame:
    """Inner join of ``left`` with at most one row of ``right`` a key, where few keys may hold most of ``left``.

    A key with over ``share`` of the rows is hot; there are at most ``1 / share`` of these, so their rows of ``right`` are
    broadcast, and only the other keys are shuffled. Both sides are read twice: pass tables.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("n"))
    hot = [r[0] for r in sizes.where(F.col("n") > max(least, int(left.count() * share))).collect()]
    if not hot:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(~is_hot).join(right.where(~is_hot), key).unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key))


def likely(df: DataFrame, keys: DataFrame, key: str, words: int = 1 << 20) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys``: every row whose key is, and few others, without a shuffle of ``df``.

    The hashes of the keys are bits of at most ``words`` words (a power of two) of 64 bits, which are broadcast.
    """
    word = F.xxhash64(key).bitwiseAND(F.lit(words - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key), 58).cast("int"))
    held = materialise(keys.select(word.alias("_word"), bit.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")), "words")
    return df.withColumn("_word", word).join(F.broadcast(held), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).select(df.columns)


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of rows that no model may learn from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def sampled(df: DataFrame, key: str, size: int, eligible: int) -> DataFrame:
    """About ``size`` of ``eligible`` rows, by a 63-bit hash of ``key``; all rows if there are no more."""
    share = min(1.0, size / max(1, eligible))
    return df.where(F.shiftrightunsigned(F.xxhash64(key), 1) <= F.lit(min(int(share * 2.0**63), (1 << 63) - 1)))


def sample_rows(df: DataFrame, key: str, size: int, eligible: int) -> list[Row]:
    """Sorted rows of ``sampled``, at most twice ``size`` of them, however often a key repeats. An empty sample of more rows than
    ``size`` is an error, so no model is learned from nothing unnoticed."""
    rows = sampled(df, key, size, eligible).orderBy(F.shiftrightunsigned(F.xxhash64(key), 1), *df.columns).limit(2 * size).collect()
    if not rows and eligible > size:
        raise RuntimeError(f"{eligible} rows to learn from, but none in the sample of {size}")
    return rows


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_slices(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, rows):
            yield kernel(piece)

    return df.mapInArrow(run, schema)
