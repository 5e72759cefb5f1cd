"""Snapshots as Parquet folders, with content-addressed sources and a manifest of digests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import LIMITS, TABLES, table


def write(tables: dict[str, DataFrame], path: str) -> None:
    """One folder per table, sorted inside range partitions by module and id; equal source contents are stored once."""
    for name, df in tables.items():
        own = df.select(*table(name).names)
        if name == "sources":
            own.select("sha256", "size", "content").dropDuplicates(["sha256"]).write.mode("overwrite").parquet(f"{path}/contents")
            own = own.drop("content")
        keys = [c for c in ("snapshot_id", "module_id", "node_id", "edge_id", "port_id", "path", "ord") if c in own.columns]
        own.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, name: str, verify: bool = True) -> DataFrame:
    """A table of a snapshot; contents whose size or digest is wrong are an error when they are read."""
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    if name != "sources":
        return spark.read.schema(table(name)).parquet(f"{path}/{name}")
    rows = spark.read.schema("snapshot_id string, file_id string, path string, sha256 string, size long").parquet(f"{path}/sources")
    contents = spark.read.schema("sha256 string, size long, content string").parquet(f"{path}/contents").select("sha256", "content")
    met = rows.join(contents, "sha256", "left").select(*table(name).names)
    if not verify:
        return met
    wrong = (F.sha2("content", 256) != F.col("sha256")) | (F.octet_length("content") != F.col("size"))
    return met.withColumn("content", F.when(wrong, F.raise_error(F.concat(F.lit("damaged source "), "path")).cast("string")).otherwise(F.col("content")))


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """archive, entry, size, sha256, content of ZIP archives, one archive a row at a time; limits on entries and sizes are errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    if len(infos) > LIMITS["archive_entries"] or sum(i.file_size for i in infos) > LIMITS["archive_bytes"] or any(i.file_size > LIMITS["archive_entry_bytes"] for i in infos):
                        raise ValueError(f"{name} exceeds the limits of an archive")
                    if any(i.file_size > LIMITS["archive_ratio"] * max(1, i.compress_size) for i in infos):
                        raise ValueError(f"{name} is compressed beyond the limit")
                    for i in infos:
                        yield pd.DataFrame({"archive": [name], "entry": [i.filename], "size": [i.file_size], "content": [z.read(i)]})

    held = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, entry string, size long, content binary")
    return held.withColumn("sha256", F.sha2("content", 256))


def verify_entries(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """archive, entry, problem: missing, undeclared, size, digest. ``manifest`` has archive, entry, size, sha256."""
    m = manifest.select("archive", "entry", F.col("size").alias("s"), F.col("sha256").alias("d"), F.lit(True).alias("declared"))
    met = entries.select("archive", "entry", "size", "sha256", F.lit(True).alias("held")).join(m, ["archive", "entry"], "full_outer")
    problem = F.when(F.col("held").isNull(), "missing").when(F.col("declared").isNull(), "undeclared").when(F.col("size") != F.col("s"), "size").when(F.col("sha256") != F.col("d"), "digest")
    return met.select("archive", "entry", problem.alias("problem")).where("problem is not null")
