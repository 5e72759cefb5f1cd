"""Session settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a run inside one process takes
    a temporary folder; a cluster, whose machines don't share such a folder, gets an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftgraph-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. Sizes estimated from files say little of rows that are made by explode
    or compress well: 3.6 million ports count as 1.5 MB, and broadcasting them takes the driver's memory."""
    return df.hint("merge")


#: Rows that one task aggregates, where the number of tasks goes by rows.
TASK_ROWS = 1 << 19


def parts_for(df: DataFrame) -> int:
    """How many partitions ``df`` needs so that each has about ``TASK_ROWS`` rows. Partitions that Spark joins by their bytes after
    compression may hold very many rows, and hash tables grow with the rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
