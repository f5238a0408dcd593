"""Session settings that several operators need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that one task takes of a loop's tables, and that are broadcast at most (about 3 MB).
SHARE = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is set, a new local one, on one machine only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written once as compressed Parquet into the shared folder and read back: smaller on disk than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """df in one partition for each core, without a shuffle: for a pass over a few numbers, however many partitions they came in."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most ``SHARE`` rows (of a few numbers each). It is read once more, to be counted."""
    return F.broadcast(df) if gathered(df).count() <= SHARE else df
