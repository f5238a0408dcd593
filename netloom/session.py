"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What the operators rely on; ``configure`` sets it on a session.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that the cluster names in spark.checkpoint.dir (where none is set, a local one, on one machine only)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()
