"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Keep skew handling even where splitting a partition costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "sheetspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is used only by a local master with no folder set; a
    cluster session without one is an error, since executors could not read a
    folder of the driver's machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current:
        return current
    if configured:
        context.setCheckpointDir(configured)
    elif (context.master or "").startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sheetspark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder, below one folder per application."""
    return f"{ensure_checkpoint_dir(spark)}/sheetspark-{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table written in the shared folder.

    Lost executors cost nothing, nothing upstream runs again, and later passes
    read only the columns they need. Columns get plain names in the files.
    """
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    path = scratch_path(df.sparkSession, "saved")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
