"""Session set-up and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "loomline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; an active one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder of this machine is taken and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; partitions and their order stay."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; order is not kept."""
    spark = df.sparkSession
    at = os.path.join(_tables(spark), uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def _tables(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "tables", spark.sparkContext.applicationId)


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` wrote in this application; DataFrames over them can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
