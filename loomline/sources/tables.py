"""Readers for the project's tables: one Parquet file or folder each, explicit columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The table ``name`` under ``base``; only ``columns`` where they are given."""
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A table over all cores where its files are fewer than those; else as it is.

    For operators that spend their time in a map over a table. A table of many files isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one of spark.sql.shuffle.partitions partitions, which AQE doesn't merge by their bytes.

    For maps whose few bytes cost much time.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
