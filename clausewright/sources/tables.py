"""Table scans: one Parquet table (file or directory) per name under a root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan ``root/name.parquet``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
