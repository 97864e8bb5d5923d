"""Parquet table scans by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, with only ``columns`` when given (pruned at the scan)."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
