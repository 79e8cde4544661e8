"""Readers of the engine's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A lazy scan of one parquet table of a data folder; columns and filters are pushed into it by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
