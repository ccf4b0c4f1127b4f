"""Parquet tables addressed by directory and name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root``; any path Spark can read will do."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
