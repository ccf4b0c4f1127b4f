"""Listing of files below a folder with their first lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, size, header); a text scan of one line per file, planned by Spark from the listing."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    own = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("_i"))
    return own.where("block = 0").groupBy("path", "size").agg(F.min_by("value", "_i").alias("header")).select("path", F.col("size").cast(T.LongType()).alias("size"), "header")
