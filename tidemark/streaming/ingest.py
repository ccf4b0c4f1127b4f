"""Arriving records: stateless normalisation and a join with a static index. An extra beside the batch pipeline.

Exclusivity needs all competitors of a record, so decisions stay in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X


def normalised(records: DataFrame) -> DataFrame:
    """(id, words, core) of a stream or table of (id, name)."""
    rows = records.select("id", X.name_words(X.fold(F.col("name"))).alias("words"))
    return rows.withColumn("core", X.core_words(F.col("words")))


def candidates(records: DataFrame, index: DataFrame) -> DataFrame:
    """(id, s1_id, token): anchors that share a core word; the index has (s1_id, token)."""
    return records.select("id", F.explode(F.array_distinct("core")).alias("token")).join(index, "token").select("id", "s1_id", "token")
