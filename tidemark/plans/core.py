"""Registration of queries, and the frames and SQL that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, root) -> DataFrame under its name, with SQL that gives the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        assert f.__name__ not in QUERIES, f.__name__
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def pairs(spark: SparkSession, root: str, dealt: str | None = None) -> DataFrame:
    """Distinct order-part pairs: (s1_id, cand_id, score, p, src, label). Lines are dealt out by both keys, or by the one that ``dealt`` names if joins or windows by it follow."""
    lines = table(spark, root, "lineitem")
    return (lines.repartition(dealt) if dealt else lines).groupBy(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("cand_id")).agg(
        F.max("l_extendedprice").alias("score"),
        (F.max("l_quantity") / 51).alias("p"),
        F.when(F.min("l_suppkey") % 2 == 0, "S2").otherwise("S3").alias("src"),
        F.max(F.col("l_returnflag") == "R").alias("label"),
    )


PAIRS = """pairs AS (SELECT l_orderkey AS s1_id, l_partkey AS cand_id, max(l_extendedprice) AS score, max(l_quantity) / 51 AS p,
  CASE WHEN min(l_suppkey) % 2 = 0 THEN 'S2' ELSE 'S3' END AS src, bool_or(l_returnflag = 'R') AS label FROM lineitem GROUP BY 1, 2)"""


def anchors(spark: SparkSession, root: str) -> DataFrame:
    """All orders as anchors: (s1_id, country)."""
    return table(spark, root, "orders").select(F.col("o_orderkey").alias("s1_id"), F.col("o_orderpriority").alias("country"))


ANCHORS = "anchors AS (SELECT o_orderkey AS s1_id, o_orderpriority AS country FROM orders)"


def names(spark: SparkSession, root: str) -> DataFrame:
    """Parts as named records: (id, country, name, num)."""
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("id"), F.substring("p_brand", 1, 7).alias("country"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("num")
    )


NAMES = "names AS (SELECT p_partkey AS id, substr(p_brand, 1, 7) AS country, p_name AS name, p_size::VARCHAR AS num FROM part)"
