"""Queries that carry matching from pairs to decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import decide, metrics
from tidemark.plans.core import PAIRS, pairs, query
from tidemark.sources.tables import table


@query(f"""
WITH {PAIRS},
odds AS (SELECT *, least(p, 0.999::DOUBLE) / (1 - least(p, 0.999::DOUBLE)) AS o FROM pairs),
soft AS (SELECT *, o / (1 + sum(o) OVER (PARTITION BY cand_id)) AS q FROM odds),
n AS (SELECT s1_id, count(*) FILTER (WHERE label) AS n_true, count(*) FILTER (WHERE round(q, 9) >= 0.05) AS n_pred,
  count(*) FILTER (WHERE label AND round(q, 9) >= 0.05) AS tp FROM soft GROUP BY 1),
f AS (SELECT o_orderpriority, coalesce(n_pred, 0) AS n_pred,
  CASE WHEN coalesce(n_pred, 0) = 0 AND coalesce(n_true, 0) = 0 THEN 1.0::DOUBLE
    ELSE 1.25::DOUBLE * coalesce(tp, 0) / (coalesce(n_pred, 0) + 0.25::DOUBLE * coalesce(n_true, 0)) END AS f
  FROM orders LEFT JOIN n ON o_orderkey = s1_id)
SELECT o_orderpriority, count(*) AS n_orders, sum(n_pred)::BIGINT AS n_pred, round(avg(f), 6) AS macro_f FROM f GROUP BY 1
""")
def exclusive_best_match(spark: SparkSession, root: str) -> DataFrame:
    """Soft exclusivity, a threshold, F0.5 per order over all orders, averaged by priority."""
    soft = decide.soft_exclusive(pairs(spark, root))
    predicted = soft.where(F.round("p_soft", 9) >= 0.05)
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("s1_id"), "o_orderpriority")
    scored = metrics.per_anchor(orders, predicted, soft.where("label"))
    return scored.groupBy("o_orderpriority").agg(
        F.count("*").alias("n_orders"), F.sum("n_pred").alias("n_pred"), F.round(F.avg("f"), 6).alias("macro_f")
    )
