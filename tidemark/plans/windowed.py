"""Window queries over competing pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.plans.core import NAMES, PAIRS, names, pairs, query
from tidemark.sources.tables import table


@query(f"""WITH {PAIRS}, c AS (SELECT s1_id, cand_id, score, max(score) OVER (PARTITION BY s1_id) AS s1_best,
  row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank_in_s1, count(*) OVER (PARTITION BY s1_id) AS n_s1_cands,
  max(score) OVER (PARTITION BY cand_id) AS c_best, count(*) OVER (PARTITION BY cand_id) AS n_c_s1,
  coalesce(nth_value(score, 2) OVER (PARTITION BY cand_id ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS c_second FROM pairs)
SELECT *, s1_best - score AS gap_s1, c_best - score AS gap_c, score - CASE WHEN score >= c_best THEN c_second ELSE c_best END AS c_margin,
  (score >= c_best)::INT AS is_c_best, (score >= c_best AND score >= s1_best)::INT AS mutual_best FROM c""")
def retrieval_context(spark: SparkSession, root: str) -> DataFrame:
    return W.retrieval_context(pairs(spark, root).select("s1_id", "cand_id", "score"))


@query(f"""WITH {PAIRS}, c AS (SELECT s1_id, cand_id, p, sum(p) OVER (PARTITION BY s1_id) AS s_sum, sum((p > 0.5)::INT) OVER (PARTITION BY s1_id) AS s_n_high,
  max(p) OVER (PARTITION BY s1_id) AS s_best, coalesce(nth_value(p, 2) OVER (PARTITION BY s1_id ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS s_second,
  row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id) AS s_rank,
  sum(p) OVER (PARTITION BY cand_id) AS c_sum, sum((p > 0.5)::INT) OVER (PARTITION BY cand_id) AS c_n_high, max(p) OVER (PARTITION BY cand_id) AS c_best,
  coalesce(nth_value(p, 2) OVER (PARTITION BY cand_id ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS c_second,
  count(*) OVER (PARTITION BY cand_id) AS c_n, row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) AS c_rank FROM pairs),
d AS (SELECT *, CASE WHEN p >= s_best THEN s_second ELSE s_best END AS s_best_other, CASE WHEN p >= c_best THEN c_second ELSE c_best END AS c_best_other FROM c)
SELECT s1_id, cand_id, round(s_sum, 6) AS s_sum, s_n_high::BIGINT AS s_n_high, s_best_other, s_rank, round(c_sum, 6) AS c_sum, c_n_high::BIGINT AS c_n_high, c_best_other, c_n, c_rank,
  round(p / greatest(s_sum, 1e-6) + 1e-9, 6) AS s_share, round(p / greatest(c_sum, 1e-6) + 1e-9, 6) AS c_share, p - c_best_other AS c_gap FROM d""")
def competition_features(spark: SparkSession, root: str) -> DataFrame:
    out = W.competition(pairs(spark, root).select("s1_id", "cand_id", "p")).drop("p")
    return out.withColumns({c: F.round(F.col(c) + (1e-9 if "share" in c else 0.0), 6) for c in ("s_sum", "c_sum", "s_share", "c_share")})  # off exact halves


@query(f"""WITH {PAIRS}, k AS (SELECT x.*, n.num AS key FROM pairs x JOIN (SELECT p_partkey, p_size::VARCHAR AS num FROM part) n ON cand_id = p_partkey)
SELECT s1_id, cand_id, count(*) OVER (PARTITION BY s1_id, key) - count(*) OVER (PARTITION BY s1_id, key, src) AS twin_num FROM k""")
def twin_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = pairs(spark, root).join(names(spark, root).select(F.col("id").alias("cand_id"), "num"), "cand_id")
    return rows.select("s1_id", "cand_id", W.other_source_count(F.col("num"), "s1_id").alias("twin_num"))


@query(f"""WITH {PAIRS}, k AS (SELECT x.*, p_type AS key FROM pairs x JOIN part ON cand_id = p_partkey)
SELECT s1_id, cand_id, coalesce(CASE src WHEN 'S2' THEN max(p) FILTER (WHERE src = 'S3') OVER w ELSE max(p) FILTER (WHERE src = 'S2') OVER w END, -1) AS twin_p
FROM k WINDOW w AS (PARTITION BY s1_id, key)""")
def other_source_max(spark: SparkSession, root: str) -> DataFrame:
    rows = pairs(spark, root).join(table(spark, root, "part").select(F.col("p_partkey").alias("cand_id"), "p_type"), "cand_id")
    return rows.select("s1_id", "cand_id", F.coalesce(W.other_source_max("p", "s1_id", "p_type"), F.lit(-1.0)).alias("twin_p"))


@query(f"""WITH {PAIRS}, {NAMES}, k AS (SELECT s1_id, cand_id, p, name FROM pairs JOIN names ON cand_id = id), c AS (SELECT *, max(p) OVER w AS b,
  nth_value(p, 2) OVER (PARTITION BY s1_id, name ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM k WINDOW w AS (PARTITION BY s1_id, name))
SELECT s1_id, cand_id, coalesce(CASE WHEN p >= b THEN s ELSE b END, -1) AS copy_p FROM c""")
def identical_copy_max(spark: SparkSession, root: str) -> DataFrame:
    rows = pairs(spark, root).join(names(spark, root).select(F.col("id").alias("cand_id"), "name"), "cand_id")
    return rows.select("s1_id", "cand_id", W.best_other("p", "s1_id", "name", none=-1.0).alias("copy_p"))


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, score FROM pairs QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) <= 2")
def top_k_per_anchor(spark: SparkSession, root: str) -> DataFrame:
    return W.top_k(pairs(spark, root).select("s1_id", "cand_id", "score"), 2, "score", "s1_id", ties=("cand_id",))


@query("""SELECT event_id, user_id, event_id - lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step FROM events""")
def lag_difference(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, root, "events").select("event_id", "user_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("step"))


@query(f"""WITH {PAIRS} SELECT s1_id, cand_id, min(p) OVER w AS p_min, max(p) OVER w AS p_max, round(sum(p) OVER w, 6) AS p_sum,
  row_number() OVER (PARTITION BY s1_id ORDER BY cand_id) = 1 AS is_first FROM pairs WINDOW w AS (PARTITION BY s1_id)""")
def group_transforms(spark: SparkSession, root: str) -> DataFrame:
    w = W.over("s1_id")
    return pairs(spark, root).select(
        "s1_id", "cand_id", F.min("p").over(w).alias("p_min"), F.max("p").over(w).alias("p_max"), F.round(F.sum("p").over(w), 6).alias("p_sum"),
        (F.row_number().over(Window.partitionBy("s1_id").orderBy("cand_id")) == 1).alias("is_first"),
    )


@query("""WITH t AS (SELECT o_orderkey, o_totalprice, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders)
SELECT o_orderkey, quarter::INT AS quarter, CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 150000 THEN 1 WHEN o_totalprice < 250000 THEN 2 ELSE 3 END AS band FROM t""")
def quantile_and_fixed_buckets(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    price = F.col("o_totalprice")
    band = F.when(price < 50000, 0).when(price < 150000, 1).when(price < 250000, 2).otherwise(3)
    return table(spark, root, "orders").select("o_orderkey", F.ntile(4).over(w).alias("quarter"), band.alias("band"))


@query(f"""WITH {PAIRS}, {NAMES}, v AS (SELECT s1_id, cand_id, src, name, num FROM pairs JOIN names ON cand_id = id),
s AS (SELECT *, name || '|' || num AS sig FROM v)
SELECT s1_id, cand_id, count(*) OVER (PARTITION BY s1_id, sig) - count(*) OVER (PARTITION BY s1_id, sig, src) AS diff_support,
  count(*) OVER (PARTITION BY s1_id, name) - count(*) OVER (PARTITION BY s1_id, name, src) AS add_support FROM s""")
def signature_support(spark: SparkSession, root: str) -> DataFrame:
    """Members of another source that differ from the anchor in the same words."""
    rows = pairs(spark, root).join(names(spark, root).withColumnRenamed("id", "cand_id"), "cand_id").withColumn("sig", F.concat_ws("|", "name", "num"))
    return rows.select(
        "s1_id", "cand_id", W.other_source_count(F.col("sig"), "s1_id").alias("diff_support"), W.other_source_count(F.col("name"), "s1_id").alias("add_support")
    )
