"""Set metrics of matches per anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETA2 = 0.25


def f_score(tp: Column, n_pred: Column, n_true: Column, beta2: float = BETA2) -> Column:
    """F-beta from counts; an empty prediction of an empty truth scores 1."""
    return F.when((n_pred == 0) & (n_true == 0), F.lit(1.0)).otherwise((1 + beta2) * tp / (n_pred + beta2 * n_true))


def per_anchor(universe: DataFrame, predicted: DataFrame, true: DataFrame, anchor: str = "s1_id", record: str = "cand_id") -> DataFrame:
    """(universe columns, n_true, n_pred, tp, f): counts are 0 for anchors without pairs; repeated pairs count once.

    Both pair lists meet in one aggregation by pair and one by anchor; no join of pairs.
    """
    side = lambda df, c: df.select(anchor, record, F.lit(c == "p").alias("_p"), F.lit(c == "t").alias("_t"))
    flags = side(predicted, "p").unionByName(side(true, "t")).groupBy(anchor, record).agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    n = flags.groupBy(anchor).agg(
        F.count_if("_t").alias("n_true"), F.count_if("_p").alias("n_pred"), F.count_if(F.col("_p") & F.col("_t")).alias("tp")
    )
    counts = universe.join(n, anchor, "left").fillna(0, ["n_true", "n_pred", "tp"])
    return counts.withColumn("f", f_score(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def bootstrap_gain(gains: DataFrame, gain: str = "gain", key: str = "s1_id", n: int = 200, seed: int = 0) -> DataFrame:
    """(gain, low, high): mean of paired differences with the 2.5 and 97.5 percentiles of ``n`` resamples.

    A row's weight in a resample is a Poisson number drawn by a hash of its key, so that rows never have to be collected
    and reruns agree. One aggregation to ``n`` rows.
    """
    draws = gains.select(gain, key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_draw"))
    u = F.pmod(F.xxhash64(F.lit(seed), key, "_draw"), F.lit(1_000_003)) / 1_000_003
    # cumulative Poisson(1) probabilities; beyond 6 the share is below 1e-4
    steps = [0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917]
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    means = draws.withColumn("_w", weight).groupBy("_draw").agg((F.sum(F.col(gain) * F.col("_w")) / F.sum("_w")).alias("_m"))
    return gains.agg(F.avg(gain).alias("gain")).crossJoin(means.agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high")))  # single rows
