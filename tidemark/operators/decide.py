"""Turning pair probabilities into an exclusive set of matches per anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Probabilities are capped here before they become odds.
CAP = 0.999


def odds(p: Column, cap: float = CAP) -> Column:
    p = F.least(p, F.lit(cap))
    return p / (1 - p)


def soft_exclusive(pairs: DataFrame, record: str = "cand_id", p: str = "p", power: float = 1.0, none: float = 1.0, cap: float = CAP, out: str = "p_soft") -> DataFrame:
    """Share of a record's odds that each of its anchors gets, with ``none`` as the odds of no match at all."""
    tempered = F.pow(odds(F.col(p), cap), F.lit(power)) if power != 1.0 else odds(F.col(p), cap)
    return pairs.withColumn("_o", tempered).withColumn(out, F.col("_o") / (F.lit(none) + F.sum("_o").over(Window.partitionBy(record)))).drop("_o")


def hard_exclusive(pairs: DataFrame, record: str = "cand_id", anchor: str = "s1_id", p: str = "p") -> DataFrame:
    """Each record's pair with the highest probability; ties go to the smaller anchor."""
    best = F.row_number().over(Window.partitionBy(record).orderBy(F.desc(p), anchor))
    return pairs.withColumn("_r", best).where("_r = 1").drop("_r")


def threshold(pairs: DataFrame, at: float | Column, p: str = "p") -> DataFrame:
    return pairs.where(F.col(p) >= at)


def capped(pairs: DataFrame, k: int, anchor: str = "s1_id", record: str = "cand_id", p: str = "p") -> DataFrame:
    """At most k records per anchor, the most probable first."""
    rank = F.row_number().over(Window.partitionBy(anchor).orderBy(F.desc(p), record))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")
