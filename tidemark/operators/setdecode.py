"""The set of matches with the highest expected F0.5, per anchor.

Candidates are independent with known probabilities, and a Poisson number of true matches was never retrieved. The best set is
always a prefix of the candidates in descending probability; a set's value follows from the distributions of
true matches inside it and outside it.
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.windows import top_k


def poisson(lam: float, terms: int, fold: bool) -> np.ndarray:
    """First probabilities of a Poisson law; ``fold`` puts the tail on the last one."""
    p = np.array([exp(-lam) * lam**k / factorial(k) for k in range(terms)])
    if fold:
        p[-1] += max(0.0, 1.0 - p.sum())
    return p


def prefix_values(p: list[float], missed: np.ndarray, beta2: float = 0.25, empty: float | None = None) -> np.ndarray:
    """Expected F of each prefix of sorted probabilities, from none to all. ``empty`` overrides the value of none."""
    n = len(p)
    inside = [np.ones(1)]
    for x in p:
        inside.append(np.convolve(inside[-1], [1 - x, x]))
    outside = [np.asarray(missed, float)]
    for x in reversed(p):
        outside.append(np.convolve(outside[-1], [1 - x, x]))
    outside.reverse()
    out = [outside[0][0] if empty is None else empty]
    for k in range(1, n + 1):
        hits, rest = np.arange(k + 1)[:, None], np.arange(len(outside[k]))[None, :]
        gain = (1 + beta2) * hits / (k + beta2 * (hits + rest))
        out.append(float(inside[k] @ gain @ outside[k]))
    return np.array(out)


def _best(p: np.ndarray, lam: float, terms: int, fold: bool) -> int:
    return int(prefix_values(list(p), poisson(lam, terms, fold)).argmax())


def decode(
    pairs: DataFrame, lam: float | None = None, c: float = 1.0, recall: float = 1.0, least: float = 0.01, cap: int = 24, terms: int = 8, fold: bool = True,
    anchor: str = "s1_id", record: str = "cand_id", p: str = "p",
) -> DataFrame:
    """Predicted pairs. With ``lam`` None the missed mass is c * (1 - recall) / recall * sum(p) plus what the cap left out."""
    live = pairs.where(F.col(p) >= least)
    top = top_k(live, cap, p, anchor, ties=(record,))
    total = live.groupBy(anchor).agg(F.sum(p).alias("_sum"))
    # at most `cap` entries in each list
    lists = top.groupBy(anchor).agg(F.reverse(F.array_sort(F.collect_list(F.col(p).cast("double")))).alias("_p"), F.sum(p).alias("_kept"))
    missed = F.lit(lam) if lam is not None else F.lit(c * (1 - recall) / recall) * F.col("_sum") + (F.col("_sum") - F.col("_kept"))

    @F.pandas_udf(T.IntegerType())
    def size(ps: pd.Series, lams: pd.Series) -> pd.Series:
        return pd.Series([_best(x, float(y), terms, fold) for x, y in zip(ps, lams, strict=True)])

    sizes = lists.join(total, anchor).select(anchor, size("_p", missed.cast("double")).alias("_k"))
    from tidemark.operators.windows import rank_of

    ranked = top.withColumn("_r", rank_of(p, anchor, ties=(record,)))
    return ranked.join(sizes, anchor).where(F.col("_r") <= F.col("_k")).drop("_r", "_k")
