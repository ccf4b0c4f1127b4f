"""Window expressions over groups of competing pairs. Ties are always broken by stated columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def best(score: str, *keys: str) -> Column:
    return F.max(score).over(over(*keys))


def size(*keys: str) -> Column:
    return F.count("*").over(over(*keys))


def second_best(score: str, *keys: str, none: float = 0.0) -> Column:
    """Second largest value of the group with repeats; ``none`` in a group of one."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.nth_value(score, 2).over(ranked), F.lit(none))


def best_other(score: str, *keys: str, none: float = 0.0) -> Column:
    """Largest value among the other members: the second best for who holds the best, else the best."""
    return F.when(F.col(score) >= best(score, *keys), second_best(score, *keys, none=none)).otherwise(best(score, *keys))


def rank_of(score: str, *keys: str, ties: tuple[str, ...] = ()) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *ties))


def share(value: str, *keys: str, floor: float = 1e-6) -> Column:
    return F.col(value) / F.greatest(F.sum(value).over(over(*keys)), F.lit(floor))


def other_source_count(key: Column, *keys: str, source: str = "src", empty: int = -1) -> Column:
    """Members with the same key from another source; ``empty`` where the key is empty or null."""
    w, own = Window.partitionBy(*keys, key), Window.partitionBy(*keys, key, source)
    n = F.count("*").over(w) - F.count("*").over(own)
    return F.when(key.isNull() | (key == ""), F.lit(empty)).otherwise(n)


def other_source_max(value: str, *keys: str, sources: tuple[str, str] = ("S2", "S3"), source: str = "src") -> Column:
    """Largest value of the other of two sources under the same keys, null if it has none."""
    a, b = sources
    of = lambda s: F.max(F.when(F.col(source) == s, F.col(value))).over(over(*keys))
    return F.when(F.col(source) == a, of(b)).when(F.col(source) == b, of(a))


def top_k(df: DataFrame, k: int, score: str, *keys: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The k best rows of each group; Spark prunes each task to k rows before the shuffle."""
    return df.withColumn("_r", rank_of(score, *keys, ties=ties)).where(F.col("_r") <= k).drop("_r")


def retrieval_context(pairs: DataFrame, anchor: str = "s1_id", record: str = "cand_id", score: str = "score") -> DataFrame:
    """Competition of a pair within its anchor and within its record; to be run before any pruning."""
    out = pairs.withColumns({
        "s1_best": best(score, anchor), "rank_in_s1": rank_of(score, anchor, ties=(record,)), "n_s1_cands": size(anchor),
        "c_best": best(score, record), "n_c_s1": size(record), "c_second": second_best(score, record),
    })
    s = F.col(score)
    out = out.withColumns({
        "gap_s1": F.col("s1_best") - s, "gap_c": F.col("c_best") - s, "c_margin": s - F.when(s >= F.col("c_best"), F.col("c_second")).otherwise(F.col("c_best")),
        "is_c_best": (s >= F.col("c_best")).cast("int"),
    })
    return out.withColumn("mutual_best", ((F.col("is_c_best") == 1) & (s >= F.col("s1_best"))).cast("int"))


def competition(pairs: DataFrame, p: str = "p", anchor: str = "s1_id", record: str = "cand_id") -> DataFrame:
    """Features of a probability among its competitors, for stacking."""
    out = pairs.withColumns({
        "s_sum": F.sum(p).over(over(anchor)), "s_n_high": F.sum((F.col(p) > 0.5).cast("int")).over(over(anchor)),
        "s_best_other": best_other(p, anchor), "s_rank": rank_of(p, anchor, ties=(record,)),
        "c_sum": F.sum(p).over(over(record)), "c_n_high": F.sum((F.col(p) > 0.5).cast("int")).over(over(record)),
        "c_best_other": best_other(p, record), "c_n": size(record), "c_rank": rank_of(p, record, ties=(anchor,)),
    })
    return out.withColumns({
        "s_share": F.col(p) / F.greatest("s_sum", F.lit(1e-6)), "c_share": F.col(p) / F.greatest("c_sum", F.lit(1e-6)),
        "c_gap": F.col(p) - F.col("c_best_other"),
    })


#: Columns of `relational`, in the order of the stacked model.
RELATIONAL = (
    "r_best", "r_sum", "r_n05", "s_rank", "s_best", "s_sum", "s_n05", "r_other_best", "s_gap", "p_share_s", "p_share_r", "r_margin", "twin_p_num", "twin_p_name",
)


def relational(pairs: DataFrame, p: str = "p", prefix: str = "", numbers: str = "nums", name: str = "name_core", anchor: str = "s1_id", record: str = "cand_id") -> DataFrame:
    """Add the competition columns of one probability column; `relationals` adds those of several models at once.

    Twins are candidates of the same anchor from the other source with the same numbers or the same core name; -1 without one, or without numbers or name.
    """
    return relationals(pairs, {prefix: p}, numbers, name, anchor, record)


def relationals(pairs: DataFrame, models: dict[str, str], numbers: str = "nums", name: str = "name_core", anchor: str = "s1_id", record: str = "cand_id") -> DataFrame:
    """`relational` of the probability columns of several models by their prefixes.

    Rows move twice whatever the number of models: to their records, and with what is told there to their anchors. What follows from two other
    columns is made behind the second move, and the second best moves with the best alone.
    """
    twin = lambda p, key: F.when(F.coalesce(F.col(key), F.lit("")) != "", F.coalesce(other_source_max(p, anchor, key), F.lit(-1.0))).otherwise(-1.0)
    many = lambda p, key: F.count_if(F.col(p) > 0.5).over(over(key))
    top = lambda pre, p: F.col(p) >= F.col(f"{pre}r_best")
    told, found, last = {}, {}, {}
    for pre, p in models.items():
        told |= {f"{pre}r_best": best(p, record), f"{pre}r_sum": F.sum(p).over(over(record)), f"{pre}r_n05": many(p, record), f"{pre}_second": second_best(p, record)}
        found |= {
            f"{pre}s_rank": rank_of(p, anchor, ties=(record,)), f"{pre}s_best": best(p, anchor), f"{pre}s_sum": F.sum(p).over(over(anchor)), f"{pre}s_n05": many(p, anchor),
            f"{pre}twin_p_num": twin(p, numbers), f"{pre}twin_p_name": twin(p, name),
        }
        q, share = F.col(p), lambda side, p=p, pre=pre: F.col(p) / F.greatest(F.col(f"{pre}{side}_sum"), F.lit(1e-6))
        other = F.when(top(pre, p), F.col(f"{pre}_second")).otherwise(F.col(f"{pre}r_best"))
        last |= {
            f"{pre}r_other_best": other, f"{pre}s_gap": F.col(f"{pre}s_best") - q, f"{pre}p_share_s": share("s"), f"{pre}p_share_r": share("r"), f"{pre}r_margin": q - other,
        }
    rows = pairs.withColumns(told).withColumns({f"{pre}_second": F.when(top(pre, p), F.col(f"{pre}_second")) for pre, p in models.items()})
    # dealt out by the anchor alone, which serves all windows within an anchor
    rows = rows.repartition(F.col(anchor)).withColumns(found).withColumns(last)
    return rows.select(*pairs.columns, *[F.col(pre + c) for pre in models for c in RELATIONAL])


#: Columns of `context`, in the order of the second model of the other pipeline.
CONTEXT = ("p1", "r_max_other", "r_sum_other", "r_high_other", "r_rank", "r_margin", "s_max_other", "s_sum_other", "s_high_other", "s_rank", "twin_num", "twin_name", "copy_max", "r_n_possible")


def context(pairs: DataFrame, p: str = "p", numbers: str = "nums", name: str = "name", same: str = "full", anchor: str = "s1_id", record: str = "cand_id") -> DataFrame:
    """Add what a probability's competitors have, itself left out; ranks are from 0, twins and copies null where there are none."""
    q = F.col(p)
    high = lambda key: F.count_if(q > 0.5).over(over(key)) - (q > 0.5).cast("int")
    copies = over(anchor, same)
    found = {"p1": q}
    for side, key, tie in (("r", record, anchor), ("s", anchor, record)):
        found |= {f"{side}_max_other": best_other(p, key), f"{side}_sum_other": F.sum(p).over(over(key)) - q, f"{side}_high_other": high(key), f"{side}_rank": rank_of(p, key, ties=(tie,)) - 1}
    found |= {
        "r_margin": q - best_other(p, record), "twin_num": F.when(F.col(numbers) != "", other_source_max(p, anchor, numbers)), "twin_name": other_source_max(p, anchor, name),
        "copy_max": F.when(F.count("*").over(copies) > 1, best_other(p, anchor, same)), "r_n_possible": F.count_if(q > 0.1).over(over(record)),
    }
    return pairs.withColumns({c: found[c] for c in CONTEXT})
