"""Joins, unions and aggregates that matching needs beyond what a DataFrame call says by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_key_join(left: DataFrame, right: DataFrame, key: str | list[str], side: str = "left") -> DataFrame:
    """Inner join on keys that exactly one row of one side owns."""
    keys = [key] if isinstance(key, str) else key
    owner = left if side == "left" else right
    single = owner.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in owner.columns if c not in keys]).where("_n = 1").drop("_n")
    return single.join(right, keys) if side == "left" else left.join(single, keys)


def blocking_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, cap: int) -> DataFrame:
    """(left_id, right_id, reach): pairs that share at least one of several keys held by at most ``cap`` left rows.

    ``reach`` has bit i set where key i is shared. Keys that are null or empty match nothing.
    """
    long = lambda df, i: df.select(i, F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("_i", "_v")).where("_v <> ''").distinct()
    held = long(left, left_id)
    small = held.groupBy("_i", "_v").agg(F.count("*").alias("_n")).where(F.col("_n") <= cap).drop("_n")
    met = held.join(small, ["_i", "_v"]).join(long(right, right_id), ["_i", "_v"])
    return met.groupBy(left_id, right_id).agg(F.sum(F.expr("shiftleft(1, _i)")).alias("reach"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def update_by_key(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Overwrite cells of existing columns where ``changes`` has a row with the keys and a value."""
    cols = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = df.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def union_retrievers(found: dict[str, DataFrame], anchor: str = "s1_id", record: str = "cand_id", missing_rank: int = 99) -> DataFrame:
    """Candidates of several retrievers side by side, one row per pair, in one aggregation.

    Each input has score, rank_q and rank_s. Absent scores are 0, absent ranks ``missing_rank``.
    """
    rows = union_all([df.select(anchor, record, "score", "rank_q", "rank_s", F.lit(r).alias("_ret")) for r, df in found.items()])
    of = lambda r, f, c, none: F.coalesce(f(F.when(F.col("_ret") == r, F.col(c))), F.lit(none)).alias(f"{c}_{r}")
    wide = rows.groupBy(anchor, record).agg(
        *[x for r in found for x in (of(r, F.max, "score", 0.0), of(r, F.min, "rank_q", missing_rank), of(r, F.min, "rank_s", missing_rank))]
    )
    each = lambda c: [F.col(f"{c}_{r}") for r in found]
    best = lambda f, c: f(*each(c)) if len(found) > 1 else each(c)[0]
    return wide.withColumns({
        "score": best(F.greatest, "score"), "rank_q": best(F.least, "rank_q"), "rank_s": best(F.least, "rank_s"),
        "n_retrievers": reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in each("score")]),
    })


def prune(pairs: DataFrame, max_rank_q: int = 10, max_rank_s: int = 15) -> DataFrame:
    return pairs.where((F.col("rank_q") <= max_rank_q) | (F.col("rank_s") <= max_rank_s))


def multiset_difference(a: Column, b: Column) -> Column:
    """Elements of array ``a`` beyond their number in ``b``, sorted."""
    extra = F.flatten(F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, (F.size(F.filter(a, lambda y: y == x)) - F.size(F.filter(b, lambda y: y == x))))))
    return F.array_sort(extra)


def collected(pairs: DataFrame, universe: DataFrame, anchor: str = "s1_id", record: str = "cand_id", out: str = "matched_entity_ids") -> DataFrame:
    """One row per anchor of the universe with its records as a comma list, empty if it has none."""
    lists = pairs.groupBy(anchor).agg(F.array_join(F.array_sort(F.collect_set(record)), ",").alias(out))
    return universe.select(anchor).join(lists, anchor, "left").fillna("", [out])
