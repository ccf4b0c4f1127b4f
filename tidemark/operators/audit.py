"""Lenses on labels and data: duplicates, patterns, conflicts, profiles, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X


def duplicate_groups(df: DataFrame, keys: list[str], label: str = "label", owner: str = "s1_id") -> DataFrame:
    """(keys, n, n_true, mixed, n_owners) of rows that share their keys with another row."""
    y = F.col(label).cast("int")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("n_true"), (F.min(y) != F.max(y)).alias("mixed"), F.count_distinct(F.when(y == 1, F.col(owner))).alias("n_owners")).where("n > 1")


def pattern_table(df: DataFrame, pattern: list[str], label: str = "label") -> DataFrame:
    """(pattern, n, n_true, majority, minority_share)."""
    n, t = F.count("*"), F.sum(F.col(label).cast("int"))
    return df.groupBy(*pattern).agg(n.alias("n"), t.alias("n_true"), (t * 2 >= n).alias("majority"), (F.least(t, n - t) / n).alias("minority_share"))


def copies_of_others(pairs: DataFrame, anchors: DataFrame, records: DataFrame, signature: str, label: str = "label") -> DataFrame:
    """True pairs whose record has the signature of another anchor and not of its own: (s1_id, cand_id, other_s1)."""
    true = pairs.where(label).select("s1_id", "cand_id")
    rec = records.select(F.col("id").alias("cand_id"), F.col(signature).alias("_c"))
    own = anchors.select(F.col("id").alias("s1_id"), F.col(signature).alias("_s"))
    # an anchor stands for all with its signature, so that a common one can't multiply
    other = anchors.groupBy(F.col(signature).alias("_c")).agg(F.min("id").alias("other_s1"))
    return true.join(rec, "cand_id").join(own, "s1_id").where("_c <> _s").join(other, "_c").select("s1_id", "cand_id", "other_s1")


def flag(df: DataFrame, p: str = "p", label: str = "label", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Rows whose label a model finds very unlikely, with the kind of doubt."""
    y = F.col(label).cast("boolean")
    kind = F.when(y & (F.col(p) < low), "match_unlikely").when(~y & (F.col(p) > high), "match_likely")
    return df.withColumn("kind", kind).where("kind IS NOT NULL")


def sample_by_group(df: DataFrame, k: int, group: list[str], keys: list[str], seed: int = 0) -> DataFrame:
    """Up to k rows of each group, the same ones for the same seed."""
    w = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def profile(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """Counts, empties, lengths, scripts and noise flags of a text column, in one pass."""
    c = F.col(text)
    flags: dict[str, Column] = {
        "n_empty": F.coalesce(F.trim(c), F.lit("")) == "", "n_nonlatin": X.has_nonlatin(c), "n_digit": c.rlike("[0-9]"),
        "n_numeric_only": c.rlike("^[0-9 ]+$"), "n_domain": c.rlike(r"(?i)\b(www\.|[a-z0-9-]+\.(com|org|net)\b)"),
        "n_mojibake": c.rlike("Ã.|â€|Â."), "n_upper": (F.upper(c) == c) & c.rlike("[A-Z]"),
    }
    n = F.length(c)
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.min(n).alias("len_min"), F.round(F.avg(n), 4).alias("len_mean"), F.max(n).alias("len_max"),
        *[F.count_if(v).alias(k) for k, v in flags.items()],
    )


def rule_impact(scored: DataFrame, by: list[str]) -> DataFrame:
    """Mean score with and without the rows that a labelling rule touches; ``scored`` has f, f_rule."""
    return scored.groupBy(*by).agg(F.avg("f").alias("f"), F.avg("f_rule").alias("f_rule"), (F.avg("f_rule") - F.avg("f")).alias("gain"))
