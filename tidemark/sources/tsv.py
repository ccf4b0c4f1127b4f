"""Tab-separated sources and sinks, catalogs of them, and lookups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import Scratch


def read_tsv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """All columns as strings, no quoting, empty fields as empty strings; "NA" and "NULL" are values."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(path).fillna("")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def union_sources(spark: SparkSession, paths: dict[str, str], columns: list[str]) -> DataFrame:
    """Several sources as one table with their name in ``src``."""
    from tidemark.operators.relational import union_all

    return union_all([read_tsv(spark, p, columns).withColumn("src", F.lit(s)) for s, p in paths.items()])


def explode_truth(truth: DataFrame, anchor: str = "source1_entity_id", matched: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, cand_id) from comma lists; an empty list has no pair."""
    return truth.select(F.col(anchor).alias("s1_id"), F.explode(F.split(matched, ",")).alias("cand_id")).where("cand_id <> ''")


def match_counts(truth: DataFrame, anchor: str = "source1_entity_id", matched: str = "matched_entity_ids") -> DataFrame:
    n = F.size(F.array_remove(F.split(F.coalesce(matched, F.lit("")), ","), ""))
    return truth.select(F.col(anchor).alias("s1_id"), n.alias("n_match"))


def with_row_ids(df: DataFrame, *order: str) -> DataFrame:
    """Add row_id, gapless from 0 in a stated order. Ranges are sorted apart; only their sizes reach the driver.

    The sorted ranges are saved before they are counted: their bounds are sampled, so a second run could deal rows otherwise.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = Scratch(df.sparkSession, "rows").save(ranged, "ranged")
    sizes = dict(ranged.groupBy(F.shiftright("_m", 33).alias("p")).count().collect())  # one number for each range
    before = [0]
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, 0))
    start = F.element_at(F.lit(before), (F.shiftright("_m", 33) + 1).cast("int")).cast("long")
    return ranged.withColumn("row_id", start + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")


def page(df: DataFrame, start: int, limit: int) -> DataFrame:
    """Rows by stored number: a filter that a sorted file answers from its statistics."""
    return df.where(F.col("row_id").between(start, start + limit - 1)).orderBy("row_id")


def take_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.join(rows.select("row_id"), "row_id", "left_semi")


def find(df: DataFrame, key: str, value) -> DataFrame:
    """The row with an id; of several the first."""
    return df.where(F.col(key) == value).orderBy("row_id").limit(1)


def search(df: DataFrame, pattern: str, columns: list[str] | None = None, regex: bool = False, ignore_case: bool = False, limit: int | None = None) -> DataFrame:
    """Rows that hold a text or a regular expression in any of the columns (all by default)."""
    hit = F.lit(False)
    for c in columns or df.columns:
        x = F.col(c).cast("string")
        if regex:
            hit = hit | x.rlike(("(?i)" if ignore_case else "") + pattern)
        else:
            hit = hit | (F.lower(x).contains(pattern.lower()) if ignore_case else x.contains(pattern))
    out = df.where(hit)
    return out if limit is None else out.limit(limit)


def catalog(spark: SparkSession, root: str, glob: str = "*.tsv") -> DataFrame:
    """(path, size, header, kind) of the files below a folder; kind by the names in the header. Contents are not read but for the first line."""
    from tidemark.sources.catalog import first_lines

    lines = first_lines(spark, root, glob)
    kind = F.when(F.col("header").contains("matched_entity_ids"), "ground_truth").when(F.col("header").contains("entity_id"), "source").otherwise("other")
    return lines.withColumn("kind", kind).orderBy("path")


def entity_view(pairs: DataFrame, truth: DataFrame, records: DataFrame, entity: str) -> DataFrame:
    """(id, role, status) of an entity, its anchor and all members of its group.

    Status: group, singleton (an anchor without matches), unmatched (a record without an anchor), no_gt (unknown).
    """
    spark = pairs.sparkSession
    e = spark.createDataFrame([(entity,)], "id string")
    owner = pairs.where(F.col("cand_id") == entity).select("s1_id").union(truth.where(F.col("s1_id") == entity).select("s1_id")).distinct()
    members = pairs.join(owner, "s1_id", "left_semi")
    known = records.where(F.col("id") == entity).select("id")
    group = owner.select(F.col("s1_id").alias("id"), F.lit("anchor").alias("role")).union(members.select("cand_id", F.lit("member")))
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    found = group.withColumn("status", F.when(n > 1, "group").otherwise("singleton"))  # one entity's group
    alone = e.join(owner.select(F.lit(entity).alias("id")), "id", "left_anti").join(known.withColumn("_k", F.lit(1)), "id", "left")
    return found.union(alone.select("id", F.lit("record"), F.when(F.col("_k").isNull(), "no_gt").otherwise("unmatched")))
