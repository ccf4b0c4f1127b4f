"""What several operators of this package share: scratch tables, document keys, batches."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.shared import Scratch, give_back, shared_dir, trim  # noqa: F401  (used by the operators)

#: Texts handed to one pass over an Arrow batch stay below about so many characters.
SLICE_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shield(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """Documents whose columns besides doc_id and text have names that clash with nothing, and what gives the names back.

    ``restore(df, *new)`` selects the documents' columns in their order and then ``new``; a column of the documents
    that has the name of a new one gives way to it.
    """
    plain = ("doc_id", "text")
    inner = {c: c if c in plain else f"_x{i}" for i, c in enumerate(docs.columns)}
    hidden = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()])

    def restore(df: DataFrame, *new: str) -> DataFrame:
        return df.select(*[F.col(x).alias(c) for c, x in inner.items() if c not in new], *new)

    return hidden, restore


#: Keys are below 2 ** KEY_BITS, so that a place in a document fits into a long with its key.
KEY_BITS = 36


def with_key(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Add ``_k`` (long, 0 to 2 ** KEY_BITS): an order key, one for each distinct (doc_id, text).

    Where doc_id is in that range and tells all texts apart, it is the key itself. Otherwise (null, negative, huge or
    repeated doc_id with different texts) distinct rows are numbered from 0 in the order doc_id, nulls first, then text
    hash. Equal rows share a key.
    """
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    ids = docs.select(F.col("doc_id").cast("long").alias("_d"), th.alias("_th"))
    clash = (
        ids.groupBy("_d").agg(F.min("_th").alias("a"), F.max("_th").alias("b"))
        .where(F.col("_d").isNull() | (F.col("_d") < 0) | (F.col("_d") >= 1 << KEY_BITS) | (F.col("a") != F.col("b"))).limit(1).count()
    )
    if not clash:
        return docs.withColumn("_k", F.col("doc_id").cast("long"))
    d, known = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNotNull()
    ids = docs.select(d.alias("_d"), known.alias("_n"), th.alias("_th")).distinct()
    numbered = scratch.save(
        ids.repartitionByRange("_n", "_d", "_th").sortWithinPartitions("_n", "_d", "_th").withColumn("_m", F.monotonically_increasing_id()), "keys"
    )
    part = F.shiftright("_m", 33)
    sizes = dict(numbered.groupBy(part.alias("p")).count().collect())  # one number for each partition
    before = [0]
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, 0))
    row = F.col("_m").bitwiseAND((1 << 33) - 1)
    keys = numbered.select("_d", "_n", "_th", (F.element_at(F.lit(before), (part + 1).cast("int")).cast("long") + row).alias("_k"))
    return docs.withColumns({"_d": d, "_n": known, "_th": th}).join(keys, ["_d", "_n", "_th"]).drop("_d", "_n", "_th")


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``limit`` characters each; a longer text is a run of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are slots, dealt out evenly; anything else as it is.

    A few unsplittable files would leave most slots idle. Plans with exchanges are left to Spark, as looking at their
    partitions would run them.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("Adaptive") or "Exchange" in plan.toString():
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if plan.execute().getNumPartitions() < slots else df


#: Most bytes of an Arrow batch of texts, so that memory follows neither the number nor the length of rows.
BATCH_BYTES = 6 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch, if it is higher; the setting is read when a plan runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower()
    size = int(re.sub("[^0-9]", "", now)) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("b")[-1:], 0)
    if size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_texts(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow over bounded slices of rows.

    ``df`` has its text in column ``text``. ``fn(columns, emit)`` gets the other columns as lists and text as str or
    None, and returns a dict of columns for ``schema``.
    """
    spec = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = arrow_schema(spec)
        for batch in batches:
            names = batch.schema.names
            step = max(1, min(batch.num_rows, SLICE_CHARS * 4 // max(1, batch.nbytes // max(1, batch.num_rows))))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                cols = {n: part.column(i).to_pylist() for i, n in enumerate(names)}
                texts = cols["text"]
                for a, b in slices(texts):
                    got = fn({n: v[a:b] for n, v in cols.items()})
                    arrays = [pa.array(got[f.name], type=f.type) for f in out_schema]
                    yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    bound_batches(df.sparkSession)
    return spread(df).mapInArrow(run, spec)


#: Bits of the filter that `pick` broadcasts: 2 ** (FILTER_BITS - 6) rows of two longs at most, whatever the number of keys.
FILTER_BITS = 25


def pick(docs: DataFrame, ids: DataFrame, key: str = "_k") -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in ids, and some others; the rest), so that a join by the key need not move all rows.

    Keys are hashed to the bits of a filter of fixed size. The more keys there are the more other documents it lets
    through, up to all of them; the join that follows tells them apart. The plan is the same for any number of keys.
    """
    at = F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)
    bit = F.expr("shiftleft(1L, cast(_b & 63 as int))")
    told = ids.select(at.alias("_b")).groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    marked = docs.withColumn("_b", at).withColumn("_w", F.shiftright("_b", 6)).join(F.broadcast(told), "_w", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    marked = marked.withColumn("_maybe", maybe).drop("_b", "_w", "_bits")
    return marked.where("_maybe").drop("_maybe"), marked.where("NOT _maybe").drop("_maybe")


_owner: str | None = None
_clear: dict[str, Callable[[], object]] = {}


def claim(owner: str, clear: Callable[[], object]) -> None:
    """Say that this worker process now works for ``owner``; what other operators have cached in it is let go.

    Workers outlive the stages of a pipeline, so their caches would add up. What Arrow and the C library keep of freed memory goes back, too.
    """
    global _owner
    if _owner == owner:
        return
    for name, f in _clear.items():
        if name != owner:
            f()
    _owner = owner
    _clear[owner] = clear
    trim()


def env_single_thread() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
