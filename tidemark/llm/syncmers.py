"""Document fingerprints from closed syncmers, by DataFrame functions only.

A text's words are hashed. A run of ``k`` words is a closed syncmer if the smallest of its word hashes is at its first
or its last place: a property of the run alone, so an edit elsewhere neither adds nor removes an anchor. The fingerprint
is the ``size`` smallest hashes of the text's distinct syncmers, 8 hex digits each, ascending. The likeness of two
fingerprints is the number of shared hashes over the longer one's length: about the share of the anchors in common.

Cases: null text is empty; a text without words has the empty fingerprint, and no other; one with fewer than ``k`` words, or with so few more
that no run of them is a syncmer, has the hash of all its words as its one hash. Two empty fingerprints are alike (1), an empty and another are not (0). Equal texts have equal
fingerprints. Rows that repeat a doc_id are ordered by text; these, and those without an id, are in one range. Texts of any length are read whole. No rows
give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 7
SIZE = 64
#: Bytes of text in a range of neighbouring documents.
RANGE_BYTES = 8 << 20
#: Most ranges whose bounds the driver keeps, and bounds that a row is held against at a time.
MAX_RANGES, STEP = 100_000, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of anything but space and tab to carriage return; no regular expression on the way."""
    flat = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def window_minima(h: Column, k: int) -> Column:
    """Minima of all windows of ``k`` neighbours: windows double in width, the last two may overlap."""

    def widen(m: Column, width: int) -> Column:
        if width == k:
            return m
        by = min(width, k - width)
        wider = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - by, F.lit(0))), F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0))), lambda a, b: F.least(a, b))
        return let(wider(m), lambda x: widen(x, width + by))

    return widen(h, 1)


def _selected(h: Column, k: int, value: Callable[[Column, Column], Column]) -> Column:
    """``value(index, run)`` of each closed syncmer; index from 0."""

    def at(low: Column, i: Column) -> Column:
        return F.when((low == h[i]) | (low == h[i + (k - 1)]), value(i, F.slice(h, i + 1, k)))

    return F.filter(F.transform(window_minima(h, k), at), lambda x: x.isNotNull())


def anchors(text: Column, k: int = K) -> Column:
    """Array of (position, hash): the closed syncmers of a text in order; position is the first word's index."""

    def of(h: Column) -> Column:
        one = lambda i, run: F.struct(i.alias("position"), F.xxhash64(run).alias("hash"))
        none = F.array().cast("array<struct<position:int,hash:bigint>>")
        return F.when(F.size(h) == 0, none).when(F.size(h) < k, F.array(one(F.lit(0), h))).otherwise(_selected(h, k, one))

    return let(word_hashes(text), of)


def fingerprint(text: Column, k: int = K, size: int = SIZE) -> Column:
    """The fingerprint string of a text."""

    def of(h: Column) -> Column:
        # the upper half of a hash as an unsigned number, so that its hex digits sort as it does
        one = lambda _, run: F.shiftrightunsigned(F.xxhash64(run), 32)
        some = let(_selected(h, k, one), lambda x: F.when(F.size(x) == 0, F.array(one(None, h))).otherwise(x))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, F.array(one(None, h))).otherwise(some)

    low = F.slice(F.sort_array(F.array_distinct(let(word_hashes(text), of))), 1, size)
    return F.array_join(F.transform(low, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _parts(fp: Column) -> Column:
    return F.regexp_extract_all(fp, F.lit("(.{8})"), F.lit(1))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over the longer fingerprint's number of hashes."""
    most = F.greatest(F.length(a), F.length(b)) / 8
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(_parts(a), _parts(b))) / most).cast("double")


def fingerprints(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint)."""
    return docs.select("doc_id", fingerprint(F.col("text"), k, size).alias("fingerprint"))


def positional_matches(a: DataFrame, b: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, other_id, position, other_position) of anchors that rows of ``a`` share with the row of ``b`` named in ``other_id``.

    ``a`` has doc_id, other_id and text, ``b`` has doc_id and text: stated pairs, not all pairs.
    """
    left = a.select("doc_id", "other_id", F.explode(anchors(F.col("text"), k)).alias("x")).select("doc_id", "other_id", "x.*")
    right = b.select(F.col("doc_id").alias("other_id"), F.explode(anchors(F.col("text"), k)).alias("x")).select("other_id", F.col("x.position").alias("other_position"), F.col("x.hash").alias("hash"))
    return left.join(right, ["other_id", "hash"]).select("doc_id", "other_id", "position", "other_position")


def _at_most(cuts: list, x: Column) -> Column:
    """How many of the ascending cuts are at most x, by every STEP-th of them first."""
    below = lambda a: F.size(F.filter(a, lambda c: c <= x))
    coarse = below(F.lit(cuts[::STEP]))
    return let(F.greatest(coarse - 1, F.lit(0)) * STEP, lambda at: at + below(F.slice(F.lit(cuts), at + 1, F.lit(STEP))))


def next_descending(df: DataFrame, columns: list[str], ranges: int, derive: dict[str, Column]) -> DataFrame:
    """Add the columns of ``derive`` and ``next_<column>`` of the row that follows in descending doc_id; the first row follows the last.

    Rows are dealt to ranges of doc_id by quantiles and sorted within each. The first row of a range is also sent to the
    range before, where it stands behind the last row; the rows themselves move once. Null ids come last. Rows with equal ids
    are ordered by ``columns``.
    """
    # at most MAX_RANGES numbers reach the driver
    steps = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(df.select(F.percentile_approx("doc_id", steps, 100_000)).first()[0] or [])) if steps else []
    known = len(cuts) - _at_most(cuts, F.col("doc_id")) if cuts else F.lit(0)
    dealt = df.withColumn("_g", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(known).cast("int"))
    first = {r[0]: r[1] for r in dealt.groupBy("_g").agg(F.max("doc_id")).collect()}  # one row for each range
    used = sorted(first)
    before = [(used[i - 1], first[g], g) for i, g in enumerate(used)]
    heads = df.sparkSession.createDataFrame(before, f"_to int, _first {dict(df.dtypes)['doc_id']}, _g int")
    on = F.col("doc_id").eqNullSafe(F.col("_first"))
    copies = dealt.join(F.broadcast(heads.drop("_g")), on).select(*df.columns, F.col("_to").alias("_g"), F.lit(1).alias("_copy"))
    rows = dealt.withColumn("_copy", F.lit(0)).unionByName(copies).repartitionById(len(cuts) + 2, "_g").withColumns(derive)
    w = Window.partitionBy("_g").orderBy("_copy", F.desc_nulls_last("doc_id"), *columns)
    out = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in [*columns, *derive]})
    return out.where("_copy = 0").drop("_g", "_copy")


def neighbours(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """Fingerprints of each text, of its edited text, and both likenesses.

    In the edited text the last floor(n_chars / 2) code points give way to the first as many (or all) of the next
    document's text, in descending doc_id; after the last document comes the first.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    chars = docs.select(F.sum(F.length(text))).first()[0] or 0
    ranges = int(min(MAX_RANGES, max(1, chars // RANGE_BYTES)))
    pairs = next_descending(rows, ["text"], ranges, {"fingerprint": fingerprint(F.col("text"), k, size)})
    n = F.length("text")
    pairs = pairs.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))")))
    out = pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint", fingerprint(F.col("edited"), k, size).alias("edited_fingerprint"), "next_fingerprint",
    )
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
