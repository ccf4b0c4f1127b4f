"""Line dedup over a suffix array of line ids, by DataFrame functions only.

All texts are one sequence of lines. The id of a line is the place of its first occurrence, and prefix doubling ranks
the suffixes: after round r suffixes that agree on their first 2^r lines (within their text) share a rank, which is the
place of the first of them. A round joins the ranks at distance 2^(r-1) and groups the pairs. Suffixes whose rank is
theirs alone agree with no other on that many lines; they are settled and leave, and the rounds end when none is left,
so their number is the logarithm of the longest repeated run.

The rounds are then walked down again. A suffix enters at the longest power of two that it shares with an earlier one,
and every step of 2^s lines asks whether the longest-common-prefix interval it is in has a narrower one that is 2^s lines
deeper and still holds an earlier suffix. What comes out is, for each place, the length of the longest run of lines that starts
there and also starts earlier. All members of an interval of some depth are in one group of a step, with the interval's first
suffix added to them, so a step is one group-by, and a suffix is in one group of each step.

Such a run goes if all its lines together have at least ``min_chars`` characters: its whole length decides, so short lines go
within a long run and stay outside of one.

Places are longs (document key, line), so all groups are hash aggregates that combine before they shuffle; a line
that a third of the texts hold is one row per task there, and a join side that Spark splits.

Lines are what stands between newlines. Lines without a word are no part of the sequence, have no characters here, and always stay.

Cases: null text stays null and has no lines; an empty text is one line without a word. Rows are ordered by doc_id,
nulls first, then by text hash where ids repeat; equal rows count as one document and get equal results. No rows give no rows.
A run may overlap the earlier one. Columns besides doc_id and text pass through `dedup` unchanged, whatever their names; n_lines and
n_removed replace columns of those names. A text has at most 2 ** LINE_BITS lines with a word; with more, the job stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, pick, shield, spread, with_key

#: Characters that a run of repeated lines has to have to be taken out.
MIN_CHARS = 50
MAX_ROUNDS = 30
#: A line's number in its text is below 2 ** LINE_BITS.
LINE_BITS = 27


def _plain(line: Column) -> Column:
    for c in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(c), F.lit(" "))
    return line


def has_word(line: Column) -> Column:
    return F.trim(_plain(line)) != ""


def lines(docs: DataFrame) -> DataFrame:
    """(p, at, line) of every line with a word: p is its place in the sequence, ``at`` its number among all lines of its text."""
    told = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    kept = F.filter(told, lambda x: has_word(x["line"]))
    rows = spread(docs).select("_k", F.posexplode(kept).alias("i", "x"))
    place = F.when(F.col("i") < 1 << LINE_BITS, F.shiftleft("_k", LINE_BITS) + F.col("i")).otherwise(F.raise_error(F.lit(f"a text has more than 2 ** {LINE_BITS} lines")))
    return rows.select(place.cast("long").alias("p"), "x.at", "x.line")


def _shared(rows: DataFrame, scratch: Scratch, *by: str) -> DataFrame:
    """(by, first) of groups with more than one place. Saved, so that a join with them can split what is hot."""
    some = rows.groupBy(*by).agg(F.min("p").alias("first"), F.max("p").alias("last")).where("first <> last").drop("last")
    return scratch.save(some, "shared")


def _join(rows: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join at any size: both sides grow with the corpus."""
    return rows.join(other.hint("merge"), on, how)


def suffix_ranks(docs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables (p, r, w, n) for n = 1, 2, 4, ...: the places whose next n lines occur elsewhere too.

    r is the first such place, w the characters of the n lines. The first table also has ``at``. ``docs`` has _k and text. n is a column
    and no constant, so that all rounds run the same compiled code, which would fill the driver's memory otherwise.
    """
    every = scratch.save(
        lines(docs).select("p", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.length("line").cast("long").alias("w")), "lines"
    )
    shared = _shared(every, scratch, "h", "g")
    now = _join(every, shared, ["h", "g"]).groupBy("p").agg(F.min("first").alias("r"), F.min("at").alias("at"), F.min("w").alias("w"), F.lit(1).cast("long").alias("n"))
    now = scratch.save(now, "ranks")
    scratch.drop(every, shared)
    out = [now]
    for _ in range(MAX_ROUNDS):
        ahead = now.select((F.col("p") - F.col("n")).alias("p"), F.col("r").alias("s"), F.col("w").alias("v"))
        pairs = scratch.save(_join(now.select("p", "r", "w", "n"), ahead, "p").select("p", "r", "s", (F.col("w") + F.col("v")).alias("w"), (F.col("n") * 2).alias("n")), "pairs")
        shared = _shared(pairs, scratch, "r", "s")
        now = scratch.save(_join(pairs, shared, ["r", "s"]).select("p", F.col("first").alias("r"), "w", "n"), "ranks")
        scratch.drop(pairs, shared)
        if now.isEmpty():
            scratch.drop(now)
            break
        out.append(now)
    return out


def longest_runs(ranks: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(p, l, c, w) of every place whose line also stands earlier: l is the length of the longest run from there that also starts earlier.

    c is where the first such run starts, w are the run's characters. ``ranks`` are `suffix_ranks`.
    """
    state = None
    for now in reversed(ranks):
        entering = now.where("r < p").select("p", F.col("n").alias("l"), F.col("r").alias("c"), "w")
        if state is None:
            state = scratch.save(entering, "runs")
            continue
        # the first suffix of an interval is no member of it as far as its own run goes, but it may be the earlier one
        heads = state.groupBy("l", "c").agg(F.lit(True).alias("head")).select(F.col("c").alias("p"), "l", "c", F.lit(0).cast("long").alias("w"), "head")
        members = state.withColumn("head", F.lit(False)).unionByName(heads).withColumn("q", F.col("p") + F.col("l"))
        ahead = now.select(F.col("p").alias("q"), F.col("r").alias("x"), F.col("w").alias("v"), "n")
        deeper = scratch.save(_join(members, ahead, "q").drop("q"), "deeper")
        shared = _shared(deeper, scratch, "l", "c", "x")
        grown = _join(deeper.where("NOT head"), shared, ["l", "c", "x"]).where("first < p").select(
            "p", (F.col("l") + F.col("n")).alias("l"), F.col("first").alias("c"), (F.col("w") + F.col("v")).alias("w")
        )
        best = F.max(F.struct("l", "c", "w")).alias("b")
        after = scratch.save(state.unionByName(grown).unionByName(entering).groupBy("p").agg(best).select("p", "b.*"), "runs")
        scratch.drop(state, deeper, shared)
        state = after
    return state


def deleted_lines(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_k, gone): for each document that loses lines, their numbers among all its lines."""
    ranks = suffix_ranks(docs, scratch)
    found = longest_runs(ranks, scratch)
    ends = _join(found, ranks[0].select("p", "at"), "p").select("p", "at", F.when(F.col("w") >= min_chars, F.col("p") + F.col("l") - 1).alias("e"), F.shiftright("p", LINE_BITS).alias("_k"))
    reach = F.max("e").over(Window.partitionBy("_k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    gone = ends.withColumn("reach", reach).where("reach >= p").groupBy("_k").agg(F.collect_list("at").alias("gone"))
    out = scratch.save(gone, "gone")
    scratch.drop(found, *ranks)
    return out


def runs(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(_k, first_line, n_lines, n_chars, copy_of): maximal runs of later copies, those that lie in no other.

    ``copy_of`` is the document key of the run's first occurrence.
    """
    scratch = scratch or Scratch(docs.sparkSession, "linededup")
    found = longest_runs(suffix_ranks(with_key(docs.select("doc_id", "text"), scratch), scratch), scratch)
    w = Window.partitionBy(F.shiftright("p", LINE_BITS)).orderBy("p")
    inside = F.coalesce(F.max(F.col("p") + F.col("l")).over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("p") + F.col("l"), F.lit(False))
    return found.withColumn("_in", inside).where("NOT _in").select(
        F.shiftright("p", LINE_BITS).alias("_k"), F.col("p").bitwiseAND((1 << LINE_BITS) - 1).alias("first_line"), F.col("l").alias("n_lines"),
        F.col("w").alias("n_chars"), F.shiftright("c", LINE_BITS).alias("copy_of"),
    )


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of ``text``, plus n_lines and n_removed."""
    scratch = scratch or Scratch(docs.sparkSession, "linededup")
    hidden, restore = shield(docs)
    keyed = with_key(hidden, scratch)
    gone = deleted_lines(keyed.select("_k", "text"), scratch, min_chars)
    parts = F.split("text", "\n")

    def without(x: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda j: x[j]), "\n")

    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(F.array(parts), without)[0])
    # only the texts that lose lines move, and the few that a filter of bounded size can't tell from them
    touched, rest = pick(keyed, gone)
    rows = _join(touched, gone, "_k", "left").unionByName(rest.withColumn("gone", F.lit(None).cast("array<int>")))
    rows = rows.withColumns({
        "n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }).withColumn("text", text)
    return restore(rows, "n_lines", "n_removed")
