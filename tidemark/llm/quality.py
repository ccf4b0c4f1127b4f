"""Quality rules as a short-circuit cascade.

A rule rejects a text on one measure. On a documented sample every rule runs alone, which gives its cost (seconds) and
the share it rejects; the cascade then runs the rules in descending order of rejections per second and stops at the
first that rejects. The order changes the cost, never the verdict. Measures are taken lazily and kept for the
text's later rules.

Of rules with equal gain the one that is named first runs first. ``rejected_by`` names the first rule that rejects in the order of this run, which
follows measured times; ``kept`` is the same in any order.

Cases: null or empty text has no words. Ratios of nothing are 0. Texts of any length are measured whole. Rows that
repeat a doc_id are judged each. No rows give no rows; a sample without rows keeps the order given. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts

SYMBOLS = "#*$%&|<>"
#: About so many rows estimate cost and selectivity.
SAMPLE_ROWS = 400


class Measures:
    """Lazy measures of one text. Words are runs of anything but space and tab to carriage return."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        n = len(w) - 2
        if n < 2:
            return 0
        grams = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(grams)) == n:
            return 0
        found, total, end = Counter(grams), 0, 0
        for i, g in enumerate(grams):
            if found[g] > 1:
                total += i + 3 - max(i, end)
                end = i + 3
        return total

    @cached_property
    def n_digits(self) -> int:
        return sum(map(self.text.count, "0123456789"))

    @cached_property
    def n_ellipsis_lines(self) -> int:
        return sum(x.endswith(("...", "\u2026")) for x in self.lines)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: The base rules, always measured.
BASE = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("duplicate_lines", lambda m: 100 * m.n_dup_lines > 50 * len(m.lines)),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
    Rule("digits", lambda m: 100 * m.n_digits > 30 * m.word_chars),
    Rule("ellipsis_lines", lambda m: 100 * m.n_ellipsis_lines > 30 * len(m.lines)),
)


#: What is measured of every text, whatever the rules say.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """{rule: (seconds per text, share rejected)} on every n-th row by a hash of its id and text, n such that about ``sample_rows`` remain.

    Costs are those of a rule after the base measures have been taken.
    """
    step = max(1, docs.count() // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).select("doc_id", "text")

    def run(cols: dict) -> dict:
        out: dict[str, list] = {"rule": [], "s": [], "n": [], "rejected": []}
        for r in rules:
            s, took = 0, 0.0
            for t in cols["text"]:
                # as in the cascade, where the base measures are there before any rule runs
                m = Measures(t)
                for k in MEASURED:
                    getattr(m, k)
                began = time.perf_counter()
                s += r.rejects(m)
                took += time.perf_counter() - began
            for k, v in zip(out, (r.name, took, len(cols["text"]), s), strict=True):
                out[k].append(v)
        return out

    got = map_texts(sample, run, "rule string, s double, n long, rejected long").groupBy("rule").agg(F.sum("s"), F.sum("n"), F.sum("rejected"))
    return {r[0]: (r[1] / r[2], r[3] / r[2]) for r in got.collect()}  # one row for each rule


def order(rules: tuple[Rule, ...], estimates: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """By rejections per second, most first; rules without an estimate come last."""

    def gain(r: Rule) -> float:
        cost, share = estimates.get(r.name, (1.0, -1.0))
        return -share / max(cost, 1e-9)

    return tuple(sorted(rules, key=gain))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by, kept)."""
    ordered = order(rules, estimate(docs, rules, sample_rows))
    base = MEASURED

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", *base, "base_failed", "rejected_by", "kept")}
        out["doc_id"] = cols["doc_id"]
        for t in cols["text"]:
            m = Measures(t)
            for k in base:
                out[k].append(getattr(m, k))
            failed = any(r.rejects(m) for r in BASE)
            by = None if failed else next((r.name for r in ordered if r.rejects(m)), None)
            out["base_failed"].append(failed)
            out["rejected_by"].append(by)
            out["kept"].append(not failed and by is None)
        return out

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{k} long" for k in base) + ", base_failed boolean, rejected_by string, kept boolean"
    return map_texts(docs.select("doc_id", "text"), run, schema)
