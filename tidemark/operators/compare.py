"""Difference classes of two records' names, numbers and addresses, as column expressions.

A name is an array of `heard` words: the word with what it sounds like, made once per record. Words that only one side has
are found as counted sets; `pair_off` then matches them by typo, sound or abbreviation; the class follows from what is left over.
Nothing here leaves the JVM but Metaphone codes, which `phonetic.metaphones_of` gives once per record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.text import content_words, is_abbreviation, jaccard, let, sound_key

HEARD = "struct<word:string,key:string,code:string,core:boolean>"


def heard(words: Column, codes: Column | None = None) -> Column:
    """Array of (word, key, code, core) of an array of words: its sound key, its Metaphone code if codes are given beside, whether it neither is nor sounds like a minor word."""

    def one(w: Column, code: Column) -> Column:
        core = F.size(content_words(F.array(w), sounds=True)) > 0
        return F.struct(w.alias("word"), sound_key(w).alias("key"), code.alias("code"), core.alias("core"))

    if codes is None:
        return F.transform(words, lambda w: one(w, F.lit(None).cast("string")))
    return F.zip_with(words, codes, one)


def beyond(a: Column, b: Column) -> Column:
    """What array a holds beyond array b, repeats counted."""
    nth = lambda xs: F.transform(xs, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(xs, 1, i + 1), lambda y: y == x)).alias("n")))
    return F.array_except(nth(a), nth(b))["x"]


def pair_off(takers: Column, free: Column, kind: str, rank: Callable[[Column], Column], cost: Callable[[Column, Column], Column]) -> Column:
    """(pairs of (a, d), rest of the takers, free): in the order of ``rank`` each taker gets the cheapest free element that fits.

    ``cost`` is null for what does not fit; among equals the least element is taken, so that the result depends on no order of the input.
    """
    empty = F.array().cast(f"array<{kind}>")
    start = F.struct(F.array().cast(f"array<struct<a:{kind},d:{kind}>>").alias("pairs"), empty.alias("rest"), F.array_distinct(free).alias("free"))

    def step(state: Column, a: Column) -> Column:
        offers = F.transform(state["free"], lambda d: F.struct(cost(a, d).alias("cost"), d.alias("d")))

        def take(best: Column) -> Column:
            got = F.struct(
                F.array_append(state["pairs"], F.struct(a.alias("a"), best["d"].alias("d"))).alias("pairs"), state["rest"].alias("rest"),
                F.filter(state["free"], lambda x: x != best["d"]).alias("free"),
            )
            none = F.struct(state["pairs"].alias("pairs"), F.array_append(state["rest"], a).alias("rest"), state["free"].alias("free"))
            return F.when(best.isNull(), none).otherwise(got)

        return let(F.array_min(F.filter(offers, lambda o: o["cost"].isNotNull())), take)

    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(takers), lambda a: F.struct(rank(a).alias("rank"), a.alias("a")))), lambda x: x["a"])
    return F.aggregate(ordered, start, step)


def _numeric(word: Column) -> Column:
    return word.rlike("^[0-9]+$")


def typo_cost(a: Column, d: Column) -> Column:
    """0 for words that sound the same, else their edits if those are few: one up to four letters, two beyond; words of three letters at least."""
    x, y = a["word"], d["word"]
    spoken = (F.length(x) > 1) & (F.length(y) > 1) & ~_numeric(x) & ~_numeric(y)
    alike = (a["key"] == d["key"]) | ((F.length(x) > 2) & (F.length(y) > 2) & F.coalesce(a["code"] == d["code"], F.lit(False)))
    allowed = F.when(F.greatest(F.length(x), F.length(y)) > 4, 2).otherwise(1)
    edits = F.levenshtein(x, y, 2)
    return F.when(spoken & alike, 0).when((F.least(F.length(x), F.length(y)) > 2) & edits.between(0, allowed), F.greatest(edits, F.lit(1)))


def typos(added: Column, dropped: Column) -> Column:
    """`pair_off` of `heard` words by `typo_cost`; long words choose first."""
    return pair_off(added, dropped, HEARD, lambda a: F.struct((-F.length(a["word"])).alias("n"), a["word"].alias("w")), typo_cost)


def abbreviations(added: Column, dropped: Column) -> Column:
    """`pair_off` of words of which one shortens the other; short words choose first."""
    fits = lambda a, d: F.when(is_abbreviation(a, d) | is_abbreviation(d, a), 0)
    return pair_off(added, dropped, "string", lambda a: F.struct(F.length(a).alias("n"), a.alias("w")), fits)


def _words(xs: Column) -> Column:
    return F.transform(xs, lambda x: x["word"])


def _sides(n_added: Column, n_dropped: Column, added: Column, dropped: Column, both: int) -> Column:
    """A class by the side that has words left over."""
    return F.when(n_dropped == 0, added).when(n_added == 0, dropped).otherwise(both)


def name_comparison(s: Column, r: Column, other_script: Column | None = None) -> Column:
    """How a record's name differs from its anchor's, both `heard`: (code, n_added, n_dropped, n_typos, minor, same_form, added, dropped, jaccard).

    Classes within a script: 0 equal; 1 only minor words (legal forms, titles, articles, single letters) differ; 2 typos; 3 typos
    and minor words; 4 one word added, 5 more; 6 one dropped, 7 more; 8 added and dropped; 9 nothing in common. Across scripts,
    by sound keys of the words that neither are nor sound like minor ones: 10 equal, 11 minor words differ, 12 added, 13 dropped, 14 both, 15
    nothing in common. ``minor`` says whether minor words changed, ``same_form`` that those changes only shorten or spell out.
    """
    within = _name_within(s, r)
    if other_script is None:
        return within
    return F.when(other_script, _name_across(s, r)).otherwise(within)


def _name_result(code: Column, n: tuple[Column, Column, Column], minor: Column, form: Column, added: Column, dropped: Column, jac: Column) -> Column:
    return F.struct(
        code.cast("int").alias("code"), n[0].alias("n_added"), n[1].alias("n_dropped"), n[2].alias("n_typos"), minor.cast("int").alias("minor"), form.cast("int").alias("same_form"),
        F.array_sort(added).alias("added"), F.array_sort(dropped).alias("dropped"), jac.alias("jaccard"),
    )


def _name_within(s: Column, r: Column) -> Column:
    minor_words = lambda ws: F.filter(ws, lambda w: F.array_contains(F.array(*[F.lit(x) for x in K.MINOR]), w))
    core_s, core_r = F.array_distinct(content_words(_words(s))), F.array_distinct(content_words(_words(r)))

    def result(x: Column) -> Column:
        pairs, core_s, core_r, added, dropped, form = (x[c] for c in ("pairs", "core_s", "core_r", "added", "dropped", "form"))
        left_a, left_d = content_words(added), content_words(dropped)
        minor = (F.size(left_a) < F.size(added)) | (F.size(left_d) < F.size(dropped))
        linked = F.exists(pairs, lambda p: F.array_contains(core_r, p["a"]["word"]) & F.array_contains(core_s, p["d"]["word"]))
        apart = (F.size(core_s) > 0) & (F.size(core_r) > 0) & ~F.arrays_overlap(core_s, core_r) & ~linked
        n = (F.size(left_a), F.size(left_d), F.size(pairs))
        one_or_more = lambda k, first: first + (k > 1).cast("int")
        settled = F.when(n[2] == 0, 1).otherwise(2 + minor.cast("int"))
        code = (
            F.when(x["equal"], 0).when(apart, 9).when(n[0] + n[1] == 0, settled)
            .otherwise(_sides(n[0], n[1], one_or_more(n[0], 4), one_or_more(n[1], 6), 8))
        )
        return _name_result(code, n, ~x["equal"] & minor, form, left_a, left_d, jaccard(core_s, core_r, 1.0))

    def matched(d: Column) -> Column:
        lesser_a, lesser_d = minor_words(_words(d["added"])), minor_words(_words(d["dropped"]))
        short = abbreviations(lesser_a, lesser_d)
        # `pair_off` works on sets: repeats of a form that is left over are no re-spelling
        form = (F.size(lesser_a) + F.size(lesser_d) > 0) & (F.size(lesser_a) == F.size(lesser_d)) & let(short, lambda x: F.size(x["pairs"]) == F.size(lesser_a))
        found = lambda m: F.struct(
            m["pairs"].alias("pairs"), core_s.alias("core_s"), core_r.alias("core_r"), _words(m["rest"]).alias("added"), _words(m["free"]).alias("dropped"),
            form.alias("form"), (F.size(d["added"]) + F.size(d["dropped"]) == 0).alias("equal"),
        )
        return let(let(typos(d["added"], d["dropped"]), found), result)

    return let(F.struct(beyond(r, s).alias("added"), beyond(s, r).alias("dropped")), matched)


def _name_across(s: Column, r: Column) -> Column:
    keyed = lambda xs: F.filter(xs, lambda x: x["core"])
    keys = lambda xs: F.transform(xs, lambda x: x["key"])
    lesser = lambda xs, core: F.array_sort(F.array_distinct(keys(F.array_except(xs, core))))
    as_word = lambda k, core: F.coalesce(F.try_element_at(F.filter(core, lambda x: x["key"] == k), F.lit(-1))["word"], k)

    def of(c: Column) -> Column:
        core_s, core_r = c["s"], c["r"]
        ks, kr = keys(core_s), keys(core_r)
        minor = lesser(s, core_s) != lesser(r, core_r)

        def result(m: Column) -> Column:
            n = (F.size(m["rest"]), F.size(m["free"]), F.size(m["pairs"]))
            apart = (F.size(ks) + F.size(kr) > 0) & ~F.arrays_overlap(ks, kr) & (n[2] == 0)
            code = F.when(apart, 15).when(n[0] + n[1] == 0, 10 + minor.cast("int")).otherwise(_sides(n[0], n[1], F.lit(12), F.lit(13), 14))
            named = lambda ws, core: F.transform(ws, lambda x: as_word(x["word"], core))
            jac = jaccard(F.array_distinct(ks), F.array_distinct(kr), 1.0)
            return _name_result(code, n, minor, F.lit(False), named(m["rest"], core_r), named(m["free"], core_s), jac)

        return let(typos(heard(beyond(kr, ks)), heard(beyond(ks, kr))), result)

    return let(F.struct(keyed(s).alias("s"), keyed(r).alias("r")), of)


def number_comparison(s: Column, r: Column) -> Column:
    """How two lists of numbers differ: (relation, log_gap, edits, n_added, n_dropped, first_changed).

    Relations: 0 the same numbers, or the same digits joined otherwise; 1 only added; 2 only dropped; else by the closest pair of a
    dropped and an added number: 3 one cut from the other, 4 one character, 5 at most 50 apart, 6 far. The closest pair is the least by
    relation, edits and text; gap and edits are its own, null where there is none. ``first_changed``: the anchor's first number is the one that changed.
    """
    lead = lambda t: F.regexp_extract(t, "^([0-9]{0,15})", 1).try_cast("bigint")

    def meet(a: Column, b: Column) -> Column:
        edits, gap = F.levenshtein(a, b), F.abs(lead(a) - lead(b))
        cut = F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)
        kind = F.when(cut, 3).when(edits == 1, 4).when(gap <= 50, 5).otherwise(6)
        return F.struct(kind.alias("kind"), edits.alias("edits"), a.alias("a"), b.alias("b"), gap.alias("gap"))

    def of(d: Column) -> Column:
        closest = F.array_min(F.flatten(F.transform(d["dropped"], lambda a: F.transform(d["added"], lambda b: meet(a, b)))))
        n_added, n_dropped = F.size(d["added"]), F.size(d["dropped"])
        same = (n_added + n_dropped == 0) | (F.array_join(s, "") == F.array_join(r, ""))
        first = F.try_element_at(s, F.lit(1))

        def result(c: Column) -> Column:
            relation = F.when(same, 0).when(n_dropped == 0, 1).when(n_added == 0, 2).otherwise(c["kind"])
            changed = F.when(n_dropped == 0, F.lit(False)).when(n_added == 0, F.array_contains(d["dropped"], first)).otherwise(first == c["a"])
            zero = lambda x, none: F.when(same, none).otherwise(x)
            return F.struct(
                relation.alias("relation"), zero(F.log1p(c["gap"]), F.lit(0.0)).alias("log_gap"), zero(c["edits"].cast("double"), F.lit(0.0)).alias("edits"),
                zero(n_added, F.lit(0)).alias("n_added"), zero(n_dropped, F.lit(0)).alias("n_dropped"), zero(F.coalesce(changed, F.lit(False)).cast("int"), F.lit(0)).alias("first_changed"),
            )

        return let(closest, result)

    return let(F.struct(beyond(r, s).alias("added"), beyond(s, r).alias("dropped")), of)


def address_comparison(sw: Column, sn: Column, rw: Column, rn: Column) -> Column:
    """How a record's address differs from its anchor's: (code, relation, n_added, n_dropped, n_typos, n_short, added, dropped, jaccard, numbers).

    ``sw`` and ``rw`` are arrays of `heard` distinct words, null for no address; ``sn`` and ``rn`` arrays of numbers. Words that shorten
    one another are equal. Classes: 0 equal, 1 only numbers differ, 2 typos, 3 typos and numbers, 4 words added, 5 dropped, 6 both, 7
    nothing in common, 8 the record's is missing, 9 the anchor's is. ``relation`` is that of `number_comparison`, 7 where an address is missing.
    """
    none = F.array().cast("array<string>")
    missing = lambda code: F.struct(
        F.lit(code).alias("code"), F.lit(7).alias("relation"), *[F.lit(0).alias(c) for c in ("n_added", "n_dropped", "n_typos", "n_short")], none.alias("added"), none.alias("dropped"),
        F.lit(None).cast("double").alias("jaccard"), F.lit(None).cast("struct<relation:int,log_gap:double,edits:double,n_added:int,n_dropped:int,first_changed:int>").alias("numbers"),
    )

    def of(x: Column) -> Column:
        numbers, short = x["numbers"], x["short"]
        still = lambda side, ws: F.filter(side, lambda h: F.array_contains(ws, h["word"]))

        def result(m: Column) -> Column:
            n_short, n = F.size(short["pairs"]), (F.size(m["rest"]), F.size(m["free"]), F.size(m["pairs"]))
            apart = ~F.arrays_overlap(_words(sw), _words(rw)) & (n[2] + n_short == 0)
            other = (numbers["relation"] > 0).cast("int")
            settled = F.when(n[2] > 0, 2).otherwise(0) + other
            code = F.when(n[0] + n[1] == 0, settled).when(apart, 7).otherwise(_sides(n[0], n[1], F.lit(4), F.lit(5), 6))
            return F.struct(
                code.cast("int").alias("code"), numbers["relation"].alias("relation"), n[0].alias("n_added"), n[1].alias("n_dropped"), n[2].alias("n_typos"), n_short.alias("n_short"),
                F.array_sort(_words(m["rest"])).alias("added"), F.array_sort(_words(m["free"])).alias("dropped"), jaccard(_words(sw), _words(rw), 1.0).alias("jaccard"), numbers.alias("numbers"),
            )

        return let(typos(still(rw, short["rest"]), still(sw, short["free"])), result)

    extra = lambda a, b: F.array_except(_words(a), _words(b))
    both = let(F.struct(number_comparison(sn, rn).alias("numbers"), abbreviations(extra(rw, sw), extra(sw, rw)).alias("short")), of)
    return F.when(rw.isNull(), missing(8)).when(sw.isNull(), missing(9)).otherwise(both)
