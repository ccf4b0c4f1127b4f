"""Text normalisation as Column expressions.

Only transliteration needs Python (`fold`, an Arrow UDF); everything after it stays in the JVM. Token lists are arrays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import constants as K

# Letters that do not decompose into a base letter and marks.
_LETTERS = str.maketrans({
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L",
    "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-",
})
# Consonants of the Devanagari block from U+0915 on, and of the blocks that are laid out alike.
_INDIC = "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v s s s h".split()
_VOWELS = "a aa i ii u uu r l e e e ai o o o au".split()
_SIGNS = "aa i ii u uu r rr e e e ai o o o au".split()


def _indic(s: str) -> str:
    """Romanise the scripts from U+0900 to U+0DFF by their common layout: a consonant carries an a unless a sign says otherwise."""
    out = []
    n = len(s)
    for i, c in enumerate(s):
        o = ord(c)
        if not 0x900 <= o <= 0xDFF:
            out.append(c)
            continue
        at = o & 0x7F
        after = ord(s[i + 1]) & 0x7F if i + 1 < n and 0x900 <= ord(s[i + 1]) <= 0xDFF else None
        if 0x05 <= at <= 0x14:
            out.append(_VOWELS[at - 0x05])
        elif 0x15 <= at <= 0x39:
            signed = after is not None and (0x3E <= after <= 0x4D)
            out.append(_INDIC[at - 0x15] + ("" if signed or after is None else "a"))
        elif 0x3E <= at <= 0x4C:
            out.append(_SIGNS[at - 0x3E])
        elif at in (0x01, 0x02):
            out.append("m")
        elif at == 0x03:
            out.append("h")
        elif 0x66 <= at <= 0x6F:
            out.append(str(at - 0x66))
    return "".join(out)


def ascii_letters(s: str) -> str:
    """Nearest ASCII spelling: decomposition without marks, a table of letters, Indic scripts by layout; others are dropped."""
    s = _indic(s.translate(_LETTERS))
    return "".join(c for c in unicodedata.normalize("NFKD", s) if c.isascii())


def fold_text(s: str | None) -> str | None:
    if s is None or s.isascii():
        return None if s is None else s.lower()
    s = unicodedata.normalize("NFKC", s)
    out, i = [], 0
    while i < len(s):
        # "n" and a degree sign stand for "number"
        if s[i] in "nN" and not (i and s[i - 1].isalnum()):
            j = i + 1
            while j < len(s) and s[j].isspace():
                j += 1
            if j < len(s) and s[j] in "°º":
                out.append(" no ")
                i = j + 1
                continue
        out.append(" " if s[i] in "°º" else s[i])
        i += 1
    return ascii_letters("".join(out)).lower()


def romanize_text(s: str | None) -> str:
    s = unicodedata.normalize("NFKC", s or "")
    if s.isascii():
        return s.lower()
    ends = set(" \t\n\r\x0b\x0c,.()-")
    kept = [c for i, c in enumerate(s) if not (c in K.FINAL_NASALS and (i + 1 == len(s) or s[i + 1] in ends))]
    return ascii_letters("".join(kept)).lower()


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _romanize(s: pd.Series) -> pd.Series:
    return s.map(romanize_text)


def fold(c: Column) -> Column:
    """Lower-case ASCII of a text. Only texts with other characters are sent to Python."""
    other = c.rlike(r"[^\x00-\x7f]")
    return F.when(other, _fold(F.when(other, c))).otherwise(F.lower(c))


def romanize(c: Column) -> Column:
    return _romanize(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def has_nonlatin(c: Column) -> Column:
    return c.rlike(r"[\x{0250}-\x{10FFFF}&&\p{L}]")


def has_indic(c: Column) -> Column:
    return c.rlike(r"[\x{0900}-\x{0DFF}]")


def script_of(c: Column) -> Column:
    """Class of the scripts in a text: the first that matches."""
    return (
        F.when(c.rlike(r"[\x{0900}-\x{0DFF}]"), "indic").when(c.rlike(r"\p{IsHan}"), "han").when(c.rlike(r"\p{IsCyrillic}"), "cyrillic")
        .when(c.rlike(r"\p{IsArabic}"), "arabic").when(c.rlike(r"[\x{00C0}-\x{024F}]"), "latin_extended").otherwise("ascii")
    )


def tokens(c: Column) -> Column:
    """Words of ASCII letters and digits of a lower-case text, without empty ones."""
    return F.array_remove(F.split(F.regexp_replace(c, "[^0-9a-z]+", " "), " "), "")


def join_initials(words: Column) -> Column:
    """Runs of two or more single letters become one word; works on the joined text."""
    return F.array_remove(F.split(F.regexp_replace(F.array_join(words, " "), r"(?<=(^| )[a-z]) (?=[a-z]( |$))", ""), " "), "")


def unleet(word: Column) -> Column:
    """Read a digit as a letter in words of three or more characters with exactly one digit, ordinals aside."""
    one = (F.length(word) >= 3) & word.rlike("^[^0-9]*[0-9][^0-9]*$") & ~word.rlike("^[0-9]+(st|nd|rd|th)$")
    return F.when(one, F.translate(word, *K.LEET)).otherwise(word)


def replace_words(words: Column, table: dict[str, str]) -> Column:
    m = lookup(table)
    return F.array_remove(F.transform(words, lambda w: F.coalesce(F.try_element_at(m, w), w)), "")


def name_words(folded: Column) -> Column:
    """Normalised words of a folded name."""
    plain = F.replace(F.replace(folded, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    return replace_words(F.transform(join_initials(tokens(plain)), unleet), K.NAME_ABBR)


def core_words(words: Column) -> Column:
    drop = F.array(*[F.lit(w) for w in (*K.LEGAL, *K.HONOR)])
    return F.filter(words, lambda w: ~F.array_contains(drop, w))


def strip_zeros(digits: Column) -> Column:
    short = F.regexp_replace(digits, "^0+", "")
    return F.when(short == "", "0").otherwise(short)


def with_state_codes(folded: Column, country: Column) -> Column:
    """State names become codes in the countries that have a table; longer names first."""
    out = folded
    for name, states in K.STATES.items():
        coded = folded
        for phrase in sorted(states, key=len, reverse=True):
            # a mark keeps what is already coded from matching again
            coded = F.regexp_replace(coded, rf"(?<![0-9a-z_]){phrase}(?![0-9a-z_])", f"\x01{states[phrase]}\x01")
        out = F.when(country == name, F.replace(coded, F.lit("\x01"), F.lit(""))).otherwise(out)
    return out


def address_parts(folded: Column, country: Column) -> Column:
    """Array of (word, number): words in order, and the digits where a word counts as a house number."""
    numbers = lookup({w: str(i) for i, w in enumerate(K.ORDINALS)})
    abbr = lookup(K.ADDR_ABBR)
    pair = lambda w, n: F.struct(w.alias("word"), n.alias("number"))
    none = F.lit(None).cast("string")

    def one(t: Column) -> Column:
        ordinal = t.rlike("^[0-9]+(st|nd|rd|th)$")
        digits = strip_zeros(F.regexp_extract(t, "^([0-9]+)", 1))
        rest = F.regexp_replace(t, "^[0-9]+", "")
        word = F.coalesce(F.try_element_at(abbr, rest), rest)
        return (
            F.when(ordinal, F.array(pair(digits, none)))
            .when(F.map_contains_key(numbers, t), F.array(pair(F.try_element_at(numbers, t), none)))
            .when(t.rlike("^[0-9]"), F.array(pair(digits, digits), pair(word, none)))
            .otherwise(F.array(pair(word, none)))
        )

    plain = with_state_codes(F.replace(folded, F.lit("'"), F.lit("")), country)
    return F.filter(F.flatten(F.transform(tokens(plain), one)), lambda x: x["word"] != "")


def address_words(parts: Column) -> Column:
    return F.transform(parts, lambda x: x["word"])


def address_numbers(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda x: x["number"].isNotNull()), lambda x: x["number"])


def consonants(word: Column) -> Column:
    """Skeleton of a word: no vowels, h or y after the first letter, no repeats."""
    return F.regexp_replace(F.regexp_replace(word, "(?<=.)[aeiouyh]", ""), r"(.)\1+", "$1")


def _sounds(word: Column, before: str) -> Column:
    for a, b in K.DIGRAPHS:
        word = F.replace(word, F.lit(a), F.lit(b))
    return F.translate(F.regexp_replace(word, f"m(?=[{before}])", "n"), *K.SOUND_LETTERS)


def _single(word: Column) -> Column:
    return F.regexp_replace(word, r"(.)\1+", "$1")


def sound(word: Column) -> Column:
    """First sound key: vowels go after the first letter."""
    s = _sounds(word, K.NASAL_BEFORE_1)
    return _single(F.concat(F.substring(s, 1, 1), F.regexp_replace(F.substring(s, 2, 1 << 30), "[aeiou]", "")))


def skeleton(word: Column) -> Column:
    """Second sound key: all vowels go; digits stay; never empty."""
    s = _sounds(F.regexp_replace(word, "[ts]ion", "sn"), K.NASAL_BEFORE_2)
    bare = _single(F.regexp_replace(s, "[aeiou]+", ""))
    return F.when(word.rlike("^[0-9]+$"), word).when(bare == "", F.substring(s, 1, 1)).otherwise(bare)


def sound_key(word: Column) -> Column:
    """`skeleton`, but a one-letter skeleton shows where a vowel stands before it: it -> *t, amy -> *m, ma -> m."""
    marked = _single(F.regexp_replace(_sounds(word, K.NASAL_BEFORE_2), "[aeiou]+", "*"))
    bare = F.regexp_replace(marked, r"\*+$", "")
    return let(skeleton(word), lambda k: F.when((F.length(k) >= 2) | word.rlike("^[0-9]+$"), k).when(bare == "", marked).otherwise(bare))


def is_abbreviation(a: Column, b: Column) -> Column:
    """Whether ``a`` shortens ``b``: same first letter, letters in order, and much shorter."""
    spread = F.concat(F.lit("^"), F.array_join(F.filter(F.split(a, ""), lambda c: c != ""), ".*"))
    short = ((F.length(a) <= 4) & (F.length(b) >= F.length(a) + 2)) | ((F.length(a) == 5) & (F.length(b) >= 10))
    numeric = a.rlike("^[0-9]+$") | b.rlike("^[0-9]+$")
    return ~numeric & short & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & F.rlike(b, spread)


def numbers_in(c: Column) -> Column:
    """All runs of digits without leading zeros."""
    return F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), strip_zeros)


def character_grams(c: Column, n: int = 3) -> Column:
    """All substrings of n characters; none for shorter texts."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def denumbered(c: Column) -> tuple[Column, Column]:
    """Keys of an address without its numbers: as it stands, and as a set of words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", " "), "[^a-z]+", " "))
    return plain, F.array_join(F.array_sort(F.array_distinct(F.split(plain, " "))), " ")


def difference_signature(a: Column, b: Column) -> Column:
    """``added|dropped``: what word array b has beyond a, and a beyond b."""
    side = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), " ")
    return F.concat(side(b, a), F.lit("|"), side(a, b))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Jaccard index of two arrays; ``empty`` for two empty ones."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / n)


def _one_of(word: Column, values: tuple[str, ...]) -> Column:
    return F.array_contains(F.array(*[F.lit(v) for v in values]), word)


def name_tokens(romanized: Column, country: Column) -> Column:
    """Sorted words of a romanised name with repeats; the country's own name becomes ``ctry``."""
    return F.array_sort(F.transform(tokens(romanized), lambda t: F.when(t == F.lower(country), "ctry").otherwise(t)))


def _plain_skeleton(word: str) -> str:
    """`skeleton` of a word that is known here, so that fixed lists are coded once and not in every row."""
    s = re.sub("[ts]ion", "sn", word)
    for a, b in K.DIGRAPHS:
        s = s.replace(a, b)
    s = re.sub(f"m(?=[{K.NASAL_BEFORE_2}])", "n", s).translate(str.maketrans(*K.SOUND_LETTERS))
    bare = re.sub(r"(.)\1+", r"\1", re.sub("[aeiou]+", "", s))
    return bare or s[:1]


#: Skeletons of the minor words, of those that have three letters left.
MINOR_SKELETONS = tuple(sorted({s for s in map(_plain_skeleton, K.MINOR) if len(s) >= 3}))


def content_words(words: Column, sounds: bool = False) -> Column:
    """Words of two letters and more that are no legal forms, honorifics or articles; ``sounds`` also drops what sounds like one."""
    kept = F.filter(words, lambda t: ~_one_of(t, K.MINOR) & (F.length(t) > 1))
    return F.filter(kept, lambda t: ~_one_of(skeleton(t), MINOR_SKELETONS)) if sounds else kept


def address_components(romanized: Column) -> Column:
    """Cleaned parts of an address between commas, without empty ones."""
    clean = lambda c: F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))
    return F.array_remove(F.transform(F.split(romanized, ","), clean), "")


def address_tokens(components: Column, areas: Column) -> Column:
    """Array of (kind, value): words ``w`` to compare, words ``a`` of areas (for retrieval alone), numbers ``n``.

    Floors (an ordinal before a word for floor) and placeholder words are left out, ordinals become ``<n>o``, tokens with
    a digit are numbers. ``areas`` lists components that are too common to identify anything.
    """
    ordinals = lookup({w: f"{i}o" for i, w in enumerate(K.ORDINALS) if i})
    item = lambda kind, v: F.struct(kind.alias("kind"), v.alias("value"))

    def of(component: Column) -> Column:
        area = F.array_contains(areas, component)

        def parse(ts: Column) -> Column:
            def one(t: Column, i: Column) -> Column:
                ordinal = F.map_contains_key(ordinals, t) | t.rlike("^0*[0-9]+(st|nd|rd|th)$")
                floor = ordinal & F.coalesce(_one_of(F.try_element_at(ts, i + 2), K.FLOOR), F.lit(False))
                spelled = F.coalesce(F.try_element_at(ordinals, t), F.concat(F.regexp_extract(t, "^0*([0-9]+)", 1), F.lit("o")))
                word = F.when(ordinal, spelled).otherwise(t)
                kind = F.when(area, "a").otherwise("w")
                return (
                    F.when(floor | (~ordinal & _one_of(t, K.ADDR_DROP)), F.lit(None))
                    .when(~ordinal & t.rlike("[0-9]"), item(F.lit("n"), F.regexp_replace(t, "^0+(?=.)", ""))).otherwise(item(kind, word))
                )

            return F.transform(ts, one)

        return let(F.split(component, " "), parse)

    return F.filter(F.flatten(F.transform(components, of)), lambda x: x.isNotNull())


def tokens_of_kind(parsed: Column, *kinds: str) -> Column:
    """Sorted distinct words of some kinds; numbers keep their order and repeats."""
    picked = F.transform(F.filter(parsed, lambda x: x["kind"].isin(*kinds)), lambda x: x["value"])
    return picked if kinds == ("n",) else F.array_sort(F.array_distinct(picked))
