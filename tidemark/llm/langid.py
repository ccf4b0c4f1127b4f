"""Language identification by interpolated Kneser-Ney character models.

One model per language over the characters of a word and the spaces around it, with n-grams up to ``ORDER``. Models
are trained on a bounded sample of labelled rows (``PER_LANG`` documents and ``LANG_CHARS`` characters for each language, by a hash of id and text). The
n-grams of all languages lie in one sorted array of hashes per order, with a probability and a back-off weight per
language beside each. A text's score under a language is the sum over its words, so a word's
scores are found once per worker and looked up afterwards; every word of the text counts.

The language with the lowest cross-entropy per character wins. Part of the sample is kept out of the counts: its
cross-entropies say how high one may be, and a text beyond that is rejected (``accepted`` false).

Cases: null text and text without a letter are ``und``, score 0, not accepted. Rows with null lang or null id teach
nothing. Without any labelled row everything is ``und``. Ties go to the language that sorts first.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import claim, map_texts

ORDER = 5
#: Most labelled documents for each language, and most languages, in the training sample.
PER_LANG = 400
MAX_LANGS = 256
#: Most characters of a sampled document, and of all those of a language.
TEXT_CHARS, LANG_CHARS = 200_000, 4_000_000
#: Every so-manieth sampled document calibrates and isn't counted.
CALIBRATE = 5
#: Letters an unknown character is one of.
ALPHABET = 1 << 16
#: Words with known scores that a worker keeps.
CACHE = 300_000
#: Entropy allowed above the limit is SHORT / sqrt(characters).
SHORT = 4.0
EDGE = 32


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _hash(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a matrix of code points."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for j in range(codes.shape[1]):
        h = (h ^ codes[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with an edge before and after each; place in the word; number of the word."""
    joined = " " + " ".join(words) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # an edge between two words ends the first and starts the second
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(words) else np.empty(0, np.int64)
    size = lengths + 2
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return codes[starts[word] + place], place, word


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # for each order: sorted hashes
    probs: list[np.ndarray] = field(default_factory=list)  # (n-grams, languages)
    back: list[np.ndarray] = field(default_factory=list)  # weight of the shorter context, for the n-gram as context
    floor: np.ndarray | None = None
    limit: float = float("inf")
    sharp: float = 1.0

    def score(self, words: list[str]) -> np.ndarray:
        """Minus log probability (nats) of each word, with its closing edge, in each language."""
        L = len(self.langs)
        if not words:
            return np.zeros((0, L), np.float32)
        codes, place, word = _flat(words)
        n = len(codes)
        p = np.tile(self.floor, (n, 1))
        before = np.full(n, -1)
        for o, keys in enumerate(self.keys, 1):
            at = np.flatnonzero(place >= o - 1)
            h = _hash(np.stack([codes[at - o + 1 + j] for j in range(o)], axis=1))
            pos = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[pos] == h
            if o > 1:
                # not seen: the shorter context's estimate, weighted if the context was seen
                ctx = before[at - 1]
                known = ctx >= 0
                p[at[known]] *= self.back[o - 2][ctx[known]]
            p[at[hit]] = self.probs[o - 1][pos[hit]]
            before = np.full(n, -1)
            before[at[hit]] = pos[hit]
        cost = -np.log(p)
        cost[place == 0] = 0
        return np.add.reduceat(cost, np.flatnonzero(place == 0), axis=0).astype(np.float32)


def _counts(words: Counter) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: distinct n-grams (code points) and their counts adjusted as Kneser and Ney do."""
    ws = list(words)
    weight = np.fromiter(words.values(), np.float64, len(ws))
    codes, place, word = _flat(ws)
    raw = []
    for o in range(1, ORDER + 1):
        at = np.flatnonzero(place >= max(o - 1, 1))
        grams = np.stack([codes[at - o + 1 + j] for j in range(o)], axis=1)
        h, first, inverse = np.unique(_hash(grams), return_index=True, return_inverse=True)
        raw.append((grams[first], np.bincount(inverse, weight[word[at]], len(h))))
    out = []
    for o, (grams, count) in enumerate(raw, 1):
        if o < ORDER:
            # how many different characters stand before it; what starts a word can have none
            longer = raw[o][0]
            h = _hash(grams)
            by = np.argsort(h)
            tail = _hash(longer[:, 1:])
            left = np.bincount(by[np.searchsorted(h[by], tail)], minlength=len(grams))
            starts = (grams[:, 0] == EDGE) & (o > 1)
            count = np.where(starts, count, np.maximum(left, 1))
        out.append((grams, count))
    return out


def train(by_lang: dict[str, Counter]) -> Model:
    langs = sorted(by_lang)
    m = Model(langs)
    counts = [_counts(by_lang[x]) for x in langs]
    L = len(langs)
    m.floor = np.full(L, 1.0 / ALPHABET)
    for o in range(1, ORDER + 1):
        grams = np.concatenate([c[o - 1][0] for c in counts])
        keys, first = np.unique(_hash(grams), return_index=True)
        grams = grams[first]
        if o == 1:
            lower = np.full((len(keys), L), 1.0 / ALPHABET)
        else:
            lower = m.probs[-1][np.searchsorted(m.keys[-1], _hash(grams[:, 1:]))]
        context = _hash(grams[:, :-1]) if o > 1 else np.zeros(len(grams), np.uint64)
        seen = np.unique(context)
        probs = np.empty((len(keys), L))
        back = np.ones((len(seen), L))
        for i, c in enumerate(counts):
            g, a = c[o - 1]
            n1, n2 = (a == 1).sum(), (a == 2).sum()
            d = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
            full = np.zeros(len(keys))
            full[np.searchsorted(keys, _hash(g))] = a
            c_at = np.searchsorted(seen, context)
            total = np.bincount(c_at, full, len(seen))
            kinds = np.bincount(c_at, full > 0, len(seen))
            back[:, i] = np.where(total > 0, d * kinds / np.maximum(total, 1e-12), 1.0)
            probs[:, i] = np.where(total[c_at] > 0, np.maximum(full - d, 0) / np.maximum(total[c_at], 1e-12), 0) + back[c_at, i] * lower[:, i]
        if o == 1:
            m.floor = back[0] / ALPHABET
        else:
            # weights by the place of the context among the n-grams of the order before
            w = np.ones((len(m.keys[-1]), L))
            at = np.searchsorted(m.keys[-1], seen)
            ok = (at < len(m.keys[-1])) & (m.keys[-1][np.minimum(at, len(m.keys[-1]) - 1)] == seen)
            w[at[ok]] = back[ok]
            m.back.append(w)
        m.keys.append(keys)
        m.probs.append(probs)
    return m


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_lang: int = PER_LANG, chars: int = LANG_CHARS) -> dict[str, list[str]]:
    """{lang: texts}: the bounded training sample, on the driver.

    Rows are thinned out by a hash of id and text to a few times ``per_lang`` for each language before anything is ranked; rows that repeat both count once.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & F.length("text").between(1, TEXT_CHARS))
    n = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not n:
        return {}
    rate = F.create_map(*[F.lit(x) for r in n for x in (r[0], min(1.0, 4 * per_lang / r[1]))])
    h = F.xxhash64("doc_id", "text")
    u = F.shiftrightunsigned(h, 11) / float(1 << 53)
    few = rows.select("doc_id", "lang", "text", h.alias("_h")).where(u < F.coalesce(F.try_element_at(rate, F.col("lang")), F.lit(0.0))).dropDuplicates(["lang", "doc_id", "_h"])
    w = Window.partitionBy("lang").orderBy("_h", "doc_id")
    upto = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    picked = few.withColumns({"_r": F.row_number().over(w), "_c": upto}).where((F.col("_r") <= per_lang) & ((F.col("_c") <= chars) | (F.col("_r") == 1)))
    out: dict[str, list[str]] = {}
    for r in sorted(picked.select("lang", "doc_id", "text").collect(), key=lambda r: (r[0], r[1], r[2])):  # per_lang texts and chars characters for each language at most
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def fit(texts: dict[str, list[str]]) -> Model | None:
    """Models with calibrated rejection from {lang: texts}."""
    texts = {k: v for k, v in texts.items() if any(has_letter(t) for t in v)}
    if not texts:
        return None
    by_lang = {}
    for k, v in texts.items():
        c: Counter = Counter()
        for i, t in enumerate(v):
            if i % CALIBRATE or len(v) < CALIBRATE:
                c.update(words_of(t))
        by_lang[k] = c
    m = train(by_lang)
    best = []
    for k, v in texts.items():
        for t in v[::CALIBRATE]:
            w = words_of(t)
            if len(w) >= 5:
                best.append(float(m.score(w).sum(axis=0)[m.langs.index(k)]) / (sum(map(len, w)) + len(w)))
    if best:
        # beyond all that was seen of real text, by the width of the upper half again
        mid, top = np.median(best), np.quantile(best, 0.99)
        m.limit = float(top + max(1.0, 2 * (top - mid)))
    return m


class Scorer:
    def __init__(self, model: Model):
        self.model, self.row, self.scores, self.used = model, {}, np.zeros((1 << 14, len(model.langs)), np.float32), 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row]
        if self.used + len(new) > CACHE:
            self.row.clear()
            self.used, new = 0, list(words)
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            got = self.model.score(part)
            while self.used + len(part) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[self.used : self.used + len(part)] = got
            self.row.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        split = [words_of(t) if t and has_letter(t) else None for t in texts]
        self.learn({w for s in split if s for w in s})
        out = []
        for s in split:
            if not s:
                out.append(("und", 0.0, None, False))
                continue
            rows = np.fromiter(map(self.row.__getitem__, s), np.int64, len(s))
            chars = sum(map(len, s)) + len(s)
            h = self.scores[rows].sum(axis=0, dtype=np.float64) / chars
            i = int(h.argmin())
            # odds against the other languages, for the evidence of at most 40 characters
            share = 1.0 / np.exp(np.clip(-(h - h[i]) * min(chars, 40), -60, 0)).sum()
            # a mean over few characters strays further
            excess = max(0.0, float(h[i]) - self.model.limit - SHORT / chars**0.5)
            out.append((self.model.langs[i], float(share * np.exp(-excess)), float(h[i]), excess == 0))
        return out


_scorers: dict[str, Scorer] = {}


def scorer(tag: str, model: Model) -> Scorer:
    """This worker's scorer for a fitted model; it lasts from task to task."""
    claim("langid", _scorers.clear)
    if tag not in _scorers:
        _scorers.clear()
        _scorers[tag] = Scorer(model)
    return _scorers[tag]


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and (lang_pred, score, entropy, accepted) of every whole text."""
    shared, tag = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by PER_LANG and MAX_LANGS

    def run(cols: dict) -> dict:
        m = shared.value
        got = scorer(tag, m)(cols["text"]) if m is not None else [("und", 0.0, None, False)] * len(cols["text"])
        lang, score, entropy, ok = zip(*got, strict=True) if got else ((), (), (), ())
        return {**{c: cols[c] for c in keep}, "lang_pred": lang, "score": score, "entropy": entropy, "accepted": ok}

    types = dict(docs.dtypes)
    cols = list(dict.fromkeys([*keep, "text"]))
    return map_texts(docs.select(*cols), run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", lang_pred string, score double, entropy double, accepted boolean")
