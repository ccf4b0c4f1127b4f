"""BPE encoding and decoding with a pair occurrence index.

The vocabulary file describes a lower-casing word-level BPE: Unicode NFC, white space removed, words split into letters,
single digits and other runs, bytes mapped to printable characters, merges inside a word, a suffix on its last symbol.
Of a slice of texts the distinct words that are not cached yet are laid out as one symbol array. An index maps each
adjacent pair to all positions at which it occurs; active ranks are applied in ascending order, every application
updating the lists of the neighbouring pairs. Words never depend on each other, so this equals merging each alone.

Cases: null text is empty text; it has no ids and decodes to the empty string. A text that holds the string of a special
token gets that token's id there, as the library does. White-space-only text has no ids. Texts of any length are cut at
white space, where no token can lie across, and encoded whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import claim, map_texts

#: Entries of a worker's caches, each; a full cache is emptied.
CACHE = 600_000
#: Below this, letters and numbers are the same in all Unicode versions in use.
LATIN_END = "\u0250"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character for each byte: itself if printable Latin-1, else from U+0100 on."""
    keep = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in keep else chr(extra))
        extra += b not in keep
    return out


def lower(s: str) -> str:
    """Lower case one character at a time, so that no rule looks at its neighbours (final sigma)."""
    return "".join(map(str.lower, s)) if "Σ" in s else s.lower()


#: What str.split() splits at besides ASCII white space.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_space(text: str) -> list[str]:
    """Pieces between ASCII white space; other white space stays inside a piece."""
    return [x.decode() for x in text.encode().split()] if _OTHER_SPACE.search(text) else text.split()


class Vocabulary:
    def __init__(self, path: str):
        self.path, self._tokenizer = path, None
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        of = self.ids
        self.rank = {(of[a], of[b]): (r, of[a + b]) for r, (a, b) in enumerate(merges)}
        self.pair = list(self.rank)
        symbols = byte_symbols()
        self.first = [of[c] for c in symbols]
        self.last = [of[c + self.suffix] for c in symbols]

    def normal(self, text: str) -> str:
        return lower(unicodedata.normalize("NFC", text))

    def pretokens(self, text: str) -> list[str]:
        if text.isascii() or max(text) < LATIN_END:
            return self.words.findall(self.normal(text))
        # the library's Unicode tables and those of this Python can be of different versions
        t = self.tokenizer()
        found = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in found]

    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def encode_words(self, words: Iterable[str]) -> list[list[int]]:
        """Token ids of each word, through one pair occurrence index over all of them."""
        first, last, rank = self.first, self.last, self.rank
        sym: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(sym))
            b = w.encode()
            sym += [first[x] for x in b[:-1]]
            sym.append(last[b[-1]])
            sym.append(-1)  # ends the word: no pair reaches across
        n = len(sym)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        target: dict[int, int] = {}
        get = rank.get
        for i in range(n - 1):
            got = get((sym[i], sym[i + 1]))
            if got:
                if got[0] in where:
                    where[got[0]].append(i)
                else:
                    where[got[0]] = [i]
                    target[got[0]] = got[1]
        active = list(where)
        heapq.heapify(active)
        pair = self.pair
        while active:
            r = heapq.heappop(active)
            a, b = pair[r]
            new = target[r]
            places = where.pop(r)
            places.sort()
            for i in places:
                if sym[i] != a:
                    continue
                j = nxt[i]
                if sym[j] != b:
                    continue
                k = nxt[j]
                sym[i] = new
                sym[j] = -2  # gone
                nxt[i] = k
                prv[k] = i
                if sym[k] >= 0 and (got := get((new, sym[k]))):
                    q = got[0]
                    if q in where:
                        where[q].append(i)
                    else:
                        where[q] = [i]
                        target[q] = got[1]
                        heapq.heappush(active, q)
                h = prv[i]
                if h >= 0 and sym[h] >= 0 and (got := get((sym[h], new))):
                    q = got[0]
                    if q in where:
                        where[q].append(h)
                    else:
                        where[q] = [h]
                        target[q] = got[1]
                        heapq.heappush(active, q)
        out = []
        for s in starts:
            ids = []
            while sym[s] >= 0:
                ids.append(sym[s])
                s = nxt[s]
            out.append(ids)
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes slices of texts; ``chunks`` maps a space-free piece of text to (ids as text, tokens as text, count)."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.known: dict[str, list[int]] = {}
        self.id_text: dict[str, bytes] = {}
        self.token_text: dict[str, bytes] = {}

    def parts(self, chunk: str) -> list[str | int]:
        """Words of a piece of text, and ids of the special tokens in it."""
        v, out, at = self.vocab, [], 0
        if "<|" in chunk:
            for m in v.special_at.finditer(chunk):
                out += v.pretokens(chunk[at : m.start()])
                out.append(v.special[m[0]])
                at = m.end()
        return out + v.pretokens(chunk[at:])

    def learn(self, chunks: Iterable[str]) -> None:
        """Fill the caches for these pieces."""
        chunks = set(chunks)
        new = [c for c in chunks if c not in self.id_text]
        if len(self.id_text) + len(new) > CACHE:
            self.id_text.clear()
            self.token_text.clear()
            new = list(chunks)
        if len(self.known) > CACHE:
            self.known.clear()
        parts = [self.parts(c) for c in new]
        words = list({w for p in parts for w in p if isinstance(w, str) and w not in self.known})
        self.known.update(zip(words, self.vocab.encode_words(words), strict=True))
        known, tokens = self.known, self.vocab.tokens
        for c, p in zip(new, parts, strict=True):
            ids = [i for w in p for i in (known[w] if isinstance(w, str) else (w,))]
            self.id_text[c] = " ".join(map(str, ids)).encode()
            self.token_text[c] = " ".join(map(tokens.__getitem__, ids)).encode()

    def join(self, texts: list[str | None]) -> Iterable[tuple[bytes, bytes]]:
        """(decimal ids, tokens) of each text, joined by single spaces."""
        split = [split_space(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        for s in split:
            a = b" ".join(filter(None, map(self.id_text.__getitem__, s)))
            yield a, b" ".join(filter(None, map(self.token_text.__getitem__, s)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process: its caches last from task to task."""
    return Encoder(path)


def decode(ids: Iterable[int], path: str | None = None) -> str:
    """Tokens joined by a space, special tokens kept: what the file, which names no decoder, prescribes."""
    return " ".join(map(vocabulary(path or default_vocabulary()).tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""
    path = path or default_vocabulary()

    def run(cols: dict) -> dict:
        claim("bpe", encoder.cache_clear)
        ids = [list(map(int, a.split())) for a, _ in encoder(path).join(cols["text"])]
        return {"doc_id": cols["doc_id"], "ids": ids}

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of their decoding."""
    path = path or default_vocabulary()

    def run(cols: dict) -> dict:
        claim("bpe", encoder.cache_clear)
        n, ids, out = [], [], []
        for a, b in encoder(path).join(cols["text"]):
            n.append(a.count(b" ") + 1 if a else 0)
            ids.append(hashlib.sha256(a).hexdigest())
            out.append(hashlib.sha256(b).hexdigest())
        return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": out}

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs.select("doc_id", "text"), run, schema)
