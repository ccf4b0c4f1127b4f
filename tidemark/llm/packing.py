"""Best-fit packing of token pieces into fixed-length sequences by minimum bin slack.

Only lengths decide how full a sequence gets, and there are at most ``capacity`` different ones. So the driver plans on
the histogram of piece lengths (one count per length, whatever the input's size): it anchors a bin on the longest
length left and finds by subset-sum dynamic programming over big-integer bitsets the fullest combination of the lengths
that are still available. The combination is removed as often as the counts allow, which makes as many equal bins in one step. The plan
is a short table of patterns; executors place each piece by its rank among the pieces of its length.

Ranks come from row numbers within (length, bucket of the document key) and sums of counts over buckets, so a length
that a third of the pieces share is spread over all buckets.

Cases: null or empty text is a document of the one closing token. A piece is never longer than ``capacity``; only
documents longer than that are cut. Rows that repeat a doc_id are documents of their own. No rows give no sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, claim, env_single_thread, map_texts, slices
from tidemark.llm.bpe import LATIN_END, byte_symbols, default_vocabulary, vocabulary

CAPACITY = 2048
#: Different pieces whose ids a worker keeps, and bytes of words it keeps beside; what is full is emptied.
KEYS, CACHE_BYTES = 1_000_000, 64 << 20
#: What an entry takes besides its characters and ids, and bytes up to which a piece is found by its hash.
ENTRY_BYTES, KEEP_CHARS = 170, 64
#: Bytes of text that are looked at together.
CHUNK = 2 << 20
#: Characters that are handed to the library at once, which takes some hundred bytes for a token until its ids are read.
LIBRARY_CHARS = 1 << 18
#: The id that closes a document.
CLOSE = b"\x00\x00\x00\x00"
#: A character beyond the Latin letters whose case and normal form are the same everywhere.
_BEYOND = re.compile(f"[^\x00-{chr(ord(LATIN_END) - 1)}]").search
#: Signs that are a word by themselves where they stand behind letters, at the end of a piece.
ENDS = ".,;:!?)]"
_SPACES = b" \t\n\x0b\x0c\r"
_SPACE = re.compile(b"[" + _SPACES + b"]").search


class Cache(dict):
    """A dictionary that is emptied once it takes more than so many bytes; long keys are not kept."""

    def __init__(self, most: int | None = None):
        self.most, self.bytes = CACHE_BYTES if most is None else most, 0

    def keep(self, found: dict[str, bytes]) -> None:
        if max(map(len, found), default=0) > KEEP_CHARS:
            found = {k: v for k, v in found.items() if len(k) <= KEEP_CHARS}
        self.update(found)
        self.bytes += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
        if self.bytes > self.most:
            self.clear()
            self.bytes = 0


class Tokens:
    """Token ids as little-endian bytes, by the tokenizers library, cached by space-free piece of text.

    The vocabulary drops white space before it looks for words, so a text's ids are those of its pieces in a row. Texts of Latin
    letters are looked at as arrays of bytes: pieces are found and hashed (64 bits) together, each different one is looked up once in a
    chunk, and ids are gathered from one array. A new piece is cut into words by the vocabulary's own pattern, and new words go to the
    library's merges as they are, past the normaliser, which has nothing to do there. Other texts go to the library whole.
    """

    def __init__(self, path: str):
        env_single_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(open(path, encoding="utf-8").read())
        cut = spec.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in cut.get("pretokenizers", ())]
        #: The pattern of words, if the vocabulary is of the kind that `Vocabulary` describes.
        self.words = vocabulary(path).words if spec["model"].get("end_of_word_suffix") and steps == ["Split", "ByteLevel"] and cut["pretokenizers"][0]["invert"] else None
        self.symbols = byte_symbols()
        self.known = Cache()
        g = np.random.default_rng(2048)
        self.byte = g.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = np.array([0, *(pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(KEEP_CHARS))], np.uint64)
        self.space = np.zeros(256, bool)
        self.space[list(_SPACES)] = True
        self.byte[self.space] = 0
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.n, self.store = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def library(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as the library finds them."""
        out: list[bytes] = []
        for a, b in slices(texts, LIBRARY_CHARS):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
        return out

    def spell(self, word: str) -> bytes:
        """Ids of a lower-case Latin word."""
        plain = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode()))
        return np.array([t.id for t in self.tokenizer.model.tokenize(plain)], "<u4").tobytes()

    def find(self, pieces: list[str]) -> list[bytes]:
        """Ids of lower-case Latin pieces."""
        known, new, out = self.known, {}, []
        for c in pieces:
            if c.isalpha():
                words = (c,)
            else:
                core = c.rstrip(ENDS)
                words = (core, c[len(core) :]) if core.isalpha() else self.words.findall(c)
            ids = b""
            for w in words:
                x = known.get(w) or new.get(w)
                if x is None:
                    x = new[w] = self.spell(w)
                ids += x
            out.append(ids)
        known.keep(new)
        return out

    def chunk(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte of each piece, end of each piece's ids) of lower-case Latin text."""
        b = np.frombuffer(data, np.uint8)
        space = self.space[b]
        here = np.arange(len(b), dtype=np.int32)
        place = here - np.maximum.accumulate(np.where(space, here, np.int32(-1)))  # from 1 in each piece, 0 between
        starts = np.flatnonzero(place == 1)
        stops = np.flatnonzero(~space & np.append(space[1:], True)) + 1
        if not len(starts):
            return np.empty(0, "<u4"), starts, starts
        size = stops - starts
        weighed = self.power[np.minimum(place, KEEP_CHARS, out=place)]
        weighed *= self.byte[b]
        h = np.add.reduceat(weighed, starts)
        del here, place, weighed
        for i in np.flatnonzero(size > KEEP_CHARS).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]])
        each, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > KEYS:
            self.forget()
        pos = np.searchsorted(self.keys, each)
        new = np.ones(len(each), bool)
        inside = pos < len(self.keys)
        new[inside] = self.keys[pos[inside]] != each[inside]
        if new.any():
            found = self.find([data[i:j].decode() for i, j in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)])
            n = np.fromiter(map(len, found), np.int64, len(found)) // 4
            at = len(self.store) + np.cumsum(n) - n
            self.store = np.concatenate([self.store, np.frombuffer(b"".join(found), "<u4")])
            self.keys, self.at, self.n = (np.insert(old, pos[new], more) for old, more in ((self.keys, each[new]), (self.at, at), (self.n, n)))
            pos = np.searchsorted(self.keys, each)
        n = self.n[pos][inverse]
        ends = np.cumsum(n)
        ids = self.store[np.repeat(self.at[pos][inverse] - ends + n, n) + np.arange(ends[-1])]
        return ids, starts, ends

    def join(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; lower case is taken ahead of the vocabulary's own, so that fewer pieces differ.

        Not beside what looks like a special token, and not outside Latin letters, where case depends on neighbours or marks.
        """
        out: list[bytes] = [b""] * len(texts)
        easy, other = [], []
        for i, t in enumerate(texts):
            if t:
                plain = self.words is not None and "<|" not in t and "\u0130" not in t and (t.isascii() or not _BEYOND(t))
                (easy if plain else other).append(i)
        for i, ids in zip(other, self.library([texts[i] for i in other]), strict=True):
            out[i] = ids
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            ids, starts, ends = self.chunk(b"\n".join([x for _, x in held]))
            cuts = np.cumsum([0, *(len(x) + 1 for _, x in held)])
            upto = np.concatenate([[0], ends])[np.searchsorted(starts, cuts)].tolist()
            for (i, _), a, b in zip(held, upto, upto[1:], strict=False):
                out[i] += ids[a:b].tobytes()

        for i in easy:
            data = texts[i].lower().encode()
            while data:
                # a longer text is cut at white space
                cut = len(data) if len(data) <= CHUNK else (m.start() if (m := _SPACE(data, CHUNK)) else len(data))
                held.append((i, data[:cut]))
                size += cut
                data = data[cut:]
                if size >= CHUNK:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return out


@lru_cache(maxsize=4)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the closing 0, cut at ``capacity``."""
    path = path or default_vocabulary()

    def run(cols: dict) -> dict:
        claim("packing", tokens.cache_clear)
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for d, b in zip(cols["doc_id"], tokens(path).join(cols["text"]), strict=True):
            b += CLOSE
            for j, a in enumerate(range(0, len(b), 4 * capacity)):
                part = b[a : a + 4 * capacity]
                out["doc_id"].append(d)
                out["piece"].append(j)
                out["start"].append(a // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                if with_ids:
                    out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
        return out

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return map_texts(docs.select("doc_id", "text"), run, schema + ", ids array<int>" * with_ids)


def _fullest(room: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """Multiplicities of lengths whose sum is as near to ``room`` as it can be; long ones first."""
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # (length, times, bits reachable before)
    bits = 1
    for n in lengths:
        if n > room or bits >> room & 1:
            continue
        left, times = min(counts[n], room // n), 1
        while left:
            times = min(times, left)
            steps.append((n, times, bits))
            bits |= (bits << (n * times)) & mask
            left -= times
            times *= 2
            if bits >> room & 1:
                break
    at, used = bits.bit_length() - 1, {}
    for n, times, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + times
            at -= n * times
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each length in a bin, number of such bins)], by minimum bin slack on the histogram."""
    counts = {int(n): int(c) for n, c in histogram.items() if c}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        anchor = lengths[0]
        counts[anchor] -= 1
        used = _fullest(capacity - anchor, counts, lengths)
        counts[anchor] += 1
        used[anchor] = used.get(anchor, 0) + 1
        times = min(counts[n] // m for n, m in used.items())
        for n, m in used.items():
            counts[n] -= m * times
        out.append((used, times))
        lengths = [n for n in lengths if counts[n]]
    return out


def place(found: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Add (sequence_id, offset) to a saved table of pieces."""
    total = found.count()
    buckets = max(1, min(1 << 20, total // 20_000))
    dealt = found.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = scratch.save(dealt.groupBy("length", "_b").agg(F.count("*").alias("n")), "sizes")
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("_r", rank - 1).join(starts, ["length", "_b"]).withColumn("_rank", F.col("_r") + F.col("_before"))

    # for each length, in the order of ranks: first rank, pieces per bin, first bin, offset in the bin
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    bins = 0
    for used, times in plan(histogram, capacity):
        at = 0
        for n, m in sorted(used.items(), reverse=True):
            table.setdefault(n, []).append((taken.get(n, 0), m, bins, at))
            taken[n] = taken.get(n, 0) + m * times
            at += n * m
        bins += times
    lookup = {n: np.array(rows, np.int64) for n, rows in table.items()}
    names = [c for c in found.columns]

    def assign(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                n = int(length[part[0]])
                rows = lookup[n]
                row = rows[np.searchsorted(rows[:, 0], rank[part], side="right") - 1]
                k = rank[part] - row[:, 0]
                seq[part] = row[:, 2] + k // row[:, 1]
                off[part] = row[:, 3] + k % row[:, 1] * n
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(assign, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    return place(scratch.save(pieces(docs, path, capacity), "pieces"), scratch, capacity)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """(sequence_id, ids): the packed token sequences themselves, for a training job to read.

    Pieces carry their ids to their places, so rows that repeat a doc_id or a text, and null ids, are each in one sequence once.
    """
    scratch = scratch or Scratch(docs.sparkSession, "sequences")
    placed = place(scratch.save(pieces(docs, path, capacity, with_ids=True), "pieces"), scratch, capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
