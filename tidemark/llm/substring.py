"""Substring dedup through a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of a document. Its fingerprint in the index is its anchor: the smallest hash of
the ``GRAM``-word runs inside it, which neighbouring windows mostly share, so that a document has about one anchor for
six words. Equal windows have equal anchors wherever they stand.

The index is three sets of immutable runs, tables bucketed and sorted by hash: the anchors of all texts with the first text that holds each,
the anchors met more than once, and the windows that have such an anchor. A batch of documents becomes one run of its different anchors, which are
counted before they are dealt out, so that a common one is one row per task; it is merge-joined with the runs before it, bucket by bucket. An anchor that is met again for the first time is in one earlier text at most; that text's windows with
it are fetched, and from then on the anchor's windows are in the index, so no earlier text is fetched twice for one anchor. The
batch's windows with repeated anchors are verified: hashed with 128 bits over all their words, merge-joined with the
windows of the index, and the earliest of equal ones stays. Once a level has ``fanout`` runs they are compacted into one of the next level.

Windows that a task itself sees again are settled there, so that a passage of a third of all texts reaches the shuffle
once per slice and not once per text. Texts that are wholly equal count once and their copies go without windows.

Earlier means added to the index before; in one call of `dedup` a smaller doc_id, or the same document and an earlier start. Cases: null
text has no words; a text shorter than a window keeps all words; rows that repeat a doc_id with different texts are ordered by text
hash; equal rows count as one document and get equal results; null ids come first. Windows may overlap themselves. No rows give no rows. Other
columns pass through `dedup`, whatever their names; n_words and n_removed replace columns of those names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import KEY_BITS, Scratch, arrow_schema, bound_batches, claim, map_texts, pick, shield, slices, with_key
from tidemark.sources.shared import short_plans

WINDOW = 20
GRAM = 10
FANOUT = 2
#: Batches that `dedup` puts a table into the index by; one more than a level holds, so that runs are compacted.
BATCHES = 3
_TOKENS = re.compile(rb"[^ \t-\r]+[ \t-\r]*")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: Words whose hashes a worker keeps, for each seed.
CACHE = 200_000


class WordHashes(dict):
    """64-bit hashes of words, found once per worker; emptied when it has grown too large."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w, self.seed)
        if len(self) > CACHE:
            self.clear()
        self[w] = h
        return h


_hashes = {0: WordHashes(0), 1: WordHashes(1)}


def _forget_hashes() -> None:
    for h in _hashes.values():
        h.clear()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(_hashes[seed].__getitem__, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs_of(h: np.ndarray, k: int, by: np.uint64 = _A) -> np.ndarray:
    """Hashes of all runs of k neighbours."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, size = h.copy(), 1
    # runs double in length; the rest is added from their binary digits
    total, done = None, 0
    while True:
        if k & size:
            part = out[done : done + n]
            total = part.copy() if total is None else total * power_of(by, size) + part
            done += size
        size *= 2
        if size > k:
            break
        out = out[: -(size // 2)] * power_of(by, size // 2) + out[size // 2 :]
    return _mix(total)


def power_of(by: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(by), n, 1 << 64))


def window_anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, hashes of all grams)."""
    g = runs_of(h, gram)
    width = window - gram + 1
    m, have = g, 1
    while have < width and len(m):
        by = min(have, width - have)
        m = np.minimum(m[:-by], m[by:]) if len(m) > by else m[:0]
        have += by
    return m, g


class Runs:
    """Immutable tables bucketed and sorted by their key, by level; a full level becomes one run of the next."""

    def __init__(self, scratch: Scratch, key: tuple[str, ...], buckets: int, fanout: int):
        self.scratch, self.spark, self.key, self.buckets, self.fanout = scratch, scratch.spark, key, buckets, fanout
        self.levels: list[list[str]] = [[]]

    def write(self, rows: DataFrame) -> str:
        """Save rows, which an aggregate or a repartition by the key has dealt out; in any other deal a bucket has more files."""
        name = f"tidemark_run_{uuid.uuid4().hex}"
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            rows = rows.repartition(self.buckets, *self.key)
        out = rows.write.bucketBy(self.buckets, *self.key).sortBy(*self.key)
        with short_plans(self.spark):
            out.option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def append(self, name: str, merge=lambda df: df) -> None:
        """Take a written run, then compact full levels; ``merge`` reduces what was put together."""
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.write(merge(_union([self.spark.table(x) for x in self.levels[level]]))))
            self.forget(self.levels[level])
            self.levels[level] = []
            level += 1

    def forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.scratch.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.forget([n for level in self.levels for n in level])
        self.levels = [[]]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class FingerprintIndex:
    """What all texts added so far say about a new batch of texts; it lasts as long as its scratch folder and the added tables."""

    def __init__(self, scratch: Scratch, buckets: int | None = None, fanout: int = FANOUT, window: int = WINDOW, gram: int = GRAM):
        self.scratch, self.spark, self.window, self.gram = scratch, scratch.spark, window, gram
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.anchors = Runs(scratch, ("anchor",), buckets, fanout)
        self.repeated = Runs(scratch, ("anchor",), buckets, fanout)
        self.windows = Runs(scratch, ("h1", "h2"), buckets, fanout)
        self.sources: list[DataFrame] = []

    def source(self, keyed: DataFrame) -> DataFrame:
        """Say where texts that will be added can be read again; their keys get numbers of their own in the index."""
        base = len(self.sources) << KEY_BITS
        df = keyed.withColumn("_k", F.col("_k") + base)
        self.sources.append(df.select("_k", "text"))
        return df

    def _anchors(self, docs: DataFrame) -> DataFrame:
        """(anchor, kt) of each text: kt is twice its key, plus one if the anchor stands in it more than once."""
        window, gram = self.window, self.gram

        def run(cols: dict) -> dict:
            claim("substring", _forget_hashes)
            a, kt = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for text, k in zip(cols["text"], cols["_k"], strict=True):
                words = text.encode().split() if text else []
                if len(words) < window:
                    continue
                m, g = window_anchors(word_hashes(words), window, gram)
                found = np.unique(m)
                s = np.sort(g)
                again = s[1:][s[1:] == s[:-1]]
                a.append(found)
                kt.append(2 * k + (np.isin(found, again).astype(np.int64) if len(again) else np.zeros(len(found), np.int64)))
            return {"anchor": np.concatenate(a).view(np.int64), "kt": np.concatenate(kt)}

        return map_texts(docs.select("_k", "text"), run, "anchor long, kt long")

    def add(self, batch: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """Append a batch (_k, text) of a `source` as one run; returns (_k, spans): the word ranges covered by windows that were there before or stand earlier in the batch.

        ``texts`` may name a cheaper plan of a table that holds the batch's texts, if ``batch`` was filtered by joins.
        """
        scratch = self.scratch
        every = scratch.save(self._anchors(batch), "anchors")
        k = F.shiftright("kt", 1)
        again = (F.min(k) != F.max(k)) | (F.max(F.col("kt") % 2) == 1)
        run = self.anchors.write(every.groupBy("anchor").agg(F.min(k).alias("k"), again.alias("again")))
        mine = self.spark.table(run)
        unknown = mine
        for known in self.repeated.tables():
            unknown = unknown.join(known.hint("merge"), "anchor", "left_anti")
        # an anchor that was not repeated before is in one earlier text at most
        earlier = [r.select("anchor", "k").join(unknown.select("anchor").hint("merge"), "anchor") for r in self.anchors.tables()]
        before = scratch.save(_union([*earlier, mine.select("anchor", "k").limit(0)]), "before")
        fresh = unknown.where("again").select("anchor").unionByName(before.select("anchor")).distinct()
        self.repeated.append(self.repeated.write(fresh))
        # no anchor is in two of these runs
        hit = scratch.save(_union([mine.select("anchor").join(r.hint("merge"), "anchor", "left_semi") for r in self.repeated.tables()]), "hit")
        some, _ = pick(every, hit, "anchor")
        by_text = lambda rows: rows.groupBy("_k").agg(F.collect_set("anchor").alias("anchors"))
        hits = scratch.save(by_text(some.join(hit.hint("merge"), "anchor").select("anchor", k.alias("_k"))), "hits")
        old = scratch.save(by_text(before.withColumnRenamed("k", "_k")), "old")
        scratch.drop(every, before, hit)
        first_text = (F.min("k").alias("k"), F.max("again").alias("again"))
        self.anchors.append(run, lambda df: df.groupBy("anchor").agg(*first_text))

        found = scratch.save(self._verified(batch if texts is None else texts, hits, 1).unionByName(self._verified(_union(self.sources), old, 0)), "windows")
        scratch.drop(hits, old)
        told = self.windows.write(found.where("stop is null").select("h1", "h2", "o", "_k", "start").repartition(self.windows.buckets, "h1", "h2"))
        rows = self.spark.table(told)
        earliest = Window.partitionBy("h1", "h2").orderBy("o", "_k", "start")
        again = [rows.withColumn("_r", F.rank().over(earliest)).where("_r > 1").drop("_r")]
        again += [rows.join(w.select("h1", "h2").distinct().hint("merge"), ["h1", "h2"], "left_semi") for w in self.windows.tables()]
        later = _union(again).where("o = 1").select("_k", "start", (F.col("start") + self.window).alias("stop"))
        spans = later.unionByName(found.where("stop is not null AND o = 1").select("_k", "start", "stop"))
        out = scratch.save(spans.groupBy("_k").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
        scratch.drop(found)
        first = F.min(F.struct("o", "_k", "start")).alias("f")
        self.windows.append(told, lambda df: df.groupBy("h1", "h2").agg(first).select("h1", "h2", "f.*"))
        return out

    def _verified(self, docs: DataFrame, hits: DataFrame, o: int) -> DataFrame:
        """(h1, h2, o, _k, start, stop): the windows with a hit anchor; those a task itself has seen before are put together as spans, without hashes."""
        window, gram = self.window, self.gram
        schema = "h1 long, h2 long, o int, _k long, start int, stop int"
        out_schema = arrow_schema(schema)

        def batch_of(h1, h2, k, start, stop) -> pa.RecordBatch:
            n = len(k)
            cols = [pa.nulls(n, pa.int64()) if h is None else pa.array(h.view(np.int64)) for h in (h1, h2)]
            cols += [pa.array(np.full(n, o, np.int32)), pa.array(k), pa.array(start.astype(np.int32)), pa.nulls(n, pa.int32()) if stop is None else pa.array(stop.astype(np.int32))]
            return pa.RecordBatch.from_arrays(cols, schema=out_schema)

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("substring", _forget_hashes)
            for batch in batches:
                rows = sorted(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), key=lambda r: r[0])
                for a, b in slices([r[1] for r in rows]):
                    got: list[list[np.ndarray]] = [[], [], [], []]
                    for k, text, anchors in rows[a:b]:
                        words = text.encode().split()
                        h = word_hashes(words)
                        m, _ = window_anchors(h, window, gram)
                        at = np.flatnonzero(np.isin(m, np.array(anchors, np.int64).view(np.uint64)))
                        if not len(at):
                            continue
                        for col, v in zip(got, (runs_of(h, window)[at], runs_of(word_hashes(words, 1), window, _B)[at], np.full(len(at), k, np.int64), at), strict=True):
                            col.append(v)
                    if not got[0]:
                        continue
                    h1, h2, k, at = map(np.concatenate, got)
                    got.clear()
                    _, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
                    f = first[inverse]
                    later = (h2 == h2[f]) & ((k != k[f]) | (at != at[f]))
                    rest = ~later
                    yield batch_of(h1[rest], h2[rest], k[rest], at[rest], None)
                    if o and later.any():
                        # neighbouring later windows are one span
                        lk, la = k[later], at[later]
                        cut = np.flatnonzero((lk[1:] != lk[:-1]) | (la[1:] != la[:-1] + 1)) + 1
                        starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(lk)]]) - 1
                        yield batch_of(None, None, lk[starts], la[starts], la[stops] + window)

        bound_batches(self.spark)
        chosen, _ = pick(docs.select("_k", "text"), hits)
        return chosen.join(hits.hint("merge"), "_k").dropDuplicates(["_k"]).select("_k", "text", "anchors").mapInArrow(verify, schema)

    def close(self) -> None:
        """Delete the index."""
        for runs in (self.anchors, self.repeated, self.windows):
            runs.close()
        self.sources = []


def _kept(n: int, spans: list | None, whole: bool, window: int) -> np.ndarray | None:
    """Mask of words that stay, None if all do."""
    if whole and n >= window:
        return np.zeros(n, bool)
    if not spans:
        return None
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["stop"] for s in spans], -1)
    return np.cumsum(edge[:-1]) == 0


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, digest: bool = False, scratch: Scratch | None = None, index: FingerprintIndex | None = None) -> DataFrame:
    """``docs`` without the words of later windows, plus n_words and n_removed.

    Words that stay keep the white space behind them; texts that lose nothing are returned as they are. With ``digest``: (doc_id, n_words,
    n_removed, kept_sha256). With an ``index`` all texts added to it before count as earlier, and it keeps these for the next call; its
    window and gram hold then.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    kept = index is not None
    index = index or FingerprintIndex(scratch, window=window, gram=gram)
    window = index.window
    hidden, restore = shield(docs)
    keyed = index.source(with_key(hidden, index.scratch))
    # wholly equal texts: the first stands for all
    ids = scratch.save(keyed.where("text is not null").select("_k", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u")).distinct(), "ids")
    groups = ids.groupBy("t", "u").agg(F.min("_k").alias("first"), F.count("*").alias("n"))
    copies = scratch.save(ids.join(groups.where("n > 1").drop("n").hint("merge"), ["t", "u"]).where("_k <> first").select("_k"), "copies")
    cuts = ids.select(F.percentile_approx("_k", [i / batches for i in range(1, batches)], 10_000)).first()[0] or [] if batches > 1 else []
    scratch.drop(ids)
    bounds = [None, *sorted(set(cuts)), None]
    found = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = keyed.select("_k", "text").where("text is not null")
        part = part.where(F.col("_k") > lo) if lo is not None else part
        part = part.where(F.col("_k") <= hi) if hi is not None else part
        maybe, single = pick(part, copies)
        found.append(index.add(single.unionByName(maybe.join(copies.hint("merge"), "_k", "left_anti")), part))
    if not kept:
        index.close()
    changed = scratch.save(
        _union(found).select("_k", "spans", F.lit(False).alias("whole")).unionByName(
            copies.select("_k", F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans"), F.lit(True).alias("whole"))
        ), "changed"
    )
    scratch.drop(copies)
    if not kept:
        scratch.drop(*found)
    types = dict(hidden.dtypes)
    others = [c for c in hidden.columns if c != "text"] if not digest else ["doc_id"]

    def run(cols: dict) -> dict:
        claim("kept", int)  # needs no hashes any more
        n, gone, out = [], [], []
        for text, spans, whole in zip(cols["text"], cols["_spans"], cols["_whole"], strict=True):
            words = text.encode().split() if text else []
            kept = _kept(len(words), spans, bool(whole), window)
            n.append(len(words))
            gone.append(0 if kept is None else int((~kept).sum()))
            if digest:
                left = words if kept is None else [w for w, k in zip(words, kept, strict=True) if k]
                out.append(hashlib.sha256(b" ".join(left)).hexdigest())
            elif not gone[-1]:
                out.append(text)
            else:
                raw = text.encode()
                head = raw[: len(raw) - len(raw.lstrip(b" \t\n\x0b\x0c\r"))]
                out.append((head + b"".join(w for w, k in zip(_TOKENS.findall(raw), kept, strict=True) if k)).decode())
        res = {c: cols[c] for c in others} | {"n_words": n, "n_removed": gone}
        return res | ({"kept_sha256": out} if digest else {"text": out})

    touched, rest = pick(keyed, changed)
    touched = touched.join(changed.hint("merge"), "_k", "left").select(*others, "text", F.col("spans").alias("_spans"), F.col("whole").alias("_whole"))
    none = F.lit(None)
    touched = touched.unionByName(rest.select(*others, "text", none.cast("array<struct<start:int,stop:int>>").alias("_spans"), none.cast("boolean").alias("_whole")))
    schema = ", ".join(f"`{c}` {types[c]}" for c in others) + ", n_words long, n_removed long, " + ("kept_sha256 string" if digest else "text string")
    out = map_texts(touched, run, schema)
    return out if digest else restore(out, "n_words", "n_removed")
