"""SimHash near-duplicates linked through vantage-point trees.

Fingerprints are 64-bit SimHashes of word shingles. Two of them link if they differ in at most ``radius`` bits. A
fingerprint is cut into ``blocks`` bit fields: of two linked fingerprints at least one field differs in at most
``radius // blocks`` bits. Every field has a vantage-point tree, built on the driver from a bounded sample of distinct
fingerprints. A tree deals all fingerprints to leaf shards by Hamming distance to its vantage points; the triangle
inequality says which other shards a fingerprint's ball overlaps, and it is sent there too. Within a shard all pairs
with a member of that shard are compared in full, so that no link is lost whatever the sample.

* Work on one field bounds the ball to a radius of 1 for the default (4 bits, 3 fields), where few balls cross a
  boundary; on all 64 bits most would.
* Equal fingerprints are one node, so a group of equal texts of any size costs one row here.
* A shard with many members is split by salt, and every pair of salts is a task of its own.
* A shard returns a star per connected group, never its pairs.

Cases: null or empty text, and text without a word, has fingerprint 0 and links like any other. A null doc_id is
kept, and never names a component unless no other member has an id. Rows that repeat a doc_id are kept each.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, claim, map_texts, pick, shield, with_key
from tidemark.llm.components import components

SEED = 42
#: Most fingerprints in the driver's sample, for the trees alone.
SAMPLE = 1 << 16
#: Members of a leaf shard that are compared in one task.
LEAF = 2048
SALT = 8192


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 8192):
        bits = np.unpackbits(h[a : a + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, k: int = 4, seed: int = SEED) -> int:
    """SimHash of the lower-cased k-word shingles, repeats counted; 0 without words."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    if n < k:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[j:] for j in range(k)), strict=False))
        n = n - k + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n if len(words) >= k else 1))


def fingerprints(docs: DataFrame, k: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, fp long): the fingerprint of each row, as a signed long."""

    def run(cols: dict) -> dict:
        fps = np.array([fingerprint(t, k) for t in cols["text"]], np.uint64).view(np.int64)
        return {**{c: cols[c] for c in keep}, "fp": fps}

    types = dict(docs.dtypes)
    return map_texts(docs.select(*keep, "text"), run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", fp long")


#: A bit field: number of the 64-bit word, shift, width.
Field = tuple[int, int, int]


def fields(blocks: int, words: int = 1) -> list[Field]:
    """All bits of ``words`` fingerprint words, each cut into ``blocks`` fields."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(cuts, cuts[1:], strict=False)]


def field(words: list[np.ndarray], at: Field) -> np.ndarray:
    word, shift, width = at
    return (words[word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)


class VantageTree:
    """A vantage-point tree over bit strings; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int):
        self.radius, self.nodes, self.leaves = radius, [], 0
        self._build(sample, max(1, leaves))

    def _build(self, points: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if leaves > 1 and len(points) >= 4:
            for v in points[:8]:
                d = np.bitwise_count(points ^ v).astype(np.int64)
                m = int(np.median(d)) if d.any() else 0
                m = m - 1 if (d <= m).all() else m
                if 0 < (d <= m).sum() < len(points):
                    near = d <= m
                    # the larger side gets the more leaves
                    n = min(leaves - 1, max(1, round(leaves * near.mean())))
                    left = self._build(points[near], n)
                    right = self._build(points[~near], leaves - n)
                    self.nodes[at] = (v, m, left, right)
                    return at
        self.nodes[at] = self.leaves
        self.leaves += 1
        return at

    def visit(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, positions, whether it is their home) for every leaf that the ball of a value overlaps."""
        n = len(values)
        stack = [(0, np.arange(n), np.ones(n, bool))]
        while stack:
            at, idx, home = stack.pop()
            if not len(idx):
                continue
            node = self.nodes[at]
            if not isinstance(node, tuple):
                yield node, idx, home
                continue
            v, m, left, right = node
            d = np.bitwise_count(values[idx] ^ v).astype(np.int64)
            a, b = d <= m + self.radius, d > m - self.radius
            stack.append((left, idx[a], (home & (d <= m))[a]))
            stack.append((right, idx[b], (home & (d > m))[b]))


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Labels of the components of n nodes under the pairs a, b: the smallest member."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (before == label).all():
            break
    return label


def shard_stars(fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links that have a member of this shard at one end at least."""
    order = np.argsort(~home, kind="stable")
    fps, members = fps[order], int(home.sum())
    n = len(fps)
    label = np.arange(n)
    step = max(1, 2_000_000 // max(1, members))
    for a in range(0, n, step):
        d = np.bitwise_count(fps[a : a + step, None] ^ fps[None, :members])
        x, y = np.nonzero(d <= radius)
        x = x + a
        x, y = x[x > y], y[x > y]
        if len(x):
            differs = label[x] != label[y]
            label = _roots(n, x[differs], y[differs], label)
    linked = label != np.arange(n)
    return fps[linked], fps[label[linked]]


def deal(distinct: DataFrame, words: list[str], cuts: list[Field], radius: int, leaf: int = LEAF, salt: int = SALT, sample: int = SAMPLE) -> DataFrame:
    """(tree, leaf, salt, home, words): every fingerprint in its home shard of each field's tree and in those its ball of ``radius`` bits overlaps."""
    total = distinct.count()
    taken = distinct.orderBy(F.xxhash64(words[0]), words[0]).limit(min(sample, max(64, total // leaf * 16))).select(*words).toPandas()
    points = [taken[w].to_numpy(np.int64).view(np.uint64) for w in words]
    mixed = np.random.default_rng(SEED)
    trees = [VantageTree(mixed.permutation(field(points, c)), max(1, total // leaf), radius) for c in cuts]

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(len(words))]

    def homes(batches):
        for batch in batches:
            fps = read(batch)
            for t, (tree, cut) in enumerate(zip(trees, cuts, strict=True)):
                for at, _, home in tree.visit(field(fps, cut)):
                    if home.any():
                        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([at], pa.int32()), pa.array([int(home.sum())], pa.int64())], ["tree", "leaf", "n"])

    # one row for each leaf: at most a quarter of the sample for each tree
    sizes = {(r[0], r[1]): r[2] for r in distinct.select(*words).mapInArrow(homes, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n")).collect()}
    salts = {k: -(-v // salt) for k, v in sizes.items() if v > salt}

    def send(batches):
        for batch in batches:
            fps = read(batch)
            for t, (tree, cut) in enumerate(zip(trees, cuts, strict=True)):
                found = list(tree.visit(field(fps, cut)))
                own = np.zeros(len(fps[0]), np.int64)
                for at, idx, home in found:
                    own[idx[home]] = at
                for at, idx, home in found:
                    # a pair of two shards is compared in the one with the higher number
                    need = home | (own[idx] < at)
                    idx, home = idx[need], home[need]
                    s = salts.get((t, at), 1)
                    mine = (fps[0][idx] % np.uint64(s)).astype(np.int32)
                    n = len(idx)
                    for j in range(s if n else 0):
                        # a split shard is compared by pairs of salts: a task holds the rows of two, whatever the shard's size
                        both = np.minimum(mine, j) * np.int32(s) + np.maximum(mine, j)
                        keys = [pa.array(np.full(n, v, np.int32)) for v in (t, at)]
                        yield pa.RecordBatch.from_arrays([*keys, pa.array(both), pa.array(home), *[pa.array(w[idx].view(np.int64)) for w in fps]], ["tree", "leaf", "salt", "home", *words])

    return distinct.select(*words).mapInArrow(send, "tree int, leaf int, salt int, home boolean, " + ", ".join(f"{w} long" for w in words))


def links(distinct: DataFrame, radius: int = 4, blocks: int = 3, leaf: int = LEAF, salt: int = SALT) -> DataFrame:
    """(u, v): edges between distinct fingerprints that span every group linked within ``radius`` bits."""

    def compare(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        u, v = shard_stars(fps, table.column("home").to_numpy(zero_copy_only=False), radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = deal(distinct, ["fp"], fields(blocks), radius // blocks, leaf, salt)
    return dealt.groupBy("tree", "leaf", "salt").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, blocks: int = 3, leaf: int = LEAF, salt: int = SALT, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id linked to the row through any chain."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, k), "fingerprints")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(distinct, radius, blocks, leaf, salt), scratch)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    groups = scratch.save(named.join(least, "root").select("fp", "component_id"), "groups")
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


def with_hex(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0"))


# near copies by similarity of the texts themselves

#: Bits of 128 in which a pair may differ to be compared by its shingles: texts at a Jaccard index of 0.8 differ in 20 on average, with a deviation of 4.
LOOSE = 34
LOOSE_WORD = 20
#: Bytes of shingles, and of what each text takes besides, in a block of a large cluster.
BLOCK = 16 << 20
TEXT_BYTES = 1024


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles, lower-cased."""
    words = (text or "").encode().lower().split()
    grams = map(b" ".join, zip(*(words[j:] for j in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes of hashes, by the finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cell(fp: np.ndarray, fp2: np.ndarray) -> np.ndarray:
    """One number for both words of a fingerprint; where two fingerprints share it, their texts are compared."""
    return (fp * np.uint64(0x9E3779B97F4A7C15)) ^ fp2


def keys(texts: list, k: int) -> dict[str, np.ndarray]:
    """For each text a hash of its set of shingles, two SimHashes of the set, and their cell."""
    sets = [shingles(t, k) for t in texts]
    fp, fp2 = (np.array([majority(g) for g in x], np.uint64) for x in (sets, map(mixed, sets)))
    node = np.array([xxhash.xxh64_intdigest(g.tobytes(), SEED) for g in sets], np.uint64)
    return {c: x.view(np.int64) for c, x in (("node", node), ("cell", cell(fp, fp2)), ("fp", fp), ("fp2", fp2))}


def shard_close(words: list[np.ndarray], home: np.ndarray, most: int, most_word: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): stars that span what is within ``most`` bits of all words in a shard, ``most_word`` in the first."""
    order = np.argsort(~home, kind="stable")
    words, members, n = [w[order] for w in words], int(home.sum()), len(home)
    label = np.arange(n)
    step = max(1, 1_000_000 // max(1, members))
    for start in range(0, n, step):
        x, y = np.nonzero(np.bitwise_count(words[0][start : start + step, None] ^ words[0][None, :members]) <= most_word)
        x = x + start
        x, y = x[x > y], y[x > y]
        near = (sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in words) <= most) & (label[x] != label[y])
        if near.any():
            label = _roots(n, x[near], y[near], label)
    linked = np.flatnonzero(label != np.arange(n))
    return order[linked], order[label[linked]]


def stars(at: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): the groups that the pairs i, j of places in ``at`` link, as stars around the smallest value of each.

    Tasks that meet the same group then tell the same links, which count once.
    """
    values, node = np.unique(at, return_inverse=True)
    root = _roots(len(values), node[i], node[j])
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def linked_sets(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): links that span the groups of sets with a Jaccard index of at least ``least``.

    Each set that a search reaches is compared with all sets not reached yet, by counts over the holders of its members.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(member, kind="stable")
    holders = np.repeat(np.arange(n), sizes)[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(member))])
    left, indexed = np.ones(n, bool), n
    u: list[int] = []
    v: list[int] = []
    for first in range(n):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo:
            remain = int(left.sum())
            if not remain:
                return np.array(u, np.int64), np.array(v, np.int64)
            if remain * 2 < indexed:
                keep = left[holders]
                ends, holders, indexed = np.concatenate([[0], np.cumsum(keep)])[ends], holders[keep], remain
            i = todo.pop()
            own = member[starts[i] : starts[i + 1]]
            counts = ends[own + 1] - ends[own]
            places = np.arange(counts.sum()) + np.repeat(ends[own] - np.cumsum(counts) + counts, counts)
            both = np.bincount(holders[places], minlength=n)
            found = np.flatnonzero(left & (both >= least * (sizes[i] + sizes - both)))
            left[found] = False
            u += [i] * len(found)
            v += found.tolist()
            todo += found.tolist()
    return np.array(u, np.int64), np.array(v, np.int64)


def near_copies(docs: DataFrame, k: int = 5, least: float = 0.8, blocks: int = 4, leaf: int = LEAF, salt: int = SALT, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, _k, group): documents linked by a Jaccard index of at least ``least`` over their distinct k-word shingles.

    ``_k`` is the order key of a document, ``group`` the smallest one linked to it through any chain. A pair at 0.8 differs in
    too many of 64 bits for any cut to be sure of a field that is nearly equal. So there are two fingerprint words and ``blocks``
    fields in each, of which one within a bit is enough: for eight fields of 16 bits that misses one pair in fourteen at 0.8, in 40 at
    0.85, in 300 at 0.9. What is close in all 128 bits, through any chain, is a cluster, and within a cluster every text is compared
    by its shingles with every other that is not linked to it yet. A cluster beyond ``block`` bytes is cut into blocks, and a task
    compares two of them. Fingerprints are of the distinct shingles; texts with equal sets of shingles are one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "nearcopies")
    keyed = with_key(docs.select("doc_id", "text"), scratch)

    def run(cols: dict) -> dict:
        claim("simhash", int)
        return {"doc_id": cols["doc_id"], "_k": cols["_k"], **keys(cols["text"], k)}

    kind = dict(docs.dtypes)["doc_id"]
    rows = scratch.save(map_texts(keyed.select("doc_id", "_k", "text"), run, f"doc_id {kind}, _k long, node long, cell long, fp long, fp2 long"), "fingerprints")
    distinct = scratch.save(rows.groupBy("node").agg(*[F.min(c).alias(c) for c in ("cell", "fp", "fp2")], F.min("_k").alias("rep")), "distinct")
    fps = scratch.save(distinct.select("fp", "fp2").distinct(), "cells")

    def compare(table: pa.Table) -> pa.Table:
        words = [table.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2")]
        i, j = shard_close(words, table.column("home").to_numpy(zero_copy_only=False), LOOSE, LOOSE_WORD)
        u, v = stars(cell(*words).view(np.int64), i, j)
        return pa.table({"u": u, "v": v})

    dealt = deal(fps, ["fp", "fp2"], fields(blocks, 2), 1, leaf, salt)
    close = components(dealt.groupBy("tree", "leaf", "salt").applyInArrow(compare, "u long, v long"), scratch)
    placed = distinct.join(close.withColumnRenamed("node", "cell"), "cell", "left").select("node", F.coalesce("root", "cell").alias("cluster"), "rep")
    placed = scratch.save(placed, "placed")
    several = placed.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    reps = scratch.save(placed.join(several, "cluster").select("node", "cluster", F.col("rep").alias("_k")), "reps")
    scratch.drop(placed, fps)

    def sets(cols: dict) -> dict:
        return {"node": cols["node"], "cluster": cols["cluster"], "grams": [shingles(t, k).tobytes() for t in cols["text"]]}

    # only texts of clusters move, and the few that a filter of bounded size can't tell from them
    touched, _ = pick(keyed.select("_k", "text"), reps)
    chosen = touched.join(reps.hint("merge"), "_k").dropDuplicates(["_k"])
    grams = scratch.save(map_texts(chosen.select("node", "cluster", "text"), sets, "node long, cluster long, grams binary"), "shingles")
    parts = F.ceil(F.sum(F.length("grams") + TEXT_BYTES) / block).cast("int").alias("parts")
    large = grams.groupBy("cluster").agg(parts).where("parts > 1")  # at most one row for each block of bytes
    cut = grams.join(F.broadcast(large), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.where("parts = 1 OR own <> other").withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def link(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        u, v = stars(node, *linked_sets([np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()], least))
        return pa.table({"u": u, "v": v})

    linked = cut.select("node", "cluster", "low", "high", "grams").groupBy("cluster", "low", "high").applyInArrow(link, "u long, v long")
    roots = components(linked, scratch)
    scratch.drop(grams, reps)
    named = distinct.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min("rep").alias("group"))
    groups = scratch.save(named.join(first, "root").select("node", "group"), "groups")
    scratch.drop(distinct)
    return rows.join(groups, "node").select("doc_id", "_k", "group")


def keep_first(docs: DataFrame, k: int = 5, least: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the first document alone of each group of `near_copies`; rows that are equal in doc_id and text all stay.

    Cases: texts without a word are one group. Null ids come first. No rows give no rows; other columns pass through, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession, "keepfirst")
    hidden, restore = shield(docs)
    keyed = with_key(hidden, scratch)
    inner = Scratch(docs.sparkSession, "nearcopies")
    others = scratch.save(near_copies(docs, k, least, scratch=inner).where("_k <> group").select("_k").distinct(), "others")
    inner.clear()
    touched, rest = pick(keyed, others)
    return restore(rest.unionByName(touched.join(others.hint("merge"), "_k", "left_anti")))
