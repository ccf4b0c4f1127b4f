"""Near, line and substring dedup against brute force."""

import hashlib
import itertools
import random

import numpy as np
import xxhash
from conftest import EDGES

from tidemark.llm import linededup, simhash, substring
from tidemark.llm.common import Scratch
from tidemark.llm.components import components

rnd = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def corpus():
    base = [prose(rnd.randint(30, 200)) for _ in range(40)]
    out = list(base)
    for t in base[:10]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out += [t, " ".join(w), t.upper()]
    out.append(base[0] + "\n" + base[1] + "\n" + base[0])
    return out


def brute_fingerprint(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words, w = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [w] if w else []
            w = ""
        else:
            w += c
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_equals_definition():
    for t in [*corpus()[:20], None, "", "a b", "É x y z q w", "x y z w"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_simhash_groups_equal_brute_force(spark, make):
    texts = corpus()
    got = {r.doc_id: r for r in simhash.near_duplicates(make(texts), leaf=8, salt=4).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    root = union(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {k: r.component_id for k, r in got.items()} == dict(enumerate(root))
    assert all(r.fp & (1 << 64) - 1 == fps[k] for k, r in got.items())


def test_shards_lose_no_link(spark):
    """Random fingerprints with planted neighbours, small leaves and salts: every linked group is whole."""
    g = np.random.default_rng(1)
    base = g.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:150].copy()
    for _ in range(4):
        near ^= np.uint64(1) << g.integers(0, 64, 150, dtype=np.uint64)
    dense = base[0] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near, dense]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(df, 4, 3, leaf=16, salt=8)
    got = {r.node: r.root for r in components(edges, Scratch(spark, "t")).collect()}
    n = len(fps)
    root = union(n, [(a, b) for a, b in itertools.combinations(range(n), 2) if int(fps[a] ^ fps[b]).bit_count() <= 4])
    names = fps.view(np.int64)
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(int(names[i]))
    for members in groups.values():
        if len(members) > 1:
            assert {got[m] for m in members} == {min(members)}
        else:
            assert members[0] not in got


def test_near_copies_equal_brute_force(spark, make):
    texts = [prose(150) for _ in range(60)]
    for i in range(20):
        w = texts[i].split()
        w[70] = "changed"
        texts.append(" ".join(w))
    texts += texts[:5]
    got = {r.doc_id: r.group for r in simhash.near_copies(make(texts), leaf=16).collect()}
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    root = union(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert got == dict(enumerate(root))


def edited(words, n, tag):
    """The words with ``n`` of them changed, at places that spoil five shingles each."""
    w = list(words)
    for p in rnd.sample(range(5, len(w) - 5, 10), n):
        w[p] = f"{tag}e{p}"
    return " ".join(w)


def test_near_copies_of_one_original(spark, make):
    """Copies that link to the original alone, while the nearest fingerprint is mostly another copy's."""
    base = [f"b{i}" for i in range(304)]
    texts = [" ".join(base)] + [edited(base, 5, f"c{i}") for i in range(120)] + [prose(150) for _ in range(20)]
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert sum(close(a, b) for a, b in itertools.combinations(range(1, 121), 2)) < 100
    root = union(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if close(a, b)])
    for block in (simhash.BLOCK, 60_000):
        assert {r.doc_id: r.group for r in simhash.near_copies(make(texts), block=block).collect()} == dict(enumerate(root))


def test_near_copies_links_go_to_the_smallest(spark, make, monkeypatch):
    """Every task links the members of a group to the smallest it has met, so that tasks which meet the same members tell the same links."""
    base = [f"b{i}" for i in range(304)]
    texts = [" ".join(base[:i] + [f"c{i}"] + base[i + 1 :]) for i in range(300)]
    told = []

    def spy(edges, scratch, inner=simhash.components):
        e = scratch.save(edges, "told")
        told.append((e.count() > 0, e.where("u <= v").count()))
        return inner(e, scratch)

    monkeypatch.setattr(simhash, "components", spy)
    assert {r.group for r in simhash.near_copies(make(texts), leaf=16, block=60_000).collect()} == {0}
    assert told == [(True, 0)] * 2


def test_near_copies_do_not_depend_on_repeats(spark, make):
    """Repeats of a passage do not part texts of the same shingles, and one shingle that prevails does not join others."""
    texts = []
    for i in range(10):
        body, loop = " ".join(f"d{i}w{j}" for j in range(200)), " ".join(f"d{i}r{j}" for j in range(20))
        texts += [f"{body} {loop} {loop}", f"{body} {' '.join([loop] * 20)}"]
    texts += ["ha " * 400 + " ".join(f"s{i}w{j}" for j in range(60)) for i in range(10)]
    got = {r.doc_id: r.group for r in simhash.near_copies(make(texts)).collect()}
    assert got == {i: i // 2 * 2 if i < 20 else i for i in range(30)}


def test_simhash_edges(spark, make):
    rows = simhash.near_duplicates(make(EDGES)).collect()
    assert len(rows) == len(EDGES)
    empty = {r.component_id for r in rows if r.doc_id in (1, 2, 5)}
    assert empty == {1}
    assert simhash.near_duplicates(make([])).count() == 0
    assert simhash.near_copies(make(EDGES)).count() == len(EDGES)


def brute_windows(rows, size=20):
    seen, out = set(), {}
    for k, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            if g in seen:
                keep[i : i + size] = [False] * size
            seen.add(g)
        left = [x for x, y in zip(w, keep) if y]
        out[k] = (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def test_substring_equals_brute_force(spark, make):
    shared = prose(45)
    texts = corpus() + [prose(20) + " " + shared + " " + prose(9) for _ in range(6)] + [("x y " * 40), "z " * 19, prose(20)]
    rows = list(enumerate(texts))
    want = brute_windows(rows)
    for batches in (1, 2, 5):
        got = substring.dedup(make(texts), batches=batches, digest=True).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    kept = substring.dedup(make(texts)).collect()
    assert {r.doc_id: hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() for r in kept} == {k: v[2] for k, v in want.items()}


def test_index_is_incremental_and_compacts(spark, make):
    """A table in three calls on one index, each against all that came before, whatever the ids; and runs that are merged on the way."""
    shared = prose(50)
    texts = corpus() + [prose(20) + " " + shared + " " + prose(9) for _ in range(8)] + ["x y " * 40, "z " * 19, prose(20)]
    rnd.shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts[:30])] + [(i, t) for i, t in enumerate(texts[30:50])] + [(i + 2000, t) for i, t in enumerate(texts[50:])]
    parts = [sorted(rows[:30]), sorted(rows[30:50]), sorted(rows[50:])]
    want = brute_windows([r for part in parts for r in part])
    index = substring.FingerprintIndex(Scratch(spark, "t"), buckets=4, fanout=2)
    for part in parts:
        got = substring.dedup(make(part), batches=3, digest=True, index=index).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {k: want[k] for k, _ in part}
        for runs in (index.anchors, index.repeated, index.windows):
            assert all(len(level) < 2 for level in runs.levels)
    assert len(index.anchors.levels) > 2
    index.close()


def test_substring_edges(spark, make):
    rows = substring.dedup(make(EDGES)).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows if r.doc_id not in (4, None)}
    assert by[5].text is None and by[5].n_words == 0
    assert by[7].n_removed == by[7].n_words - 3  # the period of the text is three words
    assert substring.dedup(make([]), digest=True).count() == 0


def brute_runs(rows):
    """For each place (document, line among all, characters): lines of the longest run from there that also starts earlier."""
    seq = []
    for k, t in rows:
        if t is not None:
            seq += [(k, i, x) for i, x in enumerate(t.split("\n")) if x.strip(" \t\x0b\x0c\r")]
    places = {}
    for p, (_, _, x) in enumerate(seq):
        places.setdefault(x, []).append(p)

    def common(p, q):
        n = 0
        while p + n < len(seq) and seq[p + n][0] == seq[p][0] and seq[q + n][0] == seq[q][0] and seq[p + n][2] == seq[q + n][2]:
            n += 1
        return n

    return seq, [max((common(p, q) for q in places[x] if q < p), default=0) for p, (_, _, x) in enumerate(seq)]


def brute_lines(rows, min_chars=linededup.MIN_CHARS):
    seq, longest = brute_runs(rows)
    gone = set()
    for p, n in enumerate(longest):
        if n and sum(len(x) for _, _, x in seq[p : p + n]) >= min_chars:
            gone |= {(k, i) for k, i, _ in seq[p : p + n]}
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in rows}


def test_lines_equal_brute_force(spark, make):
    some = [prose(n) for n in (2, 3, 9, 12, 4, 30)]
    texts = ["\n".join(rnd.choice([*some, "", " "]) for _ in range(rnd.randint(1, 25))) for _ in range(60)] + ["a\nb\nc\nd\ne", "x\nb\nc\nd\ny", "q\n\nq\n\nq"]
    got = {r.doc_id: r.text for r in linededup.dedup(make(texts)).collect()}
    assert got == brute_lines(list(enumerate(texts)))


def test_whole_length_of_a_run_decides(spark, make):
    """Short lines go where their run from one earlier place is long enough, whatever two of its lines are."""
    few = "abcdefgh"
    texts = ["\n".join(rnd.choice(few) * rnd.randint(1, 2) for _ in range(rnd.randint(1, 90))) for _ in range(25)]
    texts += [t + "\nend" for t in texts[:6]] + ["\n".join(t.split("\n")[3:40]) for t in texts[:12]] + ["\n".join(["x"] * 70), "\n".join(["x"] * 200)]
    for least in (1, 5, 12, 50):
        got = {r.doc_id: r.text for r in linededup.dedup(make(texts), min_chars=least).collect()}
        assert got == brute_lines(list(enumerate(texts)), least)
    # two lines of a repeated run, and a run put together from two earlier ones, stay
    parts = ["one of a pair", "the other of a pair", "a third line that follows", "and a fourth one"]
    texts = ["\n".join(parts), "\n".join(parts[:2]) + "\nown", "\n".join(["first", *parts[:2]]), "\n".join([parts[0], "z", parts[1], parts[2]]), "\n".join(parts)]
    got = [r.text for r in linededup.dedup(make(texts)).orderBy("doc_id").collect()]
    assert got == [*texts[:4], ""] == list(brute_lines(list(enumerate(texts))).values())


def test_line_runs_are_maximal(spark, make):
    head = [f"line {i}" for i in range(37)]
    texts = ["\n".join(head), "own\n" + "\n".join(head[5:30]) + "\nend"]
    runs = linededup.runs(make(texts)).collect()
    assert [(r._k, r.first_line, r.n_lines, r.copy_of) for r in runs] == [(1, 1, 25, 0)]
    assert runs[0].n_chars == sum(map(len, head[5:30]))


def test_line_edges(spark, make):
    rows = linededup.dedup(make(EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert {r.text for r in rows if r.doc_id == 5} == {None}
    assert {r.n_lines for r in rows if r.doc_id == 1} == {1}
    assert linededup.dedup(make([])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_substring_leaves_no_hashes_in_workers(spark):
    """Workers outlive the operator: the hashes of words are gone before the texts are written out, not when a later operator comes."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "doc_id long, text string").repartition(4)
    assert substring.dedup(docs).count() == len(corpus())
    substring.dedup(docs).collect()

    def held(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(map(len, substring._hashes.values()))] * b.num_rows, pa.int64())})

    assert {r.n for r in spark.range(0, 16, 1, 4).mapInArrow(held, "n long").collect()} == {0}
