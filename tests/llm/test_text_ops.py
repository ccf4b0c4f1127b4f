"""License scans, packing, chat, BPE, quality, fingerprints and language ID."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat, langid, license, packing, quality, syncmers

PATH = bpe.default_vocabulary()
rnd = random.Random(5)


# licenses


def brute_increasing(values):
    best = []
    for mask in range(1 << len(values)):
        pick = [v for i, v in enumerate(values) if mask >> i & 1]
        if all(a < b for a, b in zip(pick, pick[1:])) and len(pick) > len(best):
            best = pick
    return len(best)


def test_longest_increasing_subsequence():
    for _ in range(60):
        v = [rnd.randint(0, 9) for _ in range(rnd.randint(0, 9))]
        got = [v[i] for i in license.increasing(v)]
        assert all(a < b for a, b in zip(got, got[1:])) and len(got) == brute_increasing(v)


def test_alignment_is_in_order_and_equal():
    t = license.words(license.TEMPLATES["Apache-2.0"][1])
    text = ["x", *t[:9], "put", "in", *t[9:], "y"]
    pairs = license.align(t, text)
    assert len(pairs) == len(t) and all(t[i] == text[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_license_findings(spark, make):
    notice = "Licensed under the Apache License, Version 2.0."
    long = license.TEMPLATES["MIT"][1]
    texts = ["plain words only", f"before {notice} after", f"{notice}\n{notice} text {notice}", long.replace("free", "wholly free"), "Licensed under CC BY-NC 4.0.", "licensed words under a version of the sun", None, ""]
    got = collections.Counter((r.doc_id, r.license) for r in license.scan(make(texts)).collect())
    assert got == {(1, "Apache-2.0"): 1, (2, "Apache-2.0"): 3, (3, "MIT"): 1, (4, "CC-BY-NC-4.0"): 1}
    assert license.scan(make(EDGES)).count() == 0 and license.scan(make([])).count() == 0


def test_license_with_repeated_words_altered():
    """Words that a template has once are altered while its coverage stays above the least."""
    scanner = license.Scanner(license.TEMPLATES)
    for name, i, n in (("Apache-2.0", 1, 5), ("GPL-3.0", 1, 6)):
        t = license.words(license.TEMPLATES[name][i])
        once = [w for w in t if t.count(w) == 1][::3][:n]
        text = " ".join(f"altered{w}" if w in once else w for w in t)
        assert [(o[0], o[1]) for o in scanner.scan(text)] == [(name, (len(t) - n) / len(t))]


def test_license_copies_in_a_row():
    scanner = license.Scanner(license.TEMPLATES)
    for name, notices in license.TEMPLATES.items():
        for notice in notices:
            n = len(license.words(notice))
            got = scanner.scan("\n".join([notice] * 7))
            assert [(o[0], o[1], o[3], o[4]) for o in got] == [(name, 1.0, n * i, n * i + n) for i in range(7)]
    assert [o[:2] for o in scanner.scan("Released under the very MIT License. " * 4)] == [("MIT", 1.0)] * 4


# packing


def test_plan_uses_every_piece_and_fills_bins():
    for seed in range(8):
        g = np.random.default_rng(seed)
        lengths = np.minimum(64, g.geometric(0.06, 500))
        plan = packing.plan(collections.Counter(lengths.tolist()), 64)
        back = collections.Counter()
        for used, times in plan:
            assert sum(n * m for n, m in used.items()) <= 64
            for n, m in used.items():
                back[n] += m * times
        assert back == collections.Counter(lengths.tolist())
        bins = sum(t for _, t in plan)
        assert bins <= -(-int(lengths.sum()) // 64) + 2


def test_fullest_equals_brute_force():
    import itertools

    for _ in range(40):
        items = [rnd.randint(1, 12) for _ in range(rnd.randint(0, 9))]
        room = rnd.randint(0, 30)
        best = max((sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= room), default=0)
        counts = collections.Counter(items)
        used = packing._fullest(room, counts, sorted(counts, reverse=True))
        assert sum(n * m for n, m in used.items()) == best and all(m <= counts[n] for n, m in used.items())


def test_packing_round_trip(spark, make):
    texts = [" ".join(rnd.choice(["alpha", "beta", "Gamma!", "ü", "x1y2"]) for _ in range(rnd.choice([0, 3, 50, 700, 3000]))) for _ in range(40)] + [None, ""]
    docs = make(texts)
    placed = packing.pack(docs).collect()
    t = Tokenizer.from_file(PATH)
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    for r in placed:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in placed) == sum(map(len, ids))
    for n in collections.Counter(r.doc_id for r in placed).items():
        assert n[1] == -(-len(ids[n[0]]) // 2048)
    by = collections.defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    seqs = [r.ids for r in packing.sequences(docs).collect()]
    assert sum(map(len, seqs)) == sum(map(len, ids)) and max(map(len, seqs)) <= 2048


def test_sequences_of_repeated_rows_and_null_ids(spark, make):
    """Every row's tokens are in one sequence once, whatever ids repeat."""
    rows = [(1, "alpha beta"), (1, "alpha beta"), (1, "gamma"), (None, "delta"), (None, "delta"), (None, None), (2, "alpha beta")]
    t = Tokenizer.from_file(PATH)
    want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 0] for _, x in rows)
    got = []
    for r in packing.sequences(make(rows)).collect():
        ids = r.ids
        while ids:
            got.append(ids[: ids.index(0) + 1])
            ids = ids[len(got[-1]) :]
    assert sorted(got) == want


def test_packing_tokens_equal_library(monkeypatch):
    t, mine = Tokenizer.from_file(PATH), packing.Tokens(PATH)
    monkeypatch.setattr(packing, "CHUNK", 300)
    monkeypatch.setattr(packing, "KEYS", 60)
    alphabet = ["alpha", "Beta,", "it's", "we'll.", "x1y22", "...", "(a)", "ünï", "ÀÉ!", "a\u00a0b", "\x1c", "\x85", "日本", "<|endoftext|>", "<|", "İ", "e\u0301", "a" * 300, "-- ", "\t\n", "'s", "ſ", "ß"]
    for k in range(60):
        texts = ["".join(rnd.choice(alphabet[: 13 if k % 2 else None]) + rnd.choice([" ", "\n", "", "  "]) for _ in range(rnd.randint(0, 60))) for _ in range(12)] + [None, "", " "]
        assert mine.join(texts) == [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_packing_edges(spark, make):
    assert {r.doc_id for r in packing.pack(make(EDGES)).collect()} == {d for d, _ in EDGES}
    assert packing.pack(make([])).count() == 0


# chat


@given(st.text(alphabet="ab\\#<>/turn :hlcé\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_controls(s):
    e = chat.escape(s)
    assert chat.unescape(e) == s and "###" not in e and "</turn>" not in e
    role = chat.escape(s, True)
    assert chat.unescape(role) == s and ":" not in role


def test_chat_examples(spark):
    hard = "\\### Assistant: </turn> ok"
    turns = [(1, 1, "assistant", hard), (1, 0, "user", "hi"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", ""), (2, 0, "user", "no reply"), (None, 0, None, "lost"), (1, None, "system", "first")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    seq = [("system", "first"), ("user", "hi"), ("assistant", hard), ("user", ""), ("assistant", ""), ("assistant", "")]
    r = got[1]
    assert r.n_turns == 6 and r.loss_chars == len(hard)
    assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in seq).encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()
    assert got[2].loss_chars == 0 and got[None].n_turns == 1
    full = sorted(chat.render(chat.expand(df)).collect(), key=lambda x: x.example)
    assert len(full) == 3 and [chat.parse(x.text) for x in full] == [seq[:3], seq[:5], seq[:6]]
    assert chat.unescape(full[0].text[full[0].loss_start : full[0].loss_end]) == hard
    assert chat.read_back(chat.expand(df.where("conv_id = 99"))).count() == 0


def test_chat_reads_whole_examples(spark, monkeypatch):
    """What is read back comes from examples written out with all turns before them; contexts that were lost or mixed up stop the job."""
    rows = [(c, t, "assistant" if (t + c) % 3 == 0 else "user", f"{c} said {t} \\###" * (t % 4)) for c in range(12) for t in range(c)] + [(None, 0, "assistant", "x"), (None, 1, "assistant", "x"), (-1, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    assert len(got) == 13
    for c, r in got.items():
        turns = [(role, text or "") for k, _, role, text in rows if k == c]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.render(chat.expand(df)).count() == sum(r[2] == "assistant" for r in rows)
    whole = {r.conv_id: r.text for r in chat.render(chat.expand(df), rest=True).collect()}
    assert all(len(whole[c]) >= 1 for c in got) and chat.parse(whole[-1]) == [("user", "")]
    shuffled = chat.expand(df).repartition(1).orderBy("conv_id", F.desc("position"))
    with pytest.raises(Exception, match="not where it belongs"):
        chat.read_back(shuffled).collect()
    real = chat.render
    monkeypatch.setattr(chat, "render", lambda e, rest=False: real(e, rest).withColumn("text", F.expr("if(example > 0, concat('### user: other </turn>\n', text), text)")))
    with pytest.raises(Exception, match="does not begin with the one before"):
        chat.read_back(chat.expand(df)).collect()


# BPE


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_library(texts):
    t = Tokenizer.from_file(PATH)
    for x, (ids, tokens) in zip(texts, bpe.encoder(PATH).join(texts)):
        want = t.encode(x, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)).encode() and tokens.decode() == t.decode(want, skip_special_tokens=False)


def test_bpe_words_of_few_letters():
    """Overlapping pairs and repeats, where the order of merges shows."""
    t = Tokenizer.from_file(PATH)
    words = ["".join(rnd.choice("aehnst") for _ in range(rnd.randint(1, 60))) for _ in range(600)] + ["a" * n for n in range(1, 40)]
    got = bpe.vocabulary(PATH).encode_words(words)
    assert got == [e.ids for e in t.encode_batch(words, add_special_tokens=False)]


def test_bpe_cache_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    e, t = bpe.Encoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(10):
        texts = [" ".join(f"w{rnd.randint(0, 99)}" for _ in range(12)) for _ in range(3)]
        assert [a for a, _ in e.join(texts)] == [" ".join(map(str, x.ids)).encode() for x in t.encode_batch(texts, add_special_tokens=False)]


def test_bpe_edges(spark, make):
    t = Tokenizer.from_file(PATH)
    got = bpe.round_trip(make(EDGES)).collect()
    assert len(got) == len(EDGES)
    want = {}
    for d, x in EDGES:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.setdefault(d, set()).add((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id] for r in got)
    ids = {r.doc_id: r.ids for r in bpe.encode(make(["Hello, world 42"])).collect()}
    assert bpe.decode(ids[0]) == t.decode(ids[0], skip_special_tokens=False)


# quality


def brute_repeats(text):
    w = text.split(" ")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)})


def test_repeat_words_equals_brute_force():
    for _ in range(100):
        t = " ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))
        assert quality.Measures(t).n_repeat_words == brute_repeats(t)


def test_order_of_rules_changes_no_verdict(spark, make):
    texts = [" ".join(rnd.choice(["alpha", "#", "12345", "x" * 30, "beta..."]) for _ in range(60)) for _ in range(30)] + [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))]
    docs = make(texts)
    a = {r.doc_id: r.kept for r in quality.cascade(docs).collect()}
    b = {r.doc_id: r.kept for r in quality.cascade(docs, tuple(reversed(quality.RULES))).collect()}
    assert a == b and a[30]
    want = {}
    for i, t in enumerate(texts):
        m = quality.Measures(t)
        want[i] = not any(r.rejects(m) for r in (*quality.BASE, *quality.RULES))
    assert a == want


def test_rules_run_by_rejections_per_cost():
    rules = quality.RULES[:3]
    est = {rules[0].name: (1.0, 0.1), rules[1].name: (0.1, 0.1), rules[2].name: (1.0, 0.9)}
    assert [r.name for r in quality.order(rules, est)] == [rules[1].name, rules[2].name, rules[0].name]


def test_quality_edges(spark, make):
    rows = quality.cascade(make(EDGES)).collect()
    assert len(rows) == len(EDGES) and all(r.base_failed and not r.kept for r in rows)
    assert quality.cascade(make([])).count() == 0


# fingerprints


def brute_anchors(words, k):
    import xxhash

    h = [np.int64(np.uint64(xxhash.xxh64_intdigest(w.encode(), 42))) for w in words]
    return [i for i in range(len(h) - k + 1) if min(h[i : i + k]) in (h[i], h[i + k - 1])]


def test_syncmers_equal_definition(spark, make):
    from pyspark.sql import functions as F

    texts = [" ".join(rnd.choice("abcdefghijklmnop") for _ in range(n)) for n in (6, 7, 8, 40, 200)]
    for k in (2, 5, 7):
        rows = make(texts).select("doc_id", syncmers.anchors(F.col("text"), k).alias("a")).collect()
        for r in rows:
            w = texts[r.doc_id].split()
            assert [x.position for x in r.a] == (brute_anchors(w, k) if len(w) >= k else [0])


def test_syncmers_do_not_depend_on_context(spark, make):
    from pyspark.sql import functions as F

    inner = [f"v{rnd.randint(0, 99)}" for _ in range(60)]
    texts = [" ".join(inner), "other start of text " + " ".join(inner) + " other end"]
    a, b = (r.a for r in make(texts).select("doc_id", syncmers.anchors(F.col("text")).alias("a")).orderBy("doc_id").collect())
    assert {x.hash for x in a} <= {x.hash for x in b}
    left = spark.createDataFrame([(0, 1, texts[0])], "doc_id long, other_id long, text string")
    shared = syncmers.positional_matches(left, make(texts)).where("other_position = position + 4").count()
    assert shared >= len(a)


def test_short_texts_have_fingerprints_of_their_own(spark, make):
    """Texts of seven to eleven words, of which many have no syncmer, are alike to none but themselves."""
    texts = [" ".join(f"s{i}w{j}" for j in range(7 + i % 5)) for i in range(60)] + [""]
    rows = syncmers.neighbours(make(texts)).collect()
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert [i for i, x in prints.items() if not x] == [60] and len(set(prints.values())) == 61
    assert {r.near_next for r in rows} == {0.0}
    none = {i for i, n in make(texts[:60]).selectExpr("doc_id", "text").select("doc_id", syncmers.F.size(syncmers.anchors(syncmers.F.col("text")))).collect() if not n}
    assert none and all(len(prints[i]) == 8 for i in none)


def test_neighbours(spark, make):
    texts = [" ".join(f"t{i}w{rnd.randint(0, 999)}" for _ in range(rnd.randint(1, 120))) for i in range(30)] + [texts_ for texts_ in ("same text here", "same text here")]
    for ranges in (1, 4):
        old, syncmers.RANGE_BYTES = syncmers.RANGE_BYTES, max(1, sum(map(len, texts)) // ranges)
        got = {r.doc_id: r for r in syncmers.neighbours(make(texts)).collect()}
        syncmers.RANGE_BYTES = old
        n = len(texts)
        for i, t in enumerate(texts):
            nxt, half = texts[(i - 1) % n], len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
            assert got[i].near_next == (1.0 if (i, nxt) == (31, "same text here") else got[i].near_next)
            assert 0 <= got[i].near_edited <= 1
        assert got[30].fingerprint == got[31].fingerprint and got[31].near_next == 1.0
    edges = syncmers.neighbours(make(EDGES)).collect()
    assert len(edges) == len(EDGES)
    assert syncmers.neighbours(make([])).count() == 0
    assert syncmers.neighbours(make(["alone"])).first().near_next == 1.0


# language ID


def test_kneser_ney_conditionals():
    """After every context the probabilities of all characters add up to one."""
    m = langid.train({"a": collections.Counter({"abc": 3, "abd": 1, "bcd": 2, "cab": 5}), "b": collections.Counter("xyz xyy zzx".split())})
    letters = sorted({c for w in ("abc", "abd", "bcd", "cab", "xyz", "xyy", "zzx") for c in w}) + [" "]
    for lang in range(2):
        for context in ("a", "ab", "c", "x", "xy", "qq", "abc"):
            before = _opening(m, context, lang)
            step = lambda c: np.exp(before - _opening(m, context + c, lang))  # noqa: E731, B023
            total = sum(map(step, letters)) + (langid.ALPHABET - len(letters)) * step("\u1234")
            assert abs(total - 1) < 1e-6


def _opening(m, word, lang):
    """Cost of a word's characters without the edge after it, by a second path: characters one at a time."""
    if not word:
        return 0.0
    total, text = 0.0, " " + word
    for i in range(1, len(text)):
        p = m.floor[lang]
        for o in range(1, min(len(m.keys), i + 1) + 1):
            g = np.array([[ord(c) for c in text[i - o + 1 : i + 1]]])
            h = langid._hash(g)[0]
            at = np.searchsorted(m.keys[o - 1], h)
            if at < len(m.keys[o - 1]) and m.keys[o - 1][at] == h:
                p = m.probs[o - 1][at][lang]
            elif o > 1:
                c = langid._hash(g[:, :-1])[0]
                j = np.searchsorted(m.keys[o - 2], c)
                if j < len(m.keys[o - 2]) and m.keys[o - 2][j] == c:
                    p = p * m.back[o - 2][j][lang]
        total -= np.log(p)
    return total


def test_held_out_accuracy(spark, root):
    docs = spark.read.parquet(f"{root}/../sf0.01/documents.parquet")
    model = langid.fit(langid.sample(docs))
    rows = langid.identify(docs, model, keep=("doc_id", "lang")).withColumn("held", langid.held_out()).where("held").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert sum(r.accepted for r in rows) >= 0.97 * len(rows)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_langid_rejects_and_edges(spark, root, make):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    model = langid.fit(langid.sample(docs))
    noise = " ".join("".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(8)) for _ in range(40))
    got = {r.doc_id: r for r in langid.identify(make([noise, "12 34 !!", None, ""]), model).collect()}
    assert not got[0].accepted and got[0].lang_pred in {"de", "en", "es", "fr"}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 3))
    assert langid.identify(make(EDGES), model).count() == len(EDGES)
    nothing = langid.fit(langid.sample(make([])))
    assert nothing is None and {r.lang_pred for r in langid.identify(make(EDGES), nothing).collect()} == {"und"}


def test_vectors_equal_one_at_a_time():
    m = langid.train({"a": collections.Counter("hello help held".split()), "b": collections.Counter("gato gata pato".split())})
    for w in ("hello", "gat", "zzz", "h", "pelo"):
        for lang in range(2):
            assert abs(m.score([w])[0][lang] - (_opening(m, w + " ", lang))) < 1e-3 * max(1, m.score([w])[0][lang]) + 1e-3


def test_packing_hands_the_library_few_characters_at_once(monkeypatch):
    """Texts beyond Latin letters are encoded a few at a time, with the ids that they have together."""
    texts = ["слово и дело " * 300 + str(i) for i in range(40)]
    mine = packing.Tokens(PATH)
    want = mine.library(texts)
    real, sizes = mine.tokenizer, []

    class Counted:
        def encode_batch_fast(self, part, **how):
            sizes.append(sum(map(len, part)))
            return real.encode_batch_fast(part, **how)

    mine.tokenizer = Counted()
    monkeypatch.setattr(packing, "LIBRARY_CHARS", 10_000)
    assert mine.join(texts) == want and len(sizes) > 10 and max(sizes) <= 10_000
