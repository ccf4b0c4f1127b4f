"""Every opN_ query as it is registered, on the smallest tables: against its SQL, or against definitions written out here."""

import glob
import hashlib
import os
import random

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import license, queries, sql, syncmers

COLUMNS = {
    "op1": {"doc_id", "license", "coverage"}, "op2": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op3": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"}, "op4": {"doc_id", "fingerprint", "component_id"},
    "op5": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op6": {"doc_id", "n_lines", "n_removed", "kept_sha256"},
    "op7": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op8": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op9": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}, "op10": {"doc_id", "held_out", "lang_pred", "score"},
}


@pytest.fixture(scope="module")
def con(root):
    c = duckdb.connect()
    for p in glob.glob(f"{root}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, root, con, name):
    df = queries.QUERIES[name](spark, root)
    cols = sorted(df.columns)
    assert COLUMNS[name.split("_")[0]] <= set(cols)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if name in sql.ORACLES:
        found = con.execute(sql.ORACLES[name])
        at = [[d[0] for d in found.description].index(c) for c in cols]
        assert rows == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    elif name != "op1_license_scan":
        every = {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()}
        assert {r[cols.index("doc_id")] for r in rows} == every
    else:
        assert rows


def test_control_conversation(spark, root):
    r = queries.op3_chat_formatting(spark, root).where("conv_id = -7").first()
    assert r.n_turns == 2 and r.loss_chars == len(queries.CONTROL) and r.loss_sha256 == hashlib.sha256(queries.CONTROL.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{queries.CONTROL}\n" for x in ("user", "assistant")).encode()).hexdigest()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(hashes):
    h = 42
    for x in hashes:
        h = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h


def brute_fingerprint(text, k=syncmers.K, size=syncmers.SIZE):
    words = [w for w in (text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    runs = [h[i : i + k] for i in range(len(h) - k + 1)]
    chosen = [r for r in runs if min(r) in (r[0], r[-1])] or ([h] if h else [])
    return "".join(f"{x:08x}" for x in sorted({chained(r) >> 32 for r in chosen})[:size])


def brute_likeness(a, b):
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a, b))
    return 1.0 if not x and not y else len(x & y) / max(len(x), len(y))


def test_fingerprints_equal_brute_force(spark, make):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta théta".split()) + str(rnd.randint(0, 9)) for _ in range(n)) for n in (0, 1, 5, 6, 7, 8, 9, 11, 40, 300, 900)] + [None, "\t\n", "a  b\tc"]
    rows = {r.doc_id: r for r in syncmers.neighbours(make(texts)).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after = plain[i - 1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want = (brute_fingerprint(t), brute_fingerprint(edited), hashlib.sha256(edited.encode()).hexdigest())
        r = rows[i]
        assert (r.fingerprint, r.edited_fingerprint, r.edited_sha256) == want and r.n_chars == len(t)
        assert r.near_edited == pytest.approx(brute_likeness(want[0], want[1])) and r.near_next == pytest.approx(brute_likeness(want[0], brute_fingerprint(after)))


def test_scan_of_whole_texts(spark, make):
    """Notices put into texts of other words are found where they are, with the share of their words that was left."""
    rnd = random.Random(4)
    names = [(n, t) for n, ts in license.TEMPLATES.items() for t in ts]
    docs, want = [], []
    for i, (name, notice) in enumerate(names):
        before = [f"x{rnd.randint(0, 99)}q" for _ in range(rnd.randint(0, 400))]
        after = [f"y{rnd.randint(0, 99)}q" for _ in range(rnd.randint(0, 400))]
        docs.append((i, " ".join([*before, *notice.split(), *after])))
        want.append((i, name, len(before)))
    docs += [(100, " ".join(f"z{rnd.randint(0, 999)}" for _ in range(3000))), (101, None), (102, "")]
    got = license.scan(make(docs)).where(F.col("coverage") == 1.0).select("doc_id", "license", "first_word").collect()
    assert set(want) <= {tuple(r) for r in got}
    assert not {r.doc_id for r in got} & {100, 101, 102}


def test_notice_with_words_put_in():
    notice = license.TEMPLATES["MIT"][2].split()
    put = [x for i, w in enumerate(notice) for x in ([w, f"extra{i}"] if i % 2 == 0 and i < len(notice) // 2 else [w])]
    found = license.Scanner(license.TEMPLATES).scan(" ".join(put))
    assert ("MIT", 1.0) in [f[:2] for f in found]
