"""Every stage of the pipeline on its own input against brute force, and the whole of it."""

import collections
import itertools
import random
import re
from pathlib import Path

import corpus_pipeline
from conftest import EDGES
from pyspark.sql import functions as F
from test_dedup import brute_lines, brute_windows, union

from tidemark.llm import langid, packing, simhash
from tidemark.llm.common import Scratch
from tidemark.sources import shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_on_documents(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    scratch = Scratch(spark, "t")
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    accepted = scratch.save(stage("language_id")(spark, docs, root))
    assert accepted.columns == COLUMNS
    model = langid.fit(langid.sample(docs))
    want = langid.Scorer(model)([r.text for r in docs.collect()])
    assert accepted.count() == sum(w[3] for w in want) >= 0.97 * docs.count()

    lines = scratch.save(stage("line_dedup")(spark, accepted, root))
    assert lines.columns == COLUMNS and rows(lines) == brute_lines(sorted(rows(accepted).items()))
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = scratch.save(stage("near_dedup")(spark, lines, root))
    texts = sorted(rows(lines).items())
    sets = [frozenset(simhash.shingles(t).tolist()) for _, t in texts]
    close = lambda a, b: len(a & b) >= 0.8 * (len(a) + len(b) - len(a & b))
    groups = union(len(texts), [(i, j) for j in range(len(texts)) for i in range(j) if close(sets[i], sets[j])])
    assert near.columns == COLUMNS and set(rows(near)) == {texts[g][0] for g in groups}

    kept = scratch.save(stage("substring_dedup")(spark, near, root))
    want = brute_windows(sorted(rows(near).items()))
    assert {k: len(t.encode().split()) for k, t in rows(kept).items()} == {k: n - gone for k, (n, gone, _) in want.items()}

    packed = stage("best_fit_packing")(spark, kept, root).collect()
    size = collections.Counter()
    for r in packed:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= packing.CAPACITY and {r.doc_id for r in packed} == set(rows(kept))
    assert len(size) <= -(-sum(size.values()) // packing.CAPACITY) + 2


def test_stages_on_edges(spark, root, make):
    """Nulls, empty and long texts, repeated rows and repeated ids, and an empty table, in every stage."""
    rnd = random.Random(1)
    docs = make([*EDGES, *[(100 + i, " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(60))) for i in range(5)]])
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, root)
        assert f(spark, make([]), root).count() == 0
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.collect()} == {d for d, _ in rows}
            continue
        assert out.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        if name == "language_id":
            assert not collections.Counter(got) - collections.Counter(rows) and all(langid.has_letter(t or "") for _, t in got)
        elif name == "near_dedup":
            kept = collections.Counter(got)
            assert not kept - collections.Counter(rows)
            wordless = {r for r in kept if not (r[1] or "").split()}
            assert len(wordless) == 1 and {t for _, t in kept if (t or "").split()} <= {t for _, t in rows}
        else:
            assert sorted(d or -1 for d, _ in got) == sorted(d or -1 for d, _ in rows)
            assert [t is None for _, t in got] == [t is None for _, t in rows]


def test_unlabelled_documents_all_stay(spark, root, make):
    docs = make([(1, "some words of a text"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, docs, root).count() == 2


def test_run(spark, root):
    assert corpus_pipeline.run(spark, root).count() > 0


def test_driver_gives_freed_memory_back(spark, monkeypatch):
    """What the driver has freed between blocks still in use goes back after some scratch tables, not at the end of the session."""

    def own_mb():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10

    monkeypatch.setattr(shared, "_saved", itertools.count(1))
    monkeypatch.setattr(shared, "EVERY", 3)
    scratch = Scratch(spark, "give")
    blocks = [b"x" * 60_000 + bytes([i % 256]) for i in range(4000)]
    pinned = blocks[::40] + blocks[-1:]
    del blocks
    full = []
    for _ in range(3):
        full.append(own_mb())
        scratch.save(spark.range(1))
    assert full[-1] - own_mb() > 100, (full, own_mb())
    assert len(pinned) == 101
    scratch.clear()
