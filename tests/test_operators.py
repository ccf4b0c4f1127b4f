"""Decisions, metrics, windows, evidence, learning and sources."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distance as D
from tidemark.operators import audit, decide, evidence, feature_row, learn, metrics, relational, retrieve, setdecode, windows
from tidemark.sources import tsv
from tidemark.streaming import ingest

PAIRS = "s1_id string, cand_id string, p double"


def frame(spark, rows, schema=PAIRS):
    return spark.createDataFrame(rows, schema)


def test_f_score_cases(spark):
    universe = frame(spark, [("a",), ("b",), ("c",)], "s1_id string")
    predicted = frame(spark, [("a", "x"), ("a", "y"), ("a", "z"), ("a", "z"), ("b", "q")], "s1_id string, cand_id string")
    true = frame(spark, [("a", "x"), ("a", "z")], "s1_id string, cand_id string")
    got = {r.s1_id: r.f for r in metrics.per_anchor(universe, predicted, true).collect()}
    assert got == pytest.approx({"a": 0.7142857, "b": 0.0, "c": 1.0})


def test_exclusivity(spark):
    rows = frame(spark, [("a", "r", 0.5), ("b", "r", 0.5), ("a", "t", 1.0)])
    soft = {(r.s1_id, r.cand_id): r.p_soft for r in decide.soft_exclusive(rows).collect()}
    assert soft[("a", "r")] == pytest.approx(1 / 3) and soft[("a", "t")] == pytest.approx(0.999)
    assert {(r.s1_id, r.cand_id) for r in decide.hard_exclusive(rows).collect()} == {("a", "r"), ("a", "t")}


def expected_f(p, chosen, lam, terms, fold):
    missed = setdecode.poisson(lam, terms, fold)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=len(p)):
        w = np.prod([x if y else 1 - x for x, y in zip(p, labels)])
        for m, q in enumerate(missed):
            true = sum(labels) + m
            tp = sum(labels[i] for i in chosen)
            total += w * q * ((1.0 if true == 0 else 0.0) if not chosen else 1.25 * tp / (len(chosen) + 0.25 * true))
    return total


def test_set_decoder_equals_brute_force():
    rnd = random.Random(0)
    for _ in range(60):
        p = sorted((round(rnd.random(), 3) for _ in range(rnd.randint(1, 5))), reverse=True)
        lam = rnd.choice([0.0, 0.05, 0.3, 1.0])
        got = setdecode.prefix_values(p, setdecode.poisson(lam, 8, True))
        best = max((expected_f(p, c, lam, 8, True) for r in range(len(p) + 1) for c in itertools.combinations(range(len(p)), r)))
        assert got.max() == pytest.approx(best)
        for k in range(len(p) + 1):
            assert got[k] == pytest.approx(expected_f(p, tuple(range(k)), lam, 8, True))


def test_set_decoder_on_frames(spark):
    rows = frame(spark, [("a", "x", 0.95), ("a", "y", 0.9), ("a", "z", 0.05), ("b", "q", 0.1)])
    got = {(r.s1_id, r.cand_id) for r in setdecode.decode(rows, recall=1.0).collect()}
    assert got == {("a", "x"), ("a", "y")}


def test_windows(spark):
    rows = frame(spark, [("a", "x", 0.9), ("a", "y", 0.9), ("a", "z", 0.1), ("b", "x", 0.4)])
    got = {(r.s1_id, r.cand_id): (r.o, r.s) for r in rows.select("s1_id", "cand_id", windows.best_other("p", "s1_id").alias("o"), windows.second_best("p", "s1_id").alias("s")).collect()}
    assert got == {("a", "x"): (0.9, 0.9), ("a", "y"): (0.9, 0.9), ("a", "z"): (0.9, 0.9), ("b", "x"): (0.0, 0.0)}


def test_relational(spark):
    a = frame(spark, [("a", "x", 0.9), ("b", "x", 0.4)])
    changed = relational.update_by_key(a, frame(spark, [("a", "x", 0.1), ("c", "x", 0.2)]), ["s1_id", "cand_id"])
    assert {(r.s1_id, r.p) for r in changed.collect()} == {("a", 0.1), ("b", 0.4)}
    lists = relational.collected(a, frame(spark, [("a",), ("z",)], "s1_id string"))
    assert {tuple(r) for r in lists.collect()} == {("a", "x"), ("z", "")}


def test_retrieval_equals_dense_arithmetic(spark):
    docs = {"s": [("c", "1", ["a", "b", "b"]), ("c", "2", ["b", "d"])], "q": [("c", "3", ["a", "b"]), ("c", "4", ["d", "d", "e"])]}
    sides = {k: frame(spark, v, "country string, id string, tokens array<string>") for k, v in docs.items()}
    w = retrieve.tfidf(sides, 100)
    got = {(r.query_id, r.index_id): r.score for r in retrieve.similar(w["q"], w["s"], 0.0).collect()}
    every = [d for v in docs.values() for d in v]
    vocab = sorted({t for d in every for t in d[2]})
    df = {t: sum(t in d[2] for d in every) for t in vocab}
    vec = {}
    for d in every:
        v = np.array([(1 + np.log(d[2].count(t))) * (np.log((1 + len(every)) / (1 + df[t])) + 1) if t in d[2] else 0 for t in vocab])
        vec[d[1]] = v / np.linalg.norm(v)
    want = {(q[1], s[1]): vec[q[1]] @ vec[s[1]] for q in docs["q"] for s in docs["s"] if vec[q[1]] @ vec[s[1]] > 0}
    assert got == pytest.approx(want)


def test_rarest_token_rescues_a_query(spark):
    index = frame(spark, [("c", str(i), t, 1.0) for i in range(6) for t in ("common", "rare")[: 2 if i < 3 else 1]], "country string, id string, token string, w double")
    q = frame(spark, [("c", "q", "common", 1.0), ("c", "q", "rare", 1.0)], "country string, id string, token string, w double")
    assert [r.token for r in retrieve.capped_index(q, index, share=0.0, least=2).collect()] == ["rare"]
    assert {r.token for r in retrieve.capped_index(q, index, share=0.0, least=9).collect()} == {"common", "rare"}


def test_log_odds_and_encoding(spark):
    words = frame(spark, [("t", True)] * 30 + [("t", False)] * 10 + [("u", True)] * 5, "token string, label boolean")
    totals = frame(spark, [(True,)] * 50 + [(False,)] * 40, "label boolean")
    got = {r.token: r.lo for r in evidence.log_odds(words, totals=totals).collect()}
    assert got == pytest.approx({"t": np.log(31 / 50) - np.log(11 / 40)})
    pairs = frame(spark, [("a", "x", ["t", "v"]), ("b", "y", [])], "s1_id string, cand_id string, w array<string>")
    table = frame(spark, [("t", 0.5)], "token string, lo double")
    rows = {r.s1_id: r for r in evidence.encode(pairs, "w", table, ["s1_id", "cand_id"], "e").collect()}
    assert (rows["a"].e_sum, rows["a"].e_n, rows["a"].e_unknown) == (0.5, 2, 1) and (rows["b"].e_sum, rows["b"].e_n) == (0.0, 0)


def test_equivalences(spark):
    pairs = frame(spark, [(["main", "street"], ["main", "st"])] * 6 + [(["new", "york", "x"], ["ny", "x"])] * 6, "a array<string>, b array<string>")
    got = {r.variant: r.canonical for r in evidence.mine_equivalences(pairs, "a", "b", least=5).collect()}
    assert got == {"st": "street", "ny": "new"}


def test_calibration_is_monotone_and_clipped(spark):
    rows = frame(spark, [(float(i) / 20, i % 3 == 0 or i > 12) for i in range(20)], "p double, label boolean")
    got = [r.p_cal for r in learn.calibrate(rows, rows).orderBy("p").collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1


def test_scores(spark):
    rows = frame(spark, [(0.1, False), (0.4, False), (0.35, True), (0.8, True)], "p double, label boolean")
    r = learn.scores(rows).first()
    assert r.auc == pytest.approx(0.75) and r.brier == pytest.approx(np.mean([0.01, 0.16, 0.4225, 0.04]))


def test_negative_sampling_weights(spark):
    rows = frame(spark, [(str(i), str(i), i / 3000, i % 30 == 0) for i in range(3000)], "s1_id string, cand_id string, p double, label boolean")
    got = learn.stratified_negatives(rows, 600, F.col("p") > 0.5, ["s1_id", "cand_id"])
    n, w = got.agg(F.count("*"), F.sum("weight")).first()
    assert 480 <= n <= 720 and 2400 <= w <= 3600 and got.where("label").count() == 100


def test_duplicates_and_samples(spark):
    rows = frame(spark, [("k", True, "a"), ("k", False, "b"), ("u", True, "c")], "key string, label boolean, s1_id string")
    assert [(r.key, r.n, r.mixed) for r in audit.duplicate_groups(rows, ["key"]).collect()] == [("k", 2, True)]
    many = spark.range(100).withColumn("g", F.col("id") % 3)
    one = audit.sample_by_group(many, 5, ["g"], ["id"]).collect()
    assert len(one) == 15 and sorted(one) == sorted(audit.sample_by_group(many.repartition(7), 5, ["g"], ["id"]).collect())


def test_tsv_round_trip(spark, tmp_path):
    path = str(tmp_path / "train_source1.tsv")
    with open(path, "w") as f:
        f.write('entity_id\tname\nS1-1\t"quoted" NA\nS1-2\t\nS1-3\tNULL\n')
    df = tsv.read_tsv(spark, path, ["entity_id", "name"])
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S1-1", '"quoted" NA'), ("S1-2", ""), ("S1-3", "NULL")]
    tsv.write_tsv(df, str(tmp_path / "out"))
    assert sorted(tsv.read_tsv(spark, str(tmp_path / "out"), ["entity_id", "name"]).collect()) == sorted(df.collect())
    rows = tsv.catalog(spark, str(tmp_path), "train_*.tsv").collect()
    assert [(r.kind, r.header) for r in rows] == [("source", "entity_id\tname")]


def test_truth_and_lookups(spark):
    truth = frame(spark, [("S1-1", "S2-1,S3-9"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    pairs = tsv.explode_truth(truth)
    assert {tuple(r) for r in pairs.collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-9")}
    assert {tuple(r) for r in tsv.match_counts(truth).collect()} == {("S1-1", 2), ("S1-2", 0)}
    known = frame(spark, [("S1-1",), ("S1-2",), ("S2-1",), ("S2-7",)], "id string")
    view = lambda e: sorted((r.id, r.role, r.status) for r in tsv.entity_view(pairs, truth.withColumnRenamed("source1_entity_id", "s1_id"), known, e).collect())
    group = [("S1-1", "anchor", "group"), ("S2-1", "member", "group"), ("S3-9", "member", "group")]
    assert view("S2-1") == group and view("S1-1") == group
    assert view("S1-2") == [("S1-2", "anchor", "singleton")] and view("S2-7") == [("S2-7", "record", "unmatched")] and view("S9-9") == [("S9-9", "record", "no_gt")]


def test_row_ids_are_gapless(spark):
    df = tsv.with_row_ids(spark.range(50).select((F.col("id") * 7 % 50).alias("k")).repartition(5), "k")
    assert [(r.k, r.row_id) for r in df.orderBy("k").collect()] == [(i, i) for i in range(50)]
    assert [r.k for r in tsv.page(df, 10, 3).collect()] == [10, 11, 12]


def test_row_ids_of_sampled_ranges(spark):
    """Enough rows that range bounds are sampled: numbers are still gapless and in order."""
    df = tsv.with_row_ids(spark.range(1_000_000).select(F.xxhash64("id").alias("k")), "k")
    n, low, high, several = df.agg(F.count("*"), F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")).first()
    assert (n, low, high, several) == (1_000_000, 0, 999_999, 1_000_000)
    assert [r.k for r in tsv.page(df, 500_000, 50).collect()] == sorted(r.k for r in tsv.page(df, 500_000, 50).collect())
    assert df.where("row_id < 1000").agg(F.max("k")).first()[0] < df.where("row_id >= 1000").agg(F.min("k")).first()[0]


def test_scores_of_many_probabilities(spark):
    """The area under the curve over all ranges, with ties across and within them."""
    g = np.random.default_rng(4)
    p = np.round(g.random(3000), 3)
    y = g.random(3000) < p
    rows = frame(spark, [(float(a), bool(b)) for a, b in zip(p, y)], "p double, label boolean")
    pos, neg = p[y], p[~y]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert learn.scores(rows).first().auc == pytest.approx(want)


def test_feature_row(spark):
    records = [(1, "S1", "France", "Acme Ltd", "12 Main Street, area one"), (2, "S2", "France", "Acme Limited", "12 Main St, area one"), (3, "S3", "India", "Kare Holdings", None), (4, "S2", "France", "Zenith", "14 Oak Road")]
    prepared = feature_row.prepared(frame(spark, records, "id long, src string, country string, name string, address string"), ["area one"])
    pairs = frame(spark, [(1, 2), (1, 3), (1, 4)], "s1_id long, cand_id long")
    got = {r.cand_id: r for r in feature_row.feature_row(pairs, prepared).collect()}
    assert len(feature_row.NUMERIC) == 46 and got[2].__fields__ == ["s1_id", "cand_id", *feature_row.NUMERIC, *feature_row.WORDS]
    a = got[2]
    assert (a.nd, a.ad, a.rel, a.src, a.name_same_form, a.n_addr_abbr, a.aempty_rec, a.n_num_s1, a.name_freq_s1) == (1, 0, 0, 2, 1, 1, 0, 1, 1)
    assert a.name_tsr == pytest.approx(D.token_set_ratio("acme ltd", "acme limited")) and a.core_jw == 1.0 and a.sk_jac == 1.0
    b, c = got[3], got[4]
    assert (b.nd, b.ad, b.rel, b.aempty_rec, b.addr_ph_jac, b.addr_tsr) == (9, 8, 7, 1, None, None) and (b.name_added, b.name_dropped) == ("holdings kare", "acme")
    assert (c.nd, c.ad, c.rel, c.n_num_add, c.n_num_drop, c.num_first) == (9, 7, 4, 1, 1, 1) and c.num_logdiff == pytest.approx(np.log(3)) and c.addr_added == "oak road"
    wide = feature_row.audit_row(pairs, prepared)
    assert wide.columns == ["s1_id", "cand_id", *feature_row.AUDIT, *feature_row.WORDS]


def test_string_row(spark):
    df = frame(spark, [("acme red", "acme rad", "akm rd", "akm rd", "1 oak st", "acme", "acme rad x", "akm rd", "akm", "oak")], ", ".join(f"{s}{c} string" for s in "ab" for c in ("core", "name", "skel", "snd", "addr")))
    fields = ("core", "name", "skel", "snd", "addr")
    r = feature_row.string_row(df, {f: f"a{f}" for f in fields}, {f: f"b{f}" for f in fields}).first()
    assert r.core_ratio == pytest.approx(D.ratio("acme red", "acme")) and r.addr_partial == pytest.approx(D.partial_ratio("1 oak st", "oak")) and r.core_len_ratio == 0.5
    assert len(df.columns) + 17 == len(r)


def test_vectors_in_blocks_and_chunks(spark):
    g = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(g.normal(size=(60, 8)))], "id long, vec array<float>")
    one = {tuple(r) for r in retrieve.nearest(df.where("id < 20"), df, 3).select("query_id", "index_id").collect()}
    assert len(one) == 60 and one == {tuple(r) for r in retrieve.nearest(df.where("id < 20"), df, 3, blocks=5, chunks=3).select("query_id", "index_id").collect()}


def test_vectors(spark):
    g = np.random.default_rng(0).normal(size=(40, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(g)], "id long, vec array<float>")
    got = {}
    for r in retrieve.nearest(df.where("id < 5"), df, 3, blocks=4).collect():
        got.setdefault(r.query_id, []).append((-r.cosine, r.index_id))
    u = g / np.linalg.norm(g, axis=1, keepdims=True)
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {i: list(np.argsort(-(u @ u[i]), kind="stable")[:3]) for i in range(5)}


def test_stream_of_records(spark, tmp_path):
    src = str(tmp_path / "in")
    frame(spark, [("S2-1", "Acme C0nsulting Ltd")], "id string, name string").write.parquet(src)
    index = frame(spark, [("S1-1", "acme"), ("S1-2", "zenith")], "s1_id string, token string")
    q = ingest.candidates(ingest.normalised(spark.readStream.schema("id string, name string").parquet(src)), index).writeStream.format("memory").queryName("cands").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT id, s1_id FROM cands").collect()] == [("S2-1", "S1-1")]
