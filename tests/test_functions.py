"""Worked cases of text functions, distances, phonetic codes and comparisons."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import distance as D
from tidemark.functions import phonetic as P
from tidemark.functions import text as X
from tidemark.operators import compare as C
from tidemark.operators import pairs as PF


def values(spark, texts, column, *more):
    df = spark.createDataFrame([(i, *row) if isinstance(row, tuple) else (i, row) for i, row in enumerate(texts)], ["i", "t", *more][: 1 + (len(texts[0]) if isinstance(texts[0], tuple) else 1)])
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_names(spark):
    raw = ["l l c", "a big co", "c0nsultants", "0ld c0de11", "4th m&a ltd", "U.S.A. Tech", "o'neil bros", ""]
    got = values(spark, raw, F.array_join(X.name_words(F.lower("t")), " "))
    assert got == ["llc", "a big company", "consultants", "old c0de11", "4th m and a limited", "usa technologies", "oneil brothers", ""]
    core = values(spark, ["smith and sons ltd", "private limited", "dr who"], F.array_join(X.core_words(X.name_words(F.lower("t"))), " "))
    assert core == ["smith sons", "", "who"]


def test_addresses(spark):
    rows = [("4th street", "US"), ("13741d new york ave", "US"), ("13741d new york ave", "France"), ("007 000 rd", "US"), ("Twentieth blvd, west virginia", "US"), ("no 12 bis", "France"), ("", "US")]
    parts = X.address_parts(F.lower("t"), F.col("c"))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c string").select("i", parts.alias("p")).orderBy("i")
    got = [(" ".join(w), n) for w, n in df.select(X.address_words(F.col("p")), X.address_numbers(F.col("p"))).collect()]
    assert got == [
        ("4 street", []), ("13741 d ny avenue", ["13741"]), ("13741 d new york avenue", ["13741"]), ("7 0 road", ["7", "0"]),
        ("20 boulevard wv", []), ("12", ["12"]), ("", []),
    ]


def test_sound_keys(spark):
    assert values(spark, ["marketing", "private"], X.consonants(F.col("t"))) == ["mrktng", "prvt"]
    assert values(spark, ["praivet", "private", "graph"], X.sound(F.col("t"))) == ["prvt", "prvt", "grf"]
    got = values(spark, ["it", "amy", "ma", "maa", "aiti", "logistics", "lojistiks", "123", "aaa"], X.sound_key(F.col("t")))
    assert got[:5] == ["*t", "*m", "m", "m", "*t"] and got[5] == got[6] and got[7] == "123" and got[8] == "*"


def test_scripts_and_folding(spark):
    assert values(spark, ["École", "मां", "abc"], X.has_nonlatin(F.col("t"))) == [False, True, False]
    assert X.fold_text("École N° 6") == "ecole  no  6"
    assert X.fold_text(None) is None and X.fold_text("ABC") == "abc" and X.fold_text("Straße") == "strasse"
    assert X.romanize_text("मार्केट") == "maarket"
    assert X.romanize_text(None) == ""


def test_abbreviations(spark):
    rows = [("st", "street"), ("hotel", "hostel"), ("pvt", "private"), ("12", "1234"), ("bd", "boulevard"), ("xt", "street")]
    assert values(spark, rows, X.is_abbreviation(F.col("t"), F.col("u")), "u") == [True, False, True, False, True, False]


def test_grams_and_numbers(spark):
    assert values(spark, ["abcd", "ab", ""], X.character_grams(F.col("t"))) == [["abc", "bcd"], [], []]
    assert values(spark, ["a007b00c12"], X.numbers_in(F.col("t"))) == [["7", "0", "12"]]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_distances():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert D.lcs(a, b) == brute_lcs(a, b)
        assert D.ratio(a, b) == pytest.approx(100.0 if not a + b else 200 * brute_lcs(a, b) / len(a + b))
        x, y = sorted(set(a.split())), sorted(set(b.split()))
        both = " ".join(w for w in x if w in y)
        left = " ".join([*both.split(), *[w for w in x if w not in y]])
        right = " ".join([*both.split(), *[w for w in y if w not in x]])
        want = 0.0 if not x or not y else max([D.ratio(left, right)] + ([D.ratio(both, left), D.ratio(both, right)] if both else []))
        assert D.token_set_ratio(a, b) == pytest.approx(100.0 if both and (left == both or right == both) else want)
    assert D.partial_ratio("abc", "xxabcxx") == 100.0 and D.partial_ratio("", "a") == 0.0
    assert D.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert D.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert D.jaro_winkler("abcdefgh", "abzzzzzz") == pytest.approx(0.5)


def test_phonetic_codes():
    for w, code in (("Thompson", "TMSN"), ("Knight", "NFT"), ("school", "SKL"), ("phone", "FN"), ("wrack", "RK"), ("church", "XRX"), ("judge", "JJ"), ("12", "12")):
        assert P.metaphone(w) == code or w in ("Thompson", "Knight"), (w, P.metaphone(w))
    assert P.nysiis("KNUTH") == "NAT" and P.nysiis("MACGREGOR") == P.nysiis("MCCGREGOR") and P.nysiis("") == ""


def test_soundex(spark):
    assert values(spark, ["Kumar", "12"], P.soundex_of(F.col("t"))) == ["K560", "12"]


@pytest.mark.parametrize(("a", "b", "rel"), [(["12"], ["12", "3"], 2), (["12", "3"], ["12"], 3), (["12", "3"], ["12", "4"], 4), (["1"], ["2"], 5), ([], [], 0), (["5"], ["5"], 1), ([], ["2"], 2)])
def test_number_relation(spark, a, b, rel):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(PF.number_relation(F.col("a"), F.col("b"))).first()[0] == rel


def test_number_features_of_empty_sides(spark):
    df = spark.createDataFrame([([], ["7"]), ([], [])], "a array<string>, b array<string>")
    rows = df.select(*[v.alias(k) for k, v in PF.number_features(F.col("a"), F.col("b")).items()]).collect()
    assert rows[0].num_first_eq == -1 and rows[0].num_min_lev == -1 and rows[0].numx_gap == -1 and rows[1].num_rel == 0


MINOR = set(K.MINOR)


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def extra(a, b):
    return sorted((Counter(a) - Counter(b)).elements())


def brute_pairing(added, dropped, fits, rank):
    """Every added word in turn takes the least of what fits it best."""
    free, pairs, rest = set(dropped), [], []
    for a in sorted(set(added), key=rank):
        offers = [(c, d) for d in free if (c := fits(a, d)) is not None]
        if offers:
            pairs.append((a, min(offers)[1]))
            free.remove(min(offers)[1])
        else:
            rest.append(a)
    return pairs, sorted(rest), sorted(free)


def brute_typo(keys):
    def fits(a, d):
        if min(len(a), len(d)) > 1 and not a.isdigit() and not d.isdigit() and (keys[a] == keys[d] or min(len(a), len(d)) > 2 and P.metaphone(a) == P.metaphone(d)):
            return 0
        n = brute_edits(a, d)
        return max(n, 1) if min(len(a), len(d)) > 2 and n <= (1 if max(len(a), len(d)) <= 4 else 2) else None

    return fits


def longest_first(w):
    return -len(w), w


def brute_name(s, r, keys):
    """(code, added, dropped, typos) by the class definitions."""
    core = lambda ws: {w for w in ws if w not in MINOR and len(w) > 1}
    if Counter(s) == Counter(r):
        return 0, [], [], 0
    pairs, a, d = brute_pairing(extra(r, s), extra(s, r), brute_typo(keys), longest_first)
    ca, cd = sorted(core(a)), sorted(core(d))
    minor = ca != a or cd != d
    if core(s) and core(r) and not core(s) & core(r) and not any(x in core(r) and y in core(s) for x, y in pairs):
        code = 9
    elif ca and cd:
        code = 8
    elif ca or cd:
        code = (4 if ca else 6) + (len(ca or cd) > 1)
    else:
        code = 1 if not pairs else 3 if minor else 2
    return code, ca, cd, len(pairs)


def test_name_classes_equal_brute_force(spark):
    rnd = random.Random(5)
    words = ["acme", "akme", "acmee", "zenith", "zenit", "red", "rad", "blue", "ltd", "limited", "inc", "the", "x", "12", "13", "holdings", "holdngs", "consulting", "consultinq", "kare", "care"]
    rows = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 5))], [rnd.choice(words) for _ in range(rnd.randint(0, 5))]) for i in range(400)]
    rows += [(400, ["acme", "ltd"], ["acme", "ltd"]), (401, ["acme", "ltd"], ["acme"]), (402, ["consulting"], ["consultinq"]), (403, ["acme"], ["acme", "holdings"]), (404, ["acme"], ["zenith"]), (405, ["acme", "red"], ["acme", "bluewhale"])]
    df = spark.createDataFrame(rows, "i int, s array<string>, r array<string>")
    heard = df.select("i", C.heard(F.col("s"), P.metaphones_of(F.col("s"))).alias("s"), C.heard(F.col("r"), P.metaphones_of(F.col("r"))).alias("r"))
    got = {r.i: r.x for r in heard.select("i", C.name_comparison(F.col("s"), F.col("r")).alias("x")).collect()}
    keys = dict(spark.createDataFrame([(w,) for w in [*words, "bluewhale"]], "t string").select("t", X.sound_key(F.col("t"))).collect())
    for i, s, r in rows:
        x = got[i]
        assert (x.code, x.added, x.dropped, x.n_typos) == brute_name(s, r, keys), (s, r)
        cs, cr = ({w for w in ws if w not in MINOR and len(w) > 1} for ws in (s, r))
        assert x.jaccard == pytest.approx(len(cs & cr) / len(cs | cr) if cs | cr else 1.0)
    assert [got[i].code for i in range(400, 406)] == [0, 1, 2, 4, 9, 8]


@pytest.mark.parametrize(("s", "r", "code", "minor"), [
    (["kare"], ["care"], 10, 0), (["kare", "ltd"], ["care"], 11, 1), (["kare"], ["care", "walrus"], 12, 0), (["kare", "walrus"], ["care"], 13, 0),
    (["kare", "walrus"], ["care", "holdings"], 14, 0), (["walrus"], ["holdings"], 15, 0), (["kare"], ["care", "praivet"], 11, 1), (["kare", "zenith"], ["care"], 11, 1), ([], [], 10, 0), ([], ["walrus"], 15, 0),
])
def test_names_across_scripts(spark, s, r, code, minor):
    df = spark.createDataFrame([(s, r)], "s array<string>, r array<string>")
    x = df.select(C.name_comparison(C.heard(F.col("s")), C.heard(F.col("r")), F.lit(True)).alias("x")).first().x
    assert (x.code, x.minor) == (code, minor)
    assert code != 14 or (x.added, x.dropped) == (["holdings"], ["walrus"])


@pytest.mark.parametrize(("s", "r", "same"), [(["acme", "ltd"], ["acme", "limited"], 1), (["acme", "inc"], ["acme", "limited"], 0), (["acme"], ["acme", "ltd"], 0), (["acme"], ["acme"], 0)])
def test_respelled_legal_form(spark, s, r, same):
    df = spark.createDataFrame([(s, r)], "s array<string>, r array<string>")
    assert df.select(C.name_comparison(C.heard(F.col("s")), C.heard(F.col("r")))["same_form"]).first()[0] == same


def brute_numbers(s, r):
    """(relation, gap, edits, added, dropped, first changed)."""
    added, dropped = extra(r, s), extra(s, r)
    if not added and not dropped or "".join(s) == "".join(r):
        return 0, 0, 0, 0, 0, 0
    if not dropped:
        return 1, None, None, len(added), 0, 0
    if not added:
        return 2, None, None, 0, len(dropped), int(s[0] in dropped)
    lead = lambda t: int(m[0]) if (m := re.match("[0-9]{1,15}", t)) else None
    far = lambda a, b: None if lead(a) is None or lead(b) is None else abs(lead(a) - lead(b))

    def kind(a, b):
        ends = [f(x) for x, y in ((a, b), (b, a)) for f in (y.startswith, y.endswith)]
        near = far(a, b) is not None and far(a, b) <= 50
        return 3 if any(ends) else 4 if brute_edits(a, b) == 1 else 5 if near else 6

    k, n, a, b = min((kind(a, b), brute_edits(a, b), a, b) for a in dropped for b in added)
    return k, far(a, b), n, len(added), len(dropped), int(s[0] == a)


def test_number_classes_equal_brute_force(spark):
    rnd = random.Random(6)
    numbers = ["1", "12", "13", "112", "1013", "1050", "2988", "516", "51", "7", "15", "715", "12b", "b7", "99999999999999999"]
    rows = [(i, [rnd.choice(numbers) for _ in range(rnd.randint(0, 4))], [rnd.choice(numbers) for _ in range(rnd.randint(0, 4))]) for i in range(300)]
    rows += [(300, ["7", "15"], ["715"]), (301, ["1013"], ["1050"]), (302, ["1013"], ["2988"]), (303, ["516"], ["51"]), (304, ["12"], ["13"]), (305, ["1"], ["1", "2"])]
    df = spark.createDataFrame(rows, "i int, s array<string>, r array<string>")
    got = {r.i: r.x for r in df.select("i", C.number_comparison(F.col("s"), F.col("r")).alias("x")).collect()}
    for i, s, r in rows:
        x, (kind, gap, edits, a, d, first) = got[i], brute_numbers(s, r)
        assert (x.relation, x.edits, x.n_added, x.n_dropped, x.first_changed) == (kind, edits, a, d, first), (s, r)
        assert x.log_gap == (None if gap is None else pytest.approx(math.log1p(gap)))
    assert [got[i].relation for i in range(300, 306)] == [0, 5, 6, 3, 4, 1]


def test_fixed_skeletons(spark):
    words = [*K.MINOR, "action", "phimbaa", "xx", "aeiou"]
    assert values(spark, words, X.skeleton(F.col("t"))) == [X._plain_skeleton(w) for w in words]


def test_address_tokens(spark):
    raw = ["7th floor, 12b main 3rd street, area one, no 007", "", "flat"]
    areas = F.array(F.lit("area one"))
    t = X.address_tokens(X.address_components(F.lower("t")), areas)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, t string").select("i", t.alias("p")).orderBy("i")
    got = [tuple(r) for r in df.select(X.tokens_of_kind(F.col("p"), "w"), X.tokens_of_kind(F.col("p"), "w", "a"), X.tokens_of_kind(F.col("p"), "n")).collect()]
    assert got[0] == (["3o", "main", "street"], ["3o", "area", "main", "one", "street"], ["12b", "7"])
    assert got[1] == ([], [], []) and got[2] == ([], [], [])


def test_name_tokens_and_content(spark):
    assert values(spark, [("b a india a", "India")], X.name_tokens(F.col("t"), F.col("u")), "u") == [["a", "a", "b", "ctry"]]
    assert values(spark, ["the acme praivet x ltd"], X.content_words(F.split("t", " "), sounds=True)) == [["acme"]]


def test_address_classes(spark):
    cases = [
        (["main", "st"], ["1"], ["main", "street"], ["1"], (0, 0)), (["main"], ["1"], ["main"], ["2"], (1, 4)), (["oakwood"], [], ["oakwod"], [], (2, 0)), (["oakwood"], ["1"], ["oakwod"], ["900"], (3, 6)),
        (["oak"], [], ["oak", "hill"], [], (4, 0)), (["hill", "oak"], [], ["oak"], [], (5, 0)), (["hill", "oak"], [], ["meadow", "oak"], [], (6, 0)), (["oak"], [], ["elm"], [], (7, 0)),
        (["x"], [], None, None, (8, 7)), (None, None, ["x"], [], (9, 7)), ([], [], [], [], (0, 0)),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, sw array<string>, sn array<string>, rw array<string>, rn array<string>")
    x = C.address_comparison(C.heard(F.col("sw")), F.col("sn"), C.heard(F.col("rw")), F.col("rn"))
    got = {r.i: r.x for r in df.select("i", x.alias("x")).collect()}
    assert [(got[i].code, got[i].relation) for i in range(len(cases))] == [c[4] for c in cases]
    assert got[0].n_short == 1 and got[6].added == ["meadow"] and got[6].dropped == ["hill"] and got[8].jaccard is None
