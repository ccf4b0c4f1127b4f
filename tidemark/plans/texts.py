"""Text queries: normalisation, keys, similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import distance as D
from tidemark.functions import phonetic as P
from tidemark.functions import text as X
from tidemark.plans.core import NAMES, names, query
from tidemark.sources.tables import table


def _lists(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


_SQL_TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^0-9a-z]+', ' ', 'g'), ' '), lambda t: t <> '')"


@query(f"SELECT doc_id, {_SQL_TOKENS.format('text')} AS tokens FROM documents")
def tokenise(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", X.tokens(F.lower("text")).alias("tokens"))


@query(r"""SELECT doc_id, regexp_matches(text, '[^\x00-\x{024F}]') AND regexp_matches(text, '[\x{0250}-\x{02FF}\x{0370}-\x{1FFF}\x{3040}-\x{D7FF}]') AS nonlatin,
  CASE WHEN regexp_matches(text, '[\x{00C0}-\x{024F}]') THEN 'latin_extended' ELSE 'ascii' END AS script FROM documents""")
def scripts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", X.has_nonlatin(F.col("text")).alias("nonlatin"), X.script_of(F.col("text")).alias("script"))


@query(f"""WITH t AS (SELECT p_partkey AS id, {_SQL_TOKENS.format("replace(replace(p_name || ' & co ltd c0ty', '&', ' and '), '''', '')")} AS a FROM part),
u AS (SELECT id, list_transform(a, lambda t: CASE WHEN t = 'c0ty' THEN 'coty' ELSE t END) AS a FROM t),
v AS (SELECT id, list_filter(list_transform(a, lambda t: coalesce(({_map(K.NAME_ABBR)})[t], t)), lambda t: t <> '') AS a FROM u)
SELECT id, array_to_string(a, ' ') AS name_norm, array_to_string(list_filter(a, lambda t: NOT list_contains({_lists((*K.LEGAL, *K.HONOR))}, t)), ' ') AS name_core FROM v""")
def normalise_names(spark: SparkSession, root: str) -> DataFrame:
    raw = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" & co ltd c0ty")).alias("raw"))
    rows = raw.select("id", X.name_words(F.lower("raw")).alias("w"))
    return rows.select("id", F.array_join("w", " ").alias("name_norm"), F.array_join(X.core_words(F.col("w")), " ").alias("name_core"))


@query("""SELECT s_suppkey AS id, (s_suppkey % 97) || ' ' || (s_nationkey) || ' new york street ' AS expected_start,
  array_to_string([(s_suppkey % 97)::VARCHAR, '4', CASE WHEN s_nationkey < 12 THEN 'ny' ELSE 'new york' END, 'street', s_nationkey::VARCHAR, 'd'], ' ') AS addr_norm,
  array_to_string([(s_suppkey % 97)::VARCHAR, s_nationkey::VARCHAR], ' ') AS nums FROM supplier""")
def normalise_addresses(spark: SparkSession, root: str) -> DataFrame:
    """Addresses built from supplier columns: house number, ordinal, state, abbreviation, mixed number."""
    s = table(spark, root, "supplier")
    raw = F.concat(F.lit("00"), F.col("s_suppkey") % 97, F.lit(" 4th New York St, "), F.col("s_nationkey"), F.lit("d"))
    country = F.when(F.col("s_nationkey") < 12, "US").otherwise("France")
    rows = s.select(F.col("s_suppkey").alias("id"), "s_nationkey", "s_suppkey", X.address_parts(F.lower(raw), country).alias("parts"))
    return rows.select(
        "id", F.concat(F.col("s_suppkey") % 97, F.lit(" "), "s_nationkey", F.lit(" new york street ")).alias("expected_start"),
        F.array_join(X.address_words(F.col("parts")), " ").alias("addr_norm"), F.array_join(X.address_numbers(F.col("parts")), " ").alias("nums"),
    )


def _words(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(F.explode(X.tokens(F.lower("text"))).alias("w")).distinct()


_SQL_WORDS = f"words AS (SELECT DISTINCT w FROM (SELECT unnest({_SQL_TOKENS.format('text')}) AS w FROM documents))"
_REP = "(a+|b+|c+|d+|e+|f+|g+|h+|i+|j+|k+|l+|m+|n+|o+|p+|q+|r+|s+|t+|u+|v+|w+|x+|y+|z+|0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)"


def _sql_single(x: str) -> str:
    """DuckDB's regular expressions have no back references."""
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{_REP}'), lambda r: r[1]), '')"


def _sql_sounds(x: str, nasal: str) -> str:
    for a, b in K.DIGRAPHS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"translate(regexp_replace(regexp_replace({x}, 'm([{nasal}])', 'n\\1', 'g'), 'm([{nasal}])', 'n\\1', 'g'), '{K.SOUND_LETTERS[0]}', '{K.SOUND_LETTERS[1]}')"


@query(f"""WITH {_SQL_WORDS}, s AS (SELECT w, {_sql_sounds('w', K.NASAL_BEFORE_1)} AS a, {_sql_sounds("regexp_replace(w, '[ts]ion', 'sn', 'g')", K.NASAL_BEFORE_2)} AS b FROM words)
SELECT w, {_sql_single("w[1] || regexp_replace(w[2:], '[aeiouyh]', '', 'g')")} AS consonants, {_sql_single("a[1] || regexp_replace(a[2:], '[aeiou]', '', 'g')")} AS sound,
  CASE WHEN regexp_full_match(w, '[0-9]+') THEN w WHEN regexp_full_match(b, '[aeiou]+') THEN b[1] ELSE {_sql_single("regexp_replace(b, '[aeiou]+', '', 'g')")} END AS skeleton FROM s""")
def sound_keys(spark: SparkSession, root: str) -> DataFrame:
    w = F.col("w")
    return _words(spark, root).select("w", X.consonants(w).alias("consonants"), X.sound(w).alias("sound"), X.skeleton(w).alias("skeleton"))


@query()
def phonetic_codes(spark: SparkSession, root: str) -> DataFrame:
    w = F.col("w")
    return _words(spark, root).select("w", X.sound_key(w).alias("sound_key"), P.soundex_of(w).alias("soundex"), P.metaphone_of(w).alias("metaphone"), P.nysiis_of(w).alias("nysiis"))


@query(f"""WITH {NAMES}, t AS (SELECT DISTINCT split_part(name, ' ', 1) AS a, split_part(name, ' ', 2) AS b FROM names), u AS (SELECT a[1] || a[len(a)] AS s, a FROM t UNION SELECT a, a || b FROM t)
SELECT s AS short, a AS long, s[1] = a[1] AND NOT regexp_full_match(s, '[0-9]+') AND ((length(s) <= 4 AND length(a) >= length(s) + 2) OR (length(s) = 5 AND length(a) >= 10))
  AND regexp_matches(a, '^' || array_to_string(string_split(s, ''), '.*')) AS abbreviates FROM u""")
def abbreviations(spark: SparkSession, root: str) -> DataFrame:
    t = names(spark, root).select(F.split("name", " ")[0].alias("a"), F.split("name", " ")[1].alias("b")).distinct()
    u = t.select(F.concat(F.substring("a", 1, 1), F.right(F.col("a"), F.lit(1))).alias("short"), F.col("a").alias("long")).union(t.select("a", F.concat("a", "b"))).distinct()
    return u.select("short", "long", X.is_abbreviation(F.col("short"), F.col("long")).alias("abbreviates"))


@query("""SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END) AS nums,
  trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', ' ', 'g'), '[^a-z]+', ' ', 'g')) AS k1 FROM documents""")
def numbers_and_keys(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", X.numbers_in(F.col("text")).alias("nums"), X.denumbered(F.col("text"))[0].alias("k1"))


@query(f"""WITH {NAMES}, t AS (SELECT id, string_split(name, ' ') AS a, [split_part(name, ' ', 2), country] AS b FROM names)
SELECT id, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), ' ') || '|' || array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ' ') AS signature,
  round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard FROM t""")
def signatures_and_jaccard(spark: SparkSession, root: str) -> DataFrame:
    t = names(spark, root).select("id", F.split("name", " ").alias("a"), F.array(F.split("name", " ")[1], F.col("country")).alias("b"))
    return t.select("id", X.difference_signature(F.col("a"), F.col("b")).alias("signature"), F.round(X.jaccard(F.col("a"), F.col("b"), 1.0), 9).alias("jaccard"))


def _name_pairs(spark: SparkSession, root: str) -> DataFrame:
    n = names(spark, root).select("name").distinct()
    o = n.select(F.col("name").alias("other"), F.substring("name", 1, 1).alias("k"))
    return n.withColumn("k", F.substring("name", 1, 1)).join(o, "k").select("name", "other")


_SQL_NAME_PAIRS = f"{NAMES}, n AS (SELECT DISTINCT name FROM names), np AS (SELECT a.name, b.name AS other FROM n a JOIN n b ON a.name[1] = b.name[1])"


@query(f"WITH {_SQL_NAME_PAIRS} SELECT name, other, levenshtein(name, other)::INT AS lev, CASE WHEN levenshtein(name, other) <= 5 THEN levenshtein(name, other) ELSE -1 END::INT AS lev5, round(jaro_winkler_similarity(name, other), 6) AS jw FROM np")
def edit_distances(spark: SparkSession, root: str) -> DataFrame:
    rows = _name_pairs(spark, root)
    return rows.select("name", "other", F.levenshtein("name", "other").alias("lev"), F.levenshtein("name", "other", 5).alias("lev5"), F.round(D.similarity("jaro_winkler")(F.col("name"), F.col("other")), 6).alias("jw"))


@query()
def fuzzy_similarities(spark: SparkSession, root: str) -> DataFrame:
    kinds = ("ratio", "token_set_ratio", "token_sort_ratio", "partial_ratio", "jaro_winkler", "sequence_ratio", "name_similarity")
    return D.on_distinct(_name_pairs(spark, root), "name", "other", kinds).select("name", "other", "sim.*")


@query(f"WITH {_SQL_NAME_PAIRS}, s AS (SELECT *, jaro_winkler_similarity(name, other) AS jw FROM np WHERE name <> other) SELECT name, other FROM s WHERE jw >= 0.7 QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(jw, 9) DESC, other) = 1")
def extract_best(spark: SparkSession, root: str) -> DataFrame:
    """The most similar other string above a cutoff."""
    s = _name_pairs(spark, root).where("name <> other").withColumn("jw", D.similarity("jaro_winkler")(F.col("name"), F.col("other"))).where("jw >= 0.7")
    from tidemark.operators.windows import top_k

    return top_k(s.withColumn("jw", F.round("jw", 9)), 1, "jw", "name", ties=("other",)).select("name", "other")


@query()
def fold_to_ascii(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))
