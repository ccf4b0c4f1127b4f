"""Scans, projections, filters, joins, aggregates, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.operators import windows as W
from tidemark.plans.core import ANCHORS, NAMES, PAIRS, anchors, names, pairs, query
from tidemark.sources.tables import table


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


# projections and filters


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, 1 AS one, (o_orderkey % 100)::SMALLINT AS narrow, greatest(least(o_totalprice, 100000), 50000) AS clipped FROM orders")
def projections(spark: SparkSession, root: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, root, "orders").select(
        "o_orderkey", (price * 2).alias("twice"), F.when(price > 200000, "high").when(price > 100000, "mid").otherwise("low").alias("band"),
        F.lit(1).alias("one"), (F.col("o_orderkey") % 100).cast("smallint").alias("narrow"), F.greatest(F.least(price, F.lit(100000.0)), F.lit(50000.0)).alias("clipped"),
    )


@query("SELECT s_key, c_key, best, worst, total FROM (SELECT l_orderkey AS s_key, l_partkey AS c_key, greatest(l_tax, l_discount) AS best, least(l_tax, l_discount) AS worst, round(l_tax + l_discount, 6) AS total FROM lineitem WHERE l_linenumber <= 2 OR l_quantity >= 45)")
def horizontal_and_pruning(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").where((F.col("l_linenumber") <= 2) | (F.col("l_quantity") >= 45))
    return rows.select(
        F.col("l_orderkey").alias("s_key"), F.col("l_partkey").alias("c_key"), F.greatest("l_tax", "l_discount").alias("best"),
        F.least("l_tax", "l_discount").alias("worst"), F.round(F.col("l_tax") + F.col("l_discount"), 6).alias("total"),
    )


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 IN (2, 3, 4) AND o_orderkey % 1000 < 250 AND o_totalprice BETWEEN 50000 AND 150000 AND o_orderstatus IN ('O', 'F')")
def fold_sample_between(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("o_orderkey")
    keep = (key % 10).isin(2, 3, 4) & (key % 1000 < 250) & F.col("o_totalprice").between(50000, 150000) & F.col("o_orderstatus").isin("O", "F")
    return table(spark, root, "orders").where(keep).select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id, regexp_matches(text, '[äöüßÄÖÜ]') AS umlaut, regexp_matches(text, '[0-9]{5}') AS digits, contains(text, 'License') AS license FROM documents")
def regex_predicates(spark: SparkSession, root: str) -> DataFrame:
    text = F.col("text")
    return table(spark, root, "documents").select("doc_id", text.rlike("[äöüßÄÖÜ]").alias("umlaut"), text.rlike("[0-9]{5}").alias("digits"), text.contains("License").alias("license"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity > 25)::INT + 2 * (l_discount > 0.05)::INT + 4 * (l_tax > 0.04)::INT AS reach FROM lineitem")
def key_bitmask(spark: SparkSession, root: str) -> DataFrame:
    bits = [F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04]
    reach = sum((F.shiftleft(b.cast("int"), i) for i, b in enumerate(bits)), F.lit(0))
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", reach.alias("reach"))


@query("SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, n_orders IS NULL AS missing FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def zero_filled_counts(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    rows = table(spark, root, "customer").select("c_custkey").join(n, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.col("n_orders").isNull().alias("missing"))


@query("SELECT o_orderkey, CASE WHEN l.price IS NOT NULL THEN l.price ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS price FROM lineitem WHERE l_quantity > 40 GROUP BY 1) l ON o_orderkey = l_orderkey")
def update_by_key(spark: SparkSession, root: str) -> DataFrame:
    changes = table(spark, root, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"))
    return R.update_by_key(table(spark, root, "orders").select("o_orderkey", "o_totalprice"), changes, ["o_orderkey"])


# joins


def _two_models(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    p = pairs(spark, root)
    return p.where("p >= 0.3").select("s1_id", "cand_id", "p"), p.where("score < 60000").select("s1_id", "cand_id", (F.col("score") / 60000).alias("p_t"))


@query(f"""WITH {PAIRS}, a AS (SELECT s1_id, cand_id, p FROM pairs WHERE p >= 0.3), b AS (SELECT s1_id, cand_id, score / 60000 AS p_t FROM pairs WHERE score < 60000)
SELECT s1_id, cand_id, coalesce(p, 0) AS p, coalesce(p_t, 0) AS p_t, (p IS NULL)::INT AS no_p, (p_t IS NULL)::INT AS no_t,
  (coalesce(p, 0) + coalesce(p_t, 0)) / 2 AS p_mean, coalesce(p, 0) - coalesce(p_t, 0) AS p_diff FROM a FULL JOIN b USING (s1_id, cand_id)""")
def full_outer_models(spark: SparkSession, root: str) -> DataFrame:
    a, b = _two_models(spark, root)
    rows = a.join(b, ["s1_id", "cand_id"], "full").withColumns({"no_p": F.col("p").isNull().cast("int"), "no_t": F.col("p_t").isNull().cast("int")}).fillna(0.0, ["p", "p_t"])
    return rows.withColumns({"p_mean": (F.col("p") + F.col("p_t")) / 2, "p_diff": F.col("p") - F.col("p_t")})


@query(f"WITH {PAIRS} SELECT s1_id, cand_id FROM pairs a WHERE p >= 0.3 AND NOT EXISTS (SELECT 1 FROM pairs b WHERE score < 60000 AND a.s1_id = b.s1_id AND a.cand_id = b.cand_id)")
def anti_join_new_pairs(spark: SparkSession, root: str) -> DataFrame:
    a, b = _two_models(spark, root)
    return a.select("s1_id", "cand_id").join(b, ["s1_id", "cand_id"], "left_anti")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def semi_join(spark: SparkSession, root: str) -> DataFrame:
    hit = table(spark, root, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, root, "orders").select("o_orderkey", "o_orderpriority").join(hit, "o_orderkey", "left_semi")


@query(f"WITH {PAIRS}, {ANCHORS}, {NAMES} SELECT s1_id, cand_id, a.country AS s_country, n.name AS c_name, n.num AS c_num FROM pairs JOIN anchors a USING (s1_id) JOIN names n ON cand_id = n.id")
def attribute_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Attributes of both sides of a pair."""
    s = anchors(spark, root).withColumnRenamed("country", "s_country")
    c = names(spark, root).select(F.col("id").alias("cand_id"), F.col("name").alias("c_name"), F.col("num").alias("c_num"))
    return pairs(spark, root).select("s1_id", "cand_id").join(s, "s1_id").join(c, "cand_id")


@query(f"""WITH {PAIRS}, c AS (SELECT * FROM pairs WHERE p >= 0.8)
SELECT a.s1_id, a.cand_id, max(c.p) AS view_p, count(c.cand_id) AS view_n, coalesce(bool_or(c.label), false) AS view_label FROM pairs a
LEFT JOIN c ON a.s1_id = c.s1_id AND a.src <> c.src AND a.cand_id <> c.cand_id GROUP BY 1, 2""")
def confident_views(spark: SparkSession, root: str) -> DataFrame:
    """Confident records of the same anchor from another source."""
    a = pairs(spark, root).select("s1_id", "cand_id", "src")
    v = pairs(spark, root).where("p >= 0.8").select("s1_id", F.col("cand_id").alias("v_id"), F.col("src").alias("v_src"), F.col("p").alias("v_p"), F.col("label").alias("v_label"))
    v = v.withColumnRenamed("s1_id", "v_s1")
    on = (F.col("s1_id") == F.col("v_s1")) & (F.col("src") != F.col("v_src")) & (F.col("cand_id") != F.col("v_id"))
    return a.join(v, on, "left").groupBy("s1_id", "cand_id").agg(
        F.max("v_p").alias("view_p"), F.count("v_id").alias("view_n"), F.coalesce(F.max("v_label"), F.lit(False)).alias("view_label")
    )


@query(f"""WITH {NAMES}, u AS (SELECT name, num, min(id) AS id FROM names WHERE id % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT r.id AS cand_id, u.id AS s1_id FROM names r JOIN u USING (name, num) WHERE r.id % 2 = 1""")
def unique_key_join(spark: SparkSession, root: str) -> DataFrame:
    n = names(spark, root)
    s = n.where("id % 2 = 0").select("name", "num", F.col("id").alias("s1_id"))
    c = n.where("id % 2 = 1").select("name", "num", F.col("id").alias("cand_id"))
    return R.unique_key_join(s, c, ["name", "num"]).select("cand_id", "s1_id")


@query(f"""WITH {NAMES}, k AS (SELECT id, unnest([0, 1, 2]) AS i, unnest([name, country || num, split_part(name, ' ', 1) || num]) AS v FROM names),
s AS (SELECT DISTINCT * FROM k WHERE id % 5 = 0), c AS (SELECT DISTINCT * FROM k WHERE id % 5 <> 0), b AS (SELECT i, v FROM s GROUP BY 1, 2 HAVING count(*) <= 30)
SELECT s.id AS s1_id, c.id AS cand_id, sum(1 << s.i)::BIGINT AS reach FROM s JOIN b USING (i, v) JOIN c USING (i, v) GROUP BY 1, 2""")
def blocking_join(spark: SparkSession, root: str) -> DataFrame:
    n = names(spark, root).select("id", F.col("name").alias("k1"), F.concat("country", "num").alias("k2"), F.concat(F.split("name", " ")[0], F.col("num")).alias("k3"))
    return R.blocking_join(n.where("id % 5 = 0").withColumnRenamed("id", "s1_id"), n.where("id % 5 <> 0").withColumnRenamed("id", "cand_id"), ["k1", "k2", "k3"], "s1_id", "cand_id", 30)


@query(f"""WITH {NAMES}, s AS (SELECT name, num FROM names WHERE id % 3 = 0), c AS (SELECT * FROM names WHERE id % 3 <> 0)
SELECT (SELECT count(*) FROM c WHERE name IN (SELECT name FROM s)) AS same_name, (SELECT count(*) FROM c WHERE (name, num) IN (SELECT name, num FROM s)) AS same_both, (SELECT count(*) FROM c) AS n""")
def cross_dataset_overlap(spark: SparkSession, root: str) -> DataFrame:
    n = names(spark, root)
    s, c = n.where("id % 3 = 0"), n.where("id % 3 <> 0")
    by_name, by_both = s.select("name").distinct().withColumn("a", F.lit(1)), s.select("name", "num").distinct().withColumn("b", F.lit(1))
    return c.join(by_name, "name", "left").join(by_both, ["name", "num"], "left").agg(F.count("a").alias("same_name"), F.count("b").alias("same_both"), F.count("*").alias("n"))


@query(f"WITH {NAMES} SELECT n.id, f.n AS name_freq FROM names n JOIN (SELECT country, name, count(*) AS n FROM names GROUP BY 1, 2) f USING (country, name)")
def frequency_broadcast_back(spark: SparkSession, root: str) -> DataFrame:
    n = names(spark, root)
    return n.join(n.groupBy("country", "name").agg(F.count("*").alias("name_freq")), ["country", "name"]).select("id", "name_freq")


@query("""WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[0-9]+', '', 'g') AS k FROM documents), c AS (SELECT k, count(*) AS n, min(doc_id) AS first FROM k WHERE length(k) >= 6 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
SELECT doc_id, first AS best_id, n AS bucket FROM k JOIN c USING (k)""")
def denumbered_key_join(spark: SparkSession, root: str) -> DataFrame:
    """Texts that are equal but for numbers; keys that are too short or too common are left out."""
    k = table(spark, root, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[0-9]+", "").alias("k"))
    c = k.where(F.length("k") >= 6).groupBy("k").agg(F.count("*").alias("bucket"), F.min("doc_id").alias("best_id")).where("bucket BETWEEN 2 AND 50")
    return k.join(c, "k").select("doc_id", "best_id", "bucket")


# aggregates


@query(f"""WITH {PAIRS} SELECT src, sum(p) FILTER (WHERE label) IS NOT NULL AS any_label, count(*) AS n, count_if(p > 0.5) AS n_high, round(avg((p > 0.5)::INT::DOUBLE), 9) AS high_rate,
  round(sum(p), 4) AS p_sum, max(p) AS p_max, min(p) AS p_min, round(avg(p), 9) AS p_mean, bool_or(label) AS any_true, bool_and(label) AS all_true, count(DISTINCT s1_id) AS n_anchors FROM pairs GROUP BY src""")
def conditional_aggregates(spark: SparkSession, root: str) -> DataFrame:
    high = F.col("p") > 0.5
    return pairs(spark, root).groupBy("src").agg(
        F.sum(F.when(F.col("label"), F.col("p"))).isNotNull().alias("any_label"), F.count("*").alias("n"), F.count_if(high).alias("n_high"),
        F.round(F.avg(high.cast("double")), 9).alias("high_rate"), F.round(F.sum("p"), 4).alias("p_sum"), F.max("p").alias("p_max"), F.min("p").alias("p_min"),
        F.round(F.avg("p"), 9).alias("p_mean"), F.bool_or("label").alias("any_true"), F.bool_and("label").alias("all_true"), F.count_distinct("s1_id").alias("n_anchors"),
    )


@query("""SELECT l_orderkey AS s1_id, l_partkey AS cand_id, coalesce(max(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 0) AS score_o, coalesce(max(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 0) AS score_f,
  coalesce(min(l_linenumber) FILTER (WHERE l_linestatus = 'O'), 99)::INT AS rank_q_o, coalesce(min(l_linenumber) FILTER (WHERE l_linestatus = 'F'), 99)::INT AS rank_q_f,
  coalesce(min(l_linenumber + 1) FILTER (WHERE l_linestatus = 'O'), 99)::INT AS rank_s_o, coalesce(min(l_linenumber + 1) FILTER (WHERE l_linestatus = 'F'), 99)::INT AS rank_s_f,
  max(l_extendedprice) AS score, min(l_linenumber)::INT AS rank_q, min(l_linenumber + 1)::INT AS rank_s, count(DISTINCT l_linestatus)::INT AS n_retrievers FROM lineitem GROUP BY 1, 2""")
def union_of_retrievers(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("cand_id"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").cast("int").alias("rank_q"),
        (F.col("l_linenumber") + 1).cast("int").alias("rank_s"), "l_linestatus",
    )
    return R.union_retrievers({"o": rows.where("l_linestatus = 'O'"), "f": rows.where("l_linestatus = 'F'")})


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_detection(spark: SparkSession, root: str) -> DataFrame:
    return _count(table(spark, root, "orders"), "o_custkey", "o_orderpriority").where("n > 1")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) = 1")
def keep_unrepeated(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority)::INT AS group_id FROM orders")
def group_ids(spark: SparkSession, root: str) -> DataFrame:
    """Dense ids of groups; the distinct keys are numbered, not the rows."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderpriority")
    ids = orders.select("o_orderpriority").distinct().withColumn("group_id", F.dense_rank().over(Window.orderBy("o_orderpriority")))
    return orders.join(ids, "o_orderpriority").select("o_orderkey", "group_id")


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY 1")
def value_counts(spark: SparkSession, root: str) -> DataFrame:
    n = _count(table(spark, root, "documents"), "lang")
    total = table(spark, root, "documents").agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("lang", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))  # one row


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS q25,
  round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS high FROM orders GROUP BY 1""")
def describe_by_group(spark: SparkSession, root: str) -> DataFrame:
    x = "o_totalprice"
    r = lambda c: F.round(c, 4)
    return table(spark, root, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), r(F.avg(x)).alias("mean"), r(F.stddev_samp(x)).alias("std"), F.min(x).alias("low"), r(F.percentile(x, 0.25)).alias("q25"),
        r(F.median(x)).alias("mid"), r(F.percentile(x, 0.75)).alias("q75"), F.max(x).alias("high"),
    )


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(corr(l_orderkey, l_partkey), 6) AS r_ids FROM lineitem")
def correlations(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.corr("l_orderkey", "l_partkey"), 6).alias("r_ids"))


@query("SELECT least(greatest(floor(l_quantity / 5), 0), 9)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark: SparkSession, root: str) -> DataFrame:
    return _count(table(spark, root, "lineitem").select(F.least(F.greatest(F.floor(F.col("l_quantity") / 5), F.lit(0)), F.lit(9)).cast("int").alias("bin")), "bin")


@query("""WITH c AS (SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1)
SELECT l_returnflag, f, o, round(f / (f + o), 9) AS f_share FROM c""")
def pivot_share(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0, ["F", "O"])
    return p.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"), F.round(F.col("F") / (F.col("F") + F.col("O")), 9).alias("f_share"))


@query(f"WITH {PAIRS}, {ANCHORS}, m AS (SELECT s1_id, string_agg(cand_id::VARCHAR, ',' ORDER BY cand_id::VARCHAR) AS ids FROM pairs WHERE p > 0.9 GROUP BY 1) SELECT s1_id, coalesce(ids, '') AS matched_entity_ids FROM anchors LEFT JOIN m USING (s1_id)")
def match_lists(spark: SparkSession, root: str) -> DataFrame:
    return R.collected(pairs(spark, root).where("p > 0.9").select("s1_id", F.col("cand_id").cast("string").alias("cand_id")), anchors(spark, root))


@query(f"WITH {PAIRS} SELECT cand_id, s1_id, score FROM pairs QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, s1_id) = 1")
def arg_max(spark: SparkSession, root: str) -> DataFrame:
    best = F.max_by(F.struct("s1_id", "score"), F.struct(F.col("score"), -F.col("s1_id"))).alias("b")
    return pairs(spark, root).groupBy("cand_id").agg(best).select("cand_id", "b.s1_id", "b.score")


@query(f"""WITH {PAIRS} SELECT s1_id % 7 AS pattern, src, count(*) AS n, count_if(label) AS n_true, count_if(label) * 2 >= count(*) AS majority,
  round(least(count_if(label), count(*) - count_if(label)) / count(*), 9) AS minority_share FROM pairs GROUP BY 1, 2""")
def majority_label(spark: SparkSession, root: str) -> DataFrame:
    n, t = F.count("*"), F.count_if("label")
    return pairs(spark, root).groupBy((F.col("s1_id") % 7).alias("pattern"), "src").agg(
        n.alias("n"), t.alias("n_true"), (t * 2 >= n).alias("majority"), F.round(F.least(t, n - t) / n, 9).alias("minority_share")
    )


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_flags FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def label_conflicts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("n_flags")).where("n_flags > 1")


@query("""SELECT lang, w AS token, count(*) AS df FROM (SELECT lang, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2""")
def token_document_frequency(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").select("lang", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("token"))
    return rows.where("token <> ''").groupBy("lang", "token").agg(F.count("*").alias("df"))


# sets, sorts


@query("""SELECT 'a' AS part, o_orderkey AS id, o_totalprice AS price, NULL::VARCHAR AS note FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'b', o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderkey % 3 = 1""")
def union_missing_columns(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    a = o.where("o_orderkey % 3 = 0").select(F.lit("a").alias("part"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    b = o.where("o_orderkey % 3 = 1").select(F.lit("b").alias("part"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("note"))
    return R.union_all([a, b])


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 30 UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.05")
def union_distinct_pairs(spark: SparkSession, root: str) -> DataFrame:
    li = table(spark, root, "lineitem")
    return li.where("l_quantity > 30").select("l_orderkey", "l_partkey").union(li.where("l_discount > 0.05").select("l_orderkey", "l_partkey")).distinct()


@query("(SELECT l_partkey, 'both' AS kind FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)) UNION ALL (SELECT l_partkey, 'first' FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09))")
def row_set_operations(spark: SparkSession, root: str) -> DataFrame:
    li = table(spark, root, "lineitem")
    a, b = li.where("l_quantity > 45").select("l_partkey"), li.where("l_discount > 0.09").select("l_partkey")
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.subtract(b).withColumn("kind", F.lit("first")))


@query(f"""WITH {NAMES}, t AS (SELECT id, string_split(name, ' ') AS a, string_split(country || ' ' || split_part(name, ' ', 2), ' ') AS b FROM names)
SELECT id, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS dropped, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, list_sort(list_intersect(a, b)) AS common,
  len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM t""")
def array_set_operations(spark: SparkSession, root: str) -> DataFrame:
    t = names(spark, root).select("id", F.split("name", " ").alias("a"), F.array(F.col("country"), F.split("name", " ")[1]).alias("b"))
    return t.select(
        "id", F.array_sort(F.array_except("a", "b")).alias("dropped"), F.array_sort(F.array_except("b", "a")).alias("added"),
        F.array_sort(F.array_intersect("a", "b")).alias("common"), (F.size(F.array_except("a", "b")) == 0).alias("subset"),
    )


@query("""WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS a FROM conversations GROUP BY 1), u AS (SELECT *, ['user', 'user', 'assistant'] AS b FROM t),
d AS (SELECT conv_id, unnest(a) AS x, b FROM u), c AS (SELECT conv_id, x, count(*) - len(list_filter(any_value(b), lambda y: y = x)) AS n FROM d GROUP BY conv_id, x)
SELECT t.conv_id, coalesce(list_sort(flatten(list(list_transform(generate_series(1, n), lambda i: x)) FILTER (WHERE n > 0))), []) AS extra FROM t LEFT JOIN c ON t.conv_id = c.conv_id GROUP BY 1""")
def multiset_difference(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("a"))
    b = F.array(F.lit("user"), F.lit("user"), F.lit("assistant"))
    return t.select("conv_id", R.multiset_difference(F.col("a"), b).alias("extra"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def global_top_n(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(f"WITH {PAIRS}, r AS (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS r, count(*) OVER (PARTITION BY s1_id) AS n FROM pairs) SELECT s1_id, cand_id, r AS place FROM r WHERE r <= (n + 1) // 2")
def first_m_of_group(spark: SparkSession, root: str) -> DataFrame:
    """As many of each group's sorted rows as the group itself says."""
    rows = pairs(spark, root).withColumns({"place": W.rank_of("score", "s1_id", ties=("cand_id",)), "n": W.size("s1_id")})
    return rows.where(F.col("place") <= F.floor((F.col("n") + 1) / 2)).select("s1_id", "cand_id", "place")


# nested and JSON columns


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY 1")
def json_extract(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("n_k"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority)::INT AS g FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping("o_orderpriority").cast("int").alias("g"))
