"""Audit, profile and service queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import audit as A
from tidemark.operators import learn
from tidemark.operators.windows import top_k
from tidemark.plans.core import PAIRS, names, pairs, query
from tidemark.sources import tsv
from tidemark.sources.tables import table


@query("""WITH d AS (SELECT text, toxic, quality, d.doc_id FROM documents d JOIN labels USING (doc_id))
SELECT text, count(*) AS n, sum(toxic)::BIGINT AS n_true, min(toxic) <> max(toxic) AS mixed, count(DISTINCT CASE WHEN toxic = 1 THEN doc_id END) AS n_owners FROM d GROUP BY 1 HAVING count(*) > 1""")
def duplicate_lens(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").join(table(spark, root, "labels"), "doc_id")
    return A.duplicate_groups(d, ["text"], "toxic", "doc_id")


@query("""WITH d AS (SELECT lang, source, n_chars > 2000 AS long, quality FROM documents JOIN labels USING (doc_id))
SELECT lang, long, count(*) AS n, sum(quality)::BIGINT AS n_true, sum(quality) * 2 >= count(*) AS majority, round(least(sum(quality), count(*) - sum(quality)) / count(*), 9) AS minority_share FROM d GROUP BY 1, 2""")
def pattern_lens(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").join(table(spark, root, "labels"), "doc_id").withColumn("long", F.col("n_chars") > 2000)
    return A.pattern_table(d, ["lang", "long"], "quality").withColumn("minority_share", F.round("minority_share", 9))


@query(f"""WITH {PAIRS}, s AS (SELECT p_partkey AS id, p_name AS sig FROM part), o AS (SELECT sig, min(id) AS other_s1 FROM s WHERE id % 7 = 0 GROUP BY 1),
t AS (SELECT s1_id * 7 AS s1_id, cand_id FROM pairs WHERE label)
SELECT DISTINCT t.s1_id, t.cand_id, other_s1 FROM t JOIN s c ON t.cand_id = c.id JOIN s a ON t.s1_id = a.id JOIN o ON o.sig = c.sig WHERE c.sig <> a.sig""")
def copies_of_other_anchors(spark: SparkSession, root: str) -> DataFrame:
    n = names(spark, root).select("id", F.col("name").alias("sig"))
    p = pairs(spark, root).select((F.col("s1_id") * 7).alias("s1_id"), "cand_id", "label")
    found = A.copies_of_others(p, n.where("id % 7 = 0"), n, "sig")
    return found.distinct()


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, CASE WHEN label THEN 'match_unlikely' ELSE 'match_likely' END AS kind FROM pairs WHERE (label AND p < 0.05) OR (NOT label AND p > 0.95)")
def model_flags(spark: SparkSession, root: str) -> DataFrame:
    return A.flag(pairs(spark, root), low=0.05, high=0.95).select("s1_id", "cand_id", "kind")


@query("""WITH w AS (SELECT unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'), ' '), lambda t: t <> ''))) AS token FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT token, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, token LIMIT 30""")
def top_words_of_flagged(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").join(table(spark, root, "labels").where("toxic = 1"), "doc_id")
    n = d.select(F.explode(F.array_distinct(X.tokens(F.lower("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "token").limit(30)


@query(r"""SELECT lang, count(*) AS n, min(length(text))::INT AS len_min, round(avg(length(text)), 4) AS len_mean, max(length(text))::INT AS len_max,
  count_if(coalesce(trim(text), '') = '') AS n_empty, count_if(regexp_matches(text, '[\x{0370}-\x{1FFF}\x{3040}-\x{D7FF}]')) AS n_nonlatin, count_if(regexp_matches(text, '[0-9]')) AS n_digit, count_if(regexp_matches(text, '^[0-9 ]+$')) AS n_numeric_only,
  count_if(regexp_matches(text, '(?i)\b(www\.|[a-z0-9-]+\.(com|org|net)\b)')) AS n_domain, count_if(regexp_matches(text, 'Ã.|â€|Â.')) AS n_mojibake, count_if(upper(text) = text AND regexp_matches(text, '[A-Z]')) AS n_upper FROM documents GROUP BY 1""")
def source_profile(spark: SparkSession, root: str) -> DataFrame:
    return A.profile(table(spark, root, "documents"), "text", ["lang"])


@query(f"WITH {PAIRS}, n AS (SELECT o_orderkey, count(s1_id) FILTER (WHERE label) AS m FROM orders LEFT JOIN pairs ON o_orderkey = s1_id GROUP BY 1) SELECT m AS n_match, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM n GROUP BY 1")
def truth_profile(spark: SparkSession, root: str) -> DataFrame:
    true = pairs(spark, root).where("label").groupBy("s1_id").agg(F.count("*").alias("n_match"))
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("s1_id"))
    n = o.join(true, "s1_id", "left").fillna(0, ["n_match"]).groupBy("n_match").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("n_match", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))  # one row


@query(f"""WITH {PAIRS}, x AS (SELECT pr.*, p_size FROM pairs pr JOIN part ON cand_id = p_partkey)
SELECT src, label, count(*) AS n, round(avg(p), 9) AS mean, round(median(p), 9) AS mid, count_if(s1_id % 50 = p_size) AS n_equal, count_if(abs(s1_id % 50 - p_size) BETWEEN 1 AND 10) AS n_near FROM x GROUP BY 1, 2""")
def similarity_and_number_relation(spark: SparkSession, root: str) -> DataFrame:
    """Similarity and number relation of true pairs and decoys."""
    x = pairs(spark, root).join(table(spark, root, "part").select(F.col("p_partkey").alias("cand_id"), "p_size"), "cand_id")
    gap = F.abs(F.col("s1_id") % 50 - F.col("p_size"))
    return x.groupBy("src", "label").agg(
        F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean"), F.round(F.median("p"), 9).alias("mid"), F.count_if(gap == 0).alias("n_equal"), F.count_if(gap.between(1, 10)).alias("n_near")
    )


@query("""WITH w AS (SELECT o_orderkey, o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS step FROM orders)
SELECT round(corr(o_orderkey, o_custkey), 6) AS r_ids, count_if(step = 1) AS n_adjacent, count(*) AS n FROM w""")
def leakage_checks(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.col("o_orderkey") - F.lag("o_orderkey").over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    return table(spark, root, "orders").withColumn("step", step).agg(F.round(F.corr("o_orderkey", "o_custkey"), 6).alias("r_ids"), F.count_if(F.col("step") == 1).alias("n_adjacent"), F.count("*").alias("n"))


@query()
def stratified_examples(spark: SparkSession, root: str) -> DataFrame:
    """Ten rows of each group, the same ones in every run: a sampling operator."""
    return A.sample_by_group(pairs(spark, root), 10, ["src", "label"], ["s1_id", "cand_id"], seed=3).select("src", "label", "s1_id", "cand_id")


@query()
def stratified_negative_sampling(spark: SparkSession, root: str) -> DataFrame:
    p = pairs(spark, root)
    return learn.stratified_negatives(p, p.count() // 2, F.col("p") >= 0.5, ["s1_id", "cand_id"]).select("s1_id", "cand_id", F.round("weight", 9).alias("weight"))


@query()
def stage_one_model(spark: SparkSession, root: str) -> DataFrame:
    """Boosted trees on some folds, early stopping on another, probabilities for all, isotonically calibrated."""
    from tidemark.operators import windows as W

    rows = W.retrieval_context(pairs(spark, root)).withColumnRenamed("p", "first_p").withColumn("fold", F.col("s1_id") % 10)
    rows = rows.withColumn("source_s3", (F.col("src") == "S3").cast("int"))
    f = learn.features_of(rows)
    train = rows.where("fold BETWEEN 2 AND 5").withColumn("held", F.col("fold") == 5)
    model = learn.train_gbt(train, f, validation="held", rounds=5, depth=4)
    scored = learn.predict(model, rows)
    return learn.calibrate(scored.where("fold = 9"), scored).select("s1_id", "cand_id", "p", "p_cal")


@query()
def cross_fit_model(spark: SparkSession, root: str) -> DataFrame:
    """Probabilities of each half from a model of the other."""
    from tidemark.operators import windows as W

    rows = W.competition(pairs(spark, root)).withColumn("half", (F.shiftrightunsigned(F.col("s1_id") * 2654435761, 16) % 2).cast("int"))
    out, _ = learn.cross_fit(rows.withColumnRenamed("p", "p1"), learn.features_of(rows.withColumnRenamed("p", "p1"), ("s1_id", "cand_id", "label", "half")), rounds=3, depth=3)
    return out.select("s1_id", "cand_id", "half", "p")


# service views


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id, o_orderkey FROM orders QUALIFY row_id BETWEEN 100 AND 149")
def page_of_rows(spark: SparkSession, root: str) -> DataFrame:
    """Fifty rows by number: a paging operator."""
    numbered = tsv.with_row_ids(table(spark, root, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    return tsv.page(numbered, 100, 50).select("row_id", "o_orderkey")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'License') OR contains(source, 'License')")
def literal_search(spark: SparkSession, root: str) -> DataFrame:
    return tsv.search(table(spark, root, "documents"), "License", ["text", "source"]).select("doc_id", "source")


@query("SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)version [23]')")
def regex_search_count(spark: SparkSession, root: str) -> DataFrame:
    return tsv.search(table(spark, root, "documents"), "version [23]", ["text"], regex=True, ignore_case=True).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 1")
def point_lookup(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").where("o_orderkey = 1").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"WITH {PAIRS} SELECT cand_id, min(s1_id) AS s1_id, count(*) AS n FROM pairs WHERE label GROUP BY 1")
def reverse_match_lookup(spark: SparkSession, root: str) -> DataFrame:
    return pairs(spark, root).where("label").groupBy("cand_id").agg(F.min("s1_id").alias("s1_id"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT conv_id, unnest(string_split(string_agg(role, ',' ORDER BY turn), ',')) AS role FROM conversations GROUP BY conv_id) SELECT conv_id, role, count(*) OVER () AS n FROM l""")
def list_explode(spark: SparkSession, root: str) -> DataFrame:
    """Comma lists and back: the shape of a ground truth file."""
    lists = table(spark, root, "conversations").groupBy("conv_id").agg(F.listagg("role", F.lit(",")).alias("roles"))
    rows = lists.select("conv_id", F.explode(F.split("roles", ",")).alias("role"))
    n = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(n))  # one row


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, (length(html) - length(replace(html, '<p', ''))) // 2 AS n_p FROM pages")
def page_fields(spark: SparkSession, root: str) -> DataFrame:
    html = F.col("html")
    n = F.floor((F.length(html) - F.length(F.replace(html, F.lit("<p"), F.lit("")))) / 2)
    return table(spark, root, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), n.alias("n_p"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey // 10) % 100 = 3 UNION SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 250 = 3")
def smoke_slice(spark: SparkSession, root: str) -> DataFrame:
    """Anchors of one bucket and those that some records name: the slice that a smoke run takes."""
    o = table(spark, root, "orders").where(F.floor(F.col("o_orderkey") / 10) % 100 == 3).select("o_orderkey")
    li = table(spark, root, "lineitem").where("l_partkey % 250 = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.union(li.join(table(spark, root, "orders").select("o_orderkey"), "o_orderkey", "left_semi")).distinct()


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE length(text) END::INT AS n_chars, sha256(text) AS sha FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) <= 3")
def longest_per_language(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), "text")
    return top_k(d, 3, "n_chars", "lang", ties=("doc_id",)).select("doc_id", "n_chars", F.sha2("text", 256).alias("sha"))
