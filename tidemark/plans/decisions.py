"""Queries that decide on matches, search decoders and measure them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import decide, learn, metrics, setdecode
from tidemark.operators.windows import over
from tidemark.plans.core import ANCHORS, PAIRS, anchors, pairs, query

_CAP = "least(p, 0.999::DOUBLE)"
_ODDS = f"{_CAP} / (1 - {_CAP})"


def _f(tp: str, pred: str, true: str) -> str:
    return f"CASE WHEN {pred} = 0 AND {true} = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * {tp} / ({pred} + 0.25::DOUBLE * {true}) END"


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, p FROM pairs QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id) = 1")
def hard_exclusivity(spark: SparkSession, root: str) -> DataFrame:
    return decide.hard_exclusive(pairs(spark, root)).select("s1_id", "cand_id", "p")


@query(f"WITH {PAIRS}, o AS (SELECT *, {_ODDS} AS o FROM pairs) SELECT s1_id, cand_id, round(o / (1 + sum(o) OVER (PARTITION BY cand_id)), 7) AS p_soft FROM o")
def soft_exclusivity(spark: SparkSession, root: str) -> DataFrame:
    return decide.soft_exclusive(pairs(spark, root)).select("s1_id", "cand_id", F.round("p_soft", 7).alias("p_soft"))


@query(f"""WITH {PAIRS}, o AS (SELECT *, pow({_ODDS}, 1.5) AS o FROM pairs), q AS (SELECT s1_id, cand_id, round(o / (0.5 + sum(o) OVER (PARTITION BY cand_id)), 7) AS p_soft FROM o)
SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY p_soft DESC, cand_id) <= 3""")
def tempered_exclusivity_capped(spark: SparkSession, root: str) -> DataFrame:
    soft = decide.soft_exclusive(pairs(spark, root), power=1.5, none=0.5).select("s1_id", "cand_id", F.round("p_soft", 7).alias("p_soft"))
    return decide.capped(soft, 3, p="p_soft")


@query(f"WITH {PAIRS}, {ANCHORS} SELECT s1_id, cand_id FROM pairs JOIN anchors USING (s1_id) WHERE p >= CASE country WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.8 ELSE 0.7 END + CASE WHEN src = 'S3' THEN 0.05 ELSE 0 END")
def group_thresholds(spark: SparkSession, root: str) -> DataFrame:
    rows = pairs(spark, root).join(anchors(spark, root), "s1_id")
    at = F.when(F.col("country") == "1-URGENT", 0.9).when(F.col("country") == "2-HIGH", 0.8).otherwise(0.7) + F.when(F.col("src") == "S3", 0.05).otherwise(0.0)
    return decide.threshold(rows, at).select("s1_id", "cand_id")


@query(f"""WITH {PAIRS}, {ANCHORS}, t AS (SELECT unnest(generate_series(6, 19)) * 5 AS percent), n AS (SELECT s1_id, percent, count_if(label) AS tr, count_if(round(p * 100, 6) >= percent) AS pr, count_if(label AND round(p * 100, 6) >= percent) AS tp FROM pairs, t GROUP BY 1, 2)
SELECT percent::INT AS percent, round(avg({_f('coalesce(tp, 0)', 'coalesce(pr, 0)', 'coalesce(tr, 0)')}), 6) AS macro_f FROM anchors CROSS JOIN t LEFT JOIN n USING (s1_id, percent) GROUP BY 1""")
def threshold_grid(spark: SparkSession, root: str) -> DataFrame:
    """Macro F0.5 for all thresholds in one pass: counts per anchor and threshold from one aggregation."""
    grid = [int(x) * 5 for x in range(6, 20)]
    pct = F.round(F.col("p") * 100, 6)
    hit = [F.count_if(pct >= t).alias(f"p{t}") for t in grid] + [F.count_if((pct >= t) & F.col("label")).alias(f"t{t}") for t in grid]
    n = pairs(spark, root).groupBy("s1_id").agg(F.count_if("label").alias("n_true"), *hit)
    rows = anchors(spark, root).join(n, "s1_id", "left").fillna(0)
    fs = rows.agg(*[F.avg(metrics.f_score(F.col(f"t{t}"), F.col(f"p{t}"), F.col("n_true"))).alias(str(t)) for t in grid])
    return fs.select(F.explode(F.array(*[F.struct(F.lit(t).alias("percent"), F.round(F.col(str(t)), 6).alias("macro_f")) for t in grid])).alias("x")).select("x.*")


@query()
def expected_f_decoding(spark: SparkSession, root: str) -> DataFrame:
    """The prefix of each order's candidates with the highest expected F0.5."""
    soft = decide.soft_exclusive(pairs(spark, root)).select("s1_id", "cand_id", F.col("p_soft").alias("p"))
    return setdecode.decode(soft, c=1.0, recall=0.97).select("s1_id", "cand_id")


@query()
def expected_f_decoding_constant(spark: SparkSession, root: str) -> DataFrame:
    """The same with a constant missed mass, a cut-off Poisson tail and other bounds, after hard exclusivity."""
    hard = decide.hard_exclusive(pairs(spark, root)).select("s1_id", "cand_id", "p")
    return setdecode.decode(hard, lam=0.05, least=0.02, cap=30, terms=5, fold=False).select("s1_id", "cand_id")


@query(f"""WITH {PAIRS}, {ANCHORS}, n AS (SELECT s1_id, count_if(label) AS tr, count_if(p > 0.6) AS pr, count_if(label AND p > 0.6) AS tp FROM pairs GROUP BY 1)
SELECT s1_id, coalesce(tr, 0) AS n_true, coalesce(pr, 0) AS n_pred, coalesce(tp, 0) AS tp, round({_f('coalesce(tp, 0)', 'coalesce(pr, 0)', 'coalesce(tr, 0)')}, 9) AS f FROM anchors LEFT JOIN n USING (s1_id)""")
def f_per_anchor(spark: SparkSession, root: str) -> DataFrame:
    p = pairs(spark, root)
    f = metrics.per_anchor(anchors(spark, root).select("s1_id"), p.where("p > 0.6"), p.where("label"))
    return f.withColumn("f", F.round("f", 9))


@query(f"""WITH {PAIRS} SELECT kind, count(*) AS n, count(DISTINCT s1_id) AS n_anchors FROM (SELECT s1_id, CASE WHEN label AND score < 2000 THEN 'missed_by_blocking' WHEN label AND p <= 0.6 THEN 'rejected' WHEN label THEN 'right' WHEN p > 0.6 AND NOT bool_or(label) OVER (PARTITION BY s1_id) THEN 'singleton_violated' WHEN p > 0.6 THEN 'wrong' ELSE 'left_out' END AS kind FROM pairs) GROUP BY 1""")
def error_taxonomy(spark: SparkSession, root: str) -> DataFrame:
    """Where true pairs are lost and wrong ones come from."""
    kind = (
        F.when(F.col("label") & (F.col("score") < 2000), "missed_by_blocking").when(F.col("label") & (F.col("p") <= 0.6), "rejected").when(F.col("label"), "right")
        .when((F.col("p") > 0.6) & ~F.col("matched"), "singleton_violated").when(F.col("p") > 0.6, "wrong").otherwise("left_out")
    )
    rows = pairs(spark, root).withColumn("matched", F.max("label").over(over("s1_id")))
    return rows.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("s1_id").alias("n_anchors"))


@query(f"""WITH {PAIRS}, {ANCHORS}, n AS (SELECT s1_id, count_if(label) AS tr, count_if(p > 0.6) AS pr, count_if(label AND p > 0.6) AS tp, sum(p) AS sp FROM pairs GROUP BY 1),
f AS (SELECT country, coalesce(tr, 0) AS tr, coalesce(pr, 0) AS pr, coalesce(sp, 0) AS sp, {_f('coalesce(tp, 0)', 'coalesce(pr, 0)', 'coalesce(tr, 0)')} AS f FROM anchors LEFT JOIN n USING (s1_id))
SELECT country, tr = 0 AS singleton, count(*) AS n, round(avg(f), 6) AS macro_f, round(avg((pr = 0)::INT::DOUBLE), 6) AS empty_share, round(avg(pr), 6) AS matches, round(avg(sp), 6) AS mean_p_sum FROM f GROUP BY 1, 2""")
def decision_report(spark: SparkSession, root: str) -> DataFrame:
    p = pairs(spark, root)
    f = metrics.per_anchor(anchors(spark, root), p.where("p > 0.6"), p.where("label"))
    mass = p.groupBy("s1_id").agg(F.sum("p").alias("sp"))
    rows = f.join(mass, "s1_id", "left").fillna(0.0, ["sp"])
    r = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy("country", (F.col("n_true") == 0).alias("singleton")).agg(
        F.count("*").alias("n"), r("f").alias("macro_f"), r((F.col("n_pred") == 0).cast("double")).alias("empty_share"), r("n_pred").alias("matches"), r("sp").alias("mean_p_sum")
    )


@query(f"""WITH {PAIRS}, t AS (SELECT *, p > 0.6 AS a, score / 60000 > 0.6 AS b FROM pairs)
SELECT src, count(*) AS n, count_if(a <> b) AS n_differ, count_if(a AND NOT b) AS only_a, count_if(b AND NOT a) AS only_b, round(count_if(a AND NOT b AND label) / nullif(count_if(a AND NOT b), 0), 9) AS precision_a FROM t GROUP BY 1""")
def model_disagreement(spark: SparkSession, root: str) -> DataFrame:
    a, b = F.col("p") > 0.6, F.col("score") / 60000 > 0.6
    only = F.count_if(a & ~b)
    return pairs(spark, root).groupBy("src").agg(
        F.count("*").alias("n"), F.count_if(a != b).alias("n_differ"), only.alias("only_a"), F.count_if(b & ~a).alias("only_b"),
        F.round(F.count_if(a & ~b & F.col("label")) / F.nullif(only, F.lit(0)), 9).alias("precision_a"),
    )


@query(f"WITH {PAIRS} SELECT least(floor(p * 10), 9)::INT AS bin, src, count(*) AS n, round(avg(label::INT::DOUBLE), 9) AS match_rate, round(avg(p), 9) AS p_mean FROM pairs GROUP BY 1, 2")
def match_rate_by_bin(spark: SparkSession, root: str) -> DataFrame:
    return pairs(spark, root).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin"), "src").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 9).alias("match_rate"), F.round(F.avg("p"), 9).alias("p_mean")
    )


@query()
def monte_carlo_f(spark: SparkSession, root: str) -> DataFrame:
    """Expected F0.5 by 16 draws of each pair's label, drawn by hash so that reruns agree, beside the actual one."""
    p = pairs(spark, root)
    draws = p.select("s1_id", "cand_id", "p", "label", F.explode(F.sequence(F.lit(1), F.lit(16))).alias("draw"))
    u = F.pmod(F.xxhash64("s1_id", "cand_id", "draw"), F.lit(1_000_003)) / 1_000_003
    y = u < F.col("p")
    n = draws.groupBy("s1_id", "draw").agg(F.count_if(F.col("p") > 0.6).alias("n_pred"), F.count_if(y).alias("n_true"), F.count_if(y & (F.col("p") > 0.6)).alias("tp"))
    f = n.withColumn("f", metrics.f_score(F.col("tp"), F.col("n_pred"), F.col("n_true")))
    return f.groupBy("s1_id").agg(F.round(F.avg("f"), 6).alias("expected_f"))


@query(f"""WITH {PAIRS}, a AS (SELECT s1_id, cand_id, p * 0.7 AS p FROM pairs WHERE p >= 0.3), b AS (SELECT s1_id, cand_id, score / 60000 * 0.3::DOUBLE AS p FROM pairs WHERE score < 60000)
SELECT s1_id, cand_id, round(sum(p), 9) AS p FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def fixed_blend(spark: SparkSession, root: str) -> DataFrame:
    p = pairs(spark, root)
    a, b = p.where("p >= 0.3"), p.where("score < 60000").select("s1_id", "cand_id", (F.col("score") / 60000).alias("p"))
    return learn.blend(a, b, 0.7, ["s1_id", "cand_id"]).withColumn("p", F.round("p", 9))


@query(f"""WITH {PAIRS} SELECT s1_id, cand_id, round(sum(p) / 2, 9) AS p FROM (SELECT s1_id, cand_id, p FROM pairs WHERE p >= 0.3 UNION ALL SELECT s1_id, cand_id, score / 60000 FROM pairs WHERE score < 60000) GROUP BY 1, 2""")
def equal_mean_ensemble(spark: SparkSession, root: str) -> DataFrame:
    p = pairs(spark, root)
    a, b = p.where("p >= 0.3"), p.where("score < 60000").select("s1_id", "cand_id", (F.col("score") / 60000).alias("p"))
    return learn.mean_of([a, b], ["s1_id", "cand_id"]).withColumn("p", F.round("p", 9))


@query(f"""WITH {PAIRS}, r AS (SELECT p, label, avg(p) FILTER (WHERE label) OVER () AS hi, avg(p) FILTER (WHERE NOT label) OVER () AS lo, s1_id, cand_id FROM pairs)
SELECT s1_id, cand_id, label FROM r WHERE (NOT label AND p >= hi) OR (label AND p <= lo)""")
def label_issues(spark: SparkSession, root: str) -> DataFrame:
    return learn.label_issues(pairs(spark, root)).select("s1_id", "cand_id", "label")


@query(f"""WITH {PAIRS}, g AS (SELECT p, count_if(label) AS y, count_if(NOT label) AS m FROM pairs GROUP BY 1), c AS (SELECT *, coalesce(sum(m) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT (SELECT count(*) FROM pairs) AS n, round((SELECT sum(y * (below + m / 2)) / (sum(y) * sum(m)) FROM c), 9) AS auc,
  round((SELECT avg(-(label::INT * ln(least(p, 1 - 1e-15)) + (1 - label::INT) * ln(1 - least(p, 1 - 1e-15)))) FROM pairs), 6) AS log_loss, round((SELECT avg((label::INT - p) * (label::INT - p)) FROM pairs), 9) AS brier""")
def probability_scores(spark: SparkSession, root: str) -> DataFrame:
    s = learn.scores(pairs(spark, root).where("p < 1").unionByName(pairs(spark, root).where("p >= 1")))
    return s.select("n", F.round("auc", 9).alias("auc"), F.round("log_loss", 6).alias("log_loss"), F.round("brier", 9).alias("brier"))


@query(f"""WITH {PAIRS}, r AS (SELECT *, count_if(label) OVER w AS y, count(*) OVER w AS n FROM pairs WINDOW w AS (PARTITION BY s1_id % 50, src))
SELECT s1_id, cand_id FROM r WHERE label = (y * 2 >= n)""")
def pattern_cleaning(spark: SparkSession, root: str) -> DataFrame:
    rows = pairs(spark, root).withColumn("g", F.col("s1_id") % 50)
    return learn.pattern_cleaning(rows, ["g", "src"], variant="B").select("s1_id", "cand_id")


@query(f"WITH {PAIRS} SELECT s1_id, cand_id, CASE WHEN (label AND p < 0.05) OR (NOT label AND p > 0.95) THEN 0.2 ELSE 1.0 END::DOUBLE AS weight FROM pairs")
def contradiction_weights(spark: SparkSession, root: str) -> DataFrame:
    return learn.contradictions(pairs(spark, root), variant="G", low=0.05, high=0.95).select("s1_id", "cand_id", "weight")
