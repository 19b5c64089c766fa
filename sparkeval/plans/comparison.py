"""Queries that compare two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import comparison as C
from ..operators import gates as G
from ..operators import inference as I
from ..registry import query
from ..views import runs, table, with_views


def _sides(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.where("run = 'baseline'"), r.where("run = 'candidate'")


def _aligned(spark, sf_dir, policy="exclude"):
    left, right = _sides(spark, sf_dir)
    return A.align(left, right, ["metric", "record_id"], policy)


ALIGNED = """
l AS (SELECT metric, record_id, status, value FROM runs WHERE run = 'baseline'), r AS (SELECT metric, record_id, status, value FROM runs WHERE run = 'candidate'),
al AS (SELECT coalesce(l.metric, r.metric) AS metric, coalesce(l.record_id, r.record_id) AS record_id, l.status AS ls, r.status AS rs, l.value AS lv, r.value AS rv,
  l.value IS NOT NULL AND r.value IS NOT NULL AS paired, r.value - l.value AS d FROM l FULL OUTER JOIN r ON l.metric = r.metric AND l.record_id = r.record_id),
p AS (SELECT * FROM al WHERE paired)"""


@query(with_views("runs", f"""WITH {ALIGNED}
SELECT metric, count(*) AS union_n, count(*) FILTER (paired) AS paired_n, count(*) FILTER (lv IS NULL) AS missing_left, count(*) FILTER (rv IS NULL) AS missing_right, 0::BIGINT AS non_finite,
 count(*) FILTER (ls = 'failed') AS failed_left, count(*) FILTER (rs = 'failed') AS failed_right,
 CASE WHEN (count(*) - count(*) FILTER (paired)) / count(*) > 0.2 THEN 'EXCESSIVE_MISSINGNESS' ELSE '' END AS warnings FROM al GROUP BY metric"""))
def join01_align_pairs(spark, sf_dir):
    return A.alignment_summary(_aligned(spark, sf_dir), ["metric"])


@query(with_views("runs", """SELECT metric, run, record_id, status, CASE WHEN status = 'succeeded' THEN value WHEN status = 'failed' THEN 0.0 END AS analysis_value FROM runs"""))
def flt06_analysis_values(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.select("metric", "run", "record_id", "status", A.analysis_value(F.col("status"), F.col("value"), "failures_as_zero").alias("analysis_value"))


@query(with_views("runs", f"""WITH {ALIGNED}
SELECT metric, count(*) AS n, round(avg(lv), 6) AS baseline_mean, round(avg(rv), 6) AS candidate_mean, round(avg(d), 6) AS mean_difference, round(median(d), 6) AS median_difference,
 round(avg(d) / abs(avg(lv)), 6) AS relative_difference, round(stddev_samp(d), 6) AS sd, round(avg(d) / stddev_samp(d), 6) AS dz,
 round(avg((d > 0)::INT) + 0.5 * avg((d = 0)::INT), 6) AS superiority FROM p GROUP BY metric"""))
def st19_paired_continuous_effects(spark, sf_dir):
    e = A.continuous_effects(_aligned(spark, sf_dir), ["metric"])
    return e.select("metric", "n", *[F.round(c, 6).alias(c) for c in e.columns[2:]])


@query(with_views("runs", f"""WITH {ALIGNED},
w AS (SELECT metric, record_id, d, row_number() OVER (PARTITION BY metric ORDER BY d, record_id) AS a, row_number() OVER (PARTITION BY metric ORDER BY d DESC, record_id DESC) AS b FROM p)
SELECT metric, 'regression' AS direction, a::INT AS rank, record_id, round(d, 9) AS difference FROM w WHERE a <= 10
UNION ALL SELECT metric, 'improvement', b::INT, record_id, round(d, 9) FROM w WHERE b <= 10"""))
def srt01_top_changes(spark, sf_dir):
    return A.top_changes(_aligned(spark, sf_dir), ["metric"], "record_id", 10).withColumn("difference", F.round("difference", 9))


def compare(spark, sf_dir, resamples=400, seed=7):
    """Effects, percentile interval and test of every metric, with Holm-adjusted p-values."""
    aligned = _aligned(spark, sf_dir)
    effects = A.continuous_effects(aligned, ["metric"])
    intervals = I.poisson_bootstrap_mean(aligned.where("paired"), ["metric"], "record_id", "difference", resamples, seed)
    tests = I.paired_t(aligned.where("paired"), ["metric"], "difference")
    rows = effects.join(intervals, "metric").join(tests.select("metric", "statistic", "p_value"), "metric")
    adjusted = I.adjust_p_values(rows.select(F.lit("all").alias("family"), F.col("metric").alias("key"), F.col("p_value").alias("p")))
    return rows.join(adjusted.select(F.col("key").alias("metric"), F.col("holm").alias("p_adjusted")), "metric").withColumn(
        "interpretation", A.interpretation(F.col("lower"), F.col("upper"), F.col("p_value"), F.col("mean_difference"), 0.5)
    )


@query()
def cmp01_compare_metric(spark, sf_dir):
    return compare(spark, sf_dir)


@query()
def cmp03_tests(spark, sf_dir):
    """The comparison by each of the tests, failures counting as zero."""
    left, right = _sides(spark, sf_dir)
    return C.compare_tests(left, right, policy="failures_as_zero", practical=0.5, seed=7)


@query()
def gate01_evaluate_gate(spark, sf_dir):
    rules = spark.createDataFrame(
        [
            ("no-regression", "metric-0", "maximum_regression", 5.0, 10, True),
            ("enough", "metric-1", "minimum", 0.0, 10, True),
            ("bounded", "metric-2", "maximum", 1e9, 10, False),
            ("confident", "metric-3", "lower_confidence_minimum", -50.0, 10, True),
            ("absent", "metric-9", "minimum", 0.0, 1, False),
        ],
        G.RULES,
    )
    return G.evaluate_rules(compare(spark, sf_dir), rules)


@query(with_views("runs", f"""WITH {ALIGNED},
e AS (SELECT metric, count(*) AS n, avg(d) AS md, avg(rv) AS cm FROM p GROUP BY metric),
rl(identifier, metric, operator, threshold, least_n, required) AS (VALUES ('a', 'metric-0', 'maximum_regression', 5.0, 10, true), ('b', 'metric-1', 'minimum', 0.0, 10, true),
 ('c', 'metric-2', 'maximum', 1000000000.0, 10, false), ('d', 'metric-9', 'minimum', 0.0, 1, false), ('e', 'metric-3', 'minimum', 0.0, 100000000, true))
SELECT rl.identifier, rl.metric, rl.operator, rl.required, coalesce(n >= least_n AND CASE operator WHEN 'maximum_regression' THEN md >= -abs(threshold) WHEN 'minimum' THEN cm >= threshold ELSE cm <= threshold END, false) AS passed,
 CASE WHEN n IS NULL THEN 'metric is absent' WHEN n < least_n THEN 'too few pairs'
  WHEN CASE operator WHEN 'maximum_regression' THEN md >= -abs(threshold) WHEN 'minimum' THEN cm >= threshold ELSE cm <= threshold END THEN 'holds' ELSE 'violated' END AS reason
FROM rl LEFT JOIN e USING (metric)"""))
def gate01b_point_rules(spark, sf_dir):
    """The rules that need point estimates alone."""
    rules = spark.createDataFrame(
        [
            ("a", "metric-0", "maximum_regression", 5.0, 10, True),
            ("b", "metric-1", "minimum", 0.0, 10, True),
            ("c", "metric-2", "maximum", 1e9, 10, False),
            ("d", "metric-9", "minimum", 0.0, 1, False),
            ("e", "metric-3", "minimum", 0.0, 100000000, True),
        ],
        G.RULES,
    )
    e = A.continuous_effects(_aligned(spark, sf_dir), ["metric"]).withColumn("lower", F.lit(None).cast("double")).withColumn("interpretation", F.lit("not_statistically_conclusive"))
    return G.evaluate_rules(e, rules)


@query(with_views("runs", """SELECT metric FROM runs WHERE run = 'baseline' AND status = 'failed' INTERSECT SELECT metric FROM runs WHERE run = 'candidate' AND status = 'missing'"""))
def set02_common_metrics(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return left.where("status = 'failed'").select("metric").intersect(right.where("status = 'missing'").select("metric"))


@query(with_views("runs", "SELECT DISTINCT record_id FROM runs WHERE status = 'failed' EXCEPT SELECT record_id FROM runs WHERE status = 'missing'"))
def set03_failed_never_missing(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.where("status = 'failed'").select("record_id").distinct().join(r.where("status = 'missing'").select("record_id"), "record_id", "left_anti")


@query("""SELECT e.event_id, e.event_type, c.c_name, n.n_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def join02_list_results(spark, sf_dir):
    """Samples with their optional responses, and those with their optional failures."""
    e, c, n = (table(spark, sf_dir, t) for t in ("events", "customer", "nation"))
    return e.join(c, e.user_id == c.c_custkey, "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("event_id", "event_type", "c_name", "n_name")


@query("""SELECT o_orderkey || '#rep=' || l_linenumber AS analysis_id, c_mktsegment AS metric, l_extendedprice AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus IN ('F', 'O')""")
def join03_metric_samples(spark, sf_dir):
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    j = li.join(o.where(F.col("o_orderstatus").isin("F", "O")), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.concat_ws("#rep=", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("analysis_id"), F.col("c_mktsegment").alias("metric"), F.col("l_extendedprice").alias("value"))
