"""Tests, effects, multiplicity, agreement, planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as R
from ..operators import inference as I
from ..operators import resampling as S
from ..registry import query
from ..views import raters, table, with_views
from .comparison import ALIGNED, _aligned

Z = 1.959963984540054  # fixed value: the normal quantile of 0.975


def _paired(spark, sf_dir):
    return _aligned(spark, sf_dir).where("paired")


@query("""WITH c AS (SELECT l_returnflag AS g, count(*) AS n, count(*) FILTER (l_quantity > 25) AS k FROM lineitem GROUP BY l_returnflag)
SELECT g, k, n, round(k / n, 9) AS rate, round(((k / n) + 1.959963984540054 ^ 2 / (2 * n) - 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 1.959963984540054 ^ 2 / (4 * n * n))) / (1 + 1.959963984540054 ^ 2 / n), 9) AS wilson_low,
 round(((k / n) + 1.959963984540054 ^ 2 / (2 * n) + 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 1.959963984540054 ^ 2 / (4 * n * n))) / (1 + 1.959963984540054 ^ 2 / n), 9) AS wilson_high FROM c""")
def st03_wilson_interval(spark, sf_dir):
    """The closed form, natively."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("k"))
    p, n = F.col("k") / F.col("n"), F.col("n")
    centre, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return c.select("g", "k", "n", F.round(p, 9).alias("rate"), F.round((centre - half) / (1 + Z * Z / n), 9).alias("wilson_low"), F.round((centre + half) / (1 + Z * Z / n), 9).alias("wilson_high"))


@query()
def st02_mean_t_interval(spark, sf_dir):
    return I.mean_t_interval(_paired(spark, sf_dir), ["metric"], "difference")


@query()
def st04_exact_intervals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("large", F.col("l_quantity") > 25)
    return I.proportion_intervals(li, ["l_returnflag"], "large")


@query()
def st06_bootstrap_groups(spark, sf_dir):
    """Percentile intervals of the median of each supplier nation's account balances."""
    return S.bootstrap_quantile(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", 0.5, "percentile", 200, 3)


@query()
def st07b_stratified_bootstrap(spark, sf_dir):
    """The mean price of each status of orders, by resamples that keep the number of orders of each priority."""
    return S.bootstrap_sums(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", resamples=200, seed=11, stratum="o_orderpriority")


@query()
def st07c_cluster_bootstrap(spark, sf_dir):
    """The mean price of each status of orders, by resamples of whole customers."""
    return S.bootstrap_sums(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", resamples=200, seed=11, cluster="o_custkey")


@query()
def st07_poisson_bootstrap(spark, sf_dir):
    return I.poisson_bootstrap_mean(_paired(spark, sf_dir), ["metric"], "record_id", "difference", 200, 11)


@query(with_views("runs", f"""WITH {ALIGNED} SELECT metric, count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS statistic FROM p GROUP BY metric"""))
def st10_paired_t_statistic(spark, sf_dir):
    return _paired(spark, sf_dir).groupBy("metric").agg(F.count("difference").alias("n"), F.round(F.avg("difference") / (F.stddev_samp("difference") / F.sqrt(F.count("difference"))), 6).alias("statistic"))


@query()
def st10_paired_t_test(spark, sf_dir):
    return I.paired_t(_paired(spark, sf_dir), ["metric"], "difference")


@query(with_views("runs", f"""WITH {ALIGNED},
rk AS (SELECT metric, d, (rank() OVER (PARTITION BY metric ORDER BY abs(d)) + rank() OVER (PARTITION BY metric ORDER BY abs(d)) + count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0 AS mid FROM p WHERE d <> 0)
SELECT metric, least(sum(CASE WHEN d > 0 THEN mid ELSE 0 END), sum(CASE WHEN d < 0 THEN mid ELSE 0 END))::DOUBLE AS statistic FROM rk GROUP BY metric"""))
def st11_wilcoxon_statistic(spark, sf_dir):
    return I.wilcoxon(_paired(spark, sf_dir), ["metric"], "difference").select("metric", "statistic")


@query()
def st11_wilcoxon_test(spark, sf_dir):
    return I.wilcoxon(_paired(spark, sf_dir), ["metric"], "difference").select("metric", "n", "statistic", "p_value")


@query(with_views("runs", f"WITH {ALIGNED} SELECT metric, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties FROM p GROUP BY metric"))
def st12_sign_counts(spark, sf_dir):
    return I.sign_counts(_paired(spark, sf_dir), ["metric"], "difference")


#: The exact two-sided binomial test of w wins and l losses, m together.
BINOMIAL = "least(1, 2 * sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))))"


@query(with_views("runs", f"""WITH {ALIGNED}, c AS (SELECT metric, count(*) FILTER (d > 0) AS w, count(*) FILTER (d < 0) AS l, count(*) FILTER (d <> 0)::DOUBLE AS m FROM p GROUP BY metric),
i AS (SELECT metric, w, l, m, unnest(range(0, least(w, l) + 1))::DOUBLE AS i FROM c) SELECT metric, w AS wins, l AS losses, round({BINOMIAL}, 9) AS p_value FROM i GROUP BY metric, w, l"""))
def st12_sign_test(spark, sf_dir):
    t = I.sign_test(I.sign_counts(_paired(spark, sf_dir), ["metric"], "difference"))
    return t.select("metric", "wins", "losses", F.round("p_value", 9).alias("p_value"))


@query("""SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_left, count(*) FILTER (quality = 0 AND toxic = 1) AS only_right, round(avg(quality), 9) AS left_rate, round(avg(toxic), 9) AS right_rate, round(avg(toxic) - avg(quality), 9) AS risk_difference,
 round(avg(toxic) / nullif(avg(quality), 0), 9) AS risk_ratio, round(count(*) FILTER (quality = 0 AND toxic = 1) / nullif(count(*) FILTER (quality = 1 AND toxic = 0), 0), 9) AS odds_ratio FROM labels""")
def st20_paired_binary_effects(spark, sf_dir):
    e = R.binary_effects(table(spark, sf_dir, "labels"), "quality", "toxic")
    return e.select("only_left", "only_right", *[F.round(c, 9).alias(c) for c in e.columns[2:]])


@query(f"""WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS w, count(*) FILTER (quality = 1 AND toxic = 0) AS l, count(*) FILTER (quality <> toxic)::DOUBLE AS m FROM labels),
i AS (SELECT w, l, m, unnest(range(0, least(w, l) + 1))::DOUBLE AS i FROM c) SELECT w AS only_right, l AS only_left, round({BINOMIAL}, 9) AS p_value FROM i GROUP BY w, l""")
def st13_mcnemar_test(spark, sf_dir):
    e = R.binary_effects(table(spark, sf_dir, "labels"), "quality", "toxic")
    t = I.sign_test(e.select(F.col("only_right").alias("wins"), F.col("only_left").alias("losses"), F.lit(0).cast("long").alias("ties")))
    return t.select(F.col("wins").alias("only_right"), F.col("losses").alias("only_left"), F.round("p_value", 9).alias("p_value"))


@query("""SELECT l_returnflag AS g, count(*) FILTER (l_tax > l_discount) AS wins, count(*) FILTER (l_tax < l_discount) AS losses, count(*) FILTER (l_tax = l_discount) AS ties FROM lineitem GROUP BY ALL""")
def st16_pairwise_counts(spark, sf_dir):
    """Wins, losses and the ties that the test leaves out but reports."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_tax") - F.col("l_discount")).alias("d"))
    return I.sign_counts(li, ["g"], "d")


@query()
def st14_permutation_test(spark, sf_dir):
    return I.permutation_test(_paired(spark, sf_dir), ["metric"], "difference", 1000, 5)


@query("""WITH p AS (SELECT s_nationkey AS nation, s_suppkey AS id, round(s_acctbal - 5000) AS d, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier),
q AS (SELECT * FROM p WHERE i < 9 AND d <> 0), n AS (SELECT nation, count(*) AS n, sum(d) AS observed FROM q GROUP BY nation),
r AS (SELECT nation, d, row_number() OVER (PARTITION BY nation ORDER BY id) - 1 AS j FROM q),
f AS (SELECT nation, f.flip, sum(CASE WHEN (f.flip >> j::INT) & 1 = 0 THEN d ELSE -d END) AS s FROM n JOIN range(512) f(flip) ON f.flip < (1::BIGINT << n::INT) JOIN r USING (nation) GROUP BY nation, f.flip)
SELECT nation, n, observed AS observed_sum, round(avg((abs(s) >= abs(observed))::INT), 9) AS p_two_sided, round(avg((s >= observed)::INT), 9) AS p_greater FROM f JOIN n USING (nation) GROUP BY ALL""")
def st14_exact_permutation(spark, sf_dir):
    """Exact sign flips of the first nine balances of each nation, against a round sum."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    s = table(spark, sf_dir, "supplier").withColumn("i", first).where("i <= 9").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.round(F.col("s_acctbal") - 5000).alias("d"))
    two = I.permutation_test(s, ["nation"], "d", unit="s_suppkey").where("n > 0").select("nation", "n", "observed_sum", F.round("p_value", 9).alias("p_two_sided"))
    return two.join(I.permutation_test(s, ["nation"], "d", unit="s_suppkey", alternative="greater").select("nation", F.round("p_value", 9).alias("p_greater")), "nation")


@query()
def st17_paired_tost(spark, sf_dir):
    return I.paired_tost(_paired(spark, sf_dir), ["metric"], "difference", -5.0, 5.0)


@query("""WITH t AS (SELECT l_returnflag AS family, l_linenumber::VARCHAR AS key, avg(l_discount) * 0.4 AS p FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, key) AS rk, count(*) OVER (PARTITION BY family) AS n FROM t)
SELECT family, key, round(p, 9) AS p, round(least(1, p * n), 9) AS bonferroni, round(least(1, max((n - rk + 1) * p) OVER (PARTITION BY family ORDER BY p, key ROWS UNBOUNDED PRECEDING)), 9) AS holm,
 round(least(1, min(p * n / rk) OVER (PARTITION BY family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS bh FROM r""")
def st22_adjust_p_values(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_linenumber").cast("string").alias("key")).agg((F.avg("l_discount") * 0.4).alias("p"))
    a = I.adjust_p_values(p)
    return a.select("family", "key", *[F.round(c, 9).alias(c) for c in ("p", "bonferroni", "holm", "bh")])


KAPPA = """
l AS (SELECT x, dense_rank() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT x FROM (SELECT r1 AS x FROM rt UNION ALL SELECT r2 FROM rt))), k AS (SELECT greatest(count(*) - 1, 1) AS m FROM l),
c AS (SELECT la.i AS i, lb.i AS j, count(*) AS n FROM rt JOIN l la ON rt.r1 = la.x JOIN l lb ON rt.r2 = lb.x GROUP BY ALL), t AS (SELECT sum(n) AS n FROM c),
o AS (SELECT sum(n * pow(i - j, 2) / (m * m)) AS obs FROM c, k), e AS (SELECT sum(a.n * b.n * pow(a.i - b.j, 2) / (m * m)) / any_value(t.n) AS ex FROM (SELECT i, sum(n) AS n FROM c GROUP BY i) a, (SELECT j, sum(n) AS n FROM c GROUP BY j) b, k, t)"""


@query(f"WITH rt AS (SELECT l_linenumber AS r1, least(7, floor(l_quantity / 8)::INT + 1) AS r2 FROM lineitem), {KAPPA} SELECT round(1 - obs / ex, 9) AS kappa FROM o, e")
def st23_weighted_kappa(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a"), F.least(F.lit(7), F.floor(F.col("l_quantity") / 8).cast("int") + 1).alias("b"))
    return R.weighted_kappa(li, "a", "b", "quadratic").select(F.round("kappa", 9).alias("kappa"))


@query("""WITH r AS (SELECT l_orderkey AS u, l_linestatus AS v, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem),
o AS (SELECT avg((a.v <> b.v)::INT) AS d FROM r a JOIN r b ON a.u = b.u AND a.i < b.i), c AS (SELECT v, count(*)::DOUBLE AS n FROM r GROUP BY v),
e AS (SELECT 1 - sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS d FROM c) SELECT round(1 - o.d / e.d, 9) AS alpha FROM o, e""")
def st24_krippendorff_alpha(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linestatus").alias("label"))
    return R.krippendorff_nominal(li).select(F.round("alpha", 9).alias("alpha"))


@query("""WITH x AS (SELECT c_acctbal AS a, avg(o_totalprice) AS b FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_acctbal),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT round(corr(ra, rb), 9) AS spearman, count(*) AS n FROM r""")
def st25_rank_correlation(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    x = c.join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("b")), "c_custkey").select("c_custkey", F.col("c_acctbal").alias("a"), "b")
    return R.spearman(x, "a", "b").select(F.round("spearman", 9).alias("spearman"), "n")


@query("""WITH x AS (SELECT l_linenumber AS a, least(7, floor(l_quantity / 8)::INT + 1) AS b, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT sum(CASE WHEN p.a < q.a AND p.b < q.b THEN p.n * q.n ELSE 0 END)::DOUBLE AS c, sum(CASE WHEN p.a < q.a AND p.b > q.b THEN p.n * q.n ELSE 0 END)::DOUBLE AS d FROM x p, x q),
t AS (SELECT sum(n)::DOUBLE AS n FROM x), ta AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(n)::DOUBLE AS m FROM x GROUP BY a)), tb AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(n)::DOUBLE AS m FROM x GROUP BY b))
SELECT round((c - d) / sqrt((n * (n - 1) / 2 - ta.t) * (n * (n - 1) / 2 - tb.t)), 9) AS tau_b FROM s, t, ta, tb""")
def st25b_kendall_tau(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a"), F.least(F.lit(7), F.floor(F.col("l_quantity") / 8).cast("int") + 1).alias("b"))
    return R.kendall_tau_b(li, "a", "b").select(F.round("tau_b", 9).alias("tau_b"))


@query(with_views("raters", f"WITH rt AS (SELECT a AS r1, b AS r2 FROM raters), {KAPPA} SELECT round((SELECT avg((r1 = r2)::INT) FROM rt), 9) AS accuracy, round(1 - obs / ex, 9) AS kappa FROM o, e"))
def st33_categorical_calibration(spark, sf_dir):
    r = raters(spark, sf_dir)
    k = R.weighted_kappa(r, "a", "b", "nominal").select(F.round("kappa", 9).alias("kappa"))
    return r.agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 9).alias("accuracy")).crossJoin(k)


@query("""WITH r AS (SELECT o_orderstatus AS e, CASE WHEN o_totalprice > 400000 THEN 'X' WHEN o_custkey % 3 = 0 THEN 'F' WHEN o_custkey % 3 = 1 THEN 'O' ELSE 'P' END AS o FROM orders),
l AS (SELECT DISTINCT x FROM (SELECT e AS x FROM r UNION ALL SELECT o FROM r)),
p AS (SELECT x, count(*) FILTER (e = x AND o = x)::DOUBLE AS tp, count(*) FILTER (e = x)::DOUBLE AS ne, count(*) FILTER (o = x)::DOUBLE AS no FROM l, r GROUP BY x)
SELECT sum(ne)::BIGINT AS n, round(sum(tp) / sum(ne), 9) AS accuracy, round(avg(CASE WHEN no > 0 THEN tp / no ELSE 0 END), 9) AS macro_precision, round(avg(CASE WHEN ne > 0 THEN tp / ne ELSE 0 END), 9) AS macro_recall,
 round(avg(CASE WHEN ne + no > 0 THEN 2 * tp / (ne + no) ELSE 0 END), 9) AS macro_f1, round((sum(tp) / sum(ne) - sum(ne * no) / sum(ne) / sum(ne)) / (1 - sum(ne * no) / sum(ne) / sum(ne)), 9) AS cohen_kappa FROM p""")
def st33b_calibration_scores(spark, sf_dir):
    """Labels against a rule of thumb, one label of which never was expected."""
    third = F.col("o_custkey") % 3
    guess = F.when(F.col("o_totalprice") > 400000, "X").when(third == 0, "F").when(third == 1, "O").otherwise("P")
    made = R.categorical_calibration(table(spark, sf_dir, "orders").withColumn("guess", guess), "o_orderstatus", "guess")
    return made.select("n", *[F.round(c, 9).alias(c) for c in made.columns if c != "n"])


@query("SELECT round(avg(pow(l_discount * 10 - (l_quantity > 25)::INT, 2)), 9) AS brier FROM lineitem")
def st34_brier_score(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return R.brier(li, F.col("l_discount") * 10, F.col("l_quantity") > 25).select(F.round("brier", 9).alias("brier"))


@query("""SELECT o_orderpriority AS strat, count(*) AS n, CASE WHEN count(*) < 30 THEN 'VERY_SMALL_SAMPLE' WHEN min(o_totalprice) = max(o_totalprice) THEN 'ZERO_VARIANCE' ELSE '' END AS warnings FROM orders GROUP BY ALL""")
def st01_sample_warnings(spark, sf_dir):
    return R.sample_warnings(table(spark, sf_dir, "orders"), [F.col("o_orderpriority").alias("strat")], "o_totalprice")


@query("""WITH g AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, avg(o_totalprice - 240000) / stddev_samp(o_totalprice) AS effect, avg((o_totalprice > 240000)::INT) AS preference, count(*) AS n FROM orders GROUP BY ALL)
SELECT priority, status, greatest(2, ceil(pow((1.959963984540054 + 0.8416212335729143) / abs(effect), 2)))::BIGINT AS pairs, greatest(2, ceil(pow((1.6448536269514722 + 0.8416212335729143) / abs(effect), 2)))::BIGINT AS pairs_one_sided,
 ceil(ceil(pow((1.959963984540054 * 0.5 + 0.8416212335729143 * sqrt(preference * (1 - preference))) / abs(preference - 0.5), 2)) / 0.8)::BIGINT AS judgments, round((1.959963984540054 + 0.8416212335729143) / sqrt(n), 9) AS detectable FROM g""")
def st30_sample_sizes(spark, sf_dir):
    """The pairs and judgments that the effect seen in each group would need, and the effect that its size detects."""
    from ..functions import planning as N

    price = F.col("o_totalprice")
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(
        (F.avg(price - 240000) / F.stddev_samp(price)).alias("effect"), F.avg((price > 240000).cast("double")).alias("preference"), F.count("*").alias("n")
    )
    return g.select(
        "priority", "status", N.continuous_sizes(F.col("effect")).alias("pairs"), N.continuous_sizes(F.col("effect"), one_sided=True).alias("pairs_one_sided"),
        N.preference_sizes(F.col("preference"), 0.2).alias("judgments"), F.round(N.detectable_effects(F.col("n")), 9).alias("detectable"),
    )


@query()
def st15_paired_bootstrap_test(spark, sf_dir):
    return I.paired_bootstrap_test(_paired(spark, sf_dir), ["metric"], "record_id", "difference", 1000, 13)


@query()
def st08_quantile_bootstrap(spark, sf_dir):
    """Basic and BCa intervals of a quantile and a mean, by group."""
    s = table(spark, sf_dir, "supplier")
    low = S.bootstrap_quantile(s, ["s_nationkey"], "s_acctbal", 0.9, "basic", 200, 3).withColumn("method", F.lit("basic"))
    return low.unionByName(S.bootstrap_sums(s, ["s_nationkey"], "s_acctbal", method="bca", resamples=200, seed=3).drop("n_effective").withColumn("method", F.lit("bca")))
