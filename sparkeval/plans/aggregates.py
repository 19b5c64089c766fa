"""Aggregates with explicit denominators, classification scores, costs, benchmark roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rate
from ..operators import aggregates as G
from ..registry import query
from ..views import outcomes, raters, runs, table, with_views


@query(with_views("runs", """SELECT metric, run, round(avg(value), 6) AS value, count(value) AS available_count, count(*) FILTER (status = 'missing') AS missing_count,
 count(*) FILTER (status = 'failed') AS failed_count, count(*) AS total_count, 0::BIGINT AS pending_count FROM runs GROUP BY metric, run"""))
def agg01_aggregate_metrics(spark, sf_dir):
    r = runs(spark, sf_dir)
    counters = r.groupBy("metric", "run").agg(F.count("*").alias("total_tasks"), F.count("*").alias("settled_tasks"), F.lit(0).cast("long").alias("cancelled_tasks"), F.lit(0).cast("long").alias("failed_tasks"))
    done = G.aggregate_metrics(r, counters, ["metric", "run"])
    return done.withColumn("value", F.round("value", 6))


@query("""SELECT l_returnflag AS slice, round(avg(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END), 6) AS value, count(*) + 2 AS total, count(*) FILTER (l_linenumber <> 3) AS available,
 count(*) FILTER (l_linenumber = 3) AS missing, 2::BIGINT AS failed FROM lineitem GROUP BY l_returnflag""")
def agg02_aggregate_mean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("scalar", F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount")))
    return G.aggregate_mean(li.withColumnRenamed("l_returnflag", "slice"), ["slice"], "scalar", failed=2).withColumn("value", F.round("value", 6))


@query("""SELECT l_returnflag AS currency, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice::DECIMAL(30,2) ELSE 0 END)::DOUBLE AS actual,
 sum(CASE WHEN l_linestatus <> 'F' THEN l_extendedprice::DECIMAL(30,2) ELSE 0 END)::DOUBLE AS estimated, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def agg03_summarize_costs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("currency"), (F.col("l_linestatus") != "F").alias("is_estimate"), F.col("l_extendedprice").cast("decimal(30,2)").alias("amount"))
    c = G.summarize_costs(li)
    return c.select("currency", F.col("actual").cast("double").alias("actual"), F.col("estimated").cast("double").alias("estimated"), "n")


@query("SELECT event_type AS category, 'k' || json_extract_string(props, '$.k') AS error_kind, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL")
def agg04_summarize_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.groupBy(F.col("event_type").alias("category"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("error_kind")).agg(F.count("*").alias("n"))


@query(with_views("runs", """SELECT metric, run, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'missing') AS pending FROM runs GROUP BY ALL"""))
def agg05_run_counters(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("metric", "run").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        (F.count("*") - F.count_if(F.col("status").isin("succeeded", "failed"))).alias("pending"),
    )


@query(with_views("raters", "SELECT a AS expected, b AS predicted, count(*) AS n FROM raters GROUP BY ALL"))
def agg06_confusion_matrix(spark, sf_dir):
    return raters(spark, sf_dir).groupBy(F.col("a").alias("expected"), F.col("b").alias("predicted")).agg(F.count("*").alias("n"))


@query(with_views("raters", """WITH l AS (SELECT DISTINCT x AS label FROM (SELECT a AS x FROM raters UNION ALL SELECT b FROM raters)),
c AS (SELECT label, count(*) FILTER (a = label AND b = label) AS tp, count(*) FILTER (a <> label AND b = label) AS fp, count(*) FILTER (a = label AND b <> label) AS fn FROM raters, l GROUP BY label),
s AS (SELECT label, tp, fp, fn, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM c)
SELECT round((SELECT avg((a = b)::INT) FROM raters), 9) AS accuracy, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, round(avg(f), 9) AS macro_f1,
 round(sum(tp) / sum(tp + fp), 9) AS micro_precision, round(sum(tp) / sum(tp + fn), 9) AS micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 9) AS micro_f1,
 round(sum(p * support) / sum(support), 9) AS weighted_precision, round(sum(r * support) / sum(support), 9) AS weighted_recall, round(sum(f * support) / sum(support), 9) AS weighted_f1 FROM s"""))
def agg06_classification_metrics(spark, sf_dir):
    m = G.classification_metrics(raters(spark, sf_dir), "a", "b")
    return m.select([F.round(c, 9).alias(c) for c in m.columns])


@query("""WITH x AS (SELECT (quality = 1) AS ea, (toxic = 1) AS eb, (toxic = 0) AS pa, (quality = 0) AS pb FROM labels),
c AS (SELECT 'a' AS label, ea AS e, pa AS p FROM x UNION ALL SELECT 'b', eb, pb FROM x),
s AS (SELECT label, count(*) FILTER (e AND p) AS tp, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM c GROUP BY label)
SELECT round((SELECT avg((ea = pa AND eb = pb)::INT) FROM x), 9) AS subset_accuracy, round(sum(tp) / sum(tp + fp), 9) AS micro_precision, round(sum(tp) / sum(tp + fn), 9) AS micro_recall,
 round(2 * sum(tp) / sum(2 * tp + fp + fn), 9) AS micro_f1, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS macro_f1 FROM s""")
def agg07_multilabel_metrics(spark, sf_dir):
    la = table(spark, sf_dir, "labels")
    pick = lambda a, b: F.array_compact(F.array(F.when(a, F.lit("a")), F.when(b, F.lit("b"))))
    rows = la.select(pick(F.col("quality") == 1, F.col("toxic") == 1).alias("expected"), pick(F.col("toxic") == 0, F.col("quality") == 0).alias("predicted"))
    m = G.multilabel_metrics(rows, "expected", "predicted")
    return m.select([F.round(c, 9).alias(c) for c in m.columns])


@query("""SELECT user_id % 10 AS suite, round(count(*) FILTER (event_type = 'signup') / count(*), 9) AS refusal_rate, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS error_rate,
 round(avg(value), 6) AS mean_score, round(count(*) FILTER (value = 0) / count(*), 9) AS unsupported_rate, round(sum(json_extract_string(props, '$.k')::BIGINT) / nullif(sum(value), 0), 6) AS throughput FROM events GROUP BY ALL""")
def agg08_rates(spark, sf_dir):
    """Refusal, error and support rates, and throughput; empty denominators are null."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("suite"))
    n = F.count("*")
    return e.agg(
        F.round(rate(F.count_if(F.col("event_type") == "signup"), n), 9).alias("refusal_rate"),
        F.round(rate(F.count_if(F.col("event_type") == "error"), n), 9).alias("error_rate"),
        F.round(F.avg("value"), 6).alias("mean_score"),
        F.round(rate(F.count_if(F.col("value") == 0), n), 9).alias("unsupported_rate"),
        F.round(rate(F.sum(F.get_json_object("props", "$.k").cast("long")), F.nullif(F.sum("value"), F.lit(0.0))), 6).alias("throughput"),
    )


@query("""WITH b AS (SELECT event_id // 3 AS case_id, event_type, json_extract_string(props, '$.k')::BIGINT AS tokens FROM events),
c AS (SELECT case_id, 'c' || (case_id % 5) AS category, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type <> 'error' AND tokens >= 3) AS correct, sum(tokens) AS tokens,
 count(DISTINCT event_type) = 1 AND bool_and(event_type <> 'error') AS consistent FROM b GROUP BY case_id)
SELECT category, count(*) AS cases, sum((correct >= requests // 2 + 1)::INT)::BIGINT AS majority_correct, sum(consistent::INT)::BIGINT AS consistent, sum(requests)::BIGINT AS requests, sum(failures)::BIGINT AS failures,
 sum(correct)::BIGINT AS correct_requests, sum(tokens)::BIGINT AS tokens FROM c GROUP BY category""")
def agg17_aggregate_benchmark(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tokens = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(
        F.floor(F.col("event_id") / 3).alias("case_id"),
        F.concat(F.lit("c"), (F.floor(F.col("event_id") / 3) % 5).cast("string")).alias("category"),
        F.col("event_type").alias("response"),
        (F.col("event_type") == "error").alias("failed"),
        ((F.col("event_type") != "error") & (tokens >= 3)).alias("correct"),
        tokens.alias("tokens"),
    )
    return G.benchmark_by_category(rows)


@query("""SELECT user_id % 10 AS suite, count(value) AS n, round(avg(value), 3) AS mean, round(min(value), 3) AS minimum, round(max(value), 3) AS maximum,
 round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95 FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def agg18_latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").withColumn("suite", F.col("user_id") % 10)
    return G.latency_summary(e, ["suite"], "value")


@query()
def agg18b_latency_intervals(spark, sf_dir):
    """Cluster-bootstrap intervals of the mean latency, users being the clusters."""
    from ..operators.inference import poisson_bootstrap_mean

    e = table(spark, sf_dir, "events").where("event_type <> 'error'").withColumn("suite", F.col("user_id") % 10)
    return poisson_bootstrap_mean(e, ["suite"], "user_id", "value", 200, 5)


@query()
def agg18c_latency_quantile_intervals(spark, sf_dir):
    """Median and 95th percentile of the latency with cluster-bootstrap limits, users being the clusters."""
    from ..operators.resampling import cluster_quantiles

    e = table(spark, sf_dir, "events").where("event_type <> 'error'").withColumn("suite", F.col("user_id") % 10)
    return cluster_quantiles(e, ["suite"], "user_id", "value", [0.5, 0.95], 200, 5)


def _wilson_sql(k: str, n: str) -> str:
    z = "1.959963984540054"
    side = lambda s: f"round(({k} / {n} + {z} ^ 2 / (2 * {n}) {s} {z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z} ^ 2 / (4 * {n} * {n}))) / (1 + {z} ^ 2 / {n}), 9)"
    return f"{side('-')} AS {{0}}_low, {side('+')} AS {{0}}_high"


@query(f"""WITH b AS (SELECT event_id // 3 AS case_id, event_type, json_extract_string(props, '$.k')::BIGINT AS tokens FROM events),
c AS (SELECT case_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type <> 'error' AND tokens >= 3) AS correct, sum(tokens) AS tokens,
 count(DISTINCT event_type) = 1 AND bool_and(event_type <> 'error') AS consistent FROM b GROUP BY case_id),
t AS (SELECT count(*)::DOUBLE AS cases, sum((correct >= requests // 2 + 1)::INT)::DOUBLE AS majority, sum(consistent::INT) AS consistent, sum(requests)::DOUBLE AS requests, sum(failures)::DOUBLE AS failures, sum(correct) AS correct, sum(tokens) AS tokens FROM c)
SELECT cases::BIGINT AS cases, majority::BIGINT AS majority_correct, round(majority / cases, 9) AS accuracy, {_wilson_sql("majority", "cases").format("accuracy")}, requests::BIGINT AS requests, correct::BIGINT AS correct_requests,
 round(correct / requests, 9) AS request_accuracy, consistent::BIGINT AS consistent, failures::BIGINT AS failures, round(failures / requests, 9) AS failure_rate, {_wilson_sql("failures", "requests").format("failure")},
 tokens::BIGINT AS input_tokens, (2 * tokens)::BIGINT AS output_tokens, round((tokens * 1.5 + 2 * tokens * 7.5) / 1000000, 9) AS cost FROM t""")
def agg17b_benchmark_summary(spark, sf_dir):
    """The headline row: majority accuracy and failures with Wilson limits, consistency, tokens and list price."""
    tokens = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 3).alias("case_id"), F.lit("all").alias("category"), F.col("event_type").alias("response"), (F.col("event_type") == "error").alias("failed"),
        ((F.col("event_type") != "error") & (tokens >= 3)).alias("correct"), tokens.alias("input_tokens"), (2 * tokens).alias("output_tokens"),
    )
    made = G.benchmark_summary(rows, 1.5, 7.5)
    return made.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])


@query("""SELECT coalesce(l_returnflag, 'all') AS slice, coalesce(l_linestatus, 'all') AS metric, count(*) AS n, round(avg(l_quantity), 6) AS value, round(quantile_cont(l_quantity, 0.9), 6) AS p90
 FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def agg20_slice_rollup(spark, sf_dir):
    """Every slice and the overall value in one pass."""
    li = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return li.agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("value"), F.round(F.percentile("l_quantity", 0.9), 6).alias("p90")).select(
        F.coalesce("l_returnflag", F.lit("all")).alias("slice"), F.coalesce("l_linestatus", F.lit("all")).alias("metric"), "n", "value", "p90"
    )


@query("SELECT o_orderpriority AS slice, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS labels FROM orders GROUP BY ALL")
def agg20b_distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("slice")).agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("labels"))


@query(with_views("outcomes", """WITH c AS (SELECT assignment, count(*) FILTER (verdict = 'A') AS a, count(*) FILTER (verdict = 'B') AS b, count(*) FILTER (verdict = 'tie') AS t FROM outcomes GROUP BY assignment)
SELECT sum(a)::BIGINT AS wins_a, sum(b)::BIGINT AS wins_b, sum(t)::BIGINT AS ties, round((sum(a) + 0.5 * sum(t)) / sum(a + b + t), 9) AS rate_a,
 round(avg(1 - greatest(a, b, t) / (a + b + t)), 9) AS disagreement, round(sum(a) / sum(a + b), 9) AS position_rate FROM c"""))
def agg12_pair_aggregate(spark, sf_dir):
    m = G.pair_aggregate(outcomes(spark, sf_dir))
    return m.select("wins_a", "wins_b", "ties", *[F.round(c, 9).alias(c) for c in ("rate_a", "disagreement", "position_rate")])


@query("""SELECT metric, value FROM (SELECT 'region' AS metric, r_regionkey AS value, r_name FROM region) WHERE r_name = 'ASIA' OR value BETWEEN 1 AND 2""")
def flt02_slice_predicate(spark, sf_dir):
    from ..operators.predicates import any_of, compile_predicate

    r = table(spark, sf_dir, "region").select(F.lit("region").alias("metric"), F.col("r_regionkey").alias("value"), "r_name")
    p = any_of([compile_predicate({"field": "r_name", "operator": "equals", "value": "ASIA"}), compile_predicate({"field": "value", "operator": "range", "minimum": 1, "maximum": 2})])
    return r.where(p).select("metric", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND value BETWEEN 10 AND 50 AND props IS NOT NULL AND NOT (user_id = 3)")
def flt02b_nested_slices(spark, sf_dir):
    """A slice within its parent slices: all predicates together, pushed to the scan."""
    from ..operators.predicates import all_of, compile_predicate

    rules = [
        {"field": "event_type", "operator": "in", "values": ["click", "view"]},
        {"field": "value", "operator": "range", "minimum": 10, "maximum": 50},
        {"field": "props", "operator": "exists"},
        {"field": "user_id", "operator": "not_equals", "value": 3},
    ]
    return table(spark, sf_dir, "events").where(all_of(map(compile_predicate, rules))).select("event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
def flt01_tenant_filter(spark, sf_dir):
    """Rows of one tenant: equalities on every read, a semi join for the grant."""
    grants = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(grants, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")
