"""Agent trajectories and operational metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import trajectory as J
from ..functions.text import casefold
from ..registry import query
from ..views import table, trajectories, with_views


def _steps(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    return t.groupBy("agent").agg(F.array_sort(F.collect_list(F.struct("step", "kind", "tool", "arguments", "success", "decision"))).alias("steps"))


@query(with_views("traj", """WITH f AS (SELECT agent, step FROM traj WHERE kind = 'tool_result' AND NOT success),
g AS (SELECT agent, max(step) AS upto FROM traj WHERE kind = 'final_output' OR (kind = 'tool_result' AND success) GROUP BY agent),
r AS (SELECT f.agent, avg((f.step < coalesce(upto, -1))::INT) AS recovery FROM f LEFT JOIN g USING (agent) GROUP BY f.agent)
SELECT agent, count(*) AS n_steps, round(sum((kind = 'tool_result' AND success)::INT) / nullif(sum((kind = 'tool_result')::INT), 0), 9) AS success_rate,
 round(coalesce((sum((kind = 'tool_call')::INT) - count(DISTINCT CASE WHEN kind = 'tool_call' THEN tool || '|' || arguments END)) / nullif(sum((kind = 'tool_call')::INT), 0), 0), 9) AS redundant_rate,
 round(any_value(recovery), 9) AS recovery FROM traj LEFT JOIN r USING (agent) GROUP BY agent"""))
def agt04_trajectory_metrics(spark, sf_dir):
    s = F.col("steps")
    return _steps(spark, sf_dir).select(
        "agent",
        F.size(s).cast("long").alias("n_steps"),
        F.round(J.tool_success_rate(s), 9).alias("success_rate"),
        F.round(J.redundant_call_rate(s), 9).alias("redundant_rate"),
        F.round(J.recovery_rate(s), 9).alias("recovery"),
    )


@query(with_views("traj", """WITH a AS (SELECT agent, row_number() OVER (PARTITION BY agent ORDER BY step) - 1 AS i, [kind, tool, arguments, coalesce(decision, '-')] AS x FROM traj WHERE kind IN ('tool_call', 'model_decision')),
f AS (SELECT a.agent, n, a.i AS start FROM a, range(1, 5) r(n) WHERE (SELECT count(*) FROM a b JOIN a c ON c.agent = b.agent AND c.i = b.i + n AND c.x = b.x WHERE b.agent = a.agent AND b.i >= a.i AND b.i < a.i + 2 * n) = 2 * n),
l AS (SELECT agent, n, min(start) AS start FROM f GROUP BY agent, n), g AS (SELECT agent, min(n) AS n FROM l GROUP BY agent)
SELECT DISTINCT traj.agent, g.agent IS NOT NULL AS loop, l.start, l.n AS cycle_length FROM traj LEFT JOIN g USING (agent) LEFT JOIN l ON l.agent = g.agent AND l.n = g.n"""))
def agt06_loop_detection(spark, sf_dir):
    found = _steps(spark, sf_dir).select("agent", J.find_loop(F.col("steps"), decision="decision").alias("l"))
    return found.select("agent", F.col("l").isNotNull().alias("loop"), "l.start", "l.cycle_length")


@query(with_views("traj", """WITH c AS (SELECT agent, tool, row_number() OVER (PARTITION BY agent ORDER BY step) AS i FROM traj WHERE kind = 'tool_call'), e(i, tool) AS (VALUES (1, 'tool-0'), (2, 'tool-1'), (3, 'tool-2')),
h AS (SELECT agent, count(*) AS n FROM c JOIN e USING (i, tool) GROUP BY agent)
SELECT DISTINCT traj.agent, round(coalesce(n, 0) / 3, 9) AS accuracy FROM traj LEFT JOIN h USING (agent)"""))
def agt01_tool_selection(spark, sf_dir):
    expected = F.array(*[F.lit(f"tool-{k}") for k in range(3)])
    return _steps(spark, sf_dir).select("agent", F.round(J.tool_selection_accuracy(F.col("steps"), expected), 9).alias("accuracy"))


@query(with_views("traj", "SELECT agent, step, kind = 'tool_result' AND NOT success AS failed, coalesce(max((kind = 'final_output' OR (kind = 'tool_result' AND success))::INT) OVER (PARTITION BY agent ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS recovers FROM traj"))
def win12_recovery_window(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    good = (F.col("kind") == "final_output") | ((F.col("kind") == "tool_result") & F.col("success"))
    later = Window.partitionBy("agent").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    return t.select("agent", "step", ((F.col("kind") == "tool_result") & ~F.col("success")).alias("failed"), (F.coalesce(F.max(good.cast("int")).over(later), F.lit(0)) == 1).alias("recovers"))


@query("""WITH s AS (SELECT user_id AS agent, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT agent, count(*) FILTER (before > ts) AS out_of_order, count(*) AS n FROM s GROUP BY agent""")
def win13_monotonic_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(F.col("user_id").alias("agent"), (before > F.col("ts")).alias("bad")).groupBy("agent").agg(F.count_if("bad").alias("out_of_order"), F.count("*").alias("n"))


@query("""SELECT user_id % 10 AS suite, metric, count(*) AS total, count(v) AS available, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95
FROM (SELECT user_id, 'latency-ms' AS metric, CASE WHEN event_type <> 'error' THEN value END AS v FROM events UNION ALL SELECT user_id, 'total-tokens', json_extract_string(props, '$.k')::DOUBLE FROM events UNION ALL SELECT user_id, 'cost-usd', NULL FROM events) GROUP BY ALL""")
def op_operational_metrics(spark, sf_dir):
    """Operational fields as metrics: an absent field is missing, 0 is a value; mean and quantiles."""
    from ..operators.operational import long_form, summarize

    e = table(spark, sf_dir, "events")
    operational = F.struct(
        F.when(F.col("event_type") != "error", F.col("value")).alias("latency_ms"), F.get_json_object("props", "$.k").cast("double").alias("total_tokens"), F.lit(None).cast("double").alias("cost_usd")
    )
    return summarize(long_form(e.select((F.col("user_id") % 10).alias("suite"), operational.alias("operational")), ["latency-ms", "total-tokens", "cost-usd"]), ["suite"])


@query("""WITH d AS (SELECT * FROM (VALUES ('cost-usd', 'minimize', 'usd'), ('end-to-end-latency-ms', 'minimize', 'ms'), ('error', 'minimize', 'indicator'), ('generation-latency-ms', 'minimize', 'ms'), ('input-tokens', 'minimize', 'tokens'),
 ('latency-ms', 'minimize', 'ms'), ('output-tokens', 'minimize', 'tokens'), ('refusal', 'minimize', 'indicator'), ('retrieval-latency-ms', 'minimize', 'ms'), ('throughput-tokens-per-second', 'maximize', 'tokens/s'), ('time-to-first-token-ms', 'minimize', 'ms'),
 ('total-tokens', 'minimize', 'tokens'), ('agent/step-count', 'minimize', 'steps'), ('agent/tool-cost-usd', 'minimize', 'usd')) t(identifier, direction, unit)),
v AS (SELECT 'latency-ms' AS metric, CASE WHEN event_type <> 'error' THEN value END AS v FROM events UNION ALL SELECT 'total-tokens', json_extract_string(props, '$.k')::DOUBLE FROM events UNION ALL SELECT 'error', (event_type = 'error')::INT FROM events)
SELECT identifier, direction, unit, count(metric) AS total, count(v) AS available FROM d LEFT JOIN v ON metric = identifier GROUP BY ALL""")
def udf03_operational_definitions(spark, sf_dir):
    """The operational definitions with the samples that were measured by each and those that have a value."""
    from ..operators.operational import long_form
    from ..plans.registry import definitions

    failed = F.col("event_type") == "error"
    fields = F.struct(F.when(~failed, F.col("value")).alias("latency_ms"), F.get_json_object("props", "$.k").cast("double").alias("total_tokens"), failed.cast("double").alias("error"))
    measured = long_form(table(spark, sf_dir, "events").select(fields.alias("operational")), ["latency-ms", "total-tokens", "error"])
    counts = measured.groupBy(F.col("metric").alias("identifier")).agg(F.count("*").alias("total"), F.count("value").alias("available"))
    known = definitions(spark).where("family = 'operational'").select("identifier", "direction", "unit")
    return known.join(counts, "identifier", "left").na.fill(0, ["total", "available"])


@query(with_views("traj", """WITH c AS (SELECT agent, json_extract_string(arguments, '$.k')::BIGINT <= 7 AND tool IN ('tool-0', 'tool-1', 'tool-2') AS ok FROM traj WHERE kind = 'tool_call')
SELECT agent, count(*) AS n_calls, round(avg(ok::INT), 9) AS validity, round(1 - avg(ok::INT), 9) AS invalid_rate FROM c GROUP BY agent"""))
def agt02_tool_argument_validity(spark, sf_dir):
    """Calls whose arguments fit their tool's schema; an unknown tool is invalid."""
    from ..functions.canonical import schema_errors

    schema = '{"type":"object","required":["k"],"properties":{"k":{"type":"integer","maximum":7}}}'
    calls = trajectories(spark, sf_dir).where("kind = 'tool_call'")
    ok = F.col("tool").isin("tool-0", "tool-1", "tool-2") & (F.size(schema_errors(schema)(F.col("arguments"))) == 0)
    v = F.avg(ok.cast("double"))
    return calls.groupBy("agent").agg(F.count("*").alias("n_calls"), F.round(v, 9).alias("validity"), F.round(1 - v, 9).alias("invalid_rate"))


@query(with_views("traj", """SELECT agent, count(*) AS n_steps, count(*) FILTER (kind = 'tool_call') AS n_calls, round(coalesce(sum(CASE WHEN kind = 'tool_call' THEN CASE tool WHEN 'tool-0' THEN 0.01 WHEN 'tool-1' THEN 0.02 ELSE 0 END END), 0), 9)::DOUBLE AS tool_cost FROM traj GROUP BY agent"""))
def agt10_trajectory_summary(spark, sf_dir):
    """Steps, calls and the price of the calls by a map of tools."""
    price = F.create_map(F.lit("tool-0"), F.lit(0.01), F.lit("tool-1"), F.lit(0.02))
    call = F.col("kind") == "tool_call"
    t = trajectories(spark, sf_dir).groupBy("agent")
    return t.agg(F.count("*").alias("n_steps"), F.count_if(call).alias("n_calls"), F.round(F.coalesce(F.sum(F.when(call, F.coalesce(F.try_element_at(price, F.col("tool")), F.lit(0.0)))), F.lit(0.0)), 9).alias("tool_cost"))


@query("""WITH b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(replace(lower(text), 'ß', 'ss'), '\\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split_regex(replace(lower(text || ' the of and'), 'ß', 'ss'), '\\s+'), lambda w: w <> '' AND length(w) <= 3)) AS o FROM benchmark)
SELECT item_id, round(len(list_intersect(a, o)) / len(a), 9) AS grounded FROM b""")
def agt09_grounded_share(spark, sf_dir):
    """The share of an answer's words that its tools put out; here the tools put out the words that are short once folded."""
    b = table(spark, sf_dir, "benchmark")
    outputs = F.filter(F.split(casefold(F.concat("text", F.lit(" the of and"))), r"\s+"), lambda w: F.length(w) <= 3)
    return b.select("item_id", F.round(J.grounded_share(F.col("text"), outputs), 9).alias("grounded"))


@query(with_views("traj", "SELECT agent, count(*) FILTER (NOT (json_extract_string(arguments, '$.k')::BIGINT < 90)) AS violations, min(CASE WHEN NOT (json_extract_string(arguments, '$.k')::BIGINT < 90) THEN step END) AS first_violation FROM traj GROUP BY agent"))
def agt08_state_consistency(spark, sf_dir):
    """An invariant over every step's state: how often, and where first, it breaks."""
    broken = ~(F.get_json_object("arguments", "$.k").cast("long") < 90)
    return trajectories(spark, sf_dir).groupBy("agent").agg(F.count_if(broken).alias("violations"), F.min(F.when(broken, F.col("step"))).alias("first_violation"))
