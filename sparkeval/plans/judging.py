"""Judging: pair designs, verdicts, agreement of judges, drift, rankings, run orchestration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import lifecycle as L
from ..operators import pairwise as P
from ..registry import query
from ..views import outcomes, table, with_views

SEED = 20260730


@query(with_views("outcomes", """WITH j AS (SELECT assignment, line, verdict, confidence FROM outcomes),
c AS (SELECT assignment, count(*) FILTER (verdict = 'A') AS a, count(*) FILTER (verdict = 'B') AS b, count(*) FILTER (verdict = 'tie') AS t, count(*) FILTER (verdict <> 'abstain') AS usable, avg(confidence) AS conf FROM j GROUP BY assignment)
SELECT assignment, CASE WHEN usable = 0 THEN 'tie' WHEN a > greatest(b, t) THEN 'A' WHEN b > greatest(a, t) THEN 'B' ELSE 'tie' END AS verdict, usable,
 round(1 - greatest(a, b, t) / usable, 9) AS disagreement, round(conf, 9) AS confidence FROM c"""))
def agg13_aggregate_judgments(spark, sf_dir):
    r = P.aggregate_judgments(outcomes(spark, sf_dir), "assignment")
    return r.select("assignment", "verdict", "usable", F.round("disagreement", 9).alias("disagreement"), F.round("confidence", 9).alias("confidence"))


@query(with_views("outcomes", """SELECT variant_a, round(coalesce(count(*) FILTER (verdict = 'A') / nullif(count(*) FILTER (verdict IN ('A', 'B')), 0), 0.5), 9) AS a_rate,
 round(abs(coalesce(count(*) FILTER (verdict = 'A') / nullif(count(*) FILTER (verdict IN ('A', 'B')), 0), 0.5) - 0.5), 9) AS deviation, count(*) FILTER (verdict IN ('A', 'B')) AS decisive FROM outcomes GROUP BY variant_a"""))
def agg14_position_bias(spark, sf_dir):
    r = P.position_bias(outcomes(spark, sf_dir), ["variant_a"])
    return r.select("variant_a", F.round("a_rate", 9).alias("a_rate"), F.round("deviation", 9).alias("deviation"), "decisive")


@query(with_views("outcomes", """WITH o AS (SELECT assignment, line, CASE verdict WHEN 'A' THEN variant_a WHEN 'B' THEN variant_b END AS winner FROM outcomes)
SELECT a.assignment, a.line, CASE WHEN a.winner IS NOT NULL AND b.winner IS NOT NULL THEN a.winner = b.winner END AS consistent FROM o a JOIN o b ON a.assignment = b.assignment AND b.line = a.line + 2"""))
def agg15_reversed_consistency(spark, sf_dir):
    """Each verdict with that of its counterpart two lines on."""
    o = outcomes(spark, sf_dir).select("assignment", "line", "variant_a", "variant_b", "verdict")
    other = o.select("assignment", (F.col("line") - 2).alias("line"), *[F.col(c).alias(f"r_{c}") for c in ("variant_a", "variant_b", "verdict")])
    return o.join(other, ["assignment", "line"]).select("assignment", "line", P.same_winner("variant_a", "variant_b", "verdict", "r_variant_a", "r_variant_b", "r_verdict").alias("consistent"))


@query(with_views("outcomes", """WITH w AS (SELECT line, count(*) FILTER (verdict = 'A') AS a, count(*) FILTER (verdict = 'B') AS b, count(*) FILTER (verdict = 'tie') AS t, median(confidence) AS med, avg(confidence) AS mean FROM outcomes GROUP BY line)
SELECT line, CASE WHEN a > greatest(b, t) THEN 'A' WHEN b > greatest(a, t) THEN 'B' ELSE 'tie' END AS verdict, round(med, 9) AS median_score, round(mean, 9) AS mean_score FROM w"""))
def agg16_aggregate_responses(spark, sf_dir):
    r = P.aggregate_responses(outcomes(spark, sf_dir).withColumn("scores", F.create_map(F.lit("quality"), F.col("confidence"))), ["line"])
    return r.select("line", "verdict", F.round("median_score", 9).alias("median_score"), F.round("mean_score", 9).alias("mean_score"))


@query(with_views("outcomes", """WITH s AS (SELECT line, verdict, count(*) / sum(count(*)) OVER (PARTITION BY line) AS share FROM outcomes WHERE line IN (1, 2) GROUP BY line, verdict),
v AS (SELECT sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) / 2 AS tv FROM (SELECT * FROM s WHERE line = 1) a FULL OUTER JOIN (SELECT * FROM s WHERE line = 2) b USING (verdict)),
m AS (SELECT avg(CASE WHEN line = 2 THEN confidence END) - avg(CASE WHEN line = 1 THEN confidence END) AS shift FROM outcomes)
SELECT round(tv, 9) AS verdict_distance, round(shift, 9) AS confidence_shift, round(-5 * shift, 9) AS quality_shift, tv > 0.15 OR abs(-5 * shift) > 0.5 AS alert FROM v, m"""))
def st35_judge_drift(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    o = o.withColumn("quality", 5 - 5 * F.col("confidence"))
    d = P.judge_drift(o.where("line = 1"), o.where("line = 2"), dimensions=("quality",))
    return d.select(*[F.round(c, 9).alias(c) for c in ("verdict_distance", "confidence_shift", "quality_shift")], "alert")


@query(with_views("outcomes", """WITH o AS (SELECT assignment, verdict, row_number() OVER (PARTITION BY assignment ORDER BY line, verdict) AS i FROM outcomes)
SELECT round(sum((a.verdict <> b.verdict)::INT) / count(*), 9) AS mismatch_rate, count(*) AS pairs FROM o a JOIN o b ON a.assignment = b.assignment AND a.i < b.i"""))
def st36_ensemble_disagreement(spark, sf_dir):
    return P.ensemble_disagreement(outcomes(spark, sf_dir), "assignment", "verdict").withColumn("mismatch_rate", F.round("mismatch_rate", 9))


@query(with_views("outcomes", """WITH u AS (SELECT least(variant_a, variant_b) AS a, greatest(variant_a, variant_b) AS b, CASE WHEN verdict = 'tie' THEN 't' WHEN (verdict = 'A') = (variant_a < variant_b) THEN 'a' ELSE 'b' END AS w FROM outcomes)
SELECT a, b, count(*) FILTER (w = 'a') AS wins_a, count(*) FILTER (w = 'b') AS wins_b, count(*) FILTER (w = 't') AS ties,
 round((count(*) FILTER (w = 'a') + 0.5 * count(*) FILTER (w = 't')) / count(*), 9) AS win_rate FROM u GROUP BY a, b"""))
def st21_pair_outcomes(spark, sf_dir):
    c = P.pair_outcomes(outcomes(spark, sf_dir))
    return c.withColumn("win_rate", F.round((F.col("wins_a") + 0.5 * F.col("ties")) / (F.col("wins_a") + F.col("wins_b") + F.col("ties")), 9))


def _ranking(spark, sf_dir, f):
    from ..operators import rankings

    return rankings.rank(P.pair_outcomes(outcomes(spark, sf_dir)), f)


@query()
def st26_bradley_terry(spark, sf_dir):
    from ..operators.rankings import bradley_terry

    return _ranking(spark, sf_dir, bradley_terry)


@query()
def st27_davidson(spark, sf_dir):
    from ..operators.rankings import davidson

    return _ranking(spark, sf_dir, davidson)


@query()
def st28_descriptive_elo(spark, sf_dir):
    from ..operators.rankings import elo_fold, games_of

    return elo_fold(games_of(P.pair_outcomes(outcomes(spark, sf_dir))), ["a", "b", "kind"])


@query()
def st28b_elo_in_order(spark, sf_dir):
    """The ratings after every judged pair, one by one in the order of assignments."""
    from ..operators.rankings import elo_fold

    score = F.when(F.col("verdict") == "A", 1.0).when(F.col("verdict") == "B", 0.0).otherwise(0.5)
    games = outcomes(spark, sf_dir).select("assignment", "line", F.col("variant_a").alias("a"), F.col("variant_b").alias("b"), score.alias("score"), F.lit(1).alias("games"))
    return elo_fold(games, ["assignment", "line"])


@query("""SELECT r.r_name AS record_key, a.n_name AS left_variant, b.n_name AS right_variant, s AS slot, rep AS repetition FROM region r, nation a, nation b, range(2) t(s), range(2) u(rep) WHERE a.n_name < b.n_name AND a.n_regionkey = 1 AND b.n_regionkey = 1""")
def join08_pair_cells(spark, sf_dir):
    """Records x pairs of variants x slots x repetitions."""
    records = table(spark, sf_dir, "region").select(F.col("r_name").alias("record_key"))
    variants = [r[0] for r in table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_name").orderBy("n_name").collect()]  # a design's variants: a handful
    return P.pair_cells(records, variants, slots=2, repetitions=2)


@query(f"""WITH v(l, r) AS (VALUES ('base', 'candidate'), ('base', 'third'), ('candidate', 'third')), c AS (SELECT doc_id::VARCHAR AS record_key, l, r FROM documents, v),
d AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY sha256('{SEED}' || chr(31) || record_key || chr(31) || l || chr(31) || r || chr(31) || '0' || chr(31) || '0')) AS n, ('0x' || substr(sha256('{SEED}' || chr(31) || l || chr(31) || r), 1, 2))::BIGINT AS f FROM c),
e AS (SELECT record_key, 0::BIGINT AS slot, 0::BIGINT AS repetition, CASE WHEN (f + n) % 2 = 1 THEN r ELSE l END AS variant_a, CASE WHEN (f + n) % 2 = 1 THEN l ELSE r END AS variant_b, false AS reversed FROM d),
h AS (SELECT *, sha1('{SEED}' || chr(31) || record_key || chr(31) || variant_a || chr(31) || variant_b || chr(31) || '0' || chr(31) || '0') AS h FROM e)
SELECT record_key, slot, repetition, variant_a, variant_b, reversed, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex(('0x' || substr(h, 17, 2))::BIGINT % 64 + 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS assignment_id FROM h""")
def pw01_balanced_assignments(spark, sf_dir):
    """A balanced blinded design over all documents: three variants, one slot, one repetition."""
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_key"))
    return P.balanced_assignments(P.pair_cells(records, ["base", "candidate", "third"], 1, 1), SEED)


@query(f"""SELECT o_orderkey::VARCHAR AS record_key, rep::BIGINT AS repetition, ('0x' || substr(sha256(unhex('{SEED.to_bytes(8, "big").hex()}') || encode(o_orderkey::VARCHAR) || unhex(lpad(to_hex(rep), 8, '0'))), 1, 16))::UBIGINT::VARCHAR AS seed
FROM orders, range(1, 4) r(rep)""")
def orc01_task_fanout(spark, sf_dir):
    """Records x repetitions with the derived unsigned 64-bit seeds."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_key"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("repetition"))
    return o.withColumn("seed", hashing.task_seed(SEED, F.col("record_key"), F.col("repetition")).cast("string"))


STATE_OF = {"signup": "draft", "view": "queued", "click": "running", "error": "pausing", "purchase": "paused"}


@query("""WITH s AS (SELECT user_id AS run, CASE event_type WHEN 'signup' THEN 'draft' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'pausing' ELSE 'paused' END AS state, ts, event_id FROM events),
p AS (SELECT run, state, lag(state) OVER (PARTITION BY run ORDER BY ts, event_id) AS before FROM s),
t(before, state) AS (VALUES ('draft', 'validating'), ('validating', 'draft'), ('validating', 'queued'), ('queued', 'running'), ('queued', 'cancelling'), ('queued', 'failed'), ('running', 'pausing'), ('running', 'cancelling'), ('running', 'completed'),
 ('running', 'completed_with_errors'), ('running', 'failed'), ('pausing', 'paused'), ('pausing', 'cancelling'), ('paused', 'queued'), ('paused', 'cancelling'), ('cancelling', 'cancelled'))
SELECT run, count(*) AS illegal FROM p WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.before = p.before AND t.state = p.state) GROUP BY run""")
def orc03_illegal_transitions(spark, sf_dir):
    """Changes of a run's state that its lifecycle does not allow."""
    state = F.create_map(*[F.lit(x) for pair in STATE_OF.items() for x in pair])[F.col("event_type")]
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id", state.alias("state"))
    return L.illegal_transitions(e, "run", ["ts", "event_id"], "state").groupBy("run").agg(F.count("*").alias("illegal"))


@query("""WITH c AS (SELECT user_id AS run, count(*) AS total, count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS ok, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS cancelled FROM events GROUP BY user_id)
SELECT run, CASE WHEN ok + failed + cancelled < total THEN 'running' WHEN cancelled > 0 THEN 'cancelled' WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS state FROM c""")
def orc04_finalize_if_settled(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("event_type").isin("view", "click", "purchase")).alias("succeeded"),
        F.count_if(F.col("event_type") == "error").alias("failed"),
        F.count_if(F.col("event_type") == "signup").alias("cancelled"),
    )
    return c.select("run", P.settled_state().alias("state"))


@query("""WITH c AS (SELECT user_id AS run, count(*) AS total, count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS ok, count(*) FILTER (event_type = 'error' AND user_id % 4 <> 3) AS failed, count(*) FILTER (event_type = 'signup') AS cancelled FROM events GROUP BY user_id),
s AS (SELECT *, CASE run % 5 WHEN 0 THEN 'pausing' WHEN 1 THEN 'cancelling' WHEN 2 THEN 'queued' ELSE 'running' END AS state, CASE WHEN run % 2 = 0 THEN 0 ELSE total - ok - failed - cancelled END AS active FROM c)
SELECT run, CASE WHEN state = 'pausing' THEN CASE WHEN active = 0 THEN 'paused' ELSE state END WHEN ok + failed + cancelled <> total THEN state WHEN state = 'cancelling' THEN 'cancelled'
 WHEN state = 'running' THEN CASE WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END ELSE state END AS state FROM s""")
def orc04b_finalize_by_state(spark, sf_dir):
    """The next state of runs that are running, pausing, cancelling or queued."""
    failed = (F.col("event_type") == "error") & (F.col("user_id") % 4 != 3)
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type").isin("view", "click", "purchase")).alias("succeeded"), F.count_if(failed).alias("failed"), F.count_if(F.col("event_type") == "signup").alias("cancelled"),
    )
    turn = F.col("run") % 5
    state = F.when(turn == 0, "pausing").when(turn == 1, "cancelling").when(turn == 2, "queued").otherwise("running")
    left = F.col("total") - F.col("succeeded") - F.col("failed") - F.col("cancelled")
    return c.select("run", P.finalized_state(state, F.when(F.col("run") % 2 == 0, 0).otherwise(left)).alias("state"))


@query("""SELECT o_orderkey, o_custkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS spent,
 sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) > 500000 AS over_budget FROM orders""")
def orc06_budget_check(spark, sf_dir):
    """Running cost in task order against a limit."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w)
    return o.select("o_orderkey", "o_custkey", spent.cast("double").alias("spent"), (spent > 500000).alias("over_budget"))


@query("""SELECT event_id, ((json_extract_string(props, '$.k')::BIGINT * 3 + 256 * 15) / 1000000.0)::DOUBLE AS estimated_cost FROM events""")
def orc07_estimated_cost(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("decimal(20,0)")
    return table(spark, sf_dir, "events").select("event_id", ((k * 3 + 256 * 15) / F.lit(1000000).cast("decimal(20,0)")).cast("double").alias("estimated_cost"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS org, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, sha256(event_id::VARCHAR) AS h FROM events),
c AS (SELECT org, event_id, seq, sha256(repeat('0', 64) || h) AS chain FROM e WHERE seq = 1 UNION ALL SELECT e.org, e.event_id, e.seq, sha256(c.chain || e.h) FROM c JOIN e ON e.org = c.org AND e.seq = c.seq + 1)
SELECT org, event_id, seq, chain FROM c""")
def win11_audit_links(spark, sf_dir):
    """Each event's link: the digest of the link before it and its own digest."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    s = e.select(F.col("user_id").alias("org"), "event_id", seq.alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("h"))
    return L.hash_chain(s, "org", "seq", "h").select("org", "event_id", "seq", "chain")


@query("""WITH l AS (SELECT item_id, string_split(text, chr(10)) AS lines FROM benchmark), x AS (SELECT item_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l)
SELECT item_id, 'A:L' || lpad(i::VARCHAR, 4, '0') AS evidence_id, line FROM x""")
def jdg03_evidence_ids(spark, sf_dir):
    """The numbered lines of a judged answer."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return b.select("item_id", F.format_string("A:L%04d", F.col("i") + 1).alias("evidence_id"), "line")


@query(f"""SELECT item_id, ('0x' || substr(sha256('{SEED}:' || item_id || ':' || rep), 1, 16))::UBIGINT::VARCHAR AS seed, substr(sha256('judge:' || item_id || ':' || rep), 1, 32) AS idempotency_key, rep::INT AS repetition FROM benchmark, range(3) r(rep)""")
def jdg05_repetition_seeds(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repetition"))
    key = lambda head: F.concat_ws(":", F.lit(head), "item_id", "repetition")
    return b.select("item_id", hashing.hex_u64(F.substring(F.sha2(key(str(SEED)), 256), 1, 16)).cast("string").alias("seed"), F.substring(F.sha2(key("judge"), 256), 1, 32).alias("idempotency_key"), "repetition")


@query("""SELECT user_id, event_id, substr(sha256('judge|2|' || user_id || '|' || event_id), 1, 32) AS nonce,
 round(least(15.0::DOUBLE, pow(2.0, event_id % 6) + ('0x' || substr(sha256(user_id || '|' || event_id || '|' || (event_id % 6 + 1)), 1, 4))::BIGINT / 65535.0::DOUBLE), 9) AS delay FROM events""")
def jdg05b_nonces_and_delays(spark, sf_dir):
    """The nonce of a repetition, and how long its attempts wait."""
    from ..functions.judge import nonce, retry_delay

    e = table(spark, sf_dir, "events")
    seed, repetition = F.col("user_id"), F.col("event_id")
    return e.select("user_id", "event_id", nonce("judge", "2", seed, repetition).alias("nonce"), F.round(retry_delay(seed, repetition, repetition % 6 + 1, 30.0), 9).alias("delay"))


@query("""SELECT event_id, CASE WHEN ok THEN v END AS verdict, CASE WHEN ok THEN 0.5::DOUBLE END AS confidence, CASE WHEN event_id % 97 = 0 THEN 'schema version' WHEN k > 5 THEN 'score range' END AS error,
 CASE WHEN ok THEN k::DOUBLE END AS quality, CASE WHEN ok THEN 'A:L0001' END AS evidence
FROM (SELECT *, k <= 5 AND event_id % 97 <> 0 AS ok FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN event_type = 'error' THEN 'abstain' WHEN value > 50 THEN 'A' ELSE 'B' END AS v FROM events))""")
def jdg02_parse_responses(spark, sf_dir):
    """Judge responses built from the events, read back under the strict contract."""
    from ..functions.judge import VERSION, parse_responses

    e = table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type") == "error", "abstain").when(F.col("value") > 50, "A").otherwise("B")
    body = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 97 == 0, "judge-response/0").otherwise(VERSION).alias("schema_version"), verdict.alias("verdict"), F.create_map(F.lit("quality"), F.get_json_object("props", "$.k").cast("double")).alias("scores"), F.lit(0.5).alias("confidence"),
            F.array(F.lit("A:L0001")).alias("evidence"), F.lit("because").alias("justification"), F.when(verdict == "abstain", "unclear").alias("abstention_reason"),
        ),
        {"ignoreNullFields": "false"},
    )
    read = parse_responses(e.select("event_id", body.alias("response")), {"quality": (0.0, 5.0)}, ["A:L0001"], version=VERSION)
    return read.select("event_id", "verdict", "confidence", "error", F.col("scores")["quality"].alias("quality"), F.array_join("evidence", ",").alias("evidence"))


@query("""WITH b AS (SELECT item_id, text, string_split(text, chr(10)) AS lines FROM benchmark)
SELECT item_id, '<<A n0 bytes=' || octet_length(encode(text)) || '>>' || chr(10) || array_to_string(['A:L' || lpad(i::VARCHAR, 4, '0') || ' ' || lines[i] FOR i IN range(1, len(lines) + 1)], chr(10)) || chr(10) || '<</A n0>>' AS message FROM b""")
def jdg01_judge_envelope(spark, sf_dir):
    """The numbered, delimited form in which a judge sees an answer."""
    from ..functions.judge import envelope

    return table(spark, sf_dir, "benchmark").select("item_id", envelope(F.col("text"), "A", "n0").alias("message"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS failure_share,
 round(abs(count(*) FILTER (event_type = 'error') / count(*) - (SELECT count(*) FILTER (event_type = 'error') / count(*) FROM events)), 9) AS distance FROM events GROUP BY ALL""")
def str05_drift_windows(spark, sf_dir):
    """Each day's share of failures against the overall share."""
    e = table(spark, sf_dir, "events")
    share = F.count_if(F.col("event_type") == "error") / F.count("*")
    daily = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(share.alias("s"))
    return daily.crossJoin(F.broadcast(e.agg(share.alias("all")))).select("day", F.round("s", 9).alias("failure_share"), F.round(F.abs(F.col("s") - F.col("all")), 9).alias("distance"))


@query("""SELECT c_nationkey, sum(c_acctbal::DECIMAL(30, 12))::DOUBLE AS balance, 'usd' AS currency FROM customer GROUP BY c_nationkey""")
def orc10_money(spark, sf_dir):
    """Sums of one currency in decimals of twelve places."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast("decimal(30,12)")).cast("double").alias("balance"), F.lit("usd").alias("currency"))


@query("""SELECT o_custkey, sum(o_totalprice::DECIMAL(30, 12))::DOUBLE AS total, 'EUR' AS currency,
 (sum(o_totalprice::DECIMAL(30, 12)) - min(o_totalprice::DECIMAL(30, 12)))::DOUBLE AS rest FROM orders GROUP BY o_custkey""")
def orc10b_money_totals(spark, sf_dir):
    """Checked sums and differences of amounts in one currency."""
    from ..operators import money as M

    o = table(spark, sf_dir, "orders").select("o_custkey", M.money(F.col("o_totalprice"), F.lit(" eur")).alias("price"))
    least = o.groupBy("o_custkey").agg(F.min("price").alias("least"))
    both = M.total(o, ["o_custkey"], "price").join(least, "o_custkey")
    rest = M.minus(F.col("total"), F.col("least"))["amount"]
    return both.select("o_custkey", F.col("total.amount").cast("double").alias("total"), "total.currency", rest.cast("double").alias("rest"))


@query("""SELECT 'd' || r_regionkey AS experiment, sha256('{"name":"' || r_name || '","version":1}') AS snapshot_hash FROM region""")
def orc02_snapshot_hashes(spark, sf_dir):
    """Digests of canonical snapshots, whatever the order of their keys."""
    from ..functions.canonical import canonical_json

    raw = F.concat(F.lit('{"version": 1.0, "name": "'), F.col("r_name"), F.lit('"}'))
    return table(spark, sf_dir, "region").select(F.concat(F.lit("d"), F.col("r_regionkey").cast("string")).alias("experiment"), F.sha2(canonical_json(raw), 256).alias("snapshot_hash"))


@query("SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_type AS state FROM events")
def win10_run_event_sequence(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", F.row_number().over(w).cast("long").alias("sequence"), F.col("event_type").alias("state"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' OR (event_type = 'click' AND value < 20) ORDER BY user_id, event_id LIMIT 1")
def srt05_claim_next_task(spark, sf_dir):
    """The first task that waits or whose lease ran out."""
    waiting = (F.col("event_type") == "view") | ((F.col("event_type") == "click") & (F.col("value") < 20))
    return table(spark, sf_dir, "events").where(waiting).orderBy("user_id", "event_id").limit(1).select("event_id", "user_id")


@query("""SELECT o.o_orderkey AS run, c.c_name AS experiment, n.n_name AS snapshot FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def join05_run_context(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("o_orderkey").alias("run"), F.col("c_name").alias("experiment"), F.col("n_name").alias("snapshot"))


@query("""SELECT s_nationkey AS key FROM supplier UNION SELECT c_nationkey FROM customer""")
def set01_union_of_keys(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"))).distinct()


@query("""WITH a AS (SELECT l_orderkey AS o, l_linenumber % 5 AS x, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS o, l_suppkey % 5 AS x, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT o AS unit, sum(least(a.n, b.n))::BIGINT AS shared FROM a JOIN b USING (o, x) GROUP BY o""")
def set05_multiset_intersection(spark, sf_dir):
    """How many labels two multisets of a unit share, from their counts."""
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("unit"), (F.col("l_linenumber") % 5).cast("long").alias("x")).agg(F.count("*").alias("a"))
    b = li.groupBy(F.col("l_orderkey").alias("unit"), (F.col("l_suppkey") % 5).alias("x")).agg(F.count("*").alias("b"))
    return a.join(b, ["unit", "x"]).groupBy("unit").agg(F.sum(F.least("a", "b")).alias("shared"))


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')""")
def join10_semi_and_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return o.join(li.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(li.where("l_linestatus = 'O'"), "o_orderkey", "left_anti")
