"""Queries over the event stream, run to its end.

Each query reads the table as a stream with ``availableNow`` into a Parquet or memory-free
sink in the shared folder, and returns what the sink holds; the SQL is the batch result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..streaming import progress, windows
from ..views import table


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def str07_tumbling_windows(spark, sf_dir):
    def daily(s):
        w = s.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))

    return progress.run_to_end(spark, progress.event_stream(spark, sf_dir, watermark="7 days"), daily, mode="complete")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, max(event_id) AS last_event FROM events GROUP BY user_id")
def str01_run_progress(spark, sf_dir):
    def counters(s):
        return s.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("event_id").alias("last_event"))

    return progress.run_to_end(spark, progress.event_stream(spark, sf_dir), counters, mode="complete")


@query("SELECT event_id, user_id, event_type FROM events")
def str04_idempotent_completion(spark, sf_dir):
    """Every event arrives twice and is kept once."""

    def once(s):
        twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
        return twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")

    return progress.run_to_end(spark, progress.event_stream(spark, sf_dir, watermark="400 days"), once, mode="append")


@query("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, round(sum(value * value), 4) AS squares FROM events WHERE event_type <> 'error' GROUP BY user_id")
def str06_incremental_moments(spark, sf_dir):
    """Mergeable counts, sums and squares, kept as stream state."""

    def moments(s):
        ok = s.where("event_type <> 'error'")
        return ok.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 4).alias("squares"))

    return progress.run_to_end(spark, progress.event_stream(spark, sf_dir), moments, mode="complete")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '2 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS n FROM s GROUP BY user_id, session""")
def str07b_sessions(spark, sf_dir):
    """Session windows, as a batch query."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    # a session ends at the gap itself; the SQL side keeps an event exactly at the gap, so the gap is one microsecond longer
    w = e.groupBy("user_id", F.session_window("t", "2 hours 1 microsecond").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_micros("w.start").alias("started_us"), "n")


@query("SELECT event_id // 1000 AS batch, count(*) AS n FROM events GROUP BY ALL")
def str02_outbox_relay(spark, sf_dir):
    """An outbox relayed by ``foreachBatch`` into a sink that takes every event once."""
    rows = progress.relay(spark, progress.event_stream(spark, sf_dir), key="event_id")
    return rows.groupBy(F.floor(F.col("event_id") / 1000).cast("long").alias("batch")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '2 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
w AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL '2 hours 1 microsecond' AS b, count(*) AS n FROM s GROUP BY user_id, session)
SELECT user_id, epoch_us(a) AS started_us, n FROM w WHERE b < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '1 day' FROM events)""")
def str07c_session_stream(spark, sf_dir):
    """Sessions as a stream: those whose end the watermark has passed, a day behind the last event."""

    def closed(s):
        return windows.sessions(s, "ts", "2 hours 1 microsecond", ["user_id"], [F.count("*").alias("n")]).select("user_id", F.unix_micros("started").alias("started_us"), "n")

    return progress.run_to_end(spark, progress.event_stream(spark, sf_dir, watermark="1 day"), closed)


@query("""WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' * k AS start, event_type, value FROM events, range(4) r(k))
SELECT epoch_us(start) AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL""")
def str07d_sliding_windows(spark, sf_dir):
    """Days that begin every six hours."""

    def slid(s):
        made = windows.sliding_counts(s, "ts", "1 day", "6 hours", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
        return made.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 6).alias("total"))

    return progress.run_to_end(spark, progress.event_stream(spark, sf_dir, watermark="7 days"), slid, mode="complete")


@query("""WITH w AS (SELECT (user_id % 5)::VARCHAR AS segment, epoch_ms(ts) // 86400000 * 86400000 AS start_ms, count(*) AS n, count(*) FILTER (event_type = 'error') / count(*) AS s FROM events GROUP BY ALL),
l AS (SELECT *, lag(s) OVER (PARTITION BY segment ORDER BY start_ms) AS b FROM w)
SELECT segment, start_ms, n, round(s, 9) AS share, round(b, 9) AS before, round(abs(s - b), 9) AS distance, coalesce(abs(s - b) >= 0.02, false) AS alert FROM l
WHERE start_ms + 86400000 <= (SELECT epoch_ms(max(ts)) - 86400000 FROM events)""")
def str05b_drift_stream(spark, sf_dir):
    """Each day's share of failures of a segment against its day before, put out when the day closes."""

    def alerts(s):
        d = windows.drift(s.withColumn("segment", F.col("user_id") % 5), "segment", "ts", F.col("event_type") == "error", 86_400_000, 0.02)
        return d.select(F.col("key").alias("segment"), "start_ms", "n", *[F.round(c, 9).alias(c) for c in ("share", "before", "distance")], "alert")

    return progress.run_to_end(spark, progress.event_stream(spark, sf_dir, watermark="1 day"), alerts)
