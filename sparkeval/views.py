"""The driver tables as the tables of an evaluation platform, in Spark and in SQL.

Each view is a pair: a builder of a DataFrame from (spark, sf_dir), and the text of a common
table expression that says the same, for ``with_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records_v1(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("key"), "text", "lang", "source")


def records_v2(spark, sf_dir) -> DataFrame:
    """Version 2: every tenth record is gone, every tenth edited, and some are new."""
    d = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    edited = d.withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    new = d.where("doc_id % 100 = 2").withColumn("key", F.concat(F.lit("new-"), F.col("doc_id").cast("string")))
    return edited.select(F.col("doc_id").cast("string").alias("key"), "text", "lang", "source").unionByName(new.select("key", "text", "lang", "source"))


def runs(spark, sf_dir) -> DataFrame:
    """Per-sample metric rows of a baseline and a candidate run."""
    e = table(spark, sf_dir, "events")
    record = F.floor(F.col("event_id") / 2).cast("long")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 17 == 0, "missing").otherwise("succeeded")
    return e.select(
        F.concat(F.lit("metric-"), (record % 4).cast("string")).alias("metric"),
        F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("candidate").alias("run"),
        record.alias("record_id"),
        status.alias("status"),
        F.when(status == "succeeded", F.col("value")).alias("value"),
        "user_id",
    )


def raters(spark, sf_dir) -> DataFrame:
    """Two raters of every labelled document."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit"), F.col("quality").cast("string").alias("a"), (1 - F.col("toxic")).cast("string").alias("b"))


def trajectories(spark, sf_dir) -> DataFrame:
    """Steps of agents: the events of a user in time order."""
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "view", "model_decision")
        .when(F.col("event_type") == "click", "tool_call")
        .when(F.col("event_type").isin("purchase", "error"), "tool_result")
        .otherwise("final_output")
    )
    return e.select(
        F.col("user_id").alias("agent"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("step"),
        kind.alias("kind"),
        F.concat(F.lit("tool-"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string")).alias("tool"),
        F.col("props").alias("arguments"),
        (F.col("event_type") == "purchase").alias("success"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("go-"), (F.col("user_id") % 2).cast("string"))).alias("decision"),
    )


def outcomes(spark, sf_dir) -> DataFrame:
    """Judged pairs: two lines of one order, by their suppliers' nations; the larger quantity wins."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    li = li.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("s_nationkey") % 5).cast("int").alias("item"))
    a = li.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("item").alias("a"), F.col("l_quantity").alias("qa"))
    b = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("line"), F.col("item").alias("b"), F.col("l_quantity").alias("qb"))
    pairs = a.join(b, ["l_orderkey", "line"]).where("a <> b")
    verdict = F.when(F.abs(F.col("qa") - F.col("qb")) <= 1, "tie").when(F.col("qa") > F.col("qb"), "A").otherwise("B")
    return pairs.select(
        F.col("l_orderkey").alias("assignment"), "line", F.concat(F.lit("item-"), F.col("a").cast("string")).alias("variant_a"),
        F.concat(F.lit("item-"), F.col("b").cast("string")).alias("variant_b"), verdict.alias("verdict"), ((F.col("qa") + F.col("qb")) / 100.0).alias("confidence"),
    )


def turns(spark, sf_dir) -> DataFrame:
    """Prediction and reference texts: a turn and the next one of a conversation."""
    c = table(spark, sf_dir, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    row = c.select("conv_id", "turn", F.col("text").alias("prediction"), nxt.alias("reference"))
    return row.where("reference is not null").select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), "prediction", "reference")


SQL = {
    "v1": "v1 AS (SELECT doc_id::VARCHAR AS key, text, lang, source FROM documents)",
    "v2": """v2 AS (SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 10 = 1 THEN text || ' edited' ELSE text END AS text, lang, source FROM documents WHERE doc_id % 10 <> 0
        UNION ALL SELECT 'new-' || doc_id, text, lang, source FROM documents WHERE doc_id % 100 = 2)""",
    "runs": """runs AS (SELECT 'metric-' || ((event_id // 2) % 4) AS metric, CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS run, event_id // 2 AS record_id,
        CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 17 = 0 THEN 'missing' ELSE 'succeeded' END AS status,
        CASE WHEN event_type <> 'error' AND event_id % 17 <> 0 THEN value END AS value, user_id FROM events)""",
    "raters": "raters AS (SELECT doc_id AS unit, quality::VARCHAR AS a, (1 - toxic)::VARCHAR AS b FROM labels)",
    "traj": """traj AS (SELECT user_id AS agent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
        CASE event_type WHEN 'view' THEN 'model_decision' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'tool_result' WHEN 'error' THEN 'tool_result' ELSE 'final_output' END AS kind,
        'tool-' || (json_extract_string(props, '$.k')::BIGINT % 5) AS tool, props AS arguments, event_type = 'purchase' AS success,
        CASE WHEN event_type = 'view' THEN 'go-' || (user_id % 2) END AS decision FROM events)""",
    "outcomes": """li AS (SELECT l_orderkey, l_linenumber, l_quantity, s_nationkey % 5 AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
        outcomes AS (SELECT a.l_orderkey AS assignment, a.l_linenumber AS line, 'item-' || a.item AS variant_a, 'item-' || b.item AS variant_b,
        CASE WHEN abs(a.l_quantity - b.l_quantity) <= 1 THEN 'tie' WHEN a.l_quantity > b.l_quantity THEN 'A' ELSE 'B' END AS verdict, (a.l_quantity + b.l_quantity) / 100.0 AS confidence
        FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.item <> b.item)""",
    "turns": """turns AS (SELECT conv_id || '-' || turn AS sample_id, prediction, reference FROM (SELECT conv_id, turn, text AS prediction,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS reference FROM conversations) WHERE reference IS NOT NULL)""",
}


def with_views(names: str, body: str) -> str:
    """``WITH`` the named views, then ``body``, which may begin with more of them."""
    head = "WITH " + ",\n".join(SQL[n] for n in names.split())
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head[5:]},\n{body[15:]}"
    return f"{head},\n{body[5:]}" if body.startswith("WITH ") else f"{head}\n{body}"
