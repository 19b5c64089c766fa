"""Operational metrics: the fields of one struct, in long form, with explicit denominators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_of(identifier: str) -> str:
    names = {"time-to-first-token-ms": "ttft_ms"}
    return names.get(identifier, identifier.rpartition("/")[2].replace("-", "_"))


def long_form(rows: DataFrame, identifiers: list[str]) -> DataFrame:
    """A row for each sample and metric: ``metric, value``; a field that is absent gives null."""
    have = set(rows.schema["operational"].dataType.names)
    made = [
        F.struct(F.lit(i).alias("metric"), (F.col(f"operational.{field_of(i)}").cast("double") if field_of(i) in have else F.lit(None).cast("double")).alias("value")) for i in identifiers
    ]
    return rows.select(*[c for c in rows.columns if c != "operational"], F.explode(F.array(*made)).alias("m")).select("*", "m.*").drop("m")


def summarize(long: DataFrame, keys: list[str]) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    done = long.groupBy(*keys, "metric").agg(F.count("*").alias("total"), F.count("value").alias("available"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"), q.alias("q"))
    r = lambda c: F.round(c, 6)
    return done.select(*keys, "metric", "total", "available", "missing", r("mean").alias("mean"), r(F.get("q", F.lit(0))).alias("p50"), r(F.get("q", F.lit(1))).alias("p95"))
