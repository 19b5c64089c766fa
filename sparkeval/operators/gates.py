"""Regression gates: rules over the rows of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import VERDICTS

RULES = "identifier string, metric string, operator string, threshold double, minimum_paired_count int, required boolean"


def holds(operator: Column, threshold: Column) -> Column:
    """Whether a rule holds for a comparison row; the metric's direction is not looked at."""
    mean, lower = F.col("mean_difference"), F.col("lower")
    return (
        F.when(operator == "minimum", F.col("candidate_mean") >= threshold)
        .when(operator == "maximum", F.col("candidate_mean") <= threshold)
        .when(operator == "maximum_regression", mean >= -F.abs(threshold))
        .when(operator == "lower_confidence_minimum", lower >= threshold)
        .when(operator == "no_meaningful_regression", ~F.col("interpretation").isin("meaningful_regression", VERDICTS["meaningful_regression"]))
    )


def evaluate_rules(comparison: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with ``passed``; a metric that is absent, or has too few pairs, fails it."""
    joined = F.broadcast(rules).join(comparison, "metric", "left")
    enough = F.col("n") >= F.col("minimum_paired_count")
    ok = F.coalesce(enough & holds(F.col("operator"), F.col("threshold")), F.lit(False))
    reason = F.when(F.col("n").isNull(), "metric is absent").when(~enough, "too few pairs").when(ok, "holds").otherwise("violated")
    return joined.select("identifier", "metric", "operator", "required", ok.alias("passed"), reason.alias("reason"))


def gate(evaluated: DataFrame) -> DataFrame:
    """One row: a gate passes iff all of its required rules pass."""
    return evaluated.agg(
        F.coalesce(F.bool_and(F.col("passed") | ~F.col("required")), F.lit(True)).alias("passed"),
        F.count("*").alias("n_rules"),
        F.count_if(~F.col("passed")).alias("n_failed"),
    )
