"""Comparison of two runs, metric by metric: effects, interval, test, correction, verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.progress import shared_folder
from . import alignment as A
from . import inference as I

TESTS = ("permutation", "paired_t", "wilcoxon", "sign", "paired_bootstrap")


def paired_test(pairs: DataFrame, keys: list[str], unit: str, d: str, test: str = "permutation", resamples: int = 1000, seed: int = 0) -> DataFrame:
    """Per key: ``p_value, test_method`` of the named test of a zero difference; differences that are all zero give 1."""
    if test not in TESTS:
        raise ValueError(f"no test {test}")
    at_least = max(1000, resamples)
    if test == "paired_t":
        out = I.paired_t(pairs, keys, d).withColumn("method", F.lit("paired_t"))
    elif test == "wilcoxon":
        out = I.wilcoxon(pairs, keys, d).withColumn("method", F.lit("wilcoxon_signed_rank"))
    elif test == "sign":
        out = I.sign_test(I.sign_counts(pairs, keys, d)).withColumn("method", F.lit("exact_sign"))
    elif test == "paired_bootstrap":
        out = I.paired_bootstrap_test(pairs, keys, unit, d, at_least, seed).withColumn("method", F.lit("paired_bootstrap_test"))
    else:
        out = I.permutation_test(pairs, keys, d, at_least, seed, unit)
    whole = pairs.select(*keys).distinct().join(out.select(*keys, "p_value", F.col("method").alias("test_method")), keys, "left")
    return whole.withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))


def compare_metrics(
    left: DataFrame,
    right: DataFrame,
    metric: str = "metric",
    record: str = "record_id",
    policy: str = "exclude",
    test: str = "permutation",
    resamples: int = 1000,
    seed: int = 0,
    confidence: float = 0.95,
    practical: float = 0.0,
) -> DataFrame:
    """One row for each metric that both sides have, with Holm-adjusted p-values.

    ``left`` and ``right`` have the metric, the record, ``status`` and ``value``.  The interval is the
    percentile one of a Poisson bootstrap of the mean difference over records.  A metric with fewer than
    two finite pairs fails the query.
    """
    return compare_tests(left, right, (test,), metric, record, policy, resamples, seed, confidence, practical)


def compare_tests(
    left: DataFrame,
    right: DataFrame,
    tests: tuple[str, ...] = TESTS,
    metric: str = "metric",
    record: str = "record_id",
    policy: str = "exclude",
    resamples: int = 1000,
    seed: int = 0,
    confidence: float = 0.95,
    practical: float = 0.0,
) -> DataFrame:
    """``compare_metrics`` by each of the tests; what does not depend on the test is made once, and so are the pairs."""
    both = left.select(metric).distinct().join(right.select(metric).distinct(), metric)
    aligned = A.align(left, right, [metric, record], policy).join(both, metric)
    enough = F.when(F.col("paired_n") >= 2, F.col("paired_n")).otherwise(F.raise_error(F.lit("at least two finite pairs are needed")))
    spark, several = left.sparkSession, len(tests) > 1
    folder = shared_folder(spark) if several else ""
    if several:
        aligned.write.parquet(f"{folder}/aligned")
        aligned = spark.read.parquet(f"{folder}/aligned")
    counts = A.alignment_summary(aligned, [metric])
    pairs = aligned.where("paired")
    effects = A.continuous_effects(aligned, [metric]).drop("n")
    interval = I.poisson_bootstrap_mean(pairs, [metric], record, "difference", resamples, seed, confidence)
    whole = counts.withColumn("paired_n", enough).join(effects, metric, "left").join(interval, metric, "left")
    if several:
        whole.write.parquet(f"{folder}/whole")
        whole = spark.read.parquet(f"{folder}/whole")

    def by(test: str) -> DataFrame:
        tested = paired_test(pairs, [metric], record, "difference", test, resamples, seed)
        adjusted = I.adjust_p_values(tested.select(F.lit("all").alias("family"), F.col(metric).alias("key"), F.col("p_value").alias("p"))).select(F.col("key").alias(metric), F.col("holm").alias("p_adjusted"))
        verdict = A.interpretation(F.col("lower"), F.col("upper"), F.col("p_value"), F.col("mean_difference"), practical, 1 - confidence)
        return whole.join(tested, metric, "left").join(adjusted, metric, "left").withColumn("interpretation", verdict)

    return reduce(DataFrame.unionByName, map(by, tests))
