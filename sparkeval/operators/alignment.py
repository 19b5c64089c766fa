"""Paired samples: alignment of two runs with every exclusion counted, and top changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("exclude", "failures_as_zero")


def analysis_value(status: Column, value: Column, policy: str = "exclude") -> Column:
    """The value that takes part: succeeded ones, and failures as 0.0 under that policy."""
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy}")
    out = F.when((status == "succeeded") & value.isNotNull(), value)
    return out.when(status == "failed", F.lit(0.0)) if policy == "failures_as_zero" else out


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def require_finite(x: Column) -> Column:
    """The value, null where it is null; NaN and infinities fail the query."""
    return F.when(x.isNull() | finite(x), x).otherwise(F.raise_error(F.lit("observations must be finite")).cast("double"))


def align(left: DataFrame, right: DataFrame, keys: list[str], policy: str = "exclude", strict: bool = False) -> DataFrame:
    """One row for each id of either side: statuses, values, and ``paired`` if both are finite.

    ``left`` and ``right`` have the key columns, ``status`` and ``value``.  A value that is not finite is flagged, or fails the query if ``strict``.
    """
    sides = []
    for name, df in (("left", left), ("right", right)):
        sides.append(df.select(*keys, F.col("status").alias(f"{name}_status"), (require_finite if strict else lambda x: x)(analysis_value(F.col("status"), F.col("value"), policy)).alias(f"{name}_value")))
    both = sides[0].join(sides[1], keys, "full_outer")
    have = F.col("left_value").isNotNull() & F.col("right_value").isNotNull()
    ok = finite(F.col("left_value")) & finite(F.col("right_value"))
    return both.select("*", (have & ok).alias("paired"), (have & ~ok).alias("non_finite"), F.when(have & ok, F.col("right_value") - F.col("left_value")).alias("difference"))


def alignment_summary(aligned: DataFrame, keys: list[str], threshold: float = 0.2) -> DataFrame:
    """Per key: the union, pairs, what is missing on either side (null or absent), failures, warnings.

    The small-sample and zero-variance warnings look at the left values alone.
    """
    n = F.count_if("paired")
    lo, hi = F.min(F.when(F.col("paired"), F.col("left_value"))), F.max(F.when(F.col("paired"), F.col("left_value")))
    out = aligned.groupBy(*keys).agg(
        F.count("*").alias("union_n"),
        n.alias("paired_n"),
        F.count_if(F.col("left_value").isNull()).alias("missing_left"),
        F.count_if(F.col("right_value").isNull()).alias("missing_right"),
        F.count_if("non_finite").alias("non_finite"),
        F.count_if(F.col("left_status") == "failed").alias("failed_left"),
        F.count_if(F.col("right_status") == "failed").alias("failed_right"),
        (lo == hi).alias("constant"),
    )
    notes = F.array(
        F.when(F.col("paired_n") < 30, F.lit("VERY_SMALL_SAMPLE")),
        F.when((F.col("paired_n") > 1) & F.col("constant"), F.lit("ZERO_VARIANCE")),
        F.when((F.col("union_n") - F.col("paired_n")) / F.col("union_n") > threshold, F.lit("EXCESSIVE_MISSINGNESS")),
    )
    return out.withColumn("warnings", F.array_join(F.array_compact(notes), ",")).drop("constant")


def continuous_effects(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: means, mean and median difference, relative difference, standardised effect, superiority."""
    p = aligned.where("paired")
    d = F.col("difference")
    mean, sd = F.avg(d), F.stddev_samp(d)
    base = F.avg("left_value")
    return p.groupBy(*keys).agg(
        F.count("*").alias("n"),
        base.alias("baseline_mean"),
        F.avg("right_value").alias("candidate_mean"),
        mean.alias("mean_difference"),
        F.median(d).alias("median_difference"),
        F.try_divide(mean, F.abs(base)).alias("relative_difference"),
        sd.alias("sd"),
        F.when(sd > 0, mean / sd).alias("dz"),
        (F.avg((d > 0).cast("double")) + 0.5 * F.avg((d == 0).cast("double"))).alias("superiority"),
    )


def top_changes(aligned: DataFrame, keys: list[str], record: str, k: int) -> DataFrame:
    """The ``k`` largest regressions and improvements of each key, with their ranks.

    Every partition of the window keeps k rows before the shuffle where Spark can push the
    rank limit down.
    """
    if k == 0:
        return aligned.limit(0).select(*keys, F.lit("regression").alias("direction"), F.lit(0).alias("rank"), record, "difference")
    p = aligned.where("paired").select(*keys, record, "difference")
    down = Window.partitionBy(*keys).orderBy("difference", record)
    up = Window.partitionBy(*keys).orderBy(F.desc("difference"), F.desc(record))
    worst = p.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= k).withColumn("direction", F.lit("regression"))
    best = p.withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= k).withColumn("direction", F.lit("improvement"))
    return worst.unionByName(best).select(*keys, "direction", "rank", record, "difference")


#: The published names of the verdicts.
VERDICTS = {
    "meaningful_regression": "evidence_of_meaningful_regression",
    "significant_meaningful": "statistically_significant_and_practically_meaningful",
    "significant": "statistically_significant_but_practically_small",
    "within_tolerance": "compatible_with_configured_tolerance",
    "inconclusive": "not_statistically_conclusive",
}


def interpretation(lower: Column, upper: Column, p: Column, mean: Column, practical: float, alpha: float = 0.05) -> Column:
    """The published name of the verdict that ``interpret`` gives."""
    named = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])
    return named[interpret(lower, upper, p, mean, practical, alpha)]


def interpret(lower: Column, upper: Column, p: Column, mean: Column, practical: float, alpha: float = 0.05) -> Column:
    """The verdict on a comparison, in short; it doesn't look at the metric's direction."""
    pd_ = F.lit(float(practical))
    significant = p < alpha
    return (
        F.when((pd_ > 0) & (upper <= -pd_), "meaningful_regression")
        .when(significant & (F.abs(mean) >= pd_), "significant_meaningful")
        .when(significant, "significant")
        .when((lower >= -pd_) & (upper <= pd_), "within_tolerance")
        .otherwise("inconclusive")
    )
