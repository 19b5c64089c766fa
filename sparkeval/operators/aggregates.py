"""Aggregates whose denominators are always explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rate
from .alignment import finite


def aggregate_metrics(results: DataFrame, counters: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over succeeded values with available, missing, failed, total and pending counts.

    ``counters`` has per key the run's total, settled, cancelled and failed tasks; cancelled
    tasks count as missing and failed ones as failed, beside the rows that say so.
    """
    has = (F.col("status") == "succeeded") & F.col("value").isNotNull()
    rows = results.groupBy(*keys).agg(
        F.avg(F.when(has, F.col("value"))).alias("value"),
        F.count_if(has).alias("available_count"),
        F.count_if(F.col("status") == "missing").alias("m"),
        F.count_if(F.col("status") == "failed").alias("f"),
    )
    return rows.join(counters, keys).select(
        *keys,
        "value",
        "available_count",
        (F.col("m") + F.col("cancelled_tasks")).alias("missing_count"),
        (F.col("f") + F.col("failed_tasks")).alias("failed_count"),
        F.col("total_tasks").alias("total_count"),
        (F.col("total_tasks") - F.col("settled_tasks")).alias("pending_count"),
    )


def aggregate_mean(rows: DataFrame, keys: list[str], scalar: str, failed: int = 0) -> DataFrame:
    """Mean of the finite scalars; others are missing, and failures come on top of the rows."""
    ok = finite(F.col(scalar))
    return rows.groupBy(*keys).agg(
        F.avg(F.when(ok, F.col(scalar))).alias("value"),
        (F.count("*") + failed).alias("total"),
        F.count_if(ok).alias("available"),
        F.count_if(~ok).alias("missing"),
        F.lit(failed).cast("long").alias("failed"),
    )


def summarize_costs(costs: DataFrame) -> DataFrame:
    """Per currency: actual and estimated sums as decimals, and the number of records."""
    zero = F.lit(0).cast(costs.schema["amount"].dataType)
    return costs.groupBy("currency").agg(
        F.sum(F.when(~F.col("is_estimate"), F.col("amount")).otherwise(zero)).alias("actual"),
        F.sum(F.when(F.col("is_estimate"), F.col("amount")).otherwise(zero)).alias("estimated"),
        F.count("*").alias("n"),
    )


def _per_label(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn of each label of (expected, predicted, c) counts."""
    e, p, c = F.col("expected"), F.col("predicted"), F.col("c")
    same = F.struct(e.alias("label"), c.alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    zero = F.lit(0).cast("long")
    miss = F.struct(e.alias("label"), zero.alias("tp"), zero.alias("fp"), c.alias("fn"))
    false = F.struct(p.alias("label"), zero.alias("tp"), c.alias("fp"), zero.alias("fn"))
    rows = pairs.select(F.explode(F.when(e == p, F.array(same)).otherwise(F.array(miss, false))).alias("x"))
    return rows.groupBy("x.label").agg(*(F.sum(f"x.{k}").alias(k) for k in ("tp", "fp", "fn")))


def _zero(part, whole):
    return F.coalesce(rate(part, whole), F.lit(0.0))


def classification_metrics(rows: DataFrame, expected: str, predicted: str, labels: list[str] | None = None) -> DataFrame:
    """One row: accuracy over all rows; averages over ``labels``, or over all that occur.

    Of ``labels``, one that never occurs counts with scores of zero in the macro averages and with no weight in the weighted ones.
    """
    counts = rows.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("c"))
    accuracy = counts.agg(rate(F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("c")).otherwise(0)), F.sum("c")).alias("accuracy"))
    per = _per_label(counts)
    if labels is not None:
        wanted = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, dict.fromkeys(labels)))).alias("label"))
        per = wanted.join(per, "label", "left").fillna(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = per.select("tp", "fp", "fn", (tp + fn).alias("support"), _zero(tp, tp + fp).alias("p"), _zero(tp, tp + fn).alias("r"), _zero(2 * tp, 2 * tp + fp + fn).alias("f"))
    averages = scored.agg(
        F.avg("p").alias("macro_precision"),
        F.avg("r").alias("macro_recall"),
        F.avg("f").alias("macro_f1"),
        _zero(F.sum("tp"), F.sum(tp + fp)).alias("micro_precision"),
        _zero(F.sum("tp"), F.sum(tp + fn)).alias("micro_recall"),
        _zero(2 * F.sum("tp"), F.sum(2 * tp + fp + fn)).alias("micro_f1"),
        *[_zero(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(f"weighted_{name}") for x, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))],
    )
    return accuracy.crossJoin(F.broadcast(averages))


def multilabel_metrics(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """One row over arrays of labels: subset accuracy, micro and macro scores; no labels at all give 1."""
    e, p = F.array_distinct(expected), F.array_distinct(predicted)
    exact = rows.agg(F.avg((F.array_sort(e) == F.array_sort(p)).cast("double")).alias("subset_accuracy"))
    kinds = F.transform(F.array_union(e, p), lambda x: F.struct(x.alias("label"), F.array_contains(e, x).alias("e"), F.array_contains(p, x).alias("p")))
    per = rows.select(F.explode(kinds).alias("x")).groupBy("x.label").agg(
        F.count_if(F.col("x.e") & F.col("x.p")).alias("tp"), F.count_if(~F.col("x.e") & F.col("x.p")).alias("fp"), F.count_if(F.col("x.e") & ~F.col("x.p")).alias("fn")
    )
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    none = F.count("*") == 0
    one = lambda c: F.when(none, 1.0).otherwise(c)
    scores = per.agg(
        one(_zero(tp, tp + fp)).alias("micro_precision"),
        one(_zero(tp, tp + fn)).alias("micro_recall"),
        one(_zero(2 * tp, 2 * tp + fp + fn)).alias("micro_f1"),
        one(F.avg(_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))).alias("macro_f1"),
    )
    return exact.crossJoin(F.broadcast(scores))


def benchmark_by_category(rows: DataFrame, repetitions: int | None = None) -> DataFrame:
    """Per category: majority-correct and consistent cases, requests, failures, tokens.

    ``rows`` has ``category, case_id, failed, correct, response, tokens``.  A case is right by a
    majority of its ``repetitions`` (those observed, if none are given; any other number fails), and
    consistent if all of them completed with one and the same normalized response.
    """
    done = F.when(~F.col("failed"), F.col("response"))
    per = rows.groupBy("category", "case_id").agg(
        F.count("*").alias("requests"), F.count_if("failed").alias("failures"), F.count_if("correct").alias("correct"), F.sum("tokens").alias("tokens"),
        F.count(done).alias("completed"), F.min(done).alias("first"), F.max(done).alias("last"),
    )
    if repetitions is not None:
        wrong = F.raise_error(F.concat(F.lit("a case has not its repetitions: "), F.col("case_id").cast("string")))
        per = per.withColumn("requests", F.when(F.col("requests") == repetitions, F.col("requests")).otherwise(wrong))
    majority = F.col("correct") >= F.floor(F.col("requests") / 2) + 1
    return per.groupBy("category").agg(
        F.count("*").alias("cases"),
        F.count_if(majority).alias("majority_correct"),
        F.count_if((F.col("completed") == F.col("requests")) & (F.col("first") == F.col("last"))).alias("consistent"),
        F.sum("requests").alias("requests"),
        F.sum("failures").alias("failures"),
        F.sum("correct").alias("correct_requests"),
        F.sum("tokens").alias("tokens"),
    )


def wilson(k: Column, n: Column, name: str, z: float = 1.959963984540054) -> list[Column]:
    """The limits of the share k / n; null for n = 0."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    centre, half = k / n + z * z / (2 * n), z * F.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))
    return [((centre - half) / (1 + z * z / n)).alias(f"{name}_low"), ((centre + half) / (1 + z * z / n)).alias(f"{name}_high")]


def benchmark_summary(rows: DataFrame, input_price: float, output_price: float, repetitions: int | None = None) -> DataFrame:
    """One row over all cases of ``benchmark_by_category``: the primary accuracy and the failures with Wilson limits, and the price.

    ``rows`` has ``input_tokens`` and ``output_tokens`` besides; prices are for a million of them.  The accuracy of
    requests has no limits, as requests of one case are clustered.
    """
    cases = benchmark_by_category(rows.withColumn("tokens", F.lit(0).cast("long")), repetitions)
    c = cases.agg(*[F.sum(x).alias(x) for x in ("cases", "majority_correct", "requests", "correct_requests", "consistent", "failures")])
    used = rows.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    m, n, f, q = (F.col(x) for x in ("majority_correct", "cases", "failures", "requests"))
    cost = (F.col("input_tokens") * F.lit(input_price) + F.col("output_tokens") * F.lit(output_price)) / 1_000_000
    return c.crossJoin(F.broadcast(used)).select(
        "cases", "majority_correct", rate(m, n).alias("accuracy"), *wilson(m, n, "accuracy"), "requests", "correct_requests", rate(F.col("correct_requests"), q).alias("request_accuracy"),
        "consistent", "failures", rate(f, q).alias("failure_rate"), *wilson(f, q, "failure"), "input_tokens", "output_tokens", cost.alias("cost"),
    )


def latency_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: count, mean, limits and quantiles with linear interpolation, to three places."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    made = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), q.alias("q"))
    r = lambda c: F.round(c, 3)
    return made.select(*keys, "n", r("mean").alias("mean"), r("minimum").alias("minimum"), r("maximum").alias("maximum"), r(F.get("q", F.lit(0))).alias("p50"), r(F.get("q", F.lit(1))).alias("p95"))


def pair_aggregate(judged: DataFrame) -> DataFrame:
    """One row: wins, ties, tie-adjusted rate of A, disagreement, and the rate of A among decisive verdicts."""
    per = judged.groupBy("assignment").agg(
        F.count_if(F.col("verdict") == "A").alias("a"), F.count_if(F.col("verdict") == "B").alias("b"), F.count_if(F.col("verdict") == "tie").alias("t")
    )
    usable = F.col("a") + F.col("b") + F.col("t")
    a, b, t = F.sum("a"), F.sum("b"), F.sum("t")
    return per.agg(
        a.alias("wins_a"),
        b.alias("wins_b"),
        t.alias("ties"),
        rate(a + 0.5 * t, a + b + t).alias("rate_a"),
        F.avg(1 - rate(F.greatest("a", "b", "t"), usable)).alias("disagreement"),
        rate(a, a + b).alias("position_rate"),
    )
