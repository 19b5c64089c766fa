"""Intervals and tests.

What a test needs of the rows is a handful of sums, so Spark aggregates and the closing
formula runs once per group.  Bootstraps of means use Poisson weights: every row draws its own weight
for each resample from a hash, and weighted sums are aggregated, so no group is ever
gathered.  ``bootstrap_groups`` is the classic resampling, for groups up to a stated size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special


def _finish(rows: DataFrame, names: list[str], formula) -> DataFrame:
    """``rows`` with a column for each name: ``formula`` of a row's dict, run over Arrow batches."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(parts):
        for pdf in parts:
            got = [formula(r) for r in pdf.to_dict("records")]
            for k, n in enumerate(names):
                pdf[n] = pd.Series([g[k] for g in got], dtype="float64", index=pdf.index)
            yield pdf

    return rows.mapInPandas(run, schema)


def _sums(pairs: DataFrame, keys: list[str], d: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))


def mean_t_interval(rows: DataFrame, keys: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Per key: mean and t interval; at least two values are needed, equal ones give a point."""

    def formula(r):
        if r["n"] < 2:
            return None, None
        half = special.t_quantile(0.5 + confidence / 2, r["n"] - 1) * r["sd"] / math.sqrt(r["n"])
        return r["mean"] - half, r["mean"] + half

    return _finish(_sums(rows, keys, value), ["lower", "upper"], formula)


def paired_t(pairs: DataFrame, keys: list[str], d: str) -> DataFrame:
    """Per key: t statistic and two-sided p; without variance the statistic is infinite, or 0 for no difference."""

    def formula(r):
        if r["n"] < 2:
            return None, None
        if r["sd"] == 0:
            return (math.inf, 0.0) if r["mean"] else (0.0, 1.0)
        t = r["mean"] / (r["sd"] / math.sqrt(r["n"]))
        return t, 2 * special.t_cdf(-abs(t), r["n"] - 1)

    return _finish(_sums(pairs, keys, d), ["statistic", "p_value"], formula)


def paired_tost(pairs: DataFrame, keys: list[str], d: str, low: float, high: float) -> DataFrame:
    """Per key: the two one-sided p-values of equivalence within (low, high), and the larger."""
    if not low < 0 < high:
        raise ValueError("the margins must lie on both sides of 0")

    def formula(r):
        if r["n"] < 2:
            return None, None, None
        se = r["sd"] / math.sqrt(r["n"])
        if se == 0:
            p = float(r["mean"] <= low), float(r["mean"] >= high)
        else:
            p = special.t_cdf(-(r["mean"] - low) / se, r["n"] - 1), special.t_cdf((r["mean"] - high) / se, r["n"] - 1)
        return *p, max(p)

    return _finish(_sums(pairs, keys, d), ["p_low", "p_high", "p_value"], formula)


def proportion_intervals(rows: DataFrame, keys: list[str], success: str, confidence: float = 0.95) -> DataFrame:
    """Per key: the rate with its Wilson and exact intervals."""
    counts = rows.groupBy(*keys).agg(F.count(success).alias("n"), F.count_if(success).alias("k"))

    def formula(r):
        if not r["n"]:
            return None, None, None, None, None
        k, n = int(r["k"]), int(r["n"])
        return k / n, *special.wilson(k, n, confidence), *special.clopper_pearson(k, n, confidence)

    return _finish(counts, ["rate", "wilson_low", "wilson_high", "exact_low", "exact_high"], formula)


def sign_counts(pairs: DataFrame, keys: list[str], d: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count_if(F.col(d) > 0).alias("wins"), F.count_if(F.col(d) < 0).alias("losses"), F.count_if(F.col(d) == 0).alias("ties"))


def sign_test(counts: DataFrame) -> DataFrame:
    """``counts`` of wins, losses and ties with the exact two-sided p; ties are left out."""
    return _finish(counts, ["p_value"], lambda r: (special.binomial_two_sided(int(r["wins"]), int(r["wins"] + r["losses"])),))


def value_ranks(rows: DataFrame, keys: list[str], value: Column, parts: int = 200) -> tuple[DataFrame, DataFrame]:
    """The distinct values of each group with their counts and the rank of their last row, and the ranges' bases.

    The values of a group are cut into ``parts`` ranges at approximate quantiles; a running sum orders the
    values of one range, and another the ranges, so no task orders a whole group.  The cuts only balance
    the work.  Columns: ``__v, __c, __part, __upto`` and ``__part, __base``.
    """
    v = rows.withColumn("__v", value)
    counts = v.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    cuts = v.groupBy(*keys).agg(F.percentile_approx("__v", [k / parts for k in range(1, parts)], 2000).alias("__q"))
    placed = counts.join(cuts, keys).withColumn("__part", F.size(F.filter("__q", lambda q: q < F.col("__v")))).drop("__q")
    sizes = placed.groupBy(*keys, "__part").agg(F.sum("__c").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(*keys, "__part", F.coalesce(before, F.lit(0)).alias("__base"))
    within = F.sum("__c").over(Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = placed.withColumn("__in", within).join(bases, [*keys, "__part"])
    return local.select(*keys, "__v", "__c", "__part", (F.col("__base") + F.col("__in")).alias("__upto")), bases


def mid_ranks(rows: DataFrame, keys: list[str], value: Column, name: str = "rank", parts: int = 200) -> DataFrame:
    """``rows`` with average ranks over ties, and the number of ties, for a numeric value, by ``value_ranks``."""
    ranks, _ = value_ranks(rows, keys, value, parts)
    ranked = ranks.select(*keys, "__v", (F.col("__upto") - (F.col("__c") - 1) / 2).alias(name), F.col("__c").alias(f"{name}_ties"))
    return rows.withColumn("__v", value).join(ranked, [*keys, "__v"]).drop("__v")


def wilcoxon(pairs: DataFrame, keys: list[str], d: str) -> DataFrame:
    """Per key: the signed-rank statistic over non-zero differences, and its p.

    Exact up to 50 untied differences, else the normal approximation with tie correction.
    """
    ranked = mid_ranks(pairs.where(F.col(d) != 0), keys, F.abs(F.col(d)))
    sums = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col(d) > 0, F.col("rank")).otherwise(0.0)).alias("plus"),
        F.sum(F.when(F.col(d) < 0, F.col("rank")).otherwise(0.0)).alias("minus"),
        F.sum(F.col("rank_ties") * F.col("rank_ties") - 1).cast("double").alias("tied"),
    )

    def formula(r):
        n, w = int(r["n"]), min(r["plus"], r["minus"])
        if n <= 50 and not r["tied"]:
            ways = np.zeros(n * (n + 1) // 2 + 1)
            ways[0] = 1
            for k in range(1, n + 1):
                ways[k:] += ways[:-k].copy() if k else 0
            return w, min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)
        mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - r["tied"] / 48
        return w, 2 * special.NORMAL.cdf((w - mean) / math.sqrt(var)) if var > 0 else 1.0

    return _finish(sums, ["statistic", "p_value"], formula)


ALTERNATIVES = ("two-sided", "greater", "less")
EXACT_FLIPS = 20


def _in_tail(statistic: Column, observed: Column, alternative: str) -> Column:
    """Whether a statistic of the null is as extreme as the observed one; sums in another order count as equal."""
    slack = F.abs(observed) * 1e-12
    if alternative == "greater":
        return statistic >= observed - slack
    if alternative == "less":
        return statistic <= observed + slack
    return F.abs(statistic) >= F.abs(observed) - slack


def _flip_share(x, observed: float, alternative: str) -> float:
    """The share of the sign flips of ``x`` that ``_in_tail`` holds: sums of one half against the sorted sums of the other."""

    def sums(v):
        out = np.zeros(1)
        for one in v:
            out = np.concatenate([out + one, out - one])
        return out

    left, right, slack = sums(x[: len(x) // 2]), np.sort(sums(x[len(x) // 2 :])), abs(observed) * 1e-12
    from_up = lambda t: int((len(right) - np.searchsorted(right, t - left, "left")).sum())
    upto = lambda t: int(np.searchsorted(right, t - left, "right").sum())
    if alternative == "greater":
        count = from_up(observed - slack)
    elif alternative == "less":
        count = upto(observed + slack)
    else:
        least = abs(observed) - slack
        count = from_up(least) + upto(-least) if least > 0 else 2 ** len(x)
    return count / 2 ** len(x)


def permutation_test(pairs: DataFrame, keys: list[str], d: str, resamples: int = 1000, seed: int = 0, unit: str = "record_id", alternative: str = "two-sided") -> DataFrame:
    """Per key: the sign-flip test over the non-zero differences, ``observed_sum, p_value, method, n``.

    Up to 20 of them all 2^n flips are counted, from the 2^(n/2) sums of each half; more get at least ``resamples`` random ones with the
    add-one p.  A row's sign in a resample is one bit of a hash of its ``unit``, so each resample is a
    sum that Spark aggregates with partial sums.  A key whose differences are all zero has p = 1.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError(f"no alternative {alternative}")
    if resamples < 1000:
        raise ValueError("at least 1000 resamples are needed")
    rows = pairs.where(F.col(d).isNotNull()).select(*keys, F.col(unit).alias("__id"), F.col(d).cast("double").alias("__x"))
    sizes = rows.groupBy(*keys).agg(F.count_if(F.col("__x") != 0).alias("n"), F.sum("__x").alias("observed_sum"))
    z = rows.where("__x <> 0").join(sizes, keys)
    few, many = z.where(F.col("n") <= EXACT_FLIPS), z.where(F.col("n") > EXACT_FLIPS)

    # twenty values at most meet in an array
    held = few.groupBy(*keys).agg(F.collect_list("__x").alias("__xs"), F.first("observed_sum").alias("observed_sum"))
    exact = _finish(held, ["p_value"], lambda r: (_flip_share(np.array(r["__xs"]), r["observed_sum"], alternative),)).select(*keys, "p_value")

    draws = -(-resamples // 60)
    h = many.select(*keys, "observed_sum", "__x", F.col("__id"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("h", F.xxhash64("__id", "draw", F.lit(seed)))
    signs = [F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("__x")).otherwise(-F.col("__x"))).alias(f"s{b}") for b in range(60)]
    flat = h.groupBy(*keys, "draw").agg(*signs, F.first("observed_sum").alias("observed_sum")).select(*keys, "observed_sum", F.explode(F.array(*[f"s{b}" for b in range(60)])).alias("s"))
    random = flat.groupBy(*keys).agg(((F.count_if(_in_tail(F.col("s"), F.col("observed_sum"), alternative)) + 1) / F.lit(draws * 60 + 1)).alias("p_value"))
    method = F.when(F.col("n") <= EXACT_FLIPS, "paired_permutation_exact").otherwise("paired_permutation_monte_carlo")
    return sizes.join(exact.unionByName(random), keys, "left").select(*keys, "observed_sum", F.coalesce("p_value", F.lit(1.0)).alias("p_value"), method.alias("method"), "n")


P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _xxhash64(x, seed):
    """Spark's ``xxhash64`` of 32-bit integers (64-bit ones beyond that), with a seed for each."""
    turn = lambda h, n: (h << np.uint64(n)) | (h >> np.uint64(64 - n))
    if -(1 << 31) <= np.min(x) and np.max(x) < 1 << 31:
        h = (seed + (P5 + np.uint64(4))) ^ (np.asarray(x, np.int64).astype(np.uint32).astype(np.uint64) * P1)
        h = turn(h, 23) * P2 + P3
    else:
        h = (seed + (P5 + np.uint64(8))) ^ (turn(np.asarray(x, np.int64).view(np.uint64) * P2, 31) * P1)
        h = turn(h, 27) * P1 + P4
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


#: The steps of the distribution function of Poisson(1), and the weight of each value of a hash's first 16 bits (255: two are possible).
_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
_FIRST = np.searchsorted(_STEPS, np.arange(1 << 16) / (1 << 16), "right").astype(np.uint8)
_FIRST[(_STEPS * (1 << 16)).astype(int)] = 255
#: Weights that a task makes at once, and sums that it holds.
DRAWN, HELD = 1 << 17, 1 << 22


def _poisson_weights(units: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """A Poisson(1) weight for each draw and unit: the step of ``xxhash64(unit, draw, seed)``, where ``units`` are ``xxhash64(unit)``."""
    h = _xxhash64(np.array([[seed]]), _xxhash64(draws[:, None], units.view(np.uint64)[None, :]))
    w = _FIRST[h >> np.uint64(48)]
    open_ = w == 255
    w[open_] = np.searchsorted(_STEPS, (h[open_] >> np.uint64(11)) / float(1 << 53), "right")
    return w.astype(np.float64)


def _weighted_sums(rows: DataFrame, keys: list[str], unit: str, values: list[str], resamples: int, seed: int) -> DataFrame:
    """``keys, __draw`` and the sum of each of the values over the rows, weighed for each draw by their unit.

    Each task multiplies the matrix of its rows' weights, some at a time, with their values; Spark adds up the tasks' sums.
    """
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    given = rows.select(*keys, F.xxhash64(unit).alias("__u"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    draws = np.arange(resamples)

    def out(total):
        return pd.DataFrame([[*k, *x.tolist()] for k, x in total.items()], columns=[*keys, *values])

    def run(batches):
        total: dict = {}
        for pdf in batches:
            u, x = pdf["__u"].to_numpy(), pdf[values].to_numpy(np.float64)
            for k, at in pdf.groupby(keys, dropna=False).indices.items():
                k = k if isinstance(k, tuple) else (k,)
                for lo in range(0, len(at), max(1, DRAWN // resamples)):
                    some = at[lo : lo + max(1, DRAWN // resamples)]
                    total[k] = total.get(k, 0) + (_poisson_weights(u[some], draws, seed) @ x[some]).T
                if len(total) * resamples * len(values) > HELD:
                    yield out(total)
                    total = {}
        if total:
            yield out(total)

    parts = given.mapInPandas(run, ", ".join([*kinds, *(f"`{v}` array<double>" for v in values)]))
    each = parts.select(*keys, F.posexplode(F.arrays_zip(*values)).alias("__draw", "__z")).select(*keys, "__draw", *[F.col("__z")[v].alias(v) for v in values])
    return each.groupBy(*keys, "__draw").agg(*[F.sum(v).alias(v) for v in values])


def poisson_bootstrap_mean(rows: DataFrame, keys: list[str], unit: str, value: str, resamples: int = 400, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Per key: percentile interval of the mean over Poisson-weighted resamples of ``unit``.

    With a cluster as the unit, all rows of a cluster get one weight: a cluster bootstrap.
    """
    per_unit = rows.groupBy(*keys, unit).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    means = _weighted_sums(per_unit, keys, unit, ["__s", "__n"], resamples, seed).withColumn("m", F.try_divide("__s", "__n"))
    a = (1 - confidence) / 2
    return means.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(a), F.lit(1 - a))).alias("q")).select(*keys, F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))


def bootstrap_groups(rows: DataFrame, keys: list[str], value: str, statistic, method: str = "percentile", resamples: int = 1000, seed: int = 0, confidence: float = 0.95, max_n: int = 100_000) -> DataFrame:
    """Per key: a classic bootstrap of any statistic of a vector, for groups of up to ``max_n`` values.

    A larger group fails before it is gathered; ``poisson_bootstrap_mean`` has no such bound.
    """
    if resamples < 200:
        raise ValueError("at least 200 resamples are needed")
    clean = rows.select(*keys, F.col(value).cast("double").alias("x"))
    sizes = clean.groupBy(*keys).agg(F.count("*").alias("n"))
    ok = sizes.select(*keys, F.when(F.col("n") <= max_n, F.col("n")).otherwise(F.raise_error(F.lit("a group is too large for this bootstrap"))).alias("n"))
    gathered = clean.join(ok, keys)
    fields = [f for f in gathered.schema.fields if f.name in keys]
    schema = T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in ("estimate", "lower", "upper")), T.StructField("n", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["x"].to_numpy())
        rng, est = np.random.default_rng(seed), float(statistic(x))
        draws = np.sort([float(statistic(rng.choice(x, len(x)))) for _ in range(resamples)])
        a = (1 - confidence) / 2
        if method == "bca" and len(x) > 1:
            lo, hi = _bca(x, draws, est, statistic, a)
        else:
            lo, hi = np.quantile(draws, [a, 1 - a])
            if method == "basic":
                lo, hi = 2 * est - hi, 2 * est - lo
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "estimate": est, "lower": lo, "upper": hi, "n": len(x)}])

    return gathered.groupBy(*keys).applyInPandas(run, schema)


def _bca(x, draws, est, statistic, a):
    """Bias-corrected and accelerated limits."""
    n, b = len(x), len(draws)
    share = np.clip((draws < est).mean(), 0.5 / b, 1 - 0.5 / b)
    z0 = special.NORMAL.inv_cdf(float(share))
    jack = np.array([float(statistic(np.delete(x, i))) for i in range(n)])
    dev = jack.mean() - jack
    down = 6 * ((dev**2).sum() ** 1.5)
    acc = (dev**3).sum() / down if down else 0.0
    at = []
    for p in (a, 1 - a):
        z = z0 + special.NORMAL.inv_cdf(p)
        at.append(special.NORMAL.cdf(z0 + z / (1 - acc * z)))
    return tuple(sorted(np.quantile(draws, at)))


def adjust_p_values(rows: DataFrame) -> DataFrame:
    """``family, key, p`` with Bonferroni, Holm and Benjamini-Hochberg; ties go by key."""
    up = Window.partitionBy("family").orderBy("p", "key")
    r = rows.withColumn("rank", F.row_number().over(up)).withColumn("n", F.count("*").over(Window.partitionBy("family")))
    running = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("family").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.lit(1.0)
    return r.select(
        "family",
        "key",
        "p",
        F.least(one, F.col("p") * F.col("n")).alias("bonferroni"),
        F.least(one, F.max((F.col("n") - F.col("rank") + 1) * F.col("p")).over(running)).alias("holm"),
        F.least(one, F.min(F.col("p") * F.col("n") / F.col("rank")).over(back)).alias("bh"),
    )


def paired_bootstrap_test(pairs: DataFrame, keys: list[str], unit: str, d: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """Per key: the observed mean, and the add-one p of centred, Poisson-weighted resamples."""
    if resamples < 1000:
        raise ValueError("at least 1000 resamples are needed")
    rows = pairs.where(F.col(d).isNotNull()).select(*keys, F.col(unit).alias("__unit"), F.col(d).alias("__d"))
    centre = rows.groupBy(*keys).agg(F.avg("__d").alias("observed"))
    centred = rows.join(centre, keys).select(*keys, "__unit", (F.col("__d") - F.col("observed")).alias("__x"), F.lit(1.0).alias("__one"))
    means = _weighted_sums(centred, keys, "__unit", ["__x", "__one"], resamples, seed).withColumn("m", F.try_divide("__x", "__one")).join(centre, keys)
    extreme = F.count_if(F.abs(F.col("m")) >= F.abs(F.col("observed")))
    return means.groupBy(*keys).agg(F.max("observed").alias("observed"), ((extreme + 1) / F.lit(resamples + 1)).alias("p_value"))
