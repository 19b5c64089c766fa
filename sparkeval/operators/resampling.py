"""Bootstraps of groups of any size.

No group is gathered.  A resample of n rows gives each distinct value a multinomial weight, and
multinomial weights can be dealt in two steps: to bins of values first, then within each bin.  So a bin of a bounded
number of values draws by itself and hands on one sum for each resample.  Strata draw their own sizes; clusters are the
values when they are resampled as a whole.

A quantile of a resample needs no weights: its order statistics are those of the rows at uniform
order statistics, which have a beta distribution.  So B draws ask for about 2 B ranks, which are looked up in
the counted values.  Quantiles of resampled clusters have no such form: they come from a histogram of the
clusters' weights by draw, and from the values of the bins that a draw's quantile falls into.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .inference import value_ranks

METHODS = ("percentile", "basic", "bca")
#: Fewer rows make an interval unstable; fewer clusters than this are too few.
UNSTABLE, FEW_CLUSTERS = 10, 20
#: Distinct values of a bin, and weights held at once.
BIN_VALUES, HELD = 20_000, 1 << 22
#: Ranges of values of a group in the histogram of ``cluster_quantiles``.
CUTS = 256


def _check(method: str, resamples: int, confidence: float) -> None:
    if method not in METHODS:
        raise ValueError(f"the method is one of {', '.join(METHODS)}")
    if resamples < 200:
        raise ValueError("at least 200 resamples are needed")
    if not 0 < confidence < 1:
        raise ValueError("the confidence lies between 0 and 1")


def limits(draws, estimate: float, method: str, confidence: float, acceleration: float = 0.0) -> tuple[float, float]:
    """The interval of sorted or unsorted draws."""
    a = (1 - confidence) / 2
    at = (a, 1 - a)
    if method == "bca":
        share = np.clip((draws < estimate).mean(), 0.5 / len(draws), 1 - 0.5 / len(draws))
        z0 = special.NORMAL.inv_cdf(float(share))
        z = [z0 + special.NORMAL.inv_cdf(p) for p in at]
        at = sorted(special.NORMAL.cdf(z0 + x / (1 - acceleration * x)) for x in z)
    low, high = np.quantile(draws, at)
    return (2 * estimate - high, 2 * estimate - low) if method == "basic" else (low, high)


def _warnings(n: Column, low: Column, high: Column, *more: Column) -> Column:
    notes = F.array(F.when(n < 30, "VERY_SMALL_SAMPLE"), F.when((n > 1) & (low == high), "ZERO_VARIANCE"), *more)
    return F.array_join(F.array_compact(notes), ",")


def _mapped(rows: DataFrame, keep: list[str], shape: str, formula) -> DataFrame:
    """``keep`` and the columns of ``shape``: ``formula`` of each row of a batch."""
    names = [c.split()[0] for c in shape.split(", ")]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        for pdf in batches:
            made = pd.DataFrame([formula(r) for r in pdf.to_dict("records")], columns=names, index=pdf.index)
            yield pd.concat([pdf[keep], made], axis=1)

    return rows.mapInPandas(run, f"{kinds}, {shape}")


def _acceleration(second: float, third: float) -> float:
    down = 6 * second**1.5
    return -third / down if down else 0.0


def bootstrap_quantile(rows: DataFrame, keys: list[str], value: str, p: float, method: str = "percentile", resamples: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Per key: ``estimate, lower, upper, n, warnings`` of the quantile ``p`` (linear interpolation) of the non-null values.

    The draws have the distribution of the classic bootstrap's.  The jackknife of BCa has three values, whichever row is
    left out, so it is closed.
    """
    _check(method, resamples, confidence)
    if not 0 <= p <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    clean = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    ranked, bases = value_ranks(clean, keys, F.col("__x"))
    sizes = ranked.groupBy(*keys).agg(F.sum("__c").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")).withColumn("__h", F.xxhash64(*keys))

    def drawn(r):
        n, rng = int(r["n"]), np.random.default_rng([seed, r["__h"] & (2**64 - 1)])
        h = (n - 1) * p
        k = min(int(h) + 1, n)
        u = rng.beta(k, n - k + 1, resamples)
        v = u + (1 - u) * (1 - rng.random(resamples) ** (1 / (n - k))) if k < n else u
        ranks = np.clip(np.ceil(np.stack([u, v]) * n), 1, n).astype(np.int64)
        left = int((n - 2) * p) if n > 1 else 0  # the lower place after one row has gone
        fixed = [k, min(k + 1, n), *(min(left + i, n) for i in (1, 2, 3))]
        return ranks[0].tolist(), ranks[1].tolist(), fixed

    plan = _mapped(sizes, [*keys, "n", "__low", "__high"], "__lo array<bigint>, __hi array<bigint>, __fixed array<bigint>", drawn)
    asked = plan.select(*keys, F.explode(F.array_distinct(F.concat("__lo", "__hi", "__fixed"))).alias("__at"))
    table = bases.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__base", "__part"))).alias("__b"))  # a row for each range
    placed = asked.join(table, keys).withColumn("__part", F.element_at(F.filter("__b", lambda b: b["__base"] < F.col("__at")), -1)["__part"])
    known = ranked.select(*keys, "__part", F.col("__upto").alias("__at"), "__v")
    mixed = known.unionByName(placed.select(*keys, "__part", "__at", F.lit(None).cast("double").alias("__v")))
    # the value of a rank is that of the first value whose last rank is not before it
    ahead = Window.partitionBy(*keys, "__part").orderBy("__at", F.col("__v").asc_nulls_first()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = mixed.withColumn("__x", F.first("__v", ignorenulls=True).over(ahead)).where(F.col("__v").isNull())
    values = found.groupBy(*keys).agg(F.collect_list("__at").alias("__ranks"), F.collect_list("__x").alias("__xs"))

    def closed(r):
        at = dict(zip(r["__ranks"], r["__xs"], strict=True))
        n, h = int(r["n"]), (int(r["n"]) - 1) * p
        draws = np.array([at[i] + (h - int(h)) * (at[j] - at[i]) for i, j in zip(r["__lo"], r["__hi"], strict=True)])
        k, k2, a, b, c = (at[i] for i in r["__fixed"])
        est, acc = k + (h - int(h)) * (k2 - k), 0.0
        if method == "bca" and n > 1:
            left = int((n - 2) * p)
            f = (n - 2) * p - left
            jack = np.array([b + f * (c - b), a + f * (c - a), a + f * (b - a)])
            w = np.array([left + 1, 1 if n > left + 1 else 0, max(0, n - left - 2)])
            dev = jack - (w * jack).sum() / n
            acc = _acceleration((w * dev**2).sum(), (w * dev**3).sum())
        return est, *limits(draws, est, method, confidence, acc)

    joined = plan.join(values, keys).withColumn("warnings", _warnings(F.col("n"), F.col("__low"), F.col("__high"), F.when(F.col("n") < UNSTABLE, "UNSTABLE_INTERVAL")))
    return _mapped(joined, [*keys, "n", "warnings"], "estimate double, lower double, upper double", closed).select(*keys, "estimate", "lower", "upper", "n", "warnings")


def mean_of(sums, n):
    """The mean, as a statistic of the sums of x."""
    return sums[:, 0] / n


def sd_of(sums, n):
    """The standard deviation (n - 1), as a statistic of the sums of x and x squared."""
    return np.sqrt(np.maximum(sums[:, 1] - sums[:, 0] ** 2 / n, 0) / np.maximum(n - 1, 1))


def bootstrap_sums(
    rows: DataFrame, keys: list[str], value: str, statistic: Callable = mean_of, features: Callable = lambda x: [x], method: str = "percentile", resamples: int = 1000,
    seed: int = 0, confidence: float = 0.95, stratum: str | None = None, cluster: str | None = None,
) -> DataFrame:
    """Per key: ``estimate, lower, upper, n, n_effective, warnings`` of a statistic of sums.

    ``features`` gives the columns whose sums the statistic needs, and ``statistic(sums, n)`` takes a matrix with a row for each
    resample and the resamples' sizes: means, moments, ratios, correlations of a struct column's fields.  With
    ``stratum`` every stratum is resampled to its own size; with ``cluster`` whole clusters are drawn, ``n_effective`` is their
    number, and fewer than twenty of them are warned of.  Null values are left out; a null stratum or cluster is one of its own.
    """
    _check(method, resamples, confidence)
    if stratum and cluster or (method == "bca" and (stratum or cluster)):
        raise ValueError("strata and clusters have percentile and basic intervals, and not both at once")
    x = F.col("__x")
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) if c else F.lit("")
    clean = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__x"), named(stratum).alias("__s"), named(cluster).alias("__u"))
    parts = [c.cast("double") for c in features(x)]
    m = len(parts) + 1  # the last sum is the number of rows
    if cluster:
        items = clean.groupBy(*keys, "__s", "__u").agg(F.array(*[F.sum(c) for c in parts], F.count("*").cast("double")).alias("__f"), F.min("__x").alias("__low"), F.max("__x").alias("__high")).withColumn("__c", F.lit(1).cast("long"))
        name = F.xxhash64("__u", F.lit(seed))
    else:
        counted = clean.groupBy(*keys, "__s", "__x").agg(F.count("*").alias("__c"))
        items = counted.select(*keys, "__s", "__c", F.array(*parts, F.lit(1.0)).alias("__f"), F.col("__x").alias("__low"), F.col("__x").alias("__high"), "__x")
        name = F.xxhash64("__x", F.lit(seed))
    group = [*keys, "__s"]
    items = items.withColumn("__name", name)
    bins = items.groupBy(*group).agg(F.ceil(F.count("*") / BIN_VALUES).alias("__bins"))
    dealt = items.join(bins, group)
    dealt = dealt.withColumn("__bin", F.pmod(F.col("__name"), F.col("__bins")))
    totals = dealt.groupBy(*group, "__bin").agg(F.sum("__c").alias("__n"))
    per = totals.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__bin", "__n"))).alias("__t")).withColumn("__h", F.xxhash64(*group))  # a pair for each bin

    def shared(r):
        rng, c = np.random.default_rng([seed, r["__h"] & (2**64 - 1)]), np.array([t["__n"] for t in r["__t"]])
        sizes = rng.multinomial(int(c.sum()), c / c.sum(), resamples)
        return ([{"bin": int(t["__bin"]), "sizes": sizes[:, i].tolist()} for i, t in enumerate(r["__t"])],)

    quota = _mapped(per, group, "__q array<struct<bin:bigint,sizes:array<bigint>>>", shared).select(*group, F.explode("__q").alias("__q")).select(*group, F.col("__q.bin").alias("__bin"), F.col("__q.sizes").alias("__sizes"))
    kinds = ", ".join(f"`{k}` {dealt.schema[k].dataType.simpleString()}" for k in keys)

    def drawn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("__name")
        f, c = np.stack(left["__f"].to_numpy()), left["__c"].to_numpy()
        sizes, out = np.asarray(right["__sizes"].iloc[0]), np.empty((resamples, m))
        rng = np.random.default_rng([seed + 1, int(left["__name"].iloc[0]) & (2**64 - 1)])
        step = max(1, HELD // len(c))
        for i in range(0, resamples, step):
            out[i : i + step] = rng.multinomial(sizes[i : i + step], c / c.sum()) @ f
        return pd.DataFrame([[*(left[k].iloc[0] for k in keys), out.ravel().tolist()]], columns=[*keys, "__sums"])

    sums = dealt.select(*group, "__bin", "__name", "__f", "__c").groupBy(*group, "__bin").cogroup(quota.groupBy(*group, "__bin")).applyInPandas(drawn, f"{kinds}, __sums array<double>")
    added = sums.select(*keys, F.posexplode("__sums").alias("__i", "__v")).groupBy(*keys, "__i").agg(F.sum("__v").alias("__v"))
    held = added.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("__d"))  # resamples x sums
    whole = items.groupBy(*keys).agg(
        F.array(*[F.sum(F.col("__c") * F.col("__f")[i]) for i in range(m)]).alias("__all"), F.sum("__c").alias("__units"), F.min("__low").alias("__low"), F.max("__high").alias("__high")
    )
    if method == "bca":

        def loo(r):
            s = np.array(r["__all"])[None]
            rest = s - np.array(r["__f"])[None]
            d = float(statistic(rest[:, :-1], rest[:, -1])[0] - statistic(s[:, :-1], s[:, -1])[0]) if s[0, -1] > 1 else 0.0
            return (d,)

        moved = _mapped(items.select(*keys, "__f", "__c").join(whole.select(*keys, "__all"), keys), [*keys, "__c"], "__j double", loo)
        c, j = F.col("__c"), F.col("__j")
        jack = moved.groupBy(*keys).agg(*[F.sum(c * F.pow(j, F.lit(i))).alias(f"__j{i}") for i in (1, 2, 3)])
        whole = whole.join(jack, keys)
    n = F.element_at("__all", -1).cast("long")
    more = F.when(F.col("__units") < FEW_CLUSTERS, "TOO_FEW_CLUSTERS") if cluster else F.when((n < UNSTABLE) & F.lit(not stratum), "UNSTABLE_INTERVAL")
    notes = _warnings(n, F.col("__low"), F.col("__high"), more)

    def closed(r):
        d, s = np.array([x["__v"] for x in r["__d"]]).reshape(resamples, m), np.array(r["__all"])[None]
        draws, est, acc = statistic(d[:, :-1], d[:, -1]), float(statistic(s[:, :-1], s[:, -1])[0]), 0.0
        if method == "bca":
            k = s[0, -1]
            mu = r["__j1"] / k
            acc = _acceleration(r["__j2"] - k * mu**2, r["__j3"] - 3 * mu * r["__j2"] + 2 * k * mu**3)
        return est, *limits(draws, est, method, confidence, acc)

    joined = whole.withColumn("n", n).withColumn("warnings", notes).join(held, keys)
    made = _mapped(joined, [*keys, "n", "__units", "warnings"], "estimate double, lower double, upper double", closed)
    return made.select(*keys, "estimate", "lower", "upper", "n", F.col("__units").alias("n_effective"), "warnings")


def cluster_weights(names, resamples: int, seed: int):
    """Poisson(1) weights, a row for each 64-bit name and a column for each resample, by a mixed counter."""
    z = np.asarray(names, np.int64).astype(np.uint64)[:, None] + (np.arange(resamples, dtype=np.uint64)[None] * np.uint64(2) + np.uint64(2 * seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finaliser of SplitMix64: fixed values
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    term = np.exp(-1) / np.cumprod([1.0, *range(1, 20)])
    return np.searchsorted(np.cumsum(term), u, "right").astype(np.int64)


def cluster_quantiles(rows: DataFrame, keys: list[str], cluster: str, value: str, probabilities: list[float], resamples: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Per key and probability: ``p, estimate, lower, upper, n, n_clusters``, percentile intervals over resampled clusters.

    All rows of a cluster have one Poisson weight for each resample.  First the weights of each range of values are added by
    resample; that tells in which range a resample's quantile (linear interpolation) lies.  Then the values of these
    ranges, a 256th of the rows each, are weighed one by one.  The result is exact for the weights.  Null values are left out, and so are
    resamples without a row.
    """
    _check("percentile", resamples, confidence)
    x = F.col(value).cast("double")
    clean = rows.where(F.col(value).isNotNull()).select(*keys, x.alias("__x"), F.xxhash64(F.col(cluster), *keys).alias("__u"))
    ranked, _ = value_ranks(clean, keys, F.col("__x"), CUTS)
    cells = clean.groupBy(*keys, "__x", "__u").agg(F.count("*").alias("__n")).join(ranked.select(*keys, F.col("__v").alias("__x"), "__part"), [*keys, "__x"])
    kinds = ", ".join(f"`{k}` {clean.schema[k].dataType.simpleString()}" for k in keys)
    at = [*keys, "__part"]

    def weighed(batches):
        total: dict = {}
        for pdf in batches:
            for lo in range(0, len(pdf), max(1, HELD // resamples)):
                some = pdf.iloc[lo : lo + max(1, HELD // resamples)]
                w = cluster_weights(some["__u"].to_numpy(), resamples, seed) * some["__n"].to_numpy()[:, None]
                for k, i in some.reset_index(drop=True).groupby(at, dropna=False).indices.items():
                    total[k] = total.get(k, 0) + w[i].sum(axis=0)
        if total:
            yield pd.DataFrame([[*k, w.tolist()] for k, w in total.items()], columns=[*at, "__w"])

    light = cells.groupBy(*at, "__u").agg(F.sum("__n").alias("__n"))
    bars = light.repartition(*at).mapInPandas(weighed, f"{kinds}, __part int, __w array<bigint>")
    per = bars.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__part", "__w"))).alias("__bars"))  # a vector for each range

    def targets(r):
        parts, w = [b["__part"] for b in r["__bars"]], np.array([b["__w"] for b in r["__bars"]])
        upto = np.cumsum(w, axis=0)
        out = []
        for p in probabilities:
            h = (upto[-1] - 1) * p
            for side in (0, 1):
                rank = np.minimum(np.floor(h).astype(np.int64) + side, upto[-1] - 1)
                part = (upto <= rank[None]).sum(axis=0)
                out += [{"p": p, "side": side, "draw": d, "part": int(parts[part[d]]), "rank": int(rank[d] - (upto[part[d], d] - w[part[d], d])), "share": float(h[d] - np.floor(h[d]))} for d in range(resamples) if upto[-1, d] > 0]
        return (out,)

    asked = _mapped(per, keys, "__t array<struct<p:double,side:int,draw:int,part:int,rank:bigint,share:double>>", targets).select(*keys, F.explode("__t").alias("t"))
    wanted = asked.select(*keys, F.col("t.part").alias("__part"), "t.*").groupBy(*at).agg(F.collect_list(F.struct("p", "side", "draw", "rank", "share")).alias("__t"))  # 2 x resamples x probabilities at most

    def resolved(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "p", "side", "draw", "x", "share"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        left = left.sort_values("__x")
        values, first = np.unique(left["__x"].to_numpy(), return_index=True)
        t = pd.DataFrame(list(right["__t"].iloc[0]))
        key, rows_ = [left[k].iloc[0] for k in keys], []
        step = max(1, HELD // len(left))
        for lo in range(0, resamples, step):
            some = t[(t["draw"] >= lo) & (t["draw"] < lo + step)]
            if len(some):
                w = cluster_weights(left["__u"].to_numpy(), resamples, seed)[:, lo : lo + step] if len(left) * resamples <= HELD else np.concatenate([cluster_weights(left["__u"].to_numpy()[i : i + 4096], resamples, seed)[:, lo : lo + step] for i in range(0, len(left), 4096)])
                upto = np.cumsum(np.add.reduceat(w * left["__n"].to_numpy()[:, None], first, axis=0), axis=0)
                for p, side, draw, rank, share in some[["p", "side", "draw", "rank", "share"]].itertuples(index=False):
                    rows_.append([*key, p, side, draw, values[np.searchsorted(upto[:, draw - lo], rank, "right")], share])
        return pd.DataFrame(rows_, columns=names)

    got = cells.groupBy(*at).cogroup(wanted.groupBy(*at)).applyInPandas(resolved, f"{kinds}, p double, side int, draw int, x double, share double")
    low, high = F.max(F.when(F.col("side") == 0, F.col("x"))), F.max(F.when(F.col("side") == 1, F.col("x")))
    draws = got.groupBy(*keys, "p", "draw").agg((low + F.max("share") * (high - low)).alias("q"))
    a = (1 - confidence) / 2
    spread = draws.groupBy(*keys, "p").agg(F.percentile("q", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    q = clean.groupBy(*keys).agg(F.percentile("__x", F.array(*[F.lit(float(p)) for p in probabilities])).alias("__e"), F.count("*").alias("n"))
    units = clean.select(*keys, "__u").distinct().groupBy(*keys).agg(F.count("*").alias("n_clusters"))
    est = q.join(units, keys).select(*keys, "n", "n_clusters", F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("p"), F.col("__e").alias("e"))).alias("z"))
    flat = est.select(*keys, "n", "n_clusters", F.col("z.p").alias("p"), F.col("z.e").alias("estimate"))
    return flat.join(spread, [*keys, "p"]).select(*keys, "p", "estimate", F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"), "n", "n_clusters")
