"""Agreement of raters and rank correlation, from counts.

Every statistic starts from a grouped count of (label, label); the rows of those counts, few
by nature, are what is joined with itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rate
from ..streaming.progress import shared_folder
from .inference import mid_ranks


def binary_effects(rows: DataFrame, left: str, right: str) -> DataFrame:
    """One row of two 0/1 columns: discordant counts, rates, difference, ratio, matched odds ratio."""
    lf, rt = F.col(left) == 1, F.col(right) == 1
    c = rows.agg(
        F.count_if(lf & ~rt).alias("only_left"), F.count_if(~lf & rt).alias("only_right"), F.avg(lf.cast("double")).alias("left_rate"), F.avg(rt.cast("double")).alias("right_rate")
    )
    odds = F.when(F.col("only_left") > 0, F.col("only_right") / F.col("only_left")).when(F.col("only_right") > 0, F.lit(float("inf")))
    return c.select("*", (F.col("right_rate") - F.col("left_rate")).alias("risk_difference"), F.try_divide("right_rate", "left_rate").alias("risk_ratio"), odds.alias("odds_ratio"))


def weighted_kappa(rows: DataFrame, a: str, b: str, weights: str = "quadratic") -> DataFrame:
    """One row: kappa with distances between the positions of sorted labels; one label gives 1."""
    pairs = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    labels = pairs.select(F.col("a").alias("label")).union(pairs.select("b")).distinct().withColumn("i", F.dense_rank().over(Window.orderBy("label")) - 1)
    small = F.broadcast(labels)  # the distinct labels of a rating scale
    placed = pairs.join(small.withColumnRenamed("label", "a").withColumnRenamed("i", "ia"), "a").join(small.withColumnRenamed("label", "b").withColumnRenamed("i", "ib"), "b")
    size = labels.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("m"))
    gap = lambda x, y: {"linear": F.abs(x - y) / F.col("m"), "quadratic": F.pow((x - y) / F.col("m"), 2), "nominal": (x != y).cast("double")}[weights]
    observed = placed.crossJoin(size).agg(F.sum(F.col("n") * gap(F.col("ia"), F.col("ib"))).alias("o"), F.sum("n").alias("n"))
    left = placed.groupBy("ia").agg(F.sum("n").alias("na"))
    right = placed.groupBy("ib").agg(F.sum("n").alias("nb"))
    expected = left.crossJoin(right).crossJoin(size).agg(F.sum(F.col("na") * F.col("nb") * gap(F.col("ia"), F.col("ib"))).alias("e"))
    e = F.col("e") / F.col("n")
    return observed.crossJoin(expected).select(F.when(e == 0, F.when(F.col("o") == 0, 1.0)).otherwise(1 - F.col("o") / e).alias("kappa"))


def categorical_calibration(rows: DataFrame, expected: str, observed: str) -> DataFrame:
    """One row: ``n, accuracy, macro_precision, macro_recall, macro_f1, cohen_kappa`` of two columns of labels.

    Every label that either column has counts once in the macro means, with 0 where it has no denominator.
    Kappa is null if agreement by chance is certain and the columns differ.  Labels are compared as texts; rows
    with a null take no part, and no row at all gives nulls.
    """
    clean = rows.where(F.col(expected).isNotNull() & F.col(observed).isNotNull()).select(F.col(expected).cast("string").alias("e"), F.col(observed).cast("string").alias("o"))
    cells = clean.groupBy("e", "o").agg(F.count("*").cast("double").alias("n"))
    hit = F.when(F.col("e") == F.col("o"), F.col("n")).otherwise(0.0)
    sides = cells.select(F.col("e").alias("label"), hit.alias("tp"), F.col("n").alias("as_e"), F.lit(0.0).alias("as_o")).unionByName(cells.select(F.col("o").alias("label"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("as_e"), F.col("n").alias("as_o")))
    per = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("as_e").alias("as_e"), F.sum("as_o").alias("as_o"))
    share = lambda x, y: F.coalesce(F.try_divide(x, F.nullif(y, F.lit(0.0))), F.lit(0.0))
    tp, e, o = (F.col(c) for c in ("tp", "as_e", "as_o"))
    s = per.agg(
        F.sum("as_e").cast("long").alias("n"), (F.sum("tp") / F.sum("as_e")).alias("accuracy"), F.avg(share(tp, o)).alias("macro_precision"), F.avg(share(tp, e)).alias("macro_recall"),
        F.avg(share(2 * tp, e + o)).alias("macro_f1"), (F.sum(e * o) / F.sum(e) / F.sum(e)).alias("chance"),
    )
    kappa = F.when(F.col("chance") < 1, (F.col("accuracy") - F.col("chance")) / (1 - F.col("chance"))).when(F.col("accuracy") == 1, 1.0)
    return s.withColumn("cohen_kappa", kappa).drop("chance")


def krippendorff_nominal(rows: DataFrame) -> DataFrame:
    """One row of (unit, label) rows: alpha; null without a pair, or if labels differ and none could by chance.

    The observed disagreement is that of all pairs within a unit, the expected one that of two
    labels drawn without replacement from all rows, units of one label included.  Pairs are
    counted from label counts, never made.
    """
    c = rows.where(F.col("label").isNotNull()).groupBy("unit", "label").agg(F.count("*").alias("n"))
    per = c.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    observed = per.agg(F.sum(F.col("m") * F.col("m") - F.col("sq")).alias("differ"), F.sum(F.col("m") * (F.col("m") - 1)).alias("pairs"))
    pooled = c.groupBy("label").agg(F.sum("n").cast("double").alias("n"))
    expected = pooled.agg(F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    do, de = rate(F.col("differ"), F.col("pairs")), 1 - rate(F.col("same"), F.col("total") * (F.col("total") - 1))
    return observed.crossJoin(expected).select(F.when((do == 0) & (de == 0), 1.0).otherwise(1 - F.try_divide(do, F.nullif(de, F.lit(0.0)))).alias("alpha"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of the mid-ranks, and the number of rows.

    The two columns are written once.  Made anew for every use, a mean whose parts arrive in another order may differ in its
    last bit, and its row would be lost where ranks are joined by value.
    """
    folder = shared_folder(rows.sparkSession)
    rows.select(a, b).write.parquet(folder)
    rows = rows.sparkSession.read.parquet(folder)
    ranked = mid_ranks(mid_ranks(rows.withColumn("__all", F.lit(1)), ["__all"], F.col(a), "ra"), ["__all"], F.col(b), "rb")
    return ranked.agg(F.corr("ra", "rb").alias("spearman"), F.count("*").alias("n"))


#: Rows of distinct pairs that a task sorts at once, and the number of ranges beyond which tasks grow instead.
INVERSION_ROWS, INVERSION_PARTS = 200_000, 1000


def _inversions(b, w) -> float:
    """The weight of the pairs whose earlier element is larger, bit by bit of the elements' ranks.

    Two ranks differ first at one bit; sorted by the bits above it, and by place, the ones that stand
    before a zero in the same stretch are its inversions.
    """
    rank = np.unique(b, return_inverse=True)[1]
    order, total = np.arange(len(rank)), 0.0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        r, v = rank[order], w[order]
        one = (r >> bit) & 1
        prefix = r >> (bit + 1)
        before = np.cumsum(v * one) - v * one
        first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        before -= np.repeat(before[first], np.diff(np.r_[first, len(r)]))
        total += float((before * v)[one == 0].sum())
        order = order[np.argsort(prefix * 2 + one, kind="stable")]
    return total


def kendall_tau_b(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: tau-b of all pairs of rows, from distributed counts of inversions; null without two different values of each.

    Distinct (a, b) with their counts are sorted by (a, b) into ranges, and each range counts its own
    inversions of b.  Then they are sorted by (b, first range) into ranges again, which count
    the inversions of rows from different first ranges.  Pairs that differ in both ranges are counted from the weights of the
    cells, a million at most.  Equal values may be cut at any place, since both orders are total, so no
    value is a hot key.  Rows with a null take no part.
    """
    spark = rows.sparkSession
    x = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    folder = shared_folder(spark)
    x.write.mode("overwrite").parquet(f"{folder}/pairs")
    x = spark.read.parquet(f"{folder}/pairs")
    parts = max(1, min(INVERSION_PARTS, -(-x.count() // INVERSION_ROWS)))
    ka, kb = (x.schema[c].dataType.simpleString() for c in ("a", "b"))

    def whole(batches):
        held = [p for p in batches if len(p)]
        return pd.concat(held) if held else None

    def by_a(batches):
        if (p := whole(batches)) is not None:
            p = p.sort_values(["a", "b"])
            p["p"], p["inversions"] = TaskContext.get().partitionId(), 0.0
            p.iloc[0, p.columns.get_loc("inversions")] = _inversions(p["b"].to_numpy(), p["n"].to_numpy())
            yield p

    def by_b(batches):
        if (p := whole(batches)) is not None:
            p = p.sort_values(["p", "b"])  # equal first ranges in the order of b: no inversions within one
            cells = p.groupby("p", as_index=False)["n"].sum()
            cells["q"], cells["inversions"] = TaskContext.get().partitionId(), 0.0
            cells.loc[0, "inversions"] = _inversions(p["b"].to_numpy(), p["n"].to_numpy()) + p["inversions"].sum()
            yield cells[["p", "q", "n", "inversions"]]

    def across(batches):
        if (p := whole(batches)) is not None:
            grid = np.zeros((p["p"].max() + 1, p["q"].max() + 1))
            np.add.at(grid, (p["p"], p["q"]), p["n"])
            earlier = np.cumsum(grid, axis=0) - grid
            larger = earlier.sum(axis=1, keepdims=True) - np.cumsum(earlier, axis=1)
            yield pd.DataFrame({"inversions": [float((grid * larger).sum() + p["inversions"].sum())]})

    first = x.repartitionByRange(parts, "a", "b").mapInPandas(by_a, f"a {ka}, b {kb}, n double, p int, inversions double")
    cells = first.repartitionByRange(parts, "b", "p").mapInPandas(by_b, "p int, q int, n double, inversions double")
    discordant = cells.repartition(1).mapInPandas(across, "inversions double").agg(F.sum("inversions").alias("d"))
    half = lambda m: m * (m - 1) / 2
    tied = lambda c: x.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(half(F.col("m"))).alias(f"t{c}"))
    both = x.agg(F.sum(half(F.col("n"))).alias("tab"), half(F.sum("n")).alias("all"))
    s = F.col("all") - F.col("ta") - F.col("tb") + F.col("tab") - 2 * F.coalesce("d", F.lit(0.0))
    return discordant.crossJoin(tied("a")).crossJoin(tied("b")).crossJoin(both).select(F.try_divide(s, F.sqrt((F.col("all") - F.col("ta")) * (F.col("all") - F.col("tb")))).alias("tau_b"))


def brier(rows: DataFrame, confidence: Column, outcome: Column) -> DataFrame:
    """One row: mean squared distance; a confidence outside [0, 1] fails."""
    p = F.when((confidence >= 0) & (confidence <= 1 + 1e-12), confidence).otherwise(F.raise_error(F.lit("a confidence lies outside of [0, 1]")))
    return rows.agg(F.avg(F.pow(p - outcome.cast("double"), 2)).alias("brier"))


def sample_warnings(rows: DataFrame, keys: list, value: str) -> DataFrame:
    n = F.count(value)
    notes = F.array(F.when(n < 30, "VERY_SMALL_SAMPLE"), F.when((n > 1) & (F.min(value) == F.max(value)), "ZERO_VARIANCE"))
    return rows.groupBy(*keys).agg(n.alias("n"), F.array_join(F.array_compact(notes), ",").alias("warnings"))
