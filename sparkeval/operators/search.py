"""Exact search of a stated set of queries among all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

#: Pairs that a task scores at once.
PAIRS = 1 << 20


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` and ``b``, added up in the order of ``vectors.cosine``."""
    ab, aa, bb = np.zeros((3, len(a)))
    for x, y in zip(a.T, b.T, strict=True):
        ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
    norm = np.sqrt(aa) * np.sqrt(bb)
    return np.divide(ab, norm, out=np.zeros(len(a)), where=norm != 0)


def _largest(t: pd.DataFrame, k: int, digits: int) -> tuple[pd.DataFrame, pd.Series]:
    """Of pairs ``q, other, similarity`` those that may be among the ``k`` first of their query, and the ``k``-th similarity.

    The order is that of rounded similarities, then ``other``.  Spark does the rounding that counts, so a similarity next to
    a half stands for both roundings: it stays if the upper one is as far up as the ``k``-th by the lower ones.
    """
    x = t["similarity"] * 10.0**digits + 0.5
    t = t.assign(low=np.floor(x - 1e-4), high=np.floor(x + 1e-4)).sort_values(["q", "low", "other"], ascending=[True, False, True])
    last = t.groupby("q").nth(k - 1).set_index("q")
    low, other = t["q"].map(last["low"]), t["q"].map(last["other"])
    gone = (t["high"] < low) | ((t["high"] == low) & (t["other"] > other))
    return t[~gone][["q", "other", "similarity"]], last["low"] / 10.0**digits


def _search(key: str, k: int, digits: int):
    """For a block of queries and one of rows: the pairs that may be among a query's ``k`` first.

    A matrix product scores all pairs nearly; those that come near the ``k``-th of their query so far are scored exactly.
    """

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        held, names = pd.DataFrame({"q": [], "other": rows["other"][:0], "similarity": []}), queries[key].to_numpy()
        if len(queries) and len(rows):
            if len({len(v) for side in (queries["vector"], rows["other_vector"]) for v in side} | {len(rows["other_vector"].iloc[0]) or -1}) > 1:
                raise ValueError("vectors of different lengths")
            a, b, others = np.stack(queries["vector"]), np.stack(rows["other_vector"]), rows["other"].to_numpy()
            unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-150)
            ua, ub, floor = unit(a), unit(b), np.full(len(a), -np.inf)
            step = max(k + 1, PAIRS // len(a))
            for lo in range(0, len(b), step):
                near = ua @ ub[lo : lo + step].T
                near[names[:, None] == others[None, lo : lo + step]] = -np.inf
                least = floor
                if near.shape[1] > k and np.isinf(floor).any():
                    least = np.maximum(floor, np.partition(near, -k, axis=1)[:, -k])
                i, j = np.nonzero((near >= least[:, None] - 2 * 10.0**-digits) & (near > -np.inf))
                found = pd.DataFrame({"q": i, "other": others[lo + j], "similarity": _cosines(a[i], b[lo + j])})
                held, last = _largest(pd.concat([held, found]) if len(held) else found, k, digits)
                floor[last.index.to_numpy(np.int64)] = last.to_numpy()
        return pd.DataFrame({key: names[held["q"].to_numpy(np.int64)], "other": held["other"], "similarity": held["similarity"]})

    return run


def _all_pairs(queries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    pairs = queries.join(rows, F.col(key) != F.col("other"))
    return pairs.select(key, "other", cosine(F.col("vector"), F.col("other_vector")).alias("similarity"))


def nearest(queries: DataFrame, rows: DataFrame, key: str, k: int, block: int = 4096, digits: int = 6) -> DataFrame:
    """``key, other, similarity``: the ``k`` rows with the largest cosine to each query, itself left out.

    Queries and rows are dealt into blocks of about ``block`` and twice as many.  Every two blocks meet in one task, which
    keeps about ``k`` rows of a query.  Vectors with elements that are null, not finite or beyond the range in which products
    are safe are compared pair by pair in Spark; a null vector, an empty one and different lengths fail the query.
    """
    odd = F.coalesce(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | ((x != 0) & ~F.abs(x).between(1e-70, 1e70))), F.lit(True))
    named = rows.select(F.col(key).alias("other"), F.col("vector").cast("array<double>").alias("vector")).withColumn("odd", odd).withColumnRenamed("vector", "other_vector")
    asked = queries.select(key, F.col("vector").cast("array<double>").alias("vector")).withColumn("odd", odd)
    plain_q, plain_r = asked.where("not odd").drop("odd"), named.where("not odd").drop("odd")
    nq, nr = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (rows, 2 * block)))
    deal = lambda df, name, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(name), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(plain_q, key, "qb", nq, "rb", nr), deal(plain_r, "other", "rb", nr, "qb", nq)
    kinds = f"{key} {asked.schema[key].dataType.simpleString()}, other {named.schema['other'].dataType.simpleString()}, similarity double"
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(_search(key, k, digits), kinds)
    rest = _all_pairs(asked.where("odd").drop("odd"), named.drop("odd"), key).unionByName(_all_pairs(plain_q, named.where("odd").drop("odd"), key))
    scored = found.unionByName(rest).withColumn("similarity", F.round("similarity", digits))
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "other")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")
