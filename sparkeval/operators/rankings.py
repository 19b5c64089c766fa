"""Rankings from pair counts.

Spark counts wins and ties; what is left is a row for each pair of items, which is small
(``max_items`` bounds it), and the fit runs on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.progress import shared_folder

MAX_ITEMS = 2000


def rank(counts: DataFrame, fit, max_items: int = MAX_ITEMS) -> DataFrame:
    """``item, strength, method`` by ``fit`` of the (a, b, wins_a, wins_b, ties) rows."""
    rows = counts.orderBy("a", "b").limit(max_items * max_items // 2 + 1).collect()
    items = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    if len(items) < 2 or len(items) > max_items:
        raise ValueError(f"a ranking needs 2 to {max_items} items")
    at = {x: i for i, x in enumerate(items)}
    pairs = [(at[r["a"]], at[r["b"]], int(r["wins_a"]), int(r["wins_b"]), int(r["ties"])) for r in rows]
    strengths = fit(len(items), pairs)
    return counts.sparkSession.createDataFrame([(x, float(s), fit.__name__) for x, s in zip(items, strengths, strict=True)], "item string, strength double, method string")


def _newton(n: int, gradient_hessian, extra: int = 0, steps: int = 200):
    """Newton steps with the sum of abilities held at zero."""
    x = np.zeros(n + extra)
    for _ in range(steps):
        g, h = gradient_hessian(x)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        x = x - step
        x[:n] -= x[:n].mean()
        if np.abs(step).max() < 1e-10:
            break
    return x


def _softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def bradley_terry(n: int, pairs, ridge: float = 1e-8):
    """Maximum likelihood without ties; strengths sum to one."""

    def gh(x):
        g, h = 2 * ridge * x, np.diag(np.full(n, 2 * ridge)) + 1e-9
        for a, b, wa, wb, _ in pairs:
            p = 1 / (1 + math.exp(x[b] - x[a]))
            d, w = (wa + wb) * p - wa, (wa + wb) * p * (1 - p)
            g[a] += d
            g[b] -= d
            h[a, a] += w
            h[b, b] += w
            h[a, b] -= w
            h[b, a] -= w
        return g, h

    return _softmax(_newton(n, gh))


def davidson(n: int, pairs, ridge: float = 1e-8):
    """With a parameter for ties: p(tie) is proportional to nu * sqrt(strength of a * of b)."""

    def loss_grad(x):
        nu, g = math.exp(max(-30.0, min(30.0, x[n]))), 2 * ridge * x
        total = ridge * float(x @ x)
        for a, b, wa, wb, t in pairs:
            ea, eb = math.exp(x[a]), math.exp(x[b])
            m = nu * math.sqrt(ea * eb)
            z, k = ea + eb + m, wa + wb + t
            total -= wa * math.log(ea / z) + wb * math.log(eb / z) + (t * math.log(m / z) if t else 0)
            g[a] += k * (ea + m / 2) / z - wa - t / 2
            g[b] += k * (eb + m / 2) / z - wb - t / 2
            g[n] += k * m / z - t
        return total, g

    x = np.zeros(n + 1)
    value, g = loss_grad(x)
    h = np.eye(n + 1) / max(1.0, sum(wa + wb + t for _, _, wa, wb, t in pairs))
    for _ in range(500):  # quasi-Newton with halving
        step, size = h @ g, 1.0
        while size > 1e-12:
            y = x - size * step
            new, gy = loss_grad(y)
            if new <= value - 1e-4 * size * (g @ step):
                break
            size /= 2
        s, d = y - x, gy - g
        x, value, g = y, new, gy
        if np.abs(g).max() < 1e-8 * max(1.0, abs(value)):
            break
        if (sd := s @ d) > 1e-12:
            i = np.eye(n + 1)
            h = (i - np.outer(s, d) / sd) @ h @ (i - np.outer(d, s) / sd) + np.outer(s, s) / sd
    return _softmax(x[:n])


def elo(n: int, pairs, k: float = 32.0, start: float = 1500.0):
    """Ratings after all games in order: of each pair all wins of a, then of b, then ties."""
    r = np.full(n, start)
    for a, b, wa, wb, t in pairs:
        for score, games in ((1.0, wa), (0.0, wb), (0.5, t)):
            for _ in range(games):
                gain = k * (score - 1 / (1 + 10 ** ((r[b] - r[a]) / 400)))
                r[a] += gain
                r[b] -= gain
    return r


def elo_fold(games: DataFrame, order: list[str], k: float = 32.0, start: float = 1500.0, part_rows: int = 1_000_000, max_items: int = MAX_ITEMS) -> DataFrame:
    """``item, strength, method``: ratings after all ``games(a, b, score, games)`` in the order of ``order``.

    A row stands for ``games`` games of the same outcome in a row (1, 0 or 0.5 for a).  Ratings depend on
    all games before, so this is a fold: the rows are sorted into parts of about ``part_rows``, a task folds one part
    at a time, and only the ratings, ``max_items`` numbers at most, pass from part to part.  A run of equal
    games ends early once a game moves nothing.  Rows that tie in ``order`` have no order of their own: name one that
    has no ties.
    """
    spark, at = games.sparkSession, [f"o{i}" for i in range(len(order))]
    rows = games.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("score").cast("double").alias("score"), F.col("games").cast("long").alias("games"), *[F.col(c).alias(o) for c, o in zip(order, at, strict=True)])
    folder = shared_folder(spark)
    rows.write.parquet(f"{folder}/games")
    rows = spark.read.parquet(f"{folder}/games")
    names = rows.select("a").union(rows.select("b")).distinct().limit(max_items + 1).collect()
    if not 2 <= len(names) <= max_items:
        raise ValueError(f"a ranking needs 2 to {max_items} items")
    parts = max(1, -(-rows.count() // part_rows))
    ordered = rows.repartitionByRange(parts, *at).withColumn("part", F.spark_partition_id())
    ordered.write.partitionBy("part").parquet(f"{folder}/parts")
    ordered = spark.read.parquet(f"{folder}/parts")
    ratings = {r[0]: start for r in names}
    for part in sorted(r[0] for r in ordered.select("part").distinct().collect()):

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            now = dict(ratings)  # noqa: B023  each part's job is done before the next ratings are known
            for a, b, score, games in pdf.sort_values(at)[["a", "b", "score", "games"]].itertuples(index=False):
                x, y = now[a], now[b]
                for _ in range(games):
                    gain = k * (score - 1 / (1 + 10 ** ((y - x) / 400)))
                    if x + gain == x and y - gain == y:
                        break
                    x, y = x + gain, y - gain
                now[a], now[b] = x, y
            return pd.DataFrame({"item": list(now), "strength": list(now.values())})

        state = ordered.where(F.col("part") == part).groupBy("part").applyInPandas(fold, "item string, strength double").collect()
        ratings = {r["item"]: r["strength"] for r in state}
    return spark.createDataFrame([(x, ratings[x], "elo") for x in sorted(ratings)], "item string, strength double, method string")


def games_of(counts: DataFrame) -> DataFrame:
    """The games of pair counts, pair by pair: all wins of a, then of b, then ties."""
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(score).alias("score"), F.col(c).cast("long").alias("games")) for i, (score, c) in enumerate(((1.0, "wins_a"), (0.0, "wins_b"), (0.5, "ties")))])
    return counts.select("a", "b", F.explode(each).alias("g")).select("a", "b", "g.*").where("games > 0")
