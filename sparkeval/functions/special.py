"""Distributions that the statistics need, in plain Python: driver and per-group use only."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def _invert(f, p: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if f(mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def beta_quantile(p: float, a: float, b: float) -> float:
    return _invert(lambda x: incomplete_beta(a, b, x), p, 0.0, 1.0)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    hi = 2.0
    while t_cdf(hi, df) < p:
        hi *= 2
    return _invert(lambda t: t_cdf(t, df), p, 0.0, hi)


def binomial_two_sided(k: int, n: int) -> float:
    """The exact two-sided test of k of n against one half."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(low + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in logs))


def wilson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    z = NORMAL.inv_cdf(0.5 + confidence / 2)
    p = k / n
    centre, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, min(p, (centre - half) / (1 + z * z / n))), min(1.0, max(p, (centre + half) / (1 + z * z / n)))


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    a = (1 - confidence) / 2
    return (0.0 if k == 0 else beta_quantile(a, k, n - k + 1)), (1.0 if k == n else beta_quantile(1 - a, k + 1, n - k))
