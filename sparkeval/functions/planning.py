"""Sample sizes and detectable effects: closed formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import NORMAL


def _z(alpha: float, power: float, one_sided: bool = False) -> tuple[float, float]:
    if not (0 < alpha < 1 and 0 < power < 1):
        raise ValueError("alpha and power lie between 0 and 1")
    return NORMAL.inv_cdf(1 - (alpha if one_sided else alpha / 2)), NORMAL.inv_cdf(power)


def continuous_size(effect: float, alpha: float = 0.05, power: float = 0.8, one_sided: bool = False) -> int:
    """Pairs that a standardised effect needs; two at least."""
    if effect == 0:
        raise ValueError("an effect of 0 needs endless pairs")
    return max(2, math.ceil((sum(_z(alpha, power, one_sided)) / abs(effect)) ** 2))


def preference_size(rate: float, tie_rate: float = 0.0, alpha: float = 0.05, power: float = 0.8, one_sided: bool = False) -> int:
    """Judgments that a preference rate among decisive ones needs, ties added."""
    if rate == 0.5 or not 0 < rate < 1 or not 0 <= tie_rate < 1:
        raise ValueError("the rate must differ from one half")
    za, zb = _z(alpha, power, one_sided)
    decisive = math.ceil(((za * 0.5 + zb * math.sqrt(rate * (1 - rate))) / abs(rate - 0.5)) ** 2)
    return math.ceil(decisive / (1 - tie_rate))


def detectable_effect(n: int, alpha: float = 0.05, power: float = 0.8, one_sided: bool = False) -> float:
    if n < 2:
        raise ValueError("two pairs are needed")
    return sum(_z(alpha, power, one_sided)) / math.sqrt(n)


def continuous_sizes(effect: Column, alpha: float = 0.05, power: float = 0.8, one_sided: bool = False) -> Column:
    """``continuous_size`` of a column; null for no effect."""
    z = sum(_z(alpha, power, one_sided))
    return F.when(effect != 0, F.greatest(F.lit(2).cast("long"), F.ceil(F.pow(F.lit(z) / F.nullif(F.abs(effect), F.lit(0.0)), 2))))


def preference_sizes(rate: Column, tie_rate: float = 0.0, alpha: float = 0.05, power: float = 0.8, one_sided: bool = False) -> Column:
    """``preference_size`` of a column; null for a rate of one half, or outside of (0, 1)."""
    za, zb = _z(alpha, power, one_sided)
    decisive = F.ceil(F.pow((F.lit(za * 0.5) + zb * F.sqrt(rate * (1 - rate))) / F.nullif(F.abs(rate - 0.5), F.lit(0.0)), 2))
    return F.when((rate > 0) & (rate < 1) & (rate != 0.5), F.ceil(decisive / F.lit(1 - tie_rate)))


def detectable_effects(n: Column, alpha: float = 0.05, power: float = 0.8, one_sided: bool = False) -> Column:
    """``detectable_effect`` of a column; null below two pairs."""
    return F.when(n >= 2, F.lit(sum(_z(alpha, power, one_sided))) / F.sqrt(n.cast("double")))
