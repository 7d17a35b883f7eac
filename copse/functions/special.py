"""Constants of random trees: expected isolation depth c(n), expected separation depth S(n), and score standardisation."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def digamma(x: float) -> float:
    """For x > 0: recurrence up to 12, then the asymptotic series."""
    shift = 0.0
    while x < 12:
        shift -= 1 / x
        x += 1
    y = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def harmonic(n: float) -> float:
    """H(n), also between integers."""
    return digamma(n + 1) + EULER


@lru_cache(100_000)
def expected_depth(n: float) -> float:
    """c(n) = 2 (H(n) - 1): depth at which a random tree isolates one of n points. 0 up to one point."""
    return 0.0 if n <= 1 else max(0.0, 2 * (harmonic(n) - 1))


_SEPARATION = [0.0, 0.0, 1.0]
_SEPARATION_LIMIT = 200_000


def _separation(n: int) -> float:
    if n >= _SEPARATION_LIMIT:
        return 3.0
    while len(_SEPARATION) <= n:
        k, s = len(_SEPARATION), _SEPARATION[-1]
        _SEPARATION.append(s + (3 * k - 4 - s * k) / (k * (k - 1)))
    return _SEPARATION[n]


def expected_separation(n: float) -> float:
    """S(n): expected splits that two of n points share, linear between integers; 3 in the limit."""
    if n <= 1:
        return 0.0
    low = math.floor(n)
    return _separation(low) + (n - low) * (_separation(low + 1) - _separation(low)) if n > low else _separation(low)


#: Metrics whose leaves hold logarithms of densities.
LOG_METRICS = ("density", "boxed_density", "boxed_density2")
METRICS = ("depth", "adj_depth", "adj_density", *LOG_METRICS, "boxed_ratio")


def standardised(metric: str, mean: Column, depth_norm: float) -> Column:
    """Outlier score from the mean of the trees' values; higher is more outlying for every metric."""
    if metric in ("depth", "adj_depth", "adj_density"):
        return F.pow(F.lit(2.0), -mean / F.lit(float(depth_norm)))
    if metric in ("density", "boxed_density2"):
        return -mean
    return -F.exp(mean) if metric == "boxed_density" else mean


def raw(metric: str, mean: Column) -> Column:
    """Not standardised: average depth, geometric mean of densities, or the negative box ratio."""
    if metric in LOG_METRICS:
        return F.exp(mean)
    return -mean if metric == "boxed_ratio" else mean
