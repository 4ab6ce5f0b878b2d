"""Distribution functions that Spark lacks, on numbers of a reduced result."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's distribution."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def chi2_one(x: float) -> float:
    """P(X >= x) for a chi-squared variable with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0) / 2))


def kolmogorov(x: float) -> float:
    """P(K >= x) for the limit distribution of the two-sample statistic."""
    if x < 0.3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


#: Values a side up to which the two-sample statistic's distribution is exact.
EXACT = 10_000


def kolmogorov_two_sample(d: float, n: int, m: int) -> float:
    """P(D >= d) of the two-sample statistic: exact up to EXACT values a side, else the limit."""
    if max(n, m) > EXACT:
        return kolmogorov(d * math.sqrt(n * m / (n + m)))
    return kolmogorov_exact(round(d * n * m), n, m)


def kolmogorov_exact(gap: int, n: int, m: int) -> float:
    """The share of orders of n and m values in which i of the first and j of the second have been
    seen with |i m - j n| >= ``gap`` at some time.  Values are drawn one by one; ``inside`` holds,
    by i, the probability that none has gone that far yet, and what leaves is added up."""
    if gap <= 0:
        return 1.0
    inside, out, total = np.zeros(n + 1), 0.0, n + m
    inside[0] = 1.0
    i = np.arange(n + 1)
    for t in range(1, total + 1):
        left = total - t + 1
        j = t - 1 - i
        first, second = inside * np.maximum(n - i, 0) / left, inside * np.clip(m - j, 0, m) / left
        inside = second
        inside[1:] += first[:-1]
        far = np.abs(i * m - (t - i) * n) >= gap
        out += float(inside[far].sum())
        inside[far] = 0.0
    return min(1.0, out)


def mann_whitney_exact(u: float, n: int, m: int) -> float:
    """Two-sided exact p-value without ties: the number of orders by statistic is the coefficient
    of a product of (1 - x^(m + i)) / (1 - x^i), in whole numbers of any size."""
    n, m = min(n, m), max(n, m)
    top = math.ceil(max(u, n * m - u))
    # Counts are symmetric: those of n m - s values are those of s.
    counts = np.zeros(n * m - top + 1, object)
    if not len(counts):
        return 0.0
    counts[0] = 1
    for i in range(1, n + 1):
        if m + i < len(counts):
            counts[m + i :] -= counts[: -(m + i)].copy()
        for start in range(min(i, len(counts))):
            counts[start::i] = np.cumsum(counts[start::i])
    total = math.comb(n + m, n)
    return min(1.0, float(2 * int(sum(counts)) / total))
