"""Tail probabilities of the F, t and normal distributions, without SciPy."""

from __future__ import annotations

import functools
import math

import numpy as np


def _continued(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, between 0 and 1."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _continued(a, b, x) / a
    return 1 - front * _continued(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f >= 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@functools.lru_cache(256)
def signed_rank_counts(n: int) -> np.ndarray:
    """How many of the 2^n choices of signs give each sum of the positive ranks 1 to n, as shares of all."""
    share = np.zeros(n * (n + 1) // 2 + 1)
    share[0] = 1.0
    for rank in range(1, n + 1):
        share[rank:] = (share[rank:] + share[:-rank]) / 2
        share[:rank] /= 2
    return share


def wilcoxon_exact(w: float, n: int) -> float:
    """Two-sided p of the smaller sum of ranks ``w`` of n differences without ties and zeros."""
    return min(1.0, 2 * float(signed_rank_counts(n)[: int(w) + 1].sum()))


@functools.lru_cache(256)
def rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """The share of the choices of n1 of n1 + n2 ranks that give each value of U.

    A choice is a partition of U into n1 parts of n2 at most: sums are counted part by part, by adding and taking away
    shifted counts.
    """
    n1, n2 = sorted((n1, n2))
    share = np.zeros(n1 * n2 + 1)
    share[0] = 1.0
    for k in range(1, n1 + 1):  # times (1 - x^(n2 + k)) / (1 - x^k), over the number of choices so far
        share[n2 + k :] = share[n2 + k :] - share[: -(n2 + k)] if n2 + k < len(share) else share[n2 + k :]
        for at in range(k):
            share[at::k] = np.cumsum(share[at::k])
        share *= k / (n2 + k)
    return share


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties."""
    low = int(min(u, n1 * n2 - u))
    return min(1.0, 2 * float(rank_sum_counts(n1, n2)[: low + 1].sum()))


def stars(p: float | None) -> str:
    return "" if p is None else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "ns"
