"""Quantiles and tables worked out on the driver: a few numbers, whatever the data."""

from __future__ import annotations

import math
from collections.abc import Iterator


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X > k)."""
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))


def qbinom_upper(alpha: float, n: int, p: float) -> int:
    """The least k with P(X > k) <= alpha."""
    return next(k for k in range(n + 1) if binomial_tail(k, n, p) <= alpha * (1 + 1e-12))


def gamma_cdf(x: float, shape: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        k = shape
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c = x + 1 - shape, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h


def qgamma(q: float, shape: float, scale: float) -> float:
    low, high = 0.0, max(1.0, shape)
    while gamma_cdf(high, shape) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_cdf(mid, shape) < q else (low, mid)
    return scale * (low + high) / 2


def probe_thresholds(k: int, probes: int, floor_p: float, spread_p: float) -> tuple[int, int]:
    """(floor, spread) of mismatch scores for one of so many probes of k bases, so that all of them miss a read with chance 0.01."""
    adjusted = 0.01 ** (1 / probes)
    return -qbinom_upper(adjusted, k, floor_p), qbinom_upper(adjusted, k, spread_p)


def read_thresholds(length: int, floor_p: float, spread_p: float) -> tuple[int, int]:
    """(floor, spread) of mismatch scores for a whole read."""
    return -math.floor(floor_p * length) - 1, math.floor(spread_p * length) + 1


def estimated_thresholds(mean: float, variance: float, alpha: float = 0.99, tail: float = 0.01) -> tuple[float, float]:
    """(floor, spread) under an estimated error model: a gamma fit of the score's distribution."""
    return -qgamma(alpha, mean**2 / variance, -variance / mean) - 2.1, -math.log10(tail)


def half_tails(n: int = 25) -> Iterator[tuple[int, float]]:
    """(k, P(X >= k)) of a Binomial(n, 1/2)."""
    for k in range(n + 1):
        yield k, math.fsum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
