"""P-values from one already computed statistic (plain numbers, on the driver)."""

from __future__ import annotations

import math

import numpy as np

_END = 20_000  # terms at each end of a long sum that are added one by one
_PARTS = 8  # into which each stretch between is cut
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(32)


def ks_p_value(statistic: float, n_a: int, n_b: int) -> float:
    """Two-sided Kolmogorov-Smirnov p-value from the distribution for the effective sample size.

    Twice the exact one-sided tail, less the share counted on both sides (from the limiting series,
    which only matters where the p-value is large).
    """
    if n_a == 0 or n_b == 0:
        return float("nan")
    n = max(1, round(n_a * n_b / (n_a + n_b)))
    if statistic <= 0.0:
        return 1.0
    if statistic >= 1.0:
        return 0.0
    x = math.sqrt(n) * statistic + 1.0 / (6.0 * math.sqrt(n))
    if x < 0.2:  # the series would need many terms; what is missing from 1 is below 1e-12
        return 1.0
    both = math.fsum(2 * (-1) ** k * math.exp(-2 * (k * x) ** 2) for k in range(2, 101))
    return float(min(1.0, max(0.0, 2 * _one_sided_tail(statistic, n) - both)))  # Spark takes no NumPy numbers


_SMALL = np.array([0.0] + [math.lgamma(k + 1) - (k * math.log(k) - k + 0.5 * math.log(2 * math.pi * k)) for k in range(1, 64)])


def _beyond_stirling(k: np.ndarray) -> np.ndarray:
    """ln k! less Stirling's form."""
    large = np.maximum(k, 64.0)
    series = 1 / (12 * large) - 1 / (360 * large**3) + 1 / (1260 * large**5)
    return np.where(k < 64, _SMALL[np.minimum(k, 63).astype(int)], series)


def _tail_terms(d: float, n: int, j: np.ndarray) -> np.ndarray:
    """C(n, j) (d + j/n)^(j-1) (1 - d - j/n)^(n-j) for 0 < j < n (1 - d); real j from 64 to n - 64 too."""
    x, rest = j / n, n - j
    powers = j * np.log1p(d / x) + rest * np.log1p(-d / (1 - x))
    choose = 0.5 * np.log(n / (2 * math.pi * j * rest)) - _beyond_stirling(j) - _beyond_stirling(rest)
    return np.exp(powers + choose + float(_beyond_stirling(np.array([float(n)]))[0]) - np.log(d + x))


def _one_sided_tail(d: float, n: int) -> float:
    """P(D+ >= d) for n values: d * sum over j of C(n, j) (d + j/n)^(j-1) (1 - d - j/n)^(n-j).

    The sum runs over all j at every size. Between its ends its terms change so slowly that they are
    added as an integral, with the first correction of the Euler-Maclaurin formula.
    """
    last = math.ceil(n * (1 - d)) - 1  # the last j whose second power is of a positive number
    total = math.exp(n * math.log1p(-d)) / d  # j = 0
    if last <= 2 * _END:
        return d * (total + math.fsum(_tail_terms(d, n, np.arange(1.0, last + 1))))
    low, high = _END + 0.5, last - _END + 0.5
    total += math.fsum(_tail_terms(d, n, np.arange(1.0, _END + 1))) + math.fsum(_tail_terms(d, n, np.arange(high + 0.5, last + 1)))
    # Stretches that double in length from both ends to the middle.
    middle = (low + high) / 2
    steps = [low]
    while 2 * steps[-1] - low + _END < middle:
        steps.append(2 * steps[-1] - low + _END)
    edges = np.array(steps + [middle])
    edges = np.concatenate([np.linspace(a, b, _PARTS, endpoint=False) for a, b in zip(edges, edges[1:])])
    edges = np.concatenate([edges, [middle], (low + high - edges)[::-1]])
    centre, half = (edges[1:] + edges[:-1]) / 2, np.diff(edges) / 2
    at = centre[:, None] + half[:, None] * _NODES
    total += math.fsum((_tail_terms(d, n, at) * _WEIGHTS * half[:, None]).ravel())
    slope = np.diff(_tail_terms(d, n, np.array([low - 0.5, low + 0.5, high - 0.5, high + 0.5])))
    return d * (total - (slope[2] - slope[0]) / 24)


def correlation_p_value(rho: float, n: int) -> float:
    """Two-sided p-value of a correlation: Student t with n - 2 degrees of freedom."""
    if n < 3 or rho is None or math.isnan(rho):
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    freedom = n - 2
    # P(|T| > t) = I_{v/(v+t^2)}(v/2, 1/2), and v/(v+t^2) = 1 - rho^2.
    return _incomplete_beta(1.0 - rho * rho, freedom / 2.0, 0.5)


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    # Convergents p/q of 1/(1 + d1/(1 + d2/(1 + ...))).
    p0, p1, q0, q1 = 0.0, 1.0, 1.0, 1.0
    value = 1.0
    for step in range(1, 2000):
        m = step // 2
        if step % 2 == 0:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        p0, p1 = p1, p1 + d * p0
        q0, q1 = q1, q1 + d * q0
        p0, p1, q0, q1 = p0 / q1, p1 / q1, q0 / q1, 1.0
        if abs(p1 - value) < 1e-15 * abs(p1):
            break
        value = p1
    return front * p1
