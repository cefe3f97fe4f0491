"""Tail probabilities of the univariate tests, from sufficient statistics."""

from __future__ import annotations

import math

import numpy as np

NAN = float("nan")


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of the table [[a, b], [c, d]]: all tables with its margins that are no likelier."""
    row, col, n = a + b, a + c, a + b + c + d
    if row in (0, n) or col in (0, n):
        return 1.0
    k = np.arange(max(0, row + col - n), min(row, col) + 1)
    lg = np.vectorize(math.lgamma)

    def log_choose(n: float, k: np.ndarray) -> np.ndarray:
        return math.lgamma(n + 1) - lg(k + 1.0) - lg(n - k + 1.0)

    logs = log_choose(row, k) + log_choose(n - row, col - k) - (math.lgamma(n + 1) - math.lgamma(col + 1) - math.lgamma(n - col + 1))
    p = np.exp(logs)
    here = p[a - k[0]]
    return float(min(1.0, p[p <= here * (1 + 1e-7)].sum()))


def _exact_u(n1: int, n2: int) -> np.ndarray:
    """Distribution of U without ties."""
    top = np.zeros(n1 * n2 + 1)
    top[0] = 1.0
    for i in range(1, n1 + 1):
        # Multiply by (1 - q**(n2 + i)) / (1 - q**i).
        up = n2 + i
        shifted = top.copy()
        shifted[up:] -= top[:-up] if up <= n1 * n2 else 0
        for j in range(i, len(shifted)):
            shifted[j] += shifted[j - i]
        top = shifted
    return top / top.sum()


def mann_whitney(u1: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p of U1; ``ties`` is the sum of t**3 - t. Exact for small samples without ties, else normal with continuity correction."""
    if not n1 or not n2:
        return NAN
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and ties == 0 and n1 * n2 <= 200_000:
        a, b = min(n1, n2), max(n1, n2)
        p = _exact_u(a, b)
        return float(min(1.0, 2 * p[int(u) :].sum()))
    n = n1 + n2
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    if s == 0:
        return 1.0
    return min(1.0, math.erfc((u - n1 * n2 / 2 - 0.5) / s / math.sqrt(2)))


def kolmogorov_smirnov(d: float, n1: int, n2: int) -> float:
    """Two-sided p of the two-sample statistic: exact by counting lattice paths up to 10000 points a sample, else the limit."""
    if not n1 or not n2:
        return NAN
    g = math.gcd(n1, n2)
    step1, step2 = n2 // g, n1 // g
    h = round(d * n1 * step1)
    if h == 0:
        return 1.0
    if max(n1, n2) <= 10_000:
        # Share of paths from (0, 0) to (n1, n2) that stay inside |i * step1 - j * step2| < h, row by row, rescaled by log.
        j = np.arange(n2 + 1)
        row = (j * step2 < h).astype(float)
        scale = 0.0
        for i in range(1, n1 + 1):
            inside = np.abs(i * step1 - j * step2) < h
            lo = int(np.argmax(inside))
            hi = n2 - int(np.argmax(inside[::-1]))
            new = np.zeros(n2 + 1)
            if inside.any():
                new[lo : hi + 1] = np.cumsum(row[lo : hi + 1])
            top = new.max()
            if top == 0:
                return 1.0
            if top > 1e200:
                new /= top
                scale += math.log(top)
            row = new
        if row[n2] <= 0:
            return 1.0
        log_all = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
        return float(min(1.0, max(0.0, -math.expm1(math.log(row[n2]) + scale - log_all))))
    z = math.sqrt(n1 / (n1 + n2) * n2) * d
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k**2 * z**2)).sum())))


def kendall(discordant: float, n: int, x: tuple[float, float, float], y: tuple[float, float, float], both: float) -> float:
    """Asymptotic two-sided p of tau b. x, y: sums over ties of t(t-1)/2, t(t-1)(t-2), t(t-1)(2t+5); both: pairs tied in x and y."""
    total = n * (n - 1) / 2
    if n < 2 or x[0] == total or y[0] == total:
        return NAN
    score = total - x[0] - y[0] + both - 2 * discordant
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - x[2] - y[2]) / 18 + 2 * x[0] * y[0] / m + (x[1] * y[1] / (9 * m * (n - 2)) if n > 2 else 0)
    return math.erfc(abs(score) / math.sqrt(var) / math.sqrt(2)) if var > 0 else NAN
