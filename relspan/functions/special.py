"""Special functions in plain Python: the distributions need them and Spark lacks them."""

from __future__ import annotations

import math


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def zeta(s: float, q: float = 1.0) -> float:
    """Hurwitz zeta by Euler-Maclaurin summation, s > 1."""
    n = 12
    out = sum((q + k) ** -s for k in range(n))
    x = q + n
    out += x ** (1 - s) / (s - 1) + 0.5 * x**-s
    term = s * x ** (-s - 1)
    for k, b in enumerate((1 / 12, -1 / 720, 1 / 30240, -1 / 1209600)):
        out += b * term
        term *= (s + 2 * k + 1) * (s + 2 * k + 2) / (x * x)
    return out


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series near 0, else a continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return max(0.0, 1 - front * h)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by a continued fraction on the side where it is quick."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def fit_gamma(mean: float, mean_log: float) -> tuple[float, float]:
    """Shape and rate of the likeliest gamma distribution."""
    s = math.log(mean) - mean_log
    if s <= 0:
        return 1e6, 1e6 / mean
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        k = max(k - step, k / 10)
        if abs(step) < 1e-12 * k:
            break
    return k, k / mean


def fit_beta(mean_log: float, mean_log1m: float, mean: float, var: float) -> tuple[float, float]:
    """The likeliest beta distribution, by Newton steps from the moments' solution."""
    common = mean * (1 - mean) / max(var, 1e-12) - 1
    a, b = max(mean * common, 1e-2), max((1 - mean) * common, 1e-2)
    for _ in range(100):
        g1, g2 = digamma(a) - digamma(a + b) - mean_log, digamma(b) - digamma(a + b) - mean_log1m
        t = trigamma(a + b)
        h11, h22 = trigamma(a) - t, trigamma(b) - t
        det = h11 * h22 - t * t
        da, db = (g1 * h22 + g2 * t) / det, (g2 * h11 + g1 * t) / det
        a, b = max(a - da, a / 5), max(b - db, b / 5)
        if abs(da) + abs(db) < 1e-12 * (a + b):
            break
    return max(a, 1e-3), max(b, 1e-3)


def kolmogorov(d: float, n: int) -> float:
    """Asymptotic p-value of the Kolmogorov-Smirnov statistic."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
