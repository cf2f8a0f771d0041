"""Special functions of whole arrays of numbers: those of expressions.py over all values of a batch at once, with no more steps for larger parameters."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from relspan.functions.expressions import _BERNOULLI, gamma_steps

#: From here on parameters' densities are integrated about their peak, by so many nodes of Gauss and Legendre.
LARGE = 1000.0
_NODES = np.polynomial.legendre.leggauss(48)


def each(f: Callable[[float], float], x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(f, x.tolist()), np.float64, len(x))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * each(math.erfc, z / -math.sqrt(2))


def _stirling(z: float | np.ndarray) -> float | np.ndarray:
    """ln z! less its leading terms, z ln z - z + ln(2 pi z) / 2, of large z."""
    return 1 / (12 * z) - 1 / (360 * z**3)


def _integral(rest: Callable[[np.ndarray], np.ndarray], off: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The distribution function of a density with a single peak, at places `off` its peak, from the end that is nearer: between low and high nothing is missing."""
    end = np.where(off > 0, high, low)
    half = (end - off) / 2
    total = np.zeros(len(off))
    for node, weight in zip(*_NODES, strict=True):
        total += weight * rest(off + half * (1 + node))
    tail = np.where((off >= high) | (off <= low), 0.0, np.minimum(1.0, np.abs(half) * total))
    return np.where(off > 0, 1 - tail, tail)


def _gamma_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x) of a from LARGE on, the density around its peak integrated, so that it takes no more steps for a larger a."""
    peak = a - 1
    width, front = np.sqrt(peak), np.exp(-_stirling(peak)) / np.sqrt(2 * np.pi * peak)

    def rest(off: np.ndarray) -> np.ndarray:
        return front * np.exp(peak * np.log1p(off / peak) - off)

    return _integral(rest, x - peak, np.maximum(-peak, -10 * width), 12 * width)


def _beta_large(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) of a and b from LARGE on, in the same way."""
    a, b = a - 1, b - 1
    n = a + b
    peak, rest_of = a / n, b / n
    width = math.sqrt(peak * rest_of / n)
    front = (n + 1) * math.sqrt(n / (2 * math.pi * a * b)) * math.exp(_stirling(n) - _stirling(a) - _stirling(b))

    def rest(off: np.ndarray) -> np.ndarray:
        return front * np.exp(a * np.log1p(off / peak) + b * np.log1p(-off / rest_of))

    return _integral(rest, x - peak, np.full(len(x), -12 * width), np.full(len(x), 12 * width))


def gamma_cdf(a: float | np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x), 0 for x up to 0; a is at most `most` where x exceeds it. See expressions.py."""
    a = np.broadcast_to(np.asarray(a, np.float64), x.shape)
    steps = gamma_steps(min(most, LARGE))
    out = (x >= a + 1).astype(np.float64)
    wide = (x > 0) & (a >= LARGE)
    out[wide] = _gamma_large(a[wide], x[wide])
    inside = np.flatnonzero((x > 0) & (a < LARGE))
    front = np.exp(a[inside] * np.log(x[inside]) - x[inside] - each(math.lgamma, a[inside]))
    below = x[inside] < a[inside] + 1
    at = inside[below]
    b, y, acc = a[at], x[at], np.ones(len(at))
    for n in range(steps, 0, -1):
        acc *= y / (b + n)
        acc += 1
    out[at] = np.minimum(1.0, front[below] * acc / b)
    at = inside[~below]
    b, y = a[at], x[at]
    near = y - b
    acc = near + (2 * steps + 1)
    for n in range(steps, 0, -1):
        acc = near + (2 * n - 1) - n * (n - b) / acc
    out[at] = np.maximum(0.0, 1 - front[~below] / acc)
    return out


def beta_cdf(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), 0 and 1 beyond the ends. See expressions.py."""
    out = (x >= 1).astype(np.float64)
    inside = (x > 0) & (x < 1)
    if min(a, b) >= LARGE:
        out[inside] = _beta_large(a, b, x[inside])
        return out
    steps = 2 * gamma_steps(min(a + b, 2 * LARGE))  # the lesser of both decides
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def side(a: float, b: float, x: np.ndarray) -> np.ndarray:
        acc = np.ones(len(x))
        for i in range(steps, 0, -1):
            m = i // 2
            top = m * (b - m) / ((a - 1 + 2 * m) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 1 + 2 * m))
            acc = 1 + top * x / acc
        return np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta) / a / acc

    far = x > (a + 1) / (a + b + 2)
    out[inside & far] = 1 - side(b, a, 1 - x[inside & far])
    out[inside & ~far] = side(a, b, x[inside & ~far])
    return np.clip(out, 0.0, 1.0)


def zeta(s: float, q: np.ndarray) -> np.ndarray:
    """Hurwitz zeta for s > 1 and q from 1 on. See expressions.py."""
    out = sum((q + k) ** -s for k in range(12))
    x = q + 12.0
    out = out + x ** (1.0 - s) / (s - 1) + 0.5 * x**-s
    factor = s
    for i, c in enumerate(_BERNOULLI):
        out = out + c * factor * x ** (-s - 2 * i - 1)
        factor *= (s + 2 * i + 1) * (s + 2 * i + 2)
    return out
