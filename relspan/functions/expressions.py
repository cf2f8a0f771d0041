"""Special functions of columns as expressions: series by Horner's rule and continued fractions from their far end, inside of F.aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _down(steps: int) -> Column:
    return F.sequence(F.lit(steps), F.lit(1), F.lit(-1))


def gamma_steps(shape: float) -> int:
    """Terms after which neither the series nor the fraction of gamma_cdf() changes: their terms fall like exp(-n^2 / 2a) where x is near a."""
    return int(60 + 12 * math.sqrt(max(shape, 1.0)))


def gamma_cdf(a: Column, x: Column, log_gamma_a: Column, most: float) -> Column:
    """Regularised lower incomplete gamma P(a, x), 0 for x up to 0; a is at most `most` where x exceeds it.

    Below a + 1 the series (1 + x / (a + 1) (1 + x / (a + 2) (...))) / a, else
    the fraction 1 / (x + 1 - a - 1 (1 - a) / (x + 3 - a - 2 (2 - a) / ...)).
    """
    steps = gamma_steps(most)
    front = F.exp(a * F.ln(x) - x - log_gamma_a)
    series = F.aggregate(_down(steps), F.lit(1.0), lambda acc, n: F.lit(1.0) + x / (a + n) * acc) / a
    # b is x + 2 n + 1 - a; the fraction's tail begins with the last one
    fraction = F.aggregate(_down(steps), x + F.lit(2.0 * steps + 1) - a, lambda acc, n: x + F.lit(2.0) * n - F.lit(1.0) - a - n.cast("double") * (n - a) / acc)
    low = F.least(F.lit(1.0), front * series)
    high = F.greatest(F.lit(0.0), F.lit(1.0) - front / fraction)
    return F.when(x <= 0, F.lit(0.0)).when(x < a + F.lit(1.0), low).otherwise(high)


def normal_cdf(z: Column) -> Column:
    """Of the standard normal distribution: half of 1 +- P(1/2, z^2 / 2)."""
    half = gamma_cdf(F.lit(0.5), z * z * F.lit(0.5), F.lit(math.lgamma(0.5)), 1.0) * F.lit(0.5)
    return F.when(z < 0, F.lit(0.5) - half).otherwise(F.lit(0.5) + half)


def beta_cdf(a: float, b: float, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b), 0 and 1 beyond the ends: its continued fraction on the side where it is quick."""
    steps = 2 * gamma_steps(a + b)
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def side(a: float, b: float, x: Column) -> Column:
        def tail(acc: Column, i: Column) -> Column:
            m = F.floor(i / F.lit(2.0)).cast("double")
            even = m * (F.lit(b) - m) * x / ((F.lit(a - 1) + F.lit(2.0) * m) * (F.lit(a) + F.lit(2.0) * m))
            odd = -(F.lit(a) + m) * (F.lit(a + b) + m) * x / ((F.lit(a) + F.lit(2.0) * m) * (F.lit(a + 1) + F.lit(2.0) * m))
            return F.lit(1.0) + F.when(i % 2 == 0, even).otherwise(odd) / acc

        front = F.exp(F.lit(a) * F.ln(x) + F.lit(b) * F.log1p(-x) - F.lit(log_beta)) / F.lit(a)
        return front / F.aggregate(_down(steps), F.lit(1.0), tail)

    one = F.lit(1.0)
    inner = F.when(x > F.lit((a + 1) / (a + b + 2)), one - side(b, a, one - x)).otherwise(side(a, b, x))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, one).otherwise(F.least(one, F.greatest(F.lit(0.0), inner)))


#: Bernoulli numbers over factorials, of Euler-Maclaurin summation.
_BERNOULLI = (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600, 1 / 47900160)


def zeta(s: float, q: Column) -> Column:
    """Hurwitz zeta for s > 1 and q from 1 on: twelve terms, and Euler-Maclaurin summation of the rest."""
    terms = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0.0), lambda acc, k: acc + F.pow(q + k, F.lit(-s)))
    x = q + F.lit(12.0)
    out = terms + F.pow(x, F.lit(1.0 - s)) / F.lit(s - 1) + F.lit(0.5) * F.pow(x, F.lit(-s))
    factor = s
    for i, c in enumerate(_BERNOULLI):
        out = out + F.lit(c * factor) * F.pow(x, F.lit(-s - 2 * i - 1))
        factor *= (s + 2 * i + 1) * (s + 2 * i + 2)
    return out
