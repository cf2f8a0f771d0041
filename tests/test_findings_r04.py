"""Mining of columns of many different values, whose cost must not grow with the size of the values."""

import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspan.operators import distributions as D
from relspan.operators import judging, mining
from tests.test_ranks_and_expressions import FITS


LARGE = [
    ("poisson", {"lambda": 5000.0}, 5000.0, 71.0),
    ("gamma", {"shape": 999.0, "rate": 1.0}, 999.0, 32.0),
    ("gamma", {"shape": 20000.0, "rate": 0.1}, 200000.0, 1414.0),
    ("beta", {"alpha": 2000.0, "beta": 3000.0}, 0.4, 0.007),
    ("beta", {"alpha": 2.0, "beta": 100000.0}, 2e-5, 1.4e-5),
]


@pytest.mark.parametrize(("family", "p", "mean", "deviation"), LARGE)
def test_distribution_functions_of_large_parameters(family, p, mean, deviation):
    x = mean + deviation * np.linspace(-13, 14, 600)
    assert judging.cdf(family, p, x) == pytest.approx([D.cdf(family, p, v) for v in x.tolist()], abs=1e-9)


def test_gamma_of_any_size_is_nearly_normal():
    z = np.linspace(-6, 6, 49)
    for shape in (1e8, 1e12, 1e15):
        f = judging.cdf("gamma", {"shape": shape, "rate": 1.0}, shape + math.sqrt(shape) * z)
        assert f == pytest.approx([D.cdf("normal", {"mean": 0.0, "std": 1.0}, v) for v in z.tolist()], abs=0.2 / math.sqrt(shape) + 1e-8)


@pytest.mark.parametrize(("family", "p"), FITS)
def test_distribution_functions_of_arrays(family, p):
    rng = random.Random(3)
    x = [-1.0, 0.0, 1.0, 1e-9, 1e6] + [rng.uniform(-3, 12) for _ in range(150)] + [rng.random() for _ in range(150)] + [float(k) for k in range(0, 1200, 9)] + [rng.uniform(230, 270) for _ in range(80)]
    assert judging.cdf(family, p, np.array(x)) == pytest.approx([D.cdf(family, p, v) for v in x], abs=1e-9)
    assert judging.log_density(family, p, np.array(x), -50.0) == pytest.approx([max(-50.0, D.log_density(family, p, v)) for v in x], abs=1e-9)
    assert len(judging.cdf(family, p, np.array([]))) == 0


def test_mining_of_large_whole_numbers(spark):
    """Ids of 100,000,000 and more: over 500 different ones have no discrete family, so none is judged. Up to then they were, by 120,000 steps a value and more."""
    many = spark.range(0, 3000, 1, 4).select((F.col("id") * 7 + 100_000_000).alias("id"), (F.col("id") % 500).alias("few"), (F.col("id") % 501).alias("more"))
    sc = spark.sparkContext
    sc.setJobGroup("mining", "mining", True)
    stop = threading.Timer(60, sc.cancelJobGroup, ("mining",))
    stop.start()
    try:
        got = mining.mine({"T": many}, spark, keep=9).collect()
    finally:
        stop.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    by = {c: {r.family: r for r in got if r.column == c} for c in many.columns}
    assert {c for c, f in by.items() if "poisson" in f and "zipf" in f} == {"few"}
    x = np.arange(3000) * 7.0 + 100_000_000
    assert by["id"]["uniform"].ks == pytest.approx(1 / 3000, abs=1e-9) and by["id"]["uniform"].aic == pytest.approx(4 + 2 * 3000 * math.log(x[-1] - x[0]))
    p = {"mean": x.mean(), "std": x.std()}
    f = np.array([D.cdf("normal", p, v) for v in x])
    k = np.arange(3000)
    assert by["id"]["normal"].ks == pytest.approx(max(((k + 1) / 3000 - f).max(), (f - k / 3000).max()), abs=1e-9)
