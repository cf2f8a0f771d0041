"""Order statistics against sorted lists, and special functions as expressions against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from relspan.functions import ranks, special
from relspan.operators import distributions as D


def values(kind):
    rng = random.Random(kind)
    rows = [("hot", rng.randint(0, 400)) for _ in range(3000)] + [("same", 7)] * 500 + [("nulls", None)] * 3 + [(None, rng.randint(-5, 5)) for _ in range(40)] + [("one", 1), ("some", None), ("some", 2), ("some", 9)]
    rows = [(g, None if v is None else v / 4 if kind == "double" else f"v{v:05d}" if kind == "string" else v) for g, v in rows]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["double", "long", "string"])
def test_ranks_are_those_of_sorted_lists(spark, kind):
    rows = values(kind)
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(5)
    by = defaultdict(list)
    for g, v in rows:
        by[g] += [] if v is None else [v]
    for place in (0.0, 0.25, 0.5, 0.9, 1.0):
        found = {r.g: r.x for r in ranks.value_at(df, ("g",), "v", place, "x").collect()}
        assert found == {g: (sorted(v)[max(1, -int(-place * len(v) // 1)) - 1] if v else None) for g, v in by.items()}
        if kind != "string":
            found = {r.g: r.x for r in ranks.percentile(df, ("g",), "v", place, "x").collect()}
            want = {r.g: r.x for r in df.groupBy("g").agg(F.percentile("v", place).alias("x")).collect()}
            assert found == pytest.approx(want)
    found = {r.g: r.x for r in ranks.mode(df, ("g",), "v", "x").collect()}
    assert found == {g: min((-n, x) for x, n in Counter(v).items())[1] if v else None for g, v in by.items()}


def test_one_group_is_many_ranges(spark):
    df = spark.createDataFrame(values("long"), "g string, v long").where("g = 'hot'")
    flat, keys = ranks._named(df, ("g",), "v")
    bounds = ranks.splitters(flat, [*keys, "__v"], 4)
    at = flat.select(ranks.range_of(bounds, F.struct("__b0", "__v")).alias("r"), "__v").groupBy("r").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")).orderBy("r").collect()
    assert len(at) == 4 and all(x.hi < y.lo for x, y in zip(at, at[1:], strict=False))


def test_all_rows_and_no_rows(spark):
    df = spark.createDataFrame(values("long"), "g string, v long")
    for f in (lambda d: ranks.percentile(d, (), "v", 0.5, "x"), lambda d: ranks.value_at(d, (), "v", 0.5, "x"), lambda d: ranks.mode(d, (), "v", "x")):
        assert f(df).count() == 1 and f(df).first().x is not None
        none = f(df.limit(0)).collect()
        assert len(none) == 1 and none[0].x is None
        assert "Python" not in f(df)._jdf.queryExecution().executedPlan().toString()


FITS = [
    ("normal", {"mean": 2.0, "std": 3.0}),
    ("lognormal", {"mu": 0.5, "sigma": 1.5}),
    ("poisson", {"lambda": 4.5}),
    ("poisson", {"lambda": 900.0}),
    ("zipf", {"a": 1.3}),
    ("zipf", {"a": 3.0}),
    ("gamma", {"shape": 0.3, "rate": 2.0}),
    ("gamma", {"shape": 2500.0, "rate": 10.0}),
    ("beta", {"alpha": 0.4, "beta": 3.0}),
    ("beta", {"alpha": 300.0, "beta": 700.0}),
    ("exponential", {"rate": 0.5}),
    ("uniform", {"low": -1.0, "high": 8.0}),
]


@pytest.mark.parametrize(("family", "p"), FITS)
def test_distribution_functions_as_expressions(spark, family, p):
    rng = random.Random(3)
    x = [-1.0, 0.0, 1.0, 1e-9, 1e6] + [rng.uniform(-3, 12) for _ in range(150)] + [rng.random() for _ in range(150)] + [float(k) for k in range(0, 1200, 9)] + [rng.uniform(230, 270) for _ in range(80)]
    df = spark.createDataFrame([(v,) for v in x], "x double").withColumn("y", D._cdf_column(family, p))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r.y == pytest.approx(D.cdf(family, p, r.x), abs=1e-9), r.x
    assert special.zeta(2.0) == pytest.approx(1.6449340668482264)
