"""Running sums, neighbours, moments of parts, and mining of many columns, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from relspan import queries
from relspan.functions import special
from relspan.functions.running import followers, ranged, running_sums
from relspan.operators import distributions as D
from relspan.operators import mining, moments, satisfy
from tests.oracle import compare


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = [("hot", i, rng.choice(["a", "b", "c", None]), rng.randint(-3, 9)) for i in range(2000)] + [(None, i, "a", 1) for i in range(5)] + [("one", 0, "b", None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, at long, state string, x long").repartition(6)


def test_running_sums(events):
    rows, df = events
    got = {(r.g, r.at): (r.s, r.k) for r in running_sums(df, ["g"], ["at"], {"s": F.coalesce("x", F.lit(0)), "k": F.lit(1)}).collect()}
    want, s, k = {}, Counter(), Counter()
    for g, at, _, x in sorted(rows, key=lambda r: r[1]):
        s[g] += x or 0
        k[g] += 1
        want[g, at] = s[g], k[g]
    assert got == want


def test_followers_of_one_hot_group(events):
    rows, df = events
    assert ranged(df.where("g = 'hot'"), ["g"], ["at"]).select("__range").distinct().count() == 4
    pairs, by = Counter(), defaultdict(list)
    for g, _, state, _ in sorted(rows, key=lambda r: r[1]):
        by[g].append(state)
    for states in by.values():
        pairs.update((a, b) for a, b in zip(states, states[1:], strict=False) if a is not None)
    assert {(r.before, r.state): r.n for r in followers(df, "g", ["at"], "state").collect()} == pairs
    assert followers(df.limit(0), "g", ["at"], "state").count() == 0
    told = {(r.from_state, r.to_state): r.verdict for r in satisfy.transition_verdicts(df, "g", ["at"], "state", [("a", "b")], [("b", "a")]).collect()}
    assert told["a", "b"] == "allowed" and told["b", "a"] == "forbidden" and told["c", "c"] == "unlisted"
    assert {r.verdict for r in satisfy.transition_verdicts(df, "g", ["at"], "state", []).collect()} == {"allowed"}


def test_moments_of_parts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.gauss(1e6, 3)])) for _ in range(500)] + [("empty", None)]
    got = {r.part: r for r in moments.parts(spark.createDataFrame(rows, "p string, x double"), "p", "x").collect()}
    assert set(got) == {"a", "b", None, "empty"}
    every = [x for _, x in rows if x is not None]
    var = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)
    for part, r in got.items():
        own, rest = ([x for p, x in rows if x is not None and (p == part) == same] for same in (True, False))
        assert (r.n, r.r_n, r.w_n) == (len(own), len(rest), len(every))
        assert r.r_variance == pytest.approx(var(rest), rel=1e-6) and r.r_mean == pytest.approx(sum(rest) / len(rest))
        assert (r.variance == pytest.approx(var(own), rel=1e-6)) if own else r.variance is None
    assert moments.parts(spark.createDataFrame([], "p string, x double"), "p", "x").count() == 0


def test_contradictions(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 12.0)], "p string, x double")
    of = moments.parts(rows, "p", "x")
    told = of.select(moments.contradict(F.col("w_mean"), F.col("w_variance")).alias("own"), moments.contradict(F.lit(50.0), F.col("w_variance")).alias("far"), moments.contradict(F.col("w_mean"), F.col("w_variance") * 2).alias("wide")).collect()
    assert all((not r.own, r.far, r.wide) == (True, True, True) for r in told)


def test_mining_of_many_columns(spark):
    rng = random.Random(6)
    rows = [(rng.gauss(5, 2), rng.expovariate(0.3), float(rng.randint(0, 6)), rng.random(), None if i % 9 else 1.0, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, rare double, s string")
    got = mining.mine({"T": df, "U": df.select("a").limit(3)}, spark, keep=9).collect()
    best = {r.column: r.family for r in got if r.rank == 1}
    assert set(best) == {"a", "b", "c", "d"} and best["a"] == "normal" and best["b"] in ("exponential", "gamma")
    for r in got:
        values = sorted(x for x in (dict(zip("abcd", v[:4], strict=True))[r.column] for v in rows))
        p = D.estimate(r.family, D.summarize(df, [r.column])[r.column])
        density = sum(max(D.log_density(r.family, p, x), math.log(1e-10)) for x in values)
        at = [(D.cdf(r.family, p, x), x) for x in values]
        n = len(values)
        upto, less = {x: i + 1 for i, x in enumerate(values)}, {x: n - 1 - i for i, x in enumerate(reversed(values))}
        d = max(max(upto[x] / n - f, f - less[x] / n) for f, x in at)
        assert r.aic == pytest.approx(2 * len(p) - 2 * density, rel=1e-6) and r.ks == pytest.approx(d, abs=1e-9)
        assert r.p_value == pytest.approx(special.kolmogorov(d, n), abs=1e-9) and r.valid == (r.p_value >= 0.05)
    assert mining.mine({}, spark).count() == 0 and mining.mine({"T": df.limit(0)}, spark).count() == 0


def test_zeros_of_an_exponential(spark, tmp_path):
    """Zeros of a column that is not whole leave the exponential in, with the rate of all values, as the SQL has it."""
    rng = random.Random(7)
    rows = [(0.0,)] * 3 + [(round(rng.expovariate(0.02), 2),) for _ in range(200)]
    spark.createDataFrame(rows, "value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    compare(queries.mine_column(spark, str(tmp_path)), con, queries.ORACLE_SQL["mine_column"])
    low = spark.createDataFrame([(-0.5,), *rows], "value double")
    assert "exponential" not in {r.family for r in mining.mine({"T": low}, spark, keep=9).collect()}
