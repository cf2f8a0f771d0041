"""The families that fit columns best: all number columns of all tables in a fixed number of jobs."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relspan.operators import columns as C
from relspan.operators import distributions as D
from relspan.operators import judging as J

#: What a value outside the support counts, bounds of discreteness, and the p-value from which a fit is valid.
OUTSIDE, WHOLE, MOST, VALID = math.log(1e-10), 0.95, 500, 0.05
MINED = "table string, column string, family string, params string, aic double, bic double, ks double, p_value double, valid boolean, rank int"


def number_columns(tables: dict[str, DataFrame]) -> list[C.Wanted]:
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [(f"{t}.{c}", t, c) for t, rows in tables.items() for c, kind in rows.dtypes if kind in numbers or kind.startswith("decimal")]


def p_value(d: Column, n: Column) -> Column:
    """Asymptotic p-value of the Kolmogorov-Smirnov statistic of n values."""
    root = F.sqrt(n.cast("double"))
    x = d * (root + F.lit(0.12) + F.lit(0.11) / root)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * k * k * x * x))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series)))


def fits(s: dict) -> dict[str, dict]:
    """The families that a column's statistics allow, with their parameters; discrete ones where most values are whole.

    Zero is in the support of the exponential, whose rate is that of all values.
    Where most values are whole, zeros are a class of their own and rule it out.
    """
    positive = s["low"] > 0
    zeros = s["low"] == 0 and s["mean"] > 0 and s["share_whole"] < WHOLE
    able = {"lognormal": positive, "exponential": positive or zeros, "gamma": positive, "beta": positive and s["high"] < 1, "zipf": s["mean_rounded"] is not None, "poisson": s["low"] >= 0}
    found = {f: D.estimate(f, s) for f in D.FAMILIES if (f not in D.DISCRETE or s["share_whole"] >= WHOLE) and able.get(f, True)}
    return found | {"exponential": {"rate": 1 / s["mean"]}} if "exponential" in found else found


def mine(tables: dict[str, DataFrame], spark: SparkSession, wanted: list[C.Wanted] | None = None, keep: int = 5, least: int = 8) -> DataFrame:
    """The `keep` best families of each column, by AIC, those whose p-value is 0.05 or more first: see MINED.

    A column takes part if at least a fifth of its rows, and `least` rows, are
    numbers. Discrete: 95 % whole and at most 500 different. Likelihoods are
    sums over distinct values; a value outside the support counts ln 1e-10.
    Zipf is fitted to values of 1 and more. One job has the statistics of all
    columns, and one pass over their ordered values judges all families.
    """
    wanted = number_columns(tables) if wanted is None else wanted
    if not wanted:
        return spark.createDataFrame([], MINED)
    values = C.tall(tables, wanted)
    of = {k: fits(s) for k, s in C.summaries(values).items() if s["n"] >= least and s["n"] >= 0.2 * s["rows"]}
    if not any(of.values()):
        return spark.createDataFrame([], MINED)
    found = J.judge(C.cumulated(values.where(F.col("key").isin(list(of)))), of, OUTSIDE, MOST)
    rows = spark.createDataFrame([(k, t, c, f, json.dumps(of[k][f]), len(of[k][f])) for k, t, c in wanted if k in of for f in of[k]], "key string, table string, column string, family string, params string, free int")
    both = found.join(F.broadcast(rows), ["key", "family"])  # a row a column and family
    free, n = F.col("free").cast("double"), F.col("n").cast("double")
    told = both.select("key", "table", "column", "family", "params", (2 * free - 2 * F.col("ll")).alias("aic"), (free * F.ln(n) - 2 * F.col("ll")).alias("bic"), "ks", p_value(F.col("ks"), n).alias("p_value"))
    told = told.withColumn("valid", F.col("p_value") >= VALID)
    best = Window.partitionBy("key").orderBy(F.desc("valid"), "aic", "family")  # some families a column
    return told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).drop("key")
