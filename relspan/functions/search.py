"""Ranks among sorted bounds, and prefix sums over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in(bounds: list, value: Column) -> Column:
    """How many of the sorted bounds are below the value, by halving steps over one constant array."""
    if not bounds:
        return F.lit(0)
    table, n = F.array(*map(F.lit, bounds)), len(bounds)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) < value), at + step).otherwise(at))


def prefix_sums(values: DataFrame, x: str, n: str) -> tuple[DataFrame, float]:
    """Adds `upto`, the sum of n over all rows up to x, and gives the total; x occurs once a row.

    Rows are dealt in as many ranges between sampled quantiles as the session
    has shuffle partitions; the ranges' sums, a number each, reach the driver
    and give each range its start, and windows run within a range. What is
    scanned three times is kept in memory, or on disk where that is short.
    """
    values = values.persist()
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(values.approxQuantile(x, [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    marked = values.withColumn("__part", rank_in(bounds, F.col(x)))
    start, at = [], 0
    sums = {r["__part"]: r["own"] for r in marked.groupBy("__part").agg(F.sum(n).alias("own")).collect()}
    for part in range(len(bounds) + 1):
        start.append(at)
        at += sums.get(part) or 0
    begin = F.get(F.array(*map(F.lit, start)), F.col("__part"))
    upto = begin + F.sum(n).over(Window.partitionBy("__part").orderBy(x))
    return marked.withColumn("upto", upto).drop("__part"), at
