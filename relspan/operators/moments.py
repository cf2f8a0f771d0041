"""Moments of a whole, of each part and of what is beside it, in one aggregate; the law of total variance over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far shares and variances may be from what the parts make.
SHARE, RELATIVE, ABSOLUTE, SAME = 1e-6, 1e-3, 1e-6, 1e-9


def parts(rows: DataFrame, by: str, of: str) -> DataFrame:
    """part, and n, mean, variance (over n) of the part, of the whole (w_) and of the rest (r_), for each value of a column.

    One aggregate over the sets (by) and (), from partial moments that merge;
    the rest comes from both, so it costs no further pass. Null is a part. A
    value that is no number counts nowhere; moments of nothing are null.
    """
    c = F.col(f"`{of}`").try_cast("double")
    found = rows.withColumn("__part", F.col(f"`{by}`")).cube("__part").agg(F.grouping("__part").alias("whole"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"))
    whole = found.where("whole = 1").select(*(F.col(x).alias(f"w_{x}") for x in ("n", "mean", "variance")))  # one row
    both = found.where("whole = 0").crossJoin(F.broadcast(whole))
    rest = F.col("w_n") - F.col("n")
    n, mean = F.col("n"), F.coalesce("mean", F.lit(0.0))
    r_mean = F.try_divide(F.col("w_mean") * F.col("w_n") - mean * n, rest)
    squares = F.col("w_variance") * F.col("w_n") - F.coalesce("variance", F.lit(0.0)) * n - F.pow(mean - r_mean, F.lit(2.0)) * n * rest / F.col("w_n")
    return both.select(F.col("__part").alias("part"), "n", "mean", "variance", "w_n", "w_mean", "w_variance", rest.alias("r_n"), r_mean.alias("r_mean"), F.greatest(F.lit(0.0), F.try_divide(squares, rest)).alias("r_variance"))


def _close(a: Column, b: Column, relative: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def contradict(mean: Column, variance: Column) -> Column:
    """Whether no shares of part and rest, of parts(), make a whole with this mean and variance. Means that are equal tell nothing; null if one is missing."""
    m1, m2, v1, v2 = F.col("mean"), F.col("r_mean"), F.col("variance"), F.col("r_variance")
    share = F.try_divide(mean - m2, m1 - m2)
    implied = share * v1 + (F.lit(1.0) - share) * v2 + share * (F.lit(1.0) - share) * F.pow(m1 - m2, F.lit(2.0))
    return F.when(_close(m1, m2, SAME, 0.0), F.lit(False)).otherwise((share < -SHARE) | (share > 1 + SHARE) | ~_close(variance, implied, RELATIVE, ABSOLUTE))
