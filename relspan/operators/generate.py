"""Rows by specification: base columns by inverse distribution functions, derived columns, keys of parents and fan-out.

A uniform number is the hash of a row's id, a column's name and the seed, so a
row is the same however the rows are partitioned, and a lost task makes the same
rows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.operators import satisfy
from relspan.plans.relation import column

#: A poisson's or zipf's table of cumulative shares has no more entries than this.
MOST_ENTRIES = 100_000


def uniform(name: str, seed: int, *key: str) -> Column:
    """Between 0 and 1, both excluded, from the hash of the key columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}/{name}"), *key), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _step(u: Column, shares: list[float]) -> Column:
    """How many of the cumulative shares are at most u: the drawn entry's place, from 0."""
    total, sums = 0.0, []
    for s in shares:
        total += s
        sums.append(total)
    if not sums or total <= 0:
        raise ValueError("shares must have a positive sum")
    marks = F.array(*(F.lit(x / total) for x in sums[:-1])) if len(sums) > 1 else F.array().cast("array<double>")
    return F.size(F.filter(marks, lambda x: x <= u))


def _poisson(rate: float) -> list[float]:
    """Shares of 0, 1, 2 ... until what is left is below 1e-15."""
    top = math.ceil(rate + 10 * math.sqrt(rate) + 20)
    if top > MOST_ENTRIES:
        raise ValueError(f"a poisson of rate {rate} has too many likely values")
    return [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0) for k in range(top + 1)]


def draw(family: str, p: dict, name: str, seed: int, *key: str) -> Column:
    """A column of the family. Normal pairs take two uniforms; a truncated tail is below 1e-15 of poisson draws."""
    u = uniform(name, seed, *key)
    match family:
        case "uniform":
            return F.lit(float(p["low"])) + u * F.lit(float(p["high"]) - float(p["low"]))
        case "exponential":
            return -F.ln(u) / F.lit(float(p["rate"] if "rate" in p else p["lambda"]))
        case "normal" | "lognormal":
            z = F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * uniform(name + "/angle", seed, *key))
            if family == "normal":
                return F.lit(float(p["mean"])) + F.lit(float(p["std"])) * z
            return F.exp(F.lit(float(p["mu"])) + F.lit(float(p["sigma"])) * z)
        case "poisson":
            return _step(u, _poisson(float(p["lambda"]))).cast("long")
        case "zipf":
            n = int(p["n"])
            if n > MOST_ENTRIES:
                raise ValueError(f"a zipf over {n} values has too many")
            return (_step(u, [k ** -float(p["s"]) for k in range(1, n + 1)]) + 1).cast("long")
        case "categorical":
            weights = p["weights"]
            return F.element_at(F.array(*map(F.lit, weights)), _step(u, list(weights.values())) + 1)
    raise ValueError(f"no family {family}")


def table(spark: SparkSession, n: int, key: str, columns: dict[str, dict], seed: int = 0) -> DataFrame:
    """n rows with the key 0 to n - 1 and the columns, in order.

    A column is {"family", "params"}; {"parent": number of parent rows} for a key
    of a parent; {"expression": of the algebra} over columns before it; or {"if":
    condition, "then": column, "else": column}. "nulls" is the share of nulls.
    """
    out = spark.range(n).withColumnRenamed("id", key)
    for name, how in columns.items():
        value = _column(how, name, seed, key)
        if how.get("nulls"):
            value = F.when(uniform(name + "/null", seed, key) >= how["nulls"], value)
        out = out.withColumn(name, value)
    return out


def _column(how: dict, name: str, seed: int, key: str) -> Column:
    if "expression" in how:
        return column(how["expression"])
    if "parent" in how:
        return F.floor(uniform(name, seed, key) * F.lit(how["parent"])).cast("long")
    if "if" in how:
        return F.when(column(how["if"]), _column(how["then"], name, seed, key)).otherwise(_column(how["else"], name, seed, key))
    return draw(how["family"], how["params"], name, seed, key)


def children(parents: DataFrame, key: str, count: Column, of: str, number: str = "number") -> DataFrame:
    """Rows (of, number): `count` children of each parent, numbered from 1; none where it is null or below 1."""
    return parents.select(F.col(key).alias(of), F.explode(F.when(count >= 1, F.sequence(F.lit(1), count.cast("int")))).alias(number))


def split_sum(rows: DataFrame, group: str, total: str, name: str, seed: int, *key: str) -> DataFrame:
    """Column `name`: parts of each group's total (column `total`, the same in all its rows) that add up to it, in random shares."""
    drawn = rows.withColumn("_share", -F.ln(uniform(name, seed, *key)))
    sums = drawn.groupBy(group).agg(F.sum("_share").alias("_all"))
    return drawn.join(sums, group).withColumn(name, F.col(total) * F.col("_share") / F.col("_all")).drop("_share", "_all")


def with_mean(rows: DataFrame, group: str, mean: str, name: str) -> DataFrame:
    """Moves the drawn values of a column so that each group's mean is that of column `mean`; their spread stays. Nulls stay, and groups without a mean."""
    off = rows.groupBy(F.col(group).alias("_g")).agg((F.first(mean) - F.avg(name)).alias("_off"))
    return rows.join(off, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn(name, F.col(name) + F.coalesce("_off", F.lit(0.0))).drop("_g", "_off")


def with_maximum(rows: DataFrame, group: str, maximum: str, name: str, key: str) -> DataFrame:
    """Makes column `maximum` the greatest value of each group: the row that has the greatest (ties: the least key) takes it, none is above it."""
    top = rows.where(F.col(name).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.max_by(key, F.struct(F.col(name), -F.col(key))).alias("_top"))
    met = rows.join(top, F.col(group).eqNullSafe(F.col("_g")), "left")
    value = F.when(F.col(key) == F.col("_top"), F.col(maximum)).otherwise(F.least(F.col(name), F.col(maximum)))
    return met.withColumn(name, F.when(F.col(name).isNotNull(), value)).drop("_g", "_top")


def trial(spark: SparkSession, n: int, key: str, columns: dict[str, dict], constraints: dict[str, dict], share: float = 0.1, seed: int = 0) -> DataFrame:
    """constraint and how often it holds (see satisfy.verdicts) over the first rows of a table, a tenth, before all are made.

    Rows are drawn from hashes of their keys, so those are the rows that the whole table begins with.
    """
    return satisfy.verdicts(table(spark, max(1, math.ceil(n * share)), key, columns, seed), constraints)
