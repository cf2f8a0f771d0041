"""Running sums and neighbours within groups of any size: rows are cut into ranges of (group, order), and ranges meet by their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspan.functions.ranks import range_of, splitters

RANGE = "__range"


def ranged(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows with the number of their range of (by, order), between splitters from a probe of the rows."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*by, *order]
    return rows.withColumn(RANGE, range_of(splitters(rows.select(*columns), columns, parts), F.struct(*columns)))


def running_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums of columns over the rows of their group up to them; order tells all rows of a group apart.

    Ranges give one row of sums for each group in them; these are added up over
    earlier ranges, a row a range; windows run within a group's part of a range.
    """
    cut = ranged(rows, by, order)
    for name, c in sums.items():
        cut = cut.withColumn(f"__w_{name}", c)
    own = cut.groupBy(*by, RANGE).agg(*(F.sum(f"__w_{n}").alias(n) for n in sums))
    earlier = Window.partitionBy(*by).orderBy(RANGE)
    begins = own.select(*(F.col(b).alias(f"__k_{b}") for b in by), F.col(RANGE).alias("__k"), *((F.sum(n).over(earlier) - F.col(n)).alias(f"__b_{n}") for n in sums))
    match = [F.col(b).eqNullSafe(F.col(f"__k_{b}")) for b in by] + [F.col(RANGE) == F.col("__k")]
    within = Window.partitionBy(*by, RANGE).orderBy(*order)
    return cut.join(begins, match).select(*rows.columns, *((F.col(f"__b_{n}") + F.sum(f"__w_{n}").over(within)).alias(n) for n in sums))


def followers(rows: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """before, state, n: how often each state comes next after each in the order of a group's rows.

    A stretch of a group's rows has a first and a last state and counts of what
    follows what; two stretches in a row have the sums of both and one pair
    more, of the last and the first. So stretches are ranges, wherever they are
    cut, and a group that holds all rows is many. The first row of a group
    follows nothing, and a null before is none.
    """
    cut = ranged(rows.select(F.col(by).alias("__g"), *(F.col(o).alias(f"__o{i}") for i, o in enumerate(order)), F.col(state).alias("state")), ["__g"], [f"__o{i}" for i in range(len(order))])
    place = [f"__o{i}" for i in range(len(order))]
    inner = cut.select(F.lag("state").over(Window.partitionBy("__g", RANGE).orderBy(*place)).alias("before"), "state")
    inner = inner.where("before is not null").groupBy("before", "state").agg(F.count("*").alias("n"))
    at = F.struct(*place)
    ends = cut.groupBy("__g", RANGE).agg(F.min_by(F.struct("state"), at).alias("first"), F.max_by(F.struct("state"), at).alias("last"))
    seams = ends.select(F.lag("last").over(Window.partitionBy("__g").orderBy(RANGE))["state"].alias("before"), F.col("first.state").alias("state"))
    seams = seams.where("before is not null").groupBy("before", "state").agg(F.count("*").alias("n"))
    return inner.union(seams).groupBy("before", "state").agg(F.sum("n").alias("n"))
