"""Many columns at once: tall rows (key, value) of all of them, counted and ordered in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspan.functions import ranks
from relspan.operators import distributions as D

#: A column to look at: its key, and the table and column it is.
Wanted = tuple[str, str, str]


def tall(tables: dict[str, DataFrame], wanted: list[Wanted], of=D.clean) -> DataFrame:
    """key, x: the values of the wanted columns as rows, as numbers or as `of` says; each table is scanned once, for its columns only."""
    by: dict[str, list[Wanted]] = {}
    for w in wanted:
        by.setdefault(w[1], []).append(w)
    parts = []
    for table, own in by.items():
        each = F.array(*(F.struct(F.lit(key).alias("key"), of(F.col(f"`{column}`")).alias("x")) for key, _, column in own))
        parts.append(tables[table].select(F.explode(each).alias("r")).select("r.key", "r.x"))
    return reduce(DataFrame.union, parts)


def summaries(values: DataFrame, which: set[str] | None = None) -> dict[str, dict]:
    """The statistics of each key's numbers, those named or all: one job, a row a column."""
    got = values.groupBy("key").agg(*D.statistics("x", which)).collect()  # a row a column
    return {r["key"]: {k.removeprefix("x__"): v for k, v in r.asDict().items() if k != "key"} for r in got}


def cumulated(values: DataFrame) -> DataFrame:
    """key, x, n, upto, total: of each key's different numbers how often they occur, how many are up to them, how many there are. No group is one task."""
    at = ranks.placed(values.where("x is not null"), ("key",), "x")
    return at.select("key", F.col("value").alias("x"), "n", (F.col("before") + F.col("n")).alias("upto"), "total")


def each_key(by: dict[str, Column]) -> Column:
    """The expression of a row's key."""
    return reduce(lambda rest, k: F.when(F.col("key") == k, by[k]).otherwise(rest), by, F.lit(None))
