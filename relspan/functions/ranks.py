"""Order statistics by groups: exact, with no group in one task and no buffer of a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the probe that splitters are taken from, for each range: what the driver gets.
PROBED = 64


def _named(rows: DataFrame, by: tuple[str, ...], of: str) -> tuple[DataFrame, list[str]]:
    keys = [f"__b{i}" for i in range(len(by))]
    return rows.select(*(F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)), F.col(f"`{of}`").alias("__v")), keys


def splitters(rows: DataFrame, columns: list[str], parts: int) -> list[Column]:
    """Up to parts - 1 values of the columns, as structs in order, that cut rows into ranges of about as many different values each.

    They come from a probe of values by their hash, some PROBED a range; equal
    rows give equal splitters. A range holds at most the different values of a
    part, or rows / (PROBED * parts) where those are more.
    """
    if parts < 2:
        return []
    every = max(1, rows.count() // (PROBED * parts))
    probe = rows.where(F.pmod(F.xxhash64(*columns), F.lit(every)) == 0).select(*columns).distinct()
    found = probe.orderBy(*columns).collect()
    step = max(1, len(found) // parts)
    kinds = [f.dataType for f in probe.schema.fields]
    return [F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(r, kinds, columns, strict=True))) for r in found[step::step][: parts - 1]]


def range_of(bounds: list[Column], value: Column) -> Column:
    """How many of the ordered bounds are not above the value, by halving steps over one array."""
    if not bounds:
        return F.lit(0)
    table, n = F.array(*bounds), len(bounds)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) <= value), at + step).otherwise(at))


def placed(rows: DataFrame, by: tuple[str, ...], of: str, parts: int | None = None) -> DataFrame:
    """by, value, n, before, total: of each group's different values how often they occur, how many rows of the group are less, how many there are.

    Nulls have n 0 and come first. Values are counted, with partial counts
    before the shuffle; a range of (group, value) between probed splitters gets
    its counts by group; their sums over earlier ranges tell where each range of
    a group begins; windows run within a group's part of a range. A group that
    holds all rows is cut into as many ranges as there are shuffle partitions.
    """
    flat, keys = _named(rows, by, of)
    columns = [*keys, "__v"]
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = splitters(flat, columns, parts)
    counts = flat.groupBy(*columns).agg(F.count("__v").alias("n")).withColumn("__range", range_of(bounds, F.struct(*columns)))
    sums = counts.groupBy(*keys, "__range").agg(F.sum("n").alias("own"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))  # a row for each range of the group
    named = [F.col(k).alias(f"{k}_") for k in keys]
    begin = F.sum("own").over(group.orderBy("__range")) - F.col("own")
    begins = sums.select(*named, F.col("__range").alias("__range_"), F.sum("own").over(group).alias("total"), begin.alias("begin"))
    match = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in [*keys, "__range"]]
    both = counts.join(begins, match).select(*columns, "n", "__range", "total", "begin")
    within = Window.partitionBy(*keys, "__range").orderBy("__v")
    before = F.col("begin") + F.sum("n").over(within) - F.col("n")
    return both.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), F.col("__v").alias("value"), "n", before.alias("before"), "total")


def _at(rank: Column) -> Column:
    """The value at a rank, counted from 0, where placed() rows of a group are aggregated."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))


def percentile(rows: DataFrame, by: tuple[str, ...], of: str, place: float, alias: str) -> DataFrame:
    """by, alias: the number at a share of each group, interpolated between neighbours; null for groups without a number."""
    spot = F.lit(place) * (F.col("total") - F.lit(1))
    low, high = F.floor(spot), F.ceil(spot)
    found = placed(rows, by, of).groupBy(*(f"`{b}`" for b in by)).agg(_at(low).cast("double").alias("low"), _at(high).cast("double").alias("high"), F.first(spot - low).alias("part"))
    return found.select(*(f"`{b}`" for b in by), (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias(alias))


def value_at(rows: DataFrame, by: tuple[str, ...], of: str, place: float, alias: str) -> DataFrame:
    """by, alias: the least value of each group up to which the share of its values lies, of any type with an order; null without values."""
    rank = F.greatest(F.lit(1), F.ceil(F.lit(place) * F.col("total"))) - F.lit(1)
    return placed(rows, by, of).groupBy(*(f"`{b}`" for b in by)).agg(_at(rank).alias(alias))


def mode(rows: DataFrame, by: tuple[str, ...], of: str, alias: str) -> DataFrame:
    """by, alias: the value that occurs most often in each group, the least of several; null without values."""
    flat, keys = _named(rows, by, of)
    counts = flat.groupBy(*keys, "__v").agg(F.count("__v").alias("n"))
    best = F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), F.col("__v").alias("v"))))["v"]
    return counts.groupBy(*keys).agg(best.alias("__mode")).select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), F.col("__mode").alias(alias))
