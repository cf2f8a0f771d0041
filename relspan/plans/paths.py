"""Columns that are reached over links: the shortest path between two tables as a tree of joins, one row for each row of the first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspan.plans.catalog import Catalog, ForeignKey
from relspan.plans.relation import Refused

#: What is known of the values below a row, so that it can be merged on the way up.
_PARTIAL = {"total": F.sum, "n": F.sum, "low": F.min, "high": F.max}
FUNCTIONS = ("AVG", "COUNT", "MAX", "MIN", "SUM")


def steps(catalog: Catalog, start: str, end: str) -> list[tuple[str, ForeignKey]]:
    """A shortest path of links, each up to a parent or down to children, over keys of one column; ties by names."""
    ways: dict[str, list] = {}
    for f in sorted(catalog.links, key=lambda f: (f.table, f.column, f.parent)):
        if len(catalog.tables[f.parent].key) == 1:
            ways.setdefault(f.table, []).append(("up", f, f.parent))
            ways.setdefault(f.parent, []).append(("down", f, f.table))
    came, edge = {start: []}, [start]
    while edge and end not in came:
        further = []
        for t in edge:
            for way, f, other in ways.get(t, ()):
                if other not in came:
                    came[other] = [*came[t], (way, f)]
                    further.append(other)
        edge = further
    if end not in came:
        raise Refused(f"no links lead from {start} to {end}")
    return came[end]


def lineage(path: list[tuple[str, ForeignKey]], column: str) -> str:
    """The name of a column at the end of a path: up by the foreign key, down by the table and its foreign key."""
    return ".".join([*(f.column if way == "up" else f"{f.table}[{f.column}]" for way, f in path), column])


def _answer(fn: str) -> Column:
    return {"SUM": F.col("total"), "COUNT": F.coalesce("n", F.lit(0)), "AVG": F.try_divide("total", F.col("n")), "MIN": F.col("low"), "MAX": F.col("high")}[fn]


def along(catalog: Catalog, tables: Callable[[str], DataFrame], start: str, end: str, column: str, fn: str | None = None) -> DataFrame:
    """The rows of start with one more column, named by its lineage: that of end, or what fn makes of its rows below.

    Up, a row has one parent, so the column itself is taken (null without one)
    and fn says nothing. Down, rows are aggregated by their foreign key before
    the join, step by step, so no row of start is repeated and what is shuffled
    are groups: this is the aggregate by a foreign key at the grain of its
    parent. Then fn is one of FUNCTIONS: a mean is that of all rows below, the
    sum of none is null, their count 0.
    """
    path = steps(catalog, start, end)
    down = any(way == "down" for way, _ in path)
    if down and fn not in FUNCTIONS:
        raise Refused(f"rows below need an aggregate of {', '.join(FUNCTIONS)}")
    if column not in {c.name for c in catalog.tables[end].columns}:
        raise Refused(f"no column {column} in {end}")

    def partial(rows: DataFrame, keys: list[str]) -> DataFrame:
        x = F.col(f"`{column}`")
        number = x.try_cast("double") if fn in ("SUM", "AVG") else F.lit(None).cast("double")
        return rows.select(*keys, number.alias("total"), F.when(x.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n"), x.alias("low"), x.alias("high"))

    def below(i: int, table: str, keys: list[str]) -> DataFrame:
        """keys of the table's rows, and what is known at the end of the rest of the path."""
        if i == len(path):
            return partial(tables(table), keys)
        way, f = path[i]
        if way == "up":
            key = catalog.tables[f.parent].key[0]
            there = below(i + 1, f.parent, [key]).withColumnRenamed(key, "__to")
            own = tables(table).select(*keys, F.col(f.column).alias("__from"))
        else:
            key = catalog.tables[table].key[0]
            met = below(i + 1, f.table, [f.column])
            there = met.where(F.col(f.column).isNotNull()).groupBy(F.col(f.column).alias("__to")).agg(*(g(c).alias(c) for c, g in _PARTIAL.items()))
            own = tables(table).select(*keys, F.col(key).alias("__from"))
        return own.join(there, F.col("__from") == F.col("__to"), "left").select(*keys, *_PARTIAL)

    columns = [c.name for c in catalog.tables[start].columns]
    return below(0, start, columns).select(*columns, (_answer(fn) if down else F.col("low")).alias(lineage(path, column)))
