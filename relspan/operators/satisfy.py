"""Constraints over rows: satisfied, violated, vacuous or unevaluable, counted in one aggregate a table.

A condition is a dict. {"op": "range", "column", "min", "max"} (ends inclusive,
either may be None; "condition" makes it conditional), {"op": eq, neq, gt, gte,
lt or lte, "column", and one of "value", "rhs_column", "rhs_expr"}, {"op": "and"
or "or", "conditions"}, {"op": "not", "condition"}, {"op": "ifthen", "if", "then"}.
rhs_expr is {"op": + - * /, "column", and "value" or "rhs_column"}. "rhs_join":
{"table", "fk", "key"} takes rhs_column from the first matching row of a table,
"lhs_join" likewise column; first by the columns in "order", else in the order of
the files. Where no row matches, the comparison can't be evaluated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspan.functions.running import followers
from relspan.sources.positions import first_rows

_OPS = {"eq": Column.__eq__, "neq": Column.__ne__, "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def holds(c: dict, rows: DataFrame) -> Column:
    """True, false, or null where the condition can't be evaluated for the row.

    AND and OR stop at the first part that decides, in the order given, and a
    part that can't be evaluated before that makes all of it unevaluable. So
    null AND false is null here, unlike in SQL, while false AND null is false.
    """
    op = c["op"]
    if op in ("and", "or"):
        stop = op == "or"
        out = F.lit(not stop)
        for part in reversed(c["conditions"]):
            this = holds(part, rows)
            out = F.when(this.isNull(), F.lit(None).cast("boolean")).when(this == F.lit(stop), F.lit(stop)).otherwise(out)
        return out
    if op == "not":
        return ~holds(c["condition"], rows)
    if op == "ifthen":
        return holds(c["then"], rows)
    value = _column(looked_up(c, "lhs_join") if "lhs_join" in c else c["column"], rows)
    if op == "range":
        parts = [value >= F.lit(c["min"])] if c.get("min") is not None else []
        parts += [value <= F.lit(c["max"])] if c.get("max") is not None else []
        out = F.lit(True)
        for p in parts:
            out = out & p
        return F.when(value.isNull(), F.lit(None).cast("boolean")).otherwise(out)
    return _OPS[op](value, _right(c, rows))


def _column(name: str, rows: DataFrame) -> Column:
    """The column, or a null of no type where rows lack it: earlier parts may still decide."""
    return F.col(name) if name in rows.columns else F.lit(None)


def _right(c: dict, rows: DataFrame) -> Column:
    if "value" in c:
        return F.lit(c["value"])
    if "rhs_join" in c:
        return _column(looked_up(c, "rhs_join"), rows)
    if "rhs_column" in c:
        return _column(c["rhs_column"], rows)
    e = c["rhs_expr"]
    a = _column(e["column"], rows).cast("double")
    b = (F.lit(e["value"]) if "value" in e else _column(e["rhs_column"], rows)).cast("double")
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e["op"]]


_SIDES = {"lhs_join": "column", "rhs_join": "rhs_column"}


def looked_up(c: dict, side: str) -> str:
    j = c[side]
    return f"__{j['table']}_{j['fk']}_{c[_SIDES[side]]}".lower()


def joins(c: dict) -> list[tuple[dict, str]]:
    """The conditions that look something up, and on which side."""
    found = [(c, side) for side in _SIDES if side in c]
    for part in [*c.get("conditions", ()), *(c[k] for k in ("condition", "if", "then") if isinstance(c.get(k), dict))]:
        found += joins(part)
    return found


def prepared(rows: DataFrame, constraints: list[dict], tables: Callable[[str], DataFrame]) -> DataFrame:
    """Adds what the constraints look up in other tables: of each key the first row, even where it has a null."""
    seen = {}
    for c, side in (x for k in constraints for x in joins(k)):
        seen[looked_up(c, side)] = c[side], c[_SIDES[side]]
    for name, (j, of) in seen.items():
        other = first_rows(tables(j["table"]), j["key"], [of], j.get("order")).select("__key", F.col(of).alias(name))
        rows = rows.join(other, rows[j["fk"]] == other["__key"], "left").drop("__key")
    return rows


def verdicts(rows: DataFrame, constraints: dict[str, dict], tables: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """constraint, applicable, satisfied, violated, vacuous, unevaluable, rate: one row a constraint, one scan for all.

    applicable: satisfied or violated; rate: their share satisfied, null if
    there are none. vacuous: the condition of an ifthen (or of a range) is false.
    """
    if tables is not None:
        rows = prepared(rows, list(constraints.values()), tables)
    counts = []
    for i, c in enumerate(constraints.values()):
        given = holds(c["if"], rows) if c["op"] == "ifthen" else holds(c["condition"], rows) if c["op"] == "range" and c.get("condition") else F.lit(True)
        result = F.when(given, holds(c, rows))
        counts += [F.count_if(result).alias(f"s{i}"), F.count_if(~result).alias(f"v{i}"), F.count_if(~given).alias(f"n{i}"), F.count("*").alias(f"a{i}")]
    one = rows.agg(*counts)
    each = F.array(*(F.struct(F.lit(n).alias("constraint"), F.col(f"s{i}").alias("satisfied"), F.col(f"v{i}").alias("violated"), F.col(f"n{i}").alias("vacuous"), (F.col(f"a{i}") - F.col(f"s{i}") - F.col(f"v{i}") - F.col(f"n{i}")).alias("unevaluable")) for i, n in enumerate(constraints)))
    out = one.select(F.explode(each).alias("x")).select("x.*").withColumn("applicable", F.col("satisfied") + F.col("violated"))
    return out.withColumn("rate", F.try_divide(F.col("satisfied").cast("double"), F.col("applicable").cast("double")))


def report(found: DataFrame) -> DataFrame:
    """The rate over all constraints, weighted by rows, and how many were evaluated, vacuous and unevaluable."""
    return found.agg(
        F.try_divide(F.sum("satisfied").cast("double"), F.sum("applicable").cast("double")).alias("rate"),
        F.count_if(F.col("applicable") > 0).alias("n_evaluated"),
        F.count_if((F.col("applicable") == 0) & (F.col("vacuous") > 0)).alias("n_vacuous"),
        F.count_if((F.col("applicable") == 0) & (F.col("vacuous") == 0)).alias("n_unevaluable"),
    )


def missing_keys(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """How many rows refer to a key that the parent lacks."""
    return child.where(F.col(fk).isNotNull()).join(parent, F.col(fk) == F.col(key), "left_anti").agg(F.count("*").alias("n_missing"))


def dependency_violations(rows: DataFrame, given: list[str], then: str) -> DataFrame:
    """Groups of the given columns with several values of the other: the functional dependency fails there."""
    return rows.groupBy(*given).agg(F.count_distinct(then).alias("n_values")).where("n_values > 1")


def transitions(events: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """How often each state follows each in the order of a group's rows. An extension: sequences of events."""
    return followers(events, by, order, state).select(F.col("before").alias("from_state"), F.col("state").alias("to_state"), "n")


def transition_verdicts(events: DataFrame, by: str, order: list[str], state: str, allowed: list[tuple[str, str]], forbidden: list[tuple[str, str]] = ()) -> DataFrame:
    """from_state, to_state, n, verdict of each transition that occurs: forbidden, allowed, or unlisted where only some are allowed."""
    pair = F.struct(F.col("from_state"), F.col("to_state"))
    among = lambda pairs: F.array_contains(F.array(*(F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state")) for a, b in pairs)), pair) if pairs else F.lit(False)
    verdict = F.when(among(forbidden), "forbidden").when(F.lit(not allowed) | among(allowed), "allowed").otherwise("unlisted")
    return transitions(events, by, order, state).withColumn("verdict", verdict)


def repeated_keys(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The values of the columns that several rows hold, and n; rows with a null among them repeat nothing."""
    whole = rows.dropna(subset=columns)
    return whole.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
