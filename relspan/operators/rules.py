"""Constraints as cases state them, compiled to DataFrames: each lookup planned once, one aggregate a table.

A constraint is a dict with "table" and "type": ifthen with "condition" and
"result", or a predicate. Predicates: and, or with "conditions"; range with
"column", "min", "max", ends inclusive and either missing; eq, neq, gt, gte, lt,
lte with "column" and a right side. That is "value", or "rhs_column", or
"rhs_expr" {"column", "op" of + - * /, "value"}, in this precedence, save that
an rhs_expr goes before a value. "join" {"from": "A.x", "to": "B.y"} takes a
column from the first row of B, in the order of its files, whose y equals x;
"table_ref" names that table where it is another. "rhs_join" and "rhs_table_ref"
do the same for the right side, "join" and "table_ref" inside of rhs_expr for it.

A row for which a predicate can't be told is unevaluable, with a reason: a
column, table, key or matching row that is missing, a null, values of kinds
without an order, a division by zero. Numbers, booleans among them, texts and
times are kinds; a text compared with a time is read as one. Values of different
kinds are unequal.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.sources.positions import AT, file_order, first_rows

_COMPARE = {"eq": Column.__eq__, "neq": Column.__ne__, "gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
_STEPS = {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__, "/": F.try_divide}
NUMBER, TEXT, TIME, OTHER, NOTHING = "number", "text", "time", "other", "nothing"


@dataclass(frozen=True)
class Lookup:
    """The first row of a table for each value of a local column."""

    local: str
    table: str
    key: str


@dataclass
class Value:
    """A value of a row, its kind, and why it can't be told where it can't (null elsewhere)."""

    at: Column
    kind: str
    why: Column | None = None


@dataclass
class Truth:
    """True, false, or null where it can't be told, and why."""

    at: Column
    why: Column


@dataclass
class Plan:
    """What one table's constraints need: the lookups with the columns they read, and the compiled constraints."""

    rows: DataFrame
    tables: Mapping[str, DataFrame]
    lookups: dict[Lookup, dict[str, str]] = field(default_factory=dict)

    def column(self, name: str, join: Mapping | None, table: str | None) -> Value:
        """A column of the row or, over a join, of the row looked up."""
        if not join:
            if name not in self.rows.columns:
                return _missing(f"column {name} is not on the row")
            return Value(F.col(f"`{name}`"), kind_of(self.rows.schema[name].dataType))
        local, target = join["from"].split(".", 1)[-1], join["to"]
        table = table or (target.split(".", 1)[0] if "." in target else None)
        key = target.split(".", 1)[-1]
        if table is None:
            return _missing(f"the join to {target} names no table")
        if local not in self.rows.columns:
            return _missing(f"join column {local} is not on the row")
        other = self.tables.get(table)
        if other is None:
            return _missing(f"table {table} is not there")
        if key not in other.columns:
            return _missing(f"join key {table}.{key} is no column")
        wanted = self.lookups.setdefault(Lookup(local, table, key), {})
        number = list(self.lookups).index(Lookup(local, table, key))
        none = F.when(F.col(f"__found{number}").isNull(), F.concat(F.lit(f"no row of {table} matches {local} = "), F.coalesce(F.col(f"`{local}`").cast("string"), F.lit("null"))))
        if name not in other.columns:
            return Value(F.lit(None), NOTHING, F.coalesce(none, F.lit(f"column {name} is not on {table}")))
        alias = wanted.setdefault(name, f"__v{number}_{len(wanted)}")
        return Value(F.col(alias), kind_of(other.schema[name].dataType), none)

    def right(self, c: Mapping) -> Value:
        if "value" in c and "rhs_expr" not in c:
            return literal(c["value"])
        if "rhs_column" in c:
            return self.column(c["rhs_column"], c.get("rhs_join"), c.get("rhs_table_ref"))
        if "rhs_expr" not in c:
            return _missing("the predicate has no right side")
        e = c["rhs_expr"]
        base, op = self.column(e["column"], e.get("join"), e.get("table_ref")), e.get("op")
        if op is None:
            return base
        if op not in _STEPS:
            return _missing(f"no arithmetic operator {op}")
        with_ = literal(e.get("value"))
        if base.kind == NOTHING:
            return base
        if base.kind != NUMBER or with_.kind != NUMBER:
            return Value(F.lit(None), NOTHING, F.coalesce(base.why or F.lit(None), F.when(base.at.isNull(), "arithmetic on a null"), F.lit("arithmetic on what is no number")))
        number = _STEPS[op](base.at.cast("double"), with_.at.cast("double"))
        zero = F.lit("division by zero" if op == "/" and e["value"] == 0 else None).cast("string")
        return Value(number, NUMBER, F.coalesce(base.why if base.why is not None else F.lit(None), F.when(base.at.isNull(), "arithmetic on a null"), zero))

    def truth(self, c: Mapping) -> Truth:
        """Of a predicate. AND and OR stop at the first part that decides, in the order given; one that can't be told before that ends them too."""
        kind = c.get("type")
        if kind in ("and", "or"):
            stop = kind == "or"
            at, why = F.lit(not stop), F.lit(None).cast("string")
            for part in reversed([self.truth(p) for p in c.get("conditions") or []]):
                at = F.when(part.at.isNull(), F.lit(None).cast("boolean")).when(part.at == F.lit(stop), F.lit(stop)).otherwise(at)
                why = F.when(part.at.isNull(), part.why).when(part.at != F.lit(stop), why)
            return Truth(at, why)
        if kind == "range":
            left = self.column(c["column"], c.get("join"), c.get("table_ref"))
            ends = [(op, literal(c[end])) for op, end in (("gte", "min"), ("lte", "max")) if c.get(end) is not None]
            parts = [compared(op, left, end) for op, end in ends]
            why = left.why if left.why is not None else F.lit(None).cast("string")
            why = F.coalesce(why, F.when(left.at.isNull(), F.lit(f"column {c['column']} is null")), *(p.why for p in parts))
            at = F.lit(True)
            for p in parts:
                at = at & p.at
            return Truth(F.when(why.isNull(), at), why)
        if kind in _COMPARE:
            return compared(kind, self.column(c["column"], c.get("join"), c.get("table_ref")), self.right(c))
        return Truth(F.lit(None).cast("boolean"), F.lit(f"no predicate type {kind}"))

    def joined(self) -> DataFrame:
        """The rows with what their lookups found; a lookup of one table and key is one aggregate, of one local column one join."""
        rows, at = file_order(self.rows)
        for number, (k, wanted) in enumerate(self.lookups.items()):
            first = first_rows(self.tables[k.table], k.key, list(wanted))
            first = first.select(F.col("__key").alias(f"__key{number}"), F.lit(True).alias(f"__found{number}"), *(F.col(f"`{c}`").alias(a) for c, a in wanted.items()))
            rows = rows.join(first, F.col(f"`{k.local}`").eqNullSafe(F.col(f"__key{number}")), "left").drop(f"__key{number}")
        return rows


def _missing(why: str) -> Value:
    return Value(F.lit(None), NOTHING, F.lit(why))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.NumericType, T.BooleanType)):
        return NUMBER
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    return TIME if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else NOTHING if isinstance(t, T.NullType) else OTHER


def literal(v: object) -> Value:
    if v is None:
        return Value(F.lit(None), NOTHING)
    if isinstance(v, (bool, int, float)):
        return Value(F.lit(v), NUMBER)
    if isinstance(v, (date, datetime)):
        return Value(F.lit(v), TIME)
    return Value(F.lit(v), TEXT) if isinstance(v, str) else Value(F.lit(str(v)), OTHER)


def compared(op: str, a: Value, b: Value) -> Truth:
    """One comparison. Null on a side can't be told."""
    whys = [v.why for v in (a, b) if v.why is not None]
    null = F.when(a.at.isNull() | b.at.isNull(), F.lit("comparison with a null"))
    kinds = {a.kind, b.kind}
    left, right, mixed = a.at, b.at, None
    if NOTHING in kinds:
        return Truth(F.lit(None).cast("boolean"), F.coalesce(*whys, F.lit("comparison with a null")))
    if kinds == {TEXT, TIME}:
        left, right = (v.at.try_cast("timestamp") if v.kind == TEXT else v.at.cast("timestamp") for v in (a, b))
        odd = F.when(left.isNull() | right.isNull(), F.lit("a text is no time"))
        mixed = F.coalesce(null, odd)
    elif kinds == {NUMBER}:
        left, right = left.cast("double"), right.cast("double")
    elif kinds == {TIME}:
        left, right = left.cast("timestamp"), right.cast("timestamp")
    elif len(kinds) > 1 or kinds == {OTHER}:
        if op in ("eq", "neq"):
            why = F.coalesce(*whys, null)
            return Truth(F.when(why.isNull(), F.lit(op == "neq")), why)
        return Truth(F.lit(None).cast("boolean"), F.coalesce(*whys, null, F.lit(f"{a.kind} and {b.kind} have no order")))
    why = F.coalesce(*whys, null if mixed is None else mixed)
    return Truth(F.when(why.isNull(), _COMPARE[op](left, right)), why)


VERDICT = "constraint int, table string, type string, satisfied long, violated long, applicable long, vacuous long, unevaluable long, rate double, reason string"


def verdicts(constraints: list[Mapping], tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """One row a constraint, numbered in order: counts of rows, the share satisfied, and why it can't be told if no row could.

    applicable rows are satisfied or violated; vacuous ones fail an ifthen's
    condition. rate is null where nothing is applicable. reason is null unless
    nothing is applicable and a row is unevaluable, or the table is missing: then
    it is that of the last such row in the files. Every table is scanned once
    for all its constraints, and each lookup joined once.
    """
    by: dict[str, list[int]] = {}
    out = []
    for i, c in enumerate(constraints):
        table = c.get("table")
        if table and table in tables:
            by.setdefault(table, []).append(i)
        else:
            why = f"table {table} is not there" if table else "the constraint names no table"
            out.append((i, table or None, c.get("type"), 0, 0, 0, 0, 0, None, why))
    found = spark.createDataFrame(out, VERDICT)
    for table, own in by.items():
        plan = Plan(tables[table], tables)
        counts, names = [], []
        for i in own:
            c = constraints[i]
            if c.get("type") == "ifthen":
                given, then = plan.truth(c["condition"]), plan.truth(c["result"])
                held = F.when(given.at, then.at)
                vacuous = ~given.at
                why = F.when(given.at.isNull(), given.why).when(given.at, then.why)
            else:
                given = plan.truth(c)
                held, vacuous, why = given.at, F.lit(False), given.why
            open_ = held.isNull() & ~F.coalesce(vacuous, F.lit(False))
            counts += [F.count_if(held).alias(f"s{i}"), F.count_if(~held).alias(f"v{i}"), F.count_if(vacuous).alias(f"n{i}"), F.count_if(open_).alias(f"u{i}"), F.max_by(why, F.when(open_, F.col(AT))).alias(f"w{i}")]
            names.append((i, c.get("type")))
        one = plan.joined().agg(*counts)
        applicable = {i: F.col(f"s{i}") + F.col(f"v{i}") for i in own}
        each = [
            F.struct(
                F.lit(i).alias("constraint"), F.lit(table).alias("table"), F.lit(kind).alias("type"), F.col(f"s{i}").alias("satisfied"), F.col(f"v{i}").alias("violated"), applicable[i].alias("applicable"),
                F.col(f"n{i}").alias("vacuous"), F.col(f"u{i}").alias("unevaluable"), F.try_divide(F.col(f"s{i}").cast("double"), applicable[i].cast("double")).alias("rate"),
                F.when((applicable[i] == 0) & (F.col(f"u{i}") > 0), F.col(f"w{i}")).alias("reason"),
            )
            for i, kind in names
        ]
        found = found.unionByName(one.select(F.explode(F.array(*each)).alias("x")).select("x.*"))
    return found


def satisfaction(found: DataFrame) -> DataFrame:
    """csr and its counts over verdicts(): every applicable row weighs the same; null where none is."""
    told = F.col("reason").isNull()
    return found.agg(
        F.try_divide(F.sum("satisfied").cast("double"), F.sum("applicable").cast("double")).alias("csr"),
        F.count("*").alias("n_constraints"),
        F.count_if(told & (F.col("applicable") > 0)).alias("n_evaluated"),
        F.count_if(told & (F.col("applicable") == 0)).alias("n_vacuous"),
        F.count_if(~told).alias("n_unevaluable"),
        F.coalesce(F.sum("applicable"), F.lit(0)).alias("applicable_rows"),
        F.coalesce(F.sum("violated"), F.lit(0)).alias("violated_rows"),
    )


def parse(lines: Iterable[str]) -> list[dict]:
    """Constraints of JSON lines, each a case with ground_truth_constraints or one constraint."""
    import json

    out = []
    for line in lines:
        if line.strip():
            one = json.loads(line)
            out += one["ground_truth_constraints"] if "ground_truth_constraints" in one else [one]
    return out
