"""Validation of cases made from the rows of a table, each with one thing broken, and the findings that each must have."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.plans import case_checks
from relspan.plans.catalog import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_TABLES, _LINKS, _DISTS, _RULES = ("ground_truth_schema", "tables"), ("ground_truth_schema", "relationships"), ("ground_truth_distributions",), ("ground_truth_constraints",)
_FDS, _MOMENTS = ("functional_dependencies",), ("ground_truth_moments",)
_ID = "@ID@"

#: A case without a fault.
GOOD = {
    "id": _ID,
    "domain": "shops",
    "profile": "small",
    "nl_description": "A shop has customers and orders. The average total of an order is 42.5, and 80 percent of customers, that is 1,200 of them, pay by card. The log-mean of the total is 3.",
    "ground_truth_schema": {
        "tables": [
            {"name": "CUSTOMER", "columns": [{"name": "id", "data_type": "INTEGER"}, {"name": "card", "data_type": "BOOLEAN"}], "pk": "id"},
            {"name": "ORDERS", "columns": [{"name": "id", "data_type": "INTEGER"}, {"name": "customer_id", "data_type": "INTEGER"}, {"name": "total", "data_type": "FLOAT"}], "pk": ["id"]},
        ],
        "relationships": [{"referencing_table": "ORDERS", "referencing_column": "customer_id", "referred_table": "CUSTOMER", "referred_column": "id"}],
    },
    "ground_truth_distributions": {"ORDERS.total": {"distribution": "normal", "params": {"mean": 42.5, "std": 3}}, "CUSTOMER.card": {"family": "categorical", "params": {"weights": {"1": 0.8, "0": 0.2}}}, "ORDERS.customer_id": {"family": "zipf", "params": {"a": 2}}},
    "ground_truth_constraints": [
        {"type": "range", "table": "ORDERS", "column": "total", "min": 0, "max": 10},
        {
            "type": "ifthen",
            "table": "ORDERS",
            "condition": {"type": "and", "conditions": [{"type": "gt", "column": "total", "value": 3}, {"type": "not", "condition": {"type": "eq", "column": "card", "table_ref": "CUSTOMER", "join": {"from": "ORDERS.customer_id", "to": "CUSTOMER.id"}, "value": True}}]},
            "result": {"type": "lt", "column": "total", "rhs_expr": {"op": "*", "column": "id", "value": 2}},
        },
        {"type": "ifthen", "table": "ORDERS", "condition": {"type": "gt", "column": "total", "rhs_column": "id", "rhs_table_ref": "CUSTOMER", "rhs_join": {"from": "ORDERS.customer_id", "to": "CUSTOMER.id"}}, "result": {"type": "gt", "column": "id", "value": 0}},
    ],
    "functional_dependencies": [{"determinant": ["ORDERS.id"], "dependent": ["ORDERS.total"]}],
    "ground_truth_moments": [{"table": "ORDERS", "column": "total", "aggregate": "avg", "value": 42.5, "evidence": "Average total\n of an order is 42.5"}, {"table": "CUSTOMER", "column": "id", "aggregate": "count", "value": 1200, "evidence": "80 percent of customers, that is 1,200 of them"}],
}
_GONE = object()


def _e(subject: str, detail: str, level: str = "error") -> tuple[str, str, str]:
    return level, subject, detail


#: What is put where in a good case, and the findings that it makes. _GONE takes the field away.
FAULTS: list[tuple[tuple, object, list[tuple[str, str, str]]]] = [
    (("profile",), "small", []),
    (("profile",), _GONE, [_e("profile", "missing"), _e("profile", "no text")]),
    (("domain",), "", [_e("domain", "no text")]),
    (("nl_description",), "short", [_e("nl_description", "too short"), *(_e(f"ground_truth_moments[{i}]", "evidence is not in the text") for i in (0, 1))]),
    (("ground_truth_schema",), 5, [_e("ground_truth_schema", "no object")]),
    (_TABLES, [], [_e("ground_truth_schema", "no tables")]),
    ((*_TABLES, 2), 7, [_e("tables[2]", "no object")]),
    ((*_TABLES, 2), {"columns": []}, [_e("tables[2]", "no name")]),
    ((*_TABLES, 2), {"name": "Shop", "columns": [{"name": "id", "data_type": "UUID"}], "pk": "id"}, [_e("Shop", "not in upper snake case")]),
    ((*_TABLES, 2), {"name": "SHOP", "columns": []}, [_e("SHOP", "no columns")]),
    ((*_TABLES, 2), {"name": "SHOP", "columns": [3, {}, {"name": "Id", "data_type": "INT"}, {"name": "a", "data_type": "TEXT"}, {"name": "a", "data_type": "TEXT"}], "pk": ["a", "b"]}, [_e("SHOP", "a column is no object"), _e("SHOP", "a column has no name"), _e("SHOP.Id", "not in lower snake case"), _e("SHOP.Id", "no type INT"), _e("SHOP.a", "2 times"), _e("SHOP", "no key column b")]),
    ((*_TABLES, 2), {"name": "ORDERS", "columns": [{"name": "id", "data_type": "INTEGER"}]}, [_e("ORDERS", "2 times"), _e("ORDERS", "no key"), _e("ORDERS.id", "2 times")]),
    (_LINKS, _GONE, [_e("ground_truth_schema", "2 tables and no relationships", "warning")]),
    (_LINKS, {}, [_e("ground_truth_schema", "relationships is no array")]),
    ((*_LINKS, 1), "x", [_e("relationships[1]", "no object")]),
    ((*_LINKS, 0, "referred_table"), "SHOP", [_e("relationships[0].referred", "no table SHOP")]),
    ((*_LINKS, 0, "referencing_column"), "shop_id", [_e("relationships[0].referencing", "no column ORDERS.shop_id")]),
    (_DISTS, [], [_e("ground_truth_distributions", "no object")]),
    ((*_DISTS, "total"), {}, [_e("total", "total is not TABLE.column")]),
    ((*_DISTS, "SHOP.id"), {}, [_e("SHOP.id", "no table SHOP")]),
    ((*_DISTS, "ORDERS.size"), {}, [_e("ORDERS.size", "no column ORDERS.size")]),
    ((*_DISTS, "ORDERS.id"), 3, [_e("ORDERS.id", "no object")]),
    ((*_DISTS, "ORDERS.id"), {"family": "cauchy", "params": {}}, [_e("ORDERS.id", "no family cauchy")]),
    ((*_DISTS, "ORDERS.id"), {"family": "poisson"}, [_e("ORDERS.id", "no params")]),
    ((*_DISTS, "ORDERS.id"), {"family": "zipf", "params": {"s": 2, "n": 3}}, [_e("ORDERS.id", "lacks a"), _e("ORDERS.id", "does not take n, s")]),
    ((*_DISTS, "ORDERS.id"), {"family": "zipf", "params": {"a": 1}}, [_e("ORDERS.id", "a is not above 1")]),
    ((*_DISTS, "ORDERS.id"), {"family": "lognormal", "params": {"mean": 1, "variance": "much"}}, [_e("ORDERS.id", "variance is no number")]),
    ((*_DISTS, "ORDERS.id"), {"family": "exponential", "params": {"lambda": "0.0"}}, [_e("ORDERS.id", "lambda is not above 0")]),
    ((*_DISTS, "ORDERS.id"), {"family": "uniform", "params": {"min": 3, "max": 3}}, [_e("ORDERS.id", "max is not above min")]),
    ((*_DISTS, "CUSTOMER.card"), {"family": "poisson", "params": {"lambda": 2}}, [_e("CUSTOMER.card", "poisson over BOOLEAN", "warning")]),
    ((*_DISTS, "CUSTOMER.card", "params", "weights"), {}, [_e("CUSTOMER.card", "no weights")]),
    ((*_DISTS, "CUSTOMER.card", "params", "weights"), {"1": 3, "0": 4}, [_e("CUSTOMER.card", "weights add up to 7.0000")]),
    ((*_DISTS, "CUSTOMER.card", "params", "weights"), {"1": 1.5, "yes": -0.5}, [_e("CUSTOMER.card", "a weight is negative"), _e("CUSTOMER.card", "nominal labels", "warning")]),
    ((*_DISTS, "CUSTOMER.card", "params", "weights"), {"1": "all"}, [_e("CUSTOMER.card", "a weight is no number")]),
    (_RULES, {}, [_e("ground_truth_constraints", "no array")]),
    ((*_RULES, 3), 1, [_e("constraint[3]", "no object")]),
    ((*_RULES, 3), {"type": "unique", "table": "ORDERS"}, [_e("constraint[3]", "no type unique")]),
    ((*_RULES, 3), {"type": "range", "table": "SHOP", "min": 1}, [_e("constraint[3]", "no table SHOP")]),
    ((*_RULES, 3), {"type": "range", "table": "ORDERS", "column": "size"}, [_e("constraint[3]", "no column ORDERS.size"), _e("constraint[3]", "neither min nor max")]),
    ((*_RULES, 0, "max"), -1, [_e("constraint[0]", "max is below min")]),
    ((*_RULES, 0, "max"), "much", [_e("constraint[0]", "min or max is no number")]),
    ((*_RULES, 0, "condition"), {"type": "eq", "column": "gone", "value": 1}, [_e("constraint[0]", "no column ORDERS.gone")]),
    ((*_RULES, 3), {"type": "ifthen", "table": "ORDERS"}, [_e("constraint[3]", "no condition"), _e("constraint[3]", "no result")]),
    ((*_RULES, 1, "condition", "conditions"), [], [_e("constraint[1].condition", "and has no conditions")]),
    ((*_RULES, 1, "condition", "conditions", 0), 3, [_e("constraint[1].condition", "no object")]),
    ((*_RULES, 1, "condition", "conditions", 1, "condition"), None, [_e("constraint[1].condition", "not has no condition")]),
    ((*_RULES, 1, "condition", "conditions", 1, "condition", "column"), _GONE, [_e("constraint[1].condition", "a leaf of type eq names no column")]),
    ((*_RULES, 1, "condition", "conditions", 1, "condition", "table_ref"), "SHOP", [_e("constraint[1].condition", "no table SHOP")]),
    ((*_RULES, 1, "condition", "conditions", 1, "condition", "join", "from"), "ORDERS.shop_id", [_e("constraint[1].condition.join.from", "no column ORDERS.shop_id")]),
    ((*_RULES, 1, "condition", "conditions", 1, "condition", "join"), {"from": "ORDERS.customer_id"}, [_e("constraint[1].condition.join.to", "null is not TABLE.column")]),
    ((*_RULES, 1, "condition", "conditions", 1, "condition", "join"), 4, [_e("constraint[1].condition", "join is no object")]),
    ((*_RULES, 1, "result", "value"), 3, [_e("constraint[1].result", "several right sides: value, rhs_expr")]),
    ((*_RULES, 1, "result", "rhs_expr"), _GONE, [_e("constraint[1].result", "no right side")]),
    ((*_RULES, 1, "result", "rhs_expr"), {"op": "^", "column": "ids"}, [_e("constraint[1].result", "no arithmetic operator ^"), _e("constraint[1].result", "rhs_expr needs a value or a rhs_column"), _e("constraint[1].result.rhs_expr", "no column ORDERS.ids")]),
    ((*_RULES, 1, "result", "rhs_expr"), {"op": "+", "column": "id", "rhs_column": "x", "rhs_table_ref": "CUSTOMER"}, [_e("constraint[1].result.rhs_expr.rhs", "no column CUSTOMER.x")]),
    ((*_RULES, 1, "result", "rhs_expr"), 4, [_e("constraint[1].result", "rhs_expr is no object")]),
    ((*_RULES, 2, "condition", "rhs_column"), "x", [_e("constraint[2].condition.rhs", "no column CUSTOMER.x")]),
    ((*_RULES, 2, "condition", "rhs_join", "to"), "SHOP.id", [_e("constraint[2].condition.rhs_join.to", "no table SHOP")]),
    (_FDS, {}, [_e("functional_dependencies", "no array")]),
    ((*_FDS, 1), 2, [_e("functional_dependencies[1]", "no object")]),
    ((*_FDS, 0, "dependent"), [], [_e("functional_dependencies[0].dependent", "no list of columns")]),
    ((*_FDS, 0, "determinant"), ["id", "SHOP.id", "ORDERS.x"], [_e("functional_dependencies[0].determinant", "id is not TABLE.column"), _e("functional_dependencies[0].determinant", "no table SHOP"), _e("functional_dependencies[0].determinant", "no column ORDERS.x")]),
    (_MOMENTS, 1, [_e("ground_truth_moments", "no array")]),
    ((*_MOMENTS, 2), 1, [_e("ground_truth_moments[2]", "no object")]),
    ((*_MOMENTS, 0, "column"), "size", [_e("ground_truth_moments[0]", "no column ORDERS.size")]),
    ((*_MOMENTS, 0, "aggregate"), "median", [_e("ground_truth_moments[0]", "no aggregate median")]),
    ((*_MOMENTS, 0, "value"), "42.5", [_e("ground_truth_moments[0]", "value is no number")]),
    ((*_MOMENTS, 0, "evidence"), " ", [_e("ground_truth_moments[0]", "no evidence")]),
    ((*_MOMENTS, 0, "evidence"), "The log-mean of the total is 3", [_e("ground_truth_moments[0]", "a parameter of logarithms read as an average")]),
    ((*_MOMENTS, 1, "value"), 900, [_e("ground_truth_moments[1]", "a percentage read as a count")]),
    ((*_MOMENTS, 0, "column"), "customer_id", [_e("ground_truth_moments[0]", "an average of ids")]),
    ((*_MOMENTS, 2), {"table": "ORDERS", "column": "total", "aggregate": "avg", "value": 1200, "evidence": "that is 1,200 of them"}, [_e("ground_truth_moments", "avg(ORDERS.total) has 2 values")]),
]


def broken(path: tuple, value: object) -> dict:
    """A good case with one field changed, added or taken away."""
    case = copy.deepcopy(GOOD)
    at = case
    for k in path[:-1]:
        at = at[k]
    last = path[-1]
    if value is _GONE:
        del at[last]
    elif isinstance(at, list) and last == len(at):
        at.append(value)
    else:
        at[last] = value
    return case


def _values(rows: list[tuple[int, str, str, str]]) -> str:
    quoted = ", ".join("(" + ", ".join([str(i), *("'" + x.replace("'", "''") + "'" for x in rest)]) + ")" for i, *rest in rows)
    return f"(VALUES {quoted}) f(k, level, subject, detail)"


def dataset_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each part, broken in the way that its key chooses."""
    texts = F.array(*(F.lit(json.dumps(broken(path, value))) for path, value, _ in FAULTS))
    key = F.col("p_partkey")
    lines = read(spark, sf_dir, "PART").select(F.replace(F.get(texts, (key % len(FAULTS)).cast("int")), F.lit(_ID), key.cast("string")).alias("value"))
    return case_checks.validate(lines)


QUERIES["dataset_findings"] = dataset_findings
ORACLE_SQL["dataset_findings"] = f"SELECT p_partkey::VARCHAR AS case_id, level, subject, detail FROM part JOIN {_values([(i, *f) for i, (_, _, found) in enumerate(FAULTS) for f in found])} ON p_partkey % {len(FAULTS)} = k"
