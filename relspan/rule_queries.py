"""Queries of constraints as cases state them, over rows of the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan import queries as base
from relspan.operators import rules as R
from relspan.operators import scoring
from relspan.plans.catalog import read
from relspan.sources.positions import first_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


_TO_ORDER = {"from": "LINEITEM.l_orderkey", "to": "ORDERS.o_orderkey"}
_TO_CUSTOMER = {"from": "ORDERS.o_custkey", "to": "CUSTOMER.c_custkey"}
_TO_FIRST = {"from": "EVENTS.user_id", "to": "EVENTS.user_id"}

#: Constraints in the form of cases, over the given tables.
RULES = [
    {"table": "LINEITEM", "type": "range", "column": "l_quantity", "min": 5, "max": 45},
    {"table": "LINEITEM", "type": "gte", "column": "l_shipdate", "rhs_column": "o_orderdate", "rhs_join": _TO_ORDER, "rhs_table_ref": "ORDERS"},
    {"table": "ORDERS", "type": "ifthen", "condition": {"type": "eq", "column": "o_orderstatus", "value": "F"}, "result": {"type": "gt", "column": "o_totalprice", "value": 100000}},
    {
        "table": "ORDERS",
        "type": "ifthen",
        "condition": {"type": "eq", "column": "c_mktsegment", "table_ref": "CUSTOMER", "join": _TO_CUSTOMER, "value": "BUILDING"},
        "result": {"type": "lte", "column": "o_totalprice", "rhs_expr": {"column": "c_acctbal", "join": _TO_CUSTOMER, "op": "*", "value": 40}},
    },
    {"table": "LINEITEM", "type": "lte", "column": "l_quantity", "rhs_expr": {"column": "l_tax", "op": "/", "value": 0}},
    {
        "table": "LINEITEM",
        "type": "or",
        "conditions": [
            {"type": "lt", "column": "l_quantity", "value": 10},
            {"type": "and", "conditions": [{"type": "gt", "column": "o_totalprice", "join": _TO_ORDER, "value": 150000}, {"type": "eq", "column": "l_linestatus", "value": "O"}]},
        ],
    },
    {"table": "ORDERS", "type": "gt", "column": "o_orderstatus", "value": 5},
    {"table": "ORDERS", "type": "neq", "column": "o_orderstatus", "value": 5},
    {"table": "ORDERS", "type": "gte", "column": "o_orderdate", "value": "1995-01-01"},
    {"table": "ORDERS", "type": "and", "conditions": [{"type": "gt", "column": "o_totalprice", "value": 200000}, {"type": "eq", "column": "o_nothing", "value": 1}]},
    {"table": "NOWHERE", "type": "range", "column": "x", "min": 0},
    {"table": "EVENTS", "type": "gte", "column": "value", "rhs_column": "value", "rhs_join": _TO_FIRST, "rhs_table_ref": "EVENTS"},
    {"table": "EVENTS", "type": "ifthen", "condition": {"type": "eq", "column": "event_type", "value": "none such"}, "result": {"type": "gt", "column": "value", "value": 0}},
    {"table": "EVENTS", "type": "ifthen", "condition": {"type": "gt", "column": "value", "value": 100}, "result": {"type": "eq", "column": "event_type", "join": _TO_FIRST, "value": "purchase"}},
    {"table": "CUSTOMER", "type": "lt", "column": "n_regionkey", "join": {"from": "CUSTOMER.c_custkey", "to": "NATION.n_nationkey"}, "value": 3},
]

_LINES = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"
_ORDERS = "orders LEFT JOIN customer ON o_custkey = c_custkey"
#: The first row of each user in the order of the file.
_FIRST = "(SELECT user_id AS u, value AS v1, event_type AS t1 FROM (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY place) AS nth FROM (SELECT user_id, value, event_type, row_number() OVER () AS place FROM events)) WHERE nth = 1)"


def _rule(i: int, source: str, good: str, given: str = "true", reason: str = "NULL") -> str:
    """SQL of one verdict. good and given are SQL conditions that are null where they can't be told."""
    c = RULES[i]
    held, counted = f"CASE WHEN {given} THEN {good} END", f"({given}) AND ({good}) IS NOT NULL"
    return (
        f"SELECT {i} AS \"constraint\", '{c['table']}' AS \"table\", '{c['type']}' AS type, count(*) FILTER ({held}) AS satisfied, count(*) FILTER (NOT ({held})) AS violated, count(*) FILTER ({counted}) AS applicable, "
        f"count(*) FILTER (NOT ({given})) AS vacuous, count(*) FILTER (({given}) IS NULL OR (({given}) AND ({good}) IS NULL)) AS unevaluable, "
        f"count(*) FILTER ({held})::DOUBLE / nullif(count(*) FILTER ({counted}), 0) AS rate, {reason} AS reason FROM {source}"
    )


_VERDICTS = " UNION ALL ".join(
    [
        _rule(0, "lineitem", "l_quantity BETWEEN 5 AND 45"),
        _rule(1, _LINES, "l_shipdate >= o_orderdate"),
        _rule(2, "orders", "o_totalprice > 100000", "o_orderstatus = 'F'"),
        _rule(3, _ORDERS, "o_totalprice <= c_acctbal * 40", "c_mktsegment = 'BUILDING'"),
        _rule(4, "lineitem", "l_quantity <= l_tax / nullif(0, 0)", reason="'division by zero'"),
        _rule(5, _LINES, "CASE WHEN l_quantity < 10 THEN true WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice <= 150000 THEN false ELSE l_linestatus = 'O' END"),
        _rule(6, "orders", "NULL::BOOLEAN", reason="'text and number have no order'"),
        _rule(7, "orders", "o_orderstatus IS NOT NULL"),
        _rule(8, "orders", "o_orderdate >= TIMESTAMP '1995-01-01'"),
        _rule(9, "orders", "CASE WHEN o_totalprice > 200000 THEN NULL ELSE false END"),
        "SELECT 10, 'NOWHERE', 'range', 0, 0, 0, 0, 0, NULL, 'table NOWHERE is not there'",
        _rule(11, f"events LEFT JOIN {_FIRST} ON user_id = u", "value >= v1"),
        _rule(12, "events", "value > 0", "event_type = 'none such'"),
        _rule(13, f"events LEFT JOIN {_FIRST} ON user_id = u", "t1 = 'purchase'", "value > 100"),
        _rule(14, "customer LEFT JOIN nation ON c_custkey = n_nationkey", "n_regionkey < 3"),
    ]
)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read(spark, sf_dir, t) for t in ("LINEITEM", "ORDERS", "CUSTOMER", "EVENTS", "NATION")}


@query("rule_verdicts", _VERDICTS)
def rule_verdicts(spark, sf_dir):
    return R.verdicts(RULES, _tables(spark, sf_dir), spark)


@query(
    "rule_satisfaction",
    f"SELECT sum(satisfied)::DOUBLE / nullif(sum(applicable), 0) AS csr, count(*) AS n_constraints, count(*) FILTER (reason IS NULL AND applicable > 0) AS n_evaluated, count(*) FILTER (reason IS NULL AND applicable = 0) AS n_vacuous, "
    f"count(*) FILTER (reason IS NOT NULL) AS n_unevaluable, sum(applicable)::BIGINT AS applicable_rows, sum(violated)::BIGINT AS violated_rows FROM ({_VERDICTS})",
)
def rule_satisfaction(spark, sf_dir):
    return R.satisfaction(R.verdicts(RULES, _tables(spark, sf_dir), spark))


@query("first_of_user", f"SELECT u AS user_id, t1 AS event_type, v1 AS value FROM {_FIRST}")
def first_of_user(spark, sf_dir):
    """The first row of each user in the files."""
    return first_rows(read(spark, sf_dir, "EVENTS"), "user_id", ["event_type", "value"]).select(F.col("user_id"), "event_type", "value")


@query(
    "case_metrics",
    f"SELECT f.*, c.csr, c.n_evaluated AS csr_n_evaluated, c.n_vacuous AS csr_n_vacuous, c.n_unevaluable AS csr_n_unevaluable, c.applicable_rows AS csr_applicable_rows, c.violated_rows AS csr_violated_rows FROM ({base.ORACLE_SQL['score_report']}) f, ({ORACLE_SQL['rule_satisfaction']}) c",
)
def case_metrics(spark, sf_dir):
    """What the rows of the given tables are worth as data of a case: distributions and constraints in one row."""
    got = scoring.case_metrics(_tables(spark, sf_dir), {"ground_truth_distributions": base._SPECS, "ground_truth_constraints": RULES}, spark).drop("distance_kinds")
    return got.select(*(F.round(c, 6).alias(c) if c in ("mre", "nll", "distance", "plausibility_rate") else F.col(c) for c in got.columns))
