"""Findings about cases beside those of the registered query: lines, ids, parts that are missing, and deep trees."""

import json
import re

from relspan import case_queries
from relspan.plans import case_checks


def case(**changes):
    return {**case_queries.GOOD, "id": 1, **changes}


def test_cases_of_all_kinds(spark):
    bare = {k: v for k, v in case().items() if k not in ("functional_dependencies", "ground_truth_moments")}
    node = {"type": "eq", "column": "gone", "value": 1}
    for _ in range(3):
        node = {"type": "or", "conditions": [{"type": "not", "condition": node}]}
    deep = [{"type": "ifthen", "table": "ORDERS", "condition": node, "result": {"type": "eq", "column": "id", "value": 1}}]
    without = case()
    del without["id"]
    lines = [case(), "", "  ", "{", "[1]", "7", case(id="twice"), case(id="twice"), without, {**bare, "id": 2}]
    lines += [{**bare, "id": 3, "ground_truth_distributions": None, "ground_truth_constraints": None}, {**bare, "id": 4, "ground_truth_schema": {"tables": []}, "ground_truth_distributions": 3}, {"id": 5}, case(id=6, ground_truth_constraints=deep)]
    rows = spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in lines], "value string")
    found = case_checks.validate(rows)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in found.collect():
        by.setdefault(r.case_id, []).append((r.level, r.subject, r.detail))
    assert sorted(by.pop(None)) == [("error", "line", "no JSON"), ("error", "line", "no object"), ("error", "line", "no object")]
    assert by.pop("twice") == [("error", "dataset", "id twice 2 times")] and by.pop("?") == [("error", "id", "missing")]
    assert by.pop("4") == [("error", "ground_truth_schema", "no tables")] and by.pop("6") == [("error", "constraint[0].condition", "no column ORDERS.gone")]
    assert {x[1:] for x in by.pop("5")} >= {("domain", "missing"), ("domain", "no text"), ("ground_truth_constraints", "missing"), ("ground_truth_schema", "no object")} and not by


def test_no_cases(spark):
    assert case_checks.validate(spark.createDataFrame([], "value string")).count() == 0


def test_parts_are_read_from_cases_once(spark):
    """What is left to do reads whole cases for the checks of whole cases only; parts come from tables of their own."""
    plan = case_checks.validate(spark.createDataFrame([(json.dumps(case()),)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[row#\d+L,case_id#\d+,v#\d+,tables#", plan)) <= 3
