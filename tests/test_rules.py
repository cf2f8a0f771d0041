"""Constraints of cases against a plain reading of them, row by row, with odd rows."""

import operator
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from relspan.operators import rules
from relspan.sources.positions import first_rows


class Untold(Exception):
    pass


OPS = {"eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def operand(name, join, table, row, tables):
    if join:
        of = table or join["to"].split(".")[0]
        match = [r for r in tables[of] if r[join["to"].split(".")[1]] == row[join["from"].split(".")[1]]]
        if not match:
            raise Untold
        row = match[0]
    if name not in row:
        raise Untold
    return row[name]


def holds(c, row, tables):
    if c["type"] == "and":
        return all(holds(p, row, tables) for p in c["conditions"])
    if c["type"] == "or":
        return any(holds(p, row, tables) for p in c["conditions"])
    left = operand(c["column"], c.get("join"), c.get("table_ref"), row, tables)
    if c["type"] == "range":
        if left is None:
            raise Untold
        return (c.get("min") is None or left >= c["min"]) and (c.get("max") is None or left <= c["max"])
    if "rhs_expr" in c:
        e = c["rhs_expr"]
        right = operand(e["column"], e.get("join"), e.get("table_ref"), row, tables)
        if right is None or (e.get("op") == "/" and not e["value"]):
            raise Untold
        right = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}[e["op"]](right, e["value"]) if e.get("op") else right
    elif "value" in c:
        right = c["value"]
    else:
        right = operand(c["rhs_column"], c.get("rhs_join"), c.get("rhs_table_ref"), row, tables)
    if left is None or right is None:
        raise Untold
    if isinstance(left, str) != isinstance(right, str) and c["type"] not in ("eq", "neq"):
        raise Untold
    return OPS[c["type"]](left, right)


def plain(c, tables):
    s = v = n = u = 0
    for row in tables[c["table"]]:
        try:
            if c["type"] == "ifthen":
                if not holds(c["condition"], row, tables):
                    n += 1
                    continue
                ok = holds(c["result"], row, tables)
            else:
                ok = holds(c, row, tables)
            s, v = s + ok, v + (not ok)
        except Untold:
            u += 1
    return s, v, n, u


def random_predicate(rng, depth):
    if depth and rng.random() < 0.5:
        return {"type": rng.choice(["and", "or"]), "conditions": [random_predicate(rng, depth - 1) for _ in range(rng.randint(0, 3))]}
    join = {"from": "CHILD.ref", "to": "PARENT.id"}
    side = {"join": join, "table_ref": "PARENT"} if rng.random() < 0.3 else {}
    name = rng.choice(["x", "y", "name", "gone"] if not side else ["x", "w", "gone"])
    kind = rng.choice([*OPS, "range"])
    if kind == "range":
        return {"type": "range", "column": rng.choice(["x", "y"]), **rng.choice([{}, {"min": 2}, {"max": 6, "min": None}, {"min": 2, "max": 6}])}
    right = rng.choice([{"value": rng.randint(0, 9)}, {"value": "b"}, {"value": None}, {"rhs_column": "y"}, {"rhs_column": "x", "rhs_join": join, "rhs_table_ref": "PARENT"}, {"rhs_expr": {"column": "y", "op": rng.choice("+-*/"), "value": rng.choice([0, 2, 1.5])}}, {"rhs_expr": {"column": "x", "join": join, "op": None}}])
    return {"type": kind, "column": name, **side, **right}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, at = random.Random(5), tmp_path_factory.mktemp("rules")
    child = [{"ref": rng.choice([None, 1, 2, 3, 4, 99]), "x": rng.choice([None, *range(9)]), "y": rng.choice([None, *range(9)]), "name": rng.choice([None, "a", "b", "c"])} for _ in range(400)]
    parent = [{"id": rng.choice([None, 1, 2, 3, 4]), "x": rng.choice([None, *range(9)]), "w": rng.choice([None, 1.5, 2.5])} for _ in range(60)]
    for name, rows, kind in (("CHILD", child, [("ref", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("name", pa.string())]), ("PARENT", parent, [("id", pa.int64()), ("x", pa.int64()), ("w", pa.float64())])):
        (at / name).mkdir()
        for i in range(3):  # files in order, with keys that repeat across them
            part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
            pq.write_table(pa.Table.from_pylist(part, pa.schema(kind)), at / name / f"part-{i}.parquet", row_group_size=7)
    return {"CHILD": child, "PARENT": parent}, {t: spark.read.parquet(str(at / t)) for t in ("CHILD", "PARENT")}


@pytest.mark.parametrize("bytes_", ["200", "128m"])
def test_verdicts_are_a_plain_reading(spark, tables, bytes_):
    rng = random.Random(77)
    stated = [{"table": "CHILD", **random_predicate(rng, 2)} for _ in range(30)]
    stated += [{"table": "CHILD", "type": "ifthen", "condition": random_predicate(rng, 1), "result": random_predicate(rng, 1)} for _ in range(25)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
    try:
        got = {r.constraint: r for r in rules.verdicts(stated, tables[1], spark).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for i, c in enumerate(stated):
        s, v, n, u = plain(c, tables[0])
        r = got[i]
        assert (r.satisfied, r.violated, r.vacuous, r.unevaluable, r.applicable) == (s, v, n, u, s + v), c
        assert r.rate == (s / (s + v) if s + v else None) and (r.reason is not None) == (s + v == 0 and u > 0)


def test_one_aggregate_and_one_join_a_lookup(spark, tables):
    join = {"from": "CHILD.ref", "to": "PARENT.id"}
    stated = [{"table": "CHILD", "type": "gt", "column": "x", "rhs_column": c, "rhs_join": join, "rhs_table_ref": "PARENT"} for c in ("x", "w", "x")]
    plan = rules.verdicts(stated, tables[1], spark)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and plan.count("Relation [") == 2


def test_reasons(spark, tables):
    stated = [{"type": "range"}, {"table": "GONE", "type": "range"}, {"table": "CHILD", "type": "like", "column": "x"}, {"table": "CHILD", "type": "gt", "column": "name", "value": 1}, {"table": "CHILD", "type": "eq", "column": "x"}, {"table": "CHILD", "type": "lt", "column": "x", "rhs_expr": {"column": "x", "op": "^", "value": 1}}]
    stated += [{"table": "CHILD", "type": "eq", "column": "x", "join": {"from": "CHILD.ref", "to": "id"}, "value": 1}, {"table": "CHILD", "type": "eq", "column": "x", "join": {"from": "CHILD.ref", "to": "PARENT.no"}, "value": 1}, {"table": "CHILD", "type": "eq", "column": "x", "join": {"from": "CHILD.no", "to": "PARENT.id"}, "value": 1}]
    got = {r.constraint: r.reason for r in rules.verdicts(stated, tables[1], spark).collect()}
    assert [got[i] for i in range(3)] == ["the constraint names no table", "table GONE is not there", "no predicate type like"]
    assert got[4] == "the predicate has no right side" and got[5] == "no arithmetic operator ^" and got[6] == "the join to id names no table" and got[7] == "join key PARENT.no is no column" and got[8] == "join column no is not on the row"
    assert got[3] in ("text and number have no order", "comparison with a null")
    one = rules.satisfaction(rules.verdicts(stated, tables[1], spark)).first()
    assert one.csr is None and one.n_constraints == 9 and one.n_unevaluable == 9 and one.applicable_rows == 0
    assert rules.satisfaction(rules.verdicts([], tables[1], spark)).first().csr is None


def test_texts_are_read_as_times_and_empty_tables(spark):
    rows = spark.sql("SELECT DATE '2020-01-05' AS d, TIMESTAMP '2020-01-05 10:00:00' AS t")
    stated = [{"table": "A", "type": "gt", "column": "d", "value": "2020-01-04"}, {"table": "A", "type": "gte", "column": "t", "rhs_column": "d"}, {"table": "A", "type": "lt", "column": "d", "value": "soon"}]
    got = {r.constraint: r for r in rules.verdicts(stated, {"A": rows}, spark).collect()}
    assert got[0].satisfied == got[1].satisfied == 1 and got[2].reason == "a text is no time"
    none = {r.constraint: r for r in rules.verdicts(stated, {"A": rows.limit(0)}, spark).collect()}
    assert all(r.applicable == 0 and r.reason is None for r in none.values())


def test_first_rows_of_files(spark, tables):
    got = {r.id: (r.x, r.w) for r in first_rows(tables[1]["PARENT"], "id", ["x", "w"]).collect()}
    want = {}
    for r in tables[0]["PARENT"]:
        want.setdefault(r["id"], (r["x"], r["w"]))
    assert got == want


def test_parse():
    assert rules.parse(['{"id": 1, "ground_truth_constraints": [{"type": "range"}]}', "", '{"type": "eq"}']) == [{"type": "range"}, {"type": "eq"}]
