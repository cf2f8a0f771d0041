"""Divisions of catalogs against all divisions of small ones, and loops of work."""

import random
from itertools import combinations

import pytest

from relspan.plans import orchestrate, sharding
from relspan.plans.catalog import TESTDATA, Catalog, Column, Table
from relspan.plans.sharding import Problem, Weights, closed, divide

FACTS = {
    "a": {("ORDERS", "o_totalprice"), ("CUSTOMER", "c_acctbal")},
    "b": {("LINEITEM", "l_quantity"), ("PART", "p_size")},
    "c": {("PART", "p_brand")},
    "d": {("SUPPLIER", "s_acctbal"), ("NATION", "n_name")},
    "e": {("REGION", "r_name"), ("EVENTS", "value")},
    "none": {("NOWHERE", "x")},
}


def test_closure():
    got = closed(frozenset({("ORDERS", "o_custkey")}), TESTDATA)
    assert got == {("ORDERS", "o_custkey"), ("ORDERS", "o_orderkey"), ("CUSTOMER", "c_custkey")}


def test_divisions_keep_the_hard_rules():
    rng = random.Random(3)
    cells = sorted({(t.name, x.name) for t in TESTDATA.tables.values() for x in t.columns})
    for _ in range(25):
        facts = {str(i): set(rng.sample(cells, rng.randint(1, 3))) for i in range(rng.randint(1, 7))}
        w = Weights(*(rng.choice(sharding.GRID) for _ in range(4)))
        p = Problem(TESTDATA, facts, 8, 5)
        assert p.faults(divide(TESTDATA, facts, w, 8, 5)) == []
    assert sharding.orphans(divide(TESTDATA, FACTS), FACTS)["none"] == 0
    with pytest.raises(ValueError):
        divide(TESTDATA, FACTS, capacity=1)


def test_costs_are_near_the_best_of_all():
    """Four tables without links: every way to put the facts together."""
    c = Catalog({n: Table(n, (Column("k", "INTEGER"), Column("v", "FLOAT")), ("k",)) for n in "ABCD"})
    facts = {"x": {("A", "v"), ("B", "v")}, "y": {("B", "v"), ("C", "v")}, "z": {("D", "v")}}
    base = [closed(frozenset(f), c) for f in facts.values()]
    ways = [[base[0], base[1], base[2]], [base[0] | base[1] | base[2]]] + [[base[i] | base[j], base[3 - i - j]] for i, j in combinations(range(3), 2)]
    ways = [[s for s in w if not any(s < t for t in w)] for w in ways]
    for size in sharding.GRID:
        for n in sharding.GRID:
            w = Weights(size, n, 1.0, 1.0)
            p = Problem(c, facts, 8, 6)
            assert p.cost(divide(c, facts, w), w) <= min(p.cost(x, w) for x in ways) + 1e-9


def test_sweep(spark):
    found = sharding.sweep(spark, TESTDATA, FACTS, grid=(0.1, 30.0)).collect()
    assert sum(r.n for r in found) == 8 and all(r.structure for r in found)
    best = max(found, key=lambda r: (r.n, [-ord(x) for x in r.structure]))
    assert sharding.stable(spark, TESTDATA, FACTS, grid=(0.1, 30.0)) == best.structure
    assert sharding.stable(spark, TESTDATA, FACTS, grid=(1.0,), capacity=1) is None


def test_loops():
    def work(state):
        if state == 2:
            raise RuntimeError("odd")
        return state + 1, ["x"] * (5 - state)

    nodes = {"a": orchestrate.Node(work, lambda s, i: "a" if i else None, "b"), "b": orchestrate.Node(lambda s: (s + 1, []), lambda s, i: "a")}
    out = orchestrate.loop(nodes, "a", 0, 20)
    assert (out.state, out.ended, len(out.errors)) == (6, "done", 1)
    assert orchestrate.loop(nodes, "a", 0, 2).ended == "budget"
    bad = {"a": orchestrate.Node(lambda s: 1 / 0, lambda s, i: None, "a")}
    out = orchestrate.loop(bad, "a", 0, 20)
    assert (out.ended, out.rounds) == ("failing", 3)
    assert [r for r, _ in orchestrate.each([1, 0, 2], lambda x: 6 // x)] == [6, None, 3]


def test_budgets_and_reports():
    b = orchestrate.Budget(["a", "b", "c"], 4)
    assert b.take("a") and b.left["a"] == 3
    b.done("a")
    assert b.left == {"a": 0, "b": 6, "c": 5} and not b.take("a")
    assert orchestrate.again({1, 2, 3}, {1, 2}) and not orchestrate.again({1, 2, 3, 4}, {1, 2, 3}) and not orchestrate.again(set(), set())
    r = orchestrate.lost({"s": (1, None), "t": (None, "E")}, {"s": {"f"}, "t": {"f", "g"}})
    assert r == {"failed": {"t": "E"}, "lost_facts": ["g"], "complete": False, "feasible": True}
    assert orchestrate.Switches.of({"budget": 5}).budget == 5
    with pytest.raises(ValueError):
        orchestrate.Switches.of({"odd": 1})
