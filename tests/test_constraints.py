"""Stated constraints and their conflicts, scores of columns, lookups, and what follows from a whole text."""

import math
import random

import numpy as np
import pytest

from relspan.functions.search import prefix_sums
from relspan.operators import distributions as D
from relspan.operators import satisfy, scoring, text
from relspan.plans import audit, conflicts
from relspan.plans.catalog import TESTDATA, Catalog, Column, ForeignKey, Table
from relspan.plans.constraints import KINDS, Correlated, Distributed, Grain, StateSequence, Stated, comparable, evaluate, faults, grain, population, softenable
from relspan.plans.relation import Aggregate, Base, Both, Col, Compare, Fanout, Filter, Join, Lit, Negated, Refused, compiled

ORDERS, PRICE = Base("ORDERS"), "o_totalprice"
OPEN = Compare("=", Col("o_orderstatus"), Lit("O"))


def moments(relation, mean=None, variance=None):
    out = []
    for fn, v in (("AVG", mean), ("VARIANCE", variance)):
        if v is not None:
            out.append(Stated(Aggregate(relation, fn, PRICE, "m"), Compare("=", Col("m"), Lit(v)), (f"{fn} {v}",)))
    return out


def kinds(*stated):
    r = evaluate(list(stated), TESTDATA)
    assert not r.unsupported, r.unsupported
    assert all(c.kind in KINDS for c in r.conflicts)
    return sorted(c.kind for c in r.conflicts)


def test_distributions_conflict():
    normal = Stated(ORDERS, Distributed(PRICE, "normal", (("mean", 5.0), ("std", 1.0))), ("a",))
    assert kinds(normal, Stated(ORDERS, Distributed(PRICE, "uniform"))) == ["distributed_family_mismatch"]
    assert kinds(normal, Stated(ORDERS, Distributed(PRICE, "normal", (("std", 2.0),)))) == ["distributed_parameter_mismatch"]
    assert kinds(normal, Stated(ORDERS, Distributed(PRICE, "normal", (("std", 1.0 + 1e-8),)))) == []
    assert kinds(normal, Stated(Filter(ORDERS, OPEN), Distributed(PRICE, "uniform"))) == []  # other rows
    one = Distributed("o_orderstatus", "categorical", (("categories", ("F", "O")), ("probabilities", (0.4, 0.6))))
    two = Distributed("o_orderstatus", "categorical", (("categories", ("O", "F")), ("probabilities", (0.6, 0.4))))
    assert kinds(Stated(ORDERS, one), Stated(ORDERS, two)) == []
    found = evaluate([normal, Stated(ORDERS, Distributed(PRICE, "uniform"), ("b",))], TESTDATA).conflicts[0]
    assert found.facts == ("a", "b") and found.softenable


def test_moments_and_distributions_conflict():
    assert kinds(*moments(ORDERS, 5.0), *moments(ORDERS, 6.0)) == ["moment_value_mismatch"]
    assert kinds(*moments(ORDERS, 5.0), *moments(Filter(ORDERS, OPEN), 6.0)) == []
    normal = Stated(ORDERS, Distributed(PRICE, "normal", (("mean", 5.0), ("std", 3.0))))
    assert kinds(normal, *moments(ORDERS, 5.0, 9.0)) == []
    assert kinds(normal, *moments(ORDERS, 5.0, 8.0)) == ["moment_vs_distributed_mismatch"]
    above = Stated(Aggregate(ORDERS, "STDDEV", PRICE, "s"), Compare("<", Lit(4.0), Col("s")))
    assert kinds(normal, above) == ["moment_vs_distributed_mismatch"]
    assert kinds(normal, Stated(Aggregate(ORDERS, "AVG", PRICE, "s"), Compare("!=", Col("s"), Lit(5.0)))) == []
    stated = [("T.x", "MEAN", "=", 4.0)]
    assert [c.kind for c in conflicts.moment_conflicts(stated, [("T.x", "poisson", {"lambda": 3.0})])] == ["moment of distribution"]
    assert conflicts.moment_conflicts(stated, [("T.x", "poisson", {"lambda": 4.0}), ("T.x", "normal", {"mean": 1.0})]) == []


def test_law_of_total_variance():
    whole, part, rest = ORDERS, Filter(ORDERS, OPEN), Filter(ORDERS, Negated(OPEN))
    infeasible = ["population_reconciliation_infeasible"]
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.normal(3, 2, 40), rng.normal(9, 5, 70)
        of = [(float(np.mean(v)), float(np.var(v))) for v in (np.concatenate([x, y]), x, y)]
        good = [m for r, (a, b) in zip((whole, part, rest), of, strict=True) for m in moments(r, a, b)]
        assert kinds(*good) == []
        wrong = moments(whole, of[0][0], of[0][1] * 1.1) + good[2:]
        assert kinds(*wrong) == infeasible
        assert kinds(*moments(whole, 20.0), *moments(part, of[1][0]), *moments(rest, of[2][0])) == infeasible
    assert kinds(*moments(whole, 5.0, 0.0), *moments(part, 6.0, 1.0)) == infeasible
    assert kinds(*moments(whole, 5.0, 0.0), *moments(part, 5.0, 0.0)) == []
    assert kinds(*moments(whole, 5.0, 0.1), *moments(part, 500.0, 1.0)) == []  # a small enough part


def test_correlations_states_and_faults():
    c = lambda *p, **k: Stated(Base("LINEITEM"), Correlated(tuple(p), **k))
    q, e, d, t = "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    assert kinds(c((q, e, 0.5)), c((e, q, 0.6))) == ["correlated_value_mismatch"]
    assert kinds(c((q, e, 0.9), (e, d, 0.9), (q, d, -0.9))) == ["correlated_infeasible_matrix"]
    assert kinds(c((q, e, 0.5), copula="student_t", nu=1.5)) == ["correlated_precondition_violation"]
    assert len(evaluate([c((q, e, 0.1), (e, d, 0.1), (d, t, 0.1), (t, q, 0.1))], TESTDATA).unsupported) == 1
    assert conflicts.unchorded({("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c")}) == []
    s = lambda **k: Stated(ORDERS, StateSequence("o_orderstatus", **k))
    assert kinds(s(allowed=(("O", "F"),)), s(forbidden=(("O", "F"),))) == ["state_sequence_direct_contradiction"]
    assert kinds(s(allowed=(("O", "F"),)), s(allowed=(("F", "O"),), strict=True)) == ["state_sequence_cycle"]
    assert kinds(s(allowed=(("O", "F"), ("F", "O")))) == []
    wrong = lambda condition, relation=ORDERS: faults(Stated(relation, condition), TESTDATA)
    assert wrong(Distributed("o_orderstatus", "normal")) and wrong(Distributed("nothing", "normal")) == ["no column nothing"]
    assert wrong(Distributed(PRICE, "normal", (("std", -1),))) == ["std must be positive"]
    assert wrong(Both((OPEN, Distributed(PRICE, "normal")))) == ["Distributed stands alone"]
    assert wrong(OPEN, Base("X"))[0].startswith("relation") and wrong(Compare("=", Col("x"), Lit(1)))[0].startswith("condition")
    fan = Fanout(Base("CUSTOMER"), ORDERS, "o_custkey")
    assert wrong(Compare(">=", Col("child_count"), Lit(0)), fan) and not wrong(Compare(">=", Col("child_count"), Lit(1)), fan)
    assert wrong(Compare("!=", Col("n"), Lit(-1)), Aggregate(ORDERS, "COUNT", "*", "n"))
    assert softenable(moments(ORDERS, 1.0)[0]) and not softenable(Stated(ORDERS, OPEN)) and not softenable(s(allowed=(("a", "b"),)))


def test_populations_and_grains():
    narrow = Filter(ORDERS, OPEN)
    assert population(narrow, TESTDATA).filters == {OPEN} and population(ORDERS, TESTDATA).lineage == population(narrow, TESTDATA).lineage
    a, b = population(ORDERS, TESTDATA), population(narrow, TESTDATA)
    assert comparable(a, b, OPEN) and not comparable(a, b, Distributed(PRICE, "normal"))
    assert not comparable(a, population(Base("PART"), TESTDATA), OPEN)
    joined = Join(ORDERS, Base("CUSTOMER"), ("ORDERS", "o_custkey"), ("CUSTOMER", "c_custkey"))
    assert population(joined, TESTDATA).table == "ORDERS"
    assert grain(Aggregate(ORDERS, "SUM", PRICE, "s", ("o_custkey",)), TESTDATA) == Grain("CUSTOMER", ("c_custkey",), "rows", ("o_custkey", "s"))
    assert grain(Aggregate(ORDERS, "SUM", PRICE, "s", ("o_orderkey",)), TESTDATA).table == "ORDERS"
    assert grain(Aggregate(ORDERS, "MODE", PRICE, "s", ("o_custkey",)), TESTDATA).kind == "groups"
    assert grain(Aggregate(ORDERS, "SUM", PRICE, "s"), TESTDATA).kind == "one"
    loose = Catalog({"P": Table("P", (Column("id", "INTEGER"),), ("id",)), "C": Table("C", (Column("id", "INTEGER"), Column("p_id", "INTEGER", True)), ("id",))}, [ForeignKey("C", "p_id", "P")])
    assert "p_id.is_present" in grain(Base("C"), loose).columns


def test_a_table_joins_itself_under_an_alias(spark):
    staff = Catalog({"STAFF": Table("STAFF", (Column("id", "INTEGER"), Column("boss", "INTEGER", True), Column("pay", "INTEGER")), ("id",))}, [ForeignKey("STAFF", "boss", "STAFF")])
    rows = spark.createDataFrame([(1, None, 9), (2, 1, 5), (3, 2, 7)], "id long, boss long, pay long")
    tree = Join(Base("STAFF"), Base("STAFF", "b"), ("STAFF", "boss"), ("b", "id"))
    out = compiled(tree, staff, lambda _: rows)
    assert sorted((r["id"], r["b.id"], r["b.pay"]) for r in out.collect()) == [(1, None, None), (2, 1, 9), (3, 2, 5)]
    more = compiled(Filter(tree, Compare(">", Col("b.pay"), Lit(6))), staff, lambda _: rows)
    assert [r["id"] for r in more.collect()] == [2]
    with pytest.raises(Refused):
        compiled(Join(Base("STAFF"), Base("STAFF"), ("STAFF", "boss"), ("STAFF", "id")), staff, lambda _: rows)


def test_lookups_on_both_sides_take_the_first_row(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5)], "k long, v long")
    other = spark.createDataFrame([(1, 9, 2), (1, 3, 1), (2, None, 1), (2, 4, 2), (3, 1, 1)], "k long, limit long, at long").coalesce(1)
    j = {"table": "T", "fk": "k", "key": "k"}
    tests = {
        "read": {"op": "lt", "column": "v", "rhs_column": "limit", "rhs_join": j},
        "ordered": {"op": "lt", "column": "v", "rhs_column": "limit", "rhs_join": j | {"order": ["at"]}},
        "left": {"op": "gt", "column": "limit", "lhs_join": j, "rhs_column": "v"},
    }
    want = {"read": (1, 1, 2), "ordered": (0, 2, 2), "left": (1, 1, 2)}
    for name, c in tests.items():  # a null in the first row, and no row at all
        r = satisfy.verdicts(rows, {name: c}, lambda _: other).first()
        assert (r.satisfied, r.violated, r.unevaluable) == want[name], name


def test_log_densities_and_prefix_sums(spark):
    points = [-3.0, 0.0, 0.3, 0.5, 1.0, 2.0, 2.5, 7.0, 40.0, 1000.0]
    rows = spark.createDataFrame([(x,) for x in points], "x double")
    families = {"normal": {"mean": 1.0, "std": 2.0}, "lognormal": {"mu": 0.3, "sigma": 0.7}, "poisson": {"lambda": 4.5}, "zipf": {"a": 1.7}, "exponential": {"rate": 0.2}, "uniform": {"low": 0.0, "high": 7.0}, "beta": {"alpha": 2.0, "beta": 0.7}, "gamma": {"shape": 1.4, "rate": 0.3}}
    got = rows.select("x", *(D.log_densities(f, p).alias(f) for f, p in families.items())).collect()
    for r in got:
        for f, p in families.items():
            want = D.log_density(f, p, r.x)
            assert r[f] == want or r[f] == pytest.approx(want, rel=1e-9, abs=1e-9), (f, r.x)
    rng = random.Random(1)
    values = {rng.randint(0, 10**6): rng.randint(1, 9) for _ in range(500)}
    out, total = prefix_sums(spark.createDataFrame(list(values.items()), "x long, n long").withColumn("x", D.clean(D.F.col("x"))), "x", "n")
    assert total == sum(values.values())
    for r in out.collect():
        assert r.upto == sum(n for x, n in values.items() if x <= r.x)


def test_labels_are_plain_numbers(spark):
    rows = spark.createDataFrame([("1.0",), ("1.5",), ("0.00025",), ("12345678.25",), ("a",), (None,), ("1e3",)], "s string")
    assert [r[0] for r in rows.select(D.label(D.F.col("s"))).collect()] == ["1", "1.5", "0.00025", "12345678.25", "a", None, "1000"]


def test_scores(spark):
    rows = spark.createDataFrame([(float(x), "ab"[x % 2]) for x in range(1, 11)], "x double, s string")
    free = {"family": "uniform", "params": {"min": 1, "max": 20}, "scoring": {"max": {"tier": "free"}}, "free_params": {"max": {"min": 9, "max": 11}, "min": {"min": 2, "max": 3}}}
    s = scoring.score_column(rows, "x", free)
    assert s == {"mre": 0.0, "nll": None, "distance": None, "kind": scoring.UNSCOREABLE, "band_applicable": 2, "band_satisfied": 1}
    s = scoring.score_column(rows, "x", {"family": "uniform", "params": {"min": 0, "max": 10}})
    assert s["mre"] == pytest.approx(0.5) and s["nll"] == pytest.approx(1.0) and s["distance"] == pytest.approx(0.1)
    lognormal = {"family": "lognormal", "params": {"mean": 1.0, "variance": 1.0}, "free_params": {"variance": {"min": 0.0, "max": 0.6}}}
    sigma = np.std(np.log(np.arange(1, 11)), ddof=1)
    assert scoring.score_column(rows, "x", lognormal)["band_satisfied"] == int(sigma**2 <= 0.6)
    s = scoring.score_column(rows, "s", {"family": "categorical", "params": {"weights": {"a": 3, "b": 1}}})
    assert (s["kind"], s["distance"]) == ("tvd", pytest.approx(0.25)) and s["nll"] == pytest.approx(math.sqrt(0.75 * 0.25) / 0.75)
    assert scoring.score_column(rows, "s", {"family": "categorical", "params": {}}) == scoring.WORST
    assert scoring.score_column(rows.limit(1), "x", {"family": "normal", "params": {"mean": 0, "std": 1}}) == scoring.WORST
    assert scoring.case_report(scoring.score_case({}, {}, rows.sparkSession)).first()["mre"] == 1.0
    report = scoring.case_report(scoring.score_case({"T": rows}, {"T.x (part)": free, "T.y": free, "x": free}, rows.sparkSession)).first().asDict()
    assert (report["n_missing"], report["n_unscoreable"], report["plausibility_rate"]) == (2, 1, 0.5)
    assert report["distance_kinds"] == {"none": 2, scoring.UNSCOREABLE: 1}


def test_verbatim_is_contains(spark):
    rng = random.Random(6)
    said = ["".join(rng.choice(["ab", "c", " ", " d", "\n", "e e"]) for _ in range(rng.randint(0, 200))) for _ in range(60)] + [None, "", " "]
    asked = [t[i : i + n] for t in said[:60:5] if t for i, n in [(rng.randint(0, len(t)), rng.randint(0, 40))]] + ["zz yy xx ww", "", None, "a"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    got = [tuple(r) for r in text.verbatim(docs, items).collect()]
    want = {(i, j) for i, t in enumerate(said) for j, x in enumerate(asked) if t and x and x in t}
    assert set(got) == want and len(got) == len(want)
    assert text.verbatim(docs.limit(0), items).count() == text.verbatim(docs, items.limit(0)).count() == 0


def test_mentions_in_any_number(spark):
    texts = spark.createDataFrame([(1, "Boxes of Glass and cities"), (2, "a box; the glasses"), (3, None), (4, "class bus")], "id long, text string")
    names = spark.createDataFrame([("GLASS_BOXES",), ("CITY",), ("BUS_CLASSES",)], "name string")
    assert {tuple(r) for r in audit.mentions(texts, "id", "text", names).collect()} == {(1, "GLASS_BOXES"), (1, "CITY"), (2, "GLASS_BOXES"), (4, "BUS_CLASSES")}
