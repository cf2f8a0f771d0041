import math

import pytest

from relspan.functions import special
from relspan.operators import distributions as D
from relspan.operators import satisfy as K
from relspan.plans import conflicts, sql
from relspan.plans.catalog import TESTDATA, Catalog, ForeignKey, _table
from relspan.plans.relation import Base, Col, Fanout, Filter, Join, Project, Refused, compiled, known
from tests.test_listings import _ACCEPTED, _REFUSED

SHOP = Catalog({t.name: t for t in (_table("CUSTOMER", "id", "id:INTEGER region:VARCHAR"), _table("ORDERING", "order_id", "order_id:INTEGER customer_id:INTEGER:True total:FLOAT"))}, [ForeignKey("ORDERING", "customer_id", "CUSTOMER")])


def test_catalogs():
    assert TESTDATA.errors() == []
    bad = Catalog({"Bad": _table("Bad", "x", "x:FLOAT Y:THING")}, [ForeignKey("Bad", "x", "NONE")])
    assert len(bad.errors()) == 5


@pytest.mark.parametrize("text", _REFUSED)
def test_refusals(text):
    tree, errors = sql.try_parse(text)
    assert tree is None and errors


@pytest.mark.parametrize("text", _ACCEPTED)
def test_round_trips(text):
    assert sql.parse(sql.to_sql(sql.parse(text))) == sql.parse(text)


def test_joins_keep_children_and_nullability(spark):
    frames = {"CUSTOMER": spark.createDataFrame([(1, "N"), (2, "S")], "id long, region string"), "ORDERING": spark.createDataFrame([(10, 1, 5.0), (11, None, 7.0), (12, 1, 1.0)], "order_id long, customer_id long, total double")}
    a = Join(Base("ORDERING"), Base("CUSTOMER"), ("ORDERING", "customer_id"), ("CUSTOMER", "id"))
    b = Join(Base("CUSTOMER"), Base("ORDERING"), ("CUSTOMER", "id"), ("ORDERING", "customer_id"))
    for j in (a, b):
        k = known(j, SHOP)
        assert k.key == ("order_id",) and k.nullable["region"]
        got = {(r.order_id, r.region) for r in compiled(j, SHOP, frames.__getitem__).collect()}
        assert got == {(10, "N"), (11, None), (12, "N")}
    narrowed = known(Filter(a, sql.parse("SELECT * FROM T WHERE customer_id = 1").where), SHOP)
    assert not narrowed.nullable["customer_id"]
    fan = compiled(Fanout(Base("CUSTOMER"), Base("ORDERING"), "customer_id"), SHOP, frames.__getitem__)
    assert {(r.id, r.child_count) for r in fan.collect()} == {(1, 2), (2, 0)}
    plan = compiled(sql.parse("SELECT COUNT(*) AS n FROM ORDERING JOIN CUSTOMER ON ORDERING.customer_id = CUSTOMER.id"), SHOP, frames.__getitem__)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_illegal_relations():
    twice = Join(Join(Base("ORDERING"), Base("CUSTOMER"), ("ORDERING", "customer_id"), ("CUSTOMER", "id")), Base("ORDERING", "o2"), ("CUSTOMER", "id"), ("o2", "customer_id"))
    for bad in (twice, Project(Base("CUSTOMER"), ((Col("region"), "region"),)), Base("NOWHERE"), Filter(Base("CUSTOMER"), sql.parse("SELECT * FROM T WHERE region > 3").where), sql.parse("SELECT AVG(region) AS a FROM CUSTOMER")):
        with pytest.raises(Refused):
            known(bad, SHOP)


def test_short_circuits(spark):
    rows = spark.createDataFrame([(None, False), (False, None), (None, True), (True, None)], "a boolean, b boolean")
    parts = [{"op": "eq", "column": c, "value": True} for c in "ab"]
    got = {(r.a, r.b): (r.x, r.y) for r in rows.select("a", "b", K.holds({"op": "and", "conditions": parts}, rows).alias("x"), K.holds({"op": "or", "conditions": parts}, rows).alias("y")).collect()}
    assert got == {(None, False): (None, None), (False, None): (False, None), (None, True): (None, None), (True, None): (None, True)}


def test_verdicts(spark):
    rows = spark.createDataFrame([(i, float(i % 10), "F" if i % 2 else "O") for i in range(50)] + [(99, None, None)], "id long, x double, s string")
    got = {r.constraint: r for r in K.verdicts(rows, {"r": {"op": "range", "column": "x", "min": 2, "max": None}, "i": {"op": "ifthen", "if": {"op": "eq", "column": "s", "value": "F"}, "then": {"op": "gt", "column": "x", "value": 2}}, "n": {"op": "not", "condition": {"op": "eq", "column": "nowhere", "value": 1}}}).collect()}
    assert (got["r"].satisfied, got["r"].violated, got["r"].unevaluable, got["r"].rate) == (40, 10, 1, 0.8)
    assert (got["i"].satisfied, got["i"].violated, got["i"].vacuous, got["i"].unevaluable) == (20, 5, 25, 1)
    assert got["n"].applicable == 0 and got["n"].rate is None and got["n"].unevaluable == 51


def test_special_functions():
    assert special.digamma(1) == pytest.approx(-0.5772156649015329) and special.trigamma(1) == pytest.approx(math.pi**2 / 6)
    assert special.zeta(2) == pytest.approx(math.pi**2 / 6) and special.zeta(1.5, 3) == pytest.approx(special.zeta(1.5) - 1 - 2**-1.5)
    assert special.gamma_cdf(1, 2) == pytest.approx(1 - math.exp(-2)) and special.gamma_cdf(3, 9) == pytest.approx(1 - math.exp(-9) * (1 + 9 + 40.5))
    assert special.beta_cdf(2, 1, 0.3) == pytest.approx(0.09) and special.beta_cdf(2, 3, 0.6) == pytest.approx(0.8208)


@pytest.mark.parametrize("family,p", [("normal", {"mean": 3.0, "std": 2.0}), ("lognormal", {"mu": 1.0, "sigma": 0.5}), ("exponential", {"rate": 0.3}), ("uniform", {"low": 2.0, "high": 9.0}), ("poisson", {"lambda": 6.0}), ("beta", {"alpha": 2.0, "beta": 5.0}), ("gamma", {"shape": 3.0, "rate": 0.5})])
def test_estimates_of_samples(spark, family, p):
    import numpy as np

    g = np.random.default_rng(5)
    draw = {"normal": lambda: g.normal(3, 2, 4000), "lognormal": lambda: g.lognormal(1, 0.5, 4000), "exponential": lambda: g.exponential(1 / 0.3, 4000), "uniform": lambda: g.uniform(2, 9, 4000), "poisson": lambda: g.poisson(6, 4000), "beta": lambda: g.beta(2, 5, 4000), "gamma": lambda: g.gamma(3, 2, 4000)}[family]()
    rows = spark.createDataFrame([(float(x),) for x in draw] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    found = D.estimate(family, D.summarize(rows, ["x"])["x"])
    assert all(found[k] == pytest.approx(v, rel=0.1) for k, v in p.items())
    assert D.ks(rows, "x", family, found).first()[0] < 0.03
    assert D.cdf(family, p, 1e9) == pytest.approx(1)


def test_labels_and_specs(spark):
    rows = spark.createDataFrame([("1",), ("1.0",), ("1.5",), ("BRONZE",), (None,), ("NaN",)], "v string")
    assert sorted((r.label, round(r.share, 2)) for r in D.pmf(rows, "v").collect()) == [("1", 0.5), ("1.5", 0.25), ("BRONZE", 0.25)]
    assert D.parse_spec({"family": "LOG_NORMAL", "params": {"mean": 1, "variance": 4}}) == ("lognormal", {"mu": 1, "sigma": 2.0})
    assert D.parse_spec({"distribution": "exponential", "params": {"lambda": 3}}) == ("exponential", {"rate": 3})
    assert D.mre({"a": 2.0}, {"a": 1.0, "b": 5}) == 1.0 and D.mre({}, {"a": 1}) is None


def test_conflicts():
    assert conflicts.moment_conflicts([("t.x", "MEAN", ">", 5), ("t.x", "MEAN", "<", 4)]) and not conflicts.moment_conflicts([("t.x", "MEAN", ">", 5), ("t.y", "MEAN", "<", 4)])
    assert conflicts.moment_conflicts([("t.x", "STDDEV", "=", 3), ("t.x", "VARIANCE", "=", 8)])
    pairs = {("a", "b"): [0.9], ("b", "c"): [0.9], ("a", "c"): [-0.9]}
    assert len(conflicts.correlation_conflicts(pairs)) == 1 and not conflicts.correlation_conflicts(pairs | {("a", "c"): [0.7]})
    ring = {("x", "y"), ("y", "z"), ("z", "x")}
    assert conflicts.state_conflicts(ring, set(), True)[0].kind == "cycle" and not conflicts.state_conflicts(ring, set(), False)
    assert len(conflicts.family_conflicts([("t", "normal", {"mean": 1.0}), ("t", "normal", {"mean": 2.0}), ("t", "beta", {})])) == 2
    assert conflicts.groups([("a", "b"), ("c", "d"), ("b", "e")]) == [{"a", "b", "e"}, {"c", "d"}]
