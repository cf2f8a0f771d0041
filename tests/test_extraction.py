"""Extracted items, audits, merging and generated rows, by hand and against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspan.operators import facts as A
from relspan.operators import generate as G
from relspan.operators import satisfy as K
from relspan.operators import text as T
from relspan.operators import vectors as V
from relspan.plans import audit, extraction, merging, patches
from relspan.plans import relation as R
from relspan.plans.catalog import TESTDATA, Catalog, Column, ForeignKey, Table
from relspan.plans.conflicts import Interval


def test_forks():
    key = ("ORDERS", "o_orderstatus")
    forks = extraction.Forks([(key, ["F", "O"]), (key, ["O", "P"])])
    assert forks.branch(key, "eq", ["P"]) == ["P"] and forks.branch(key, "in", ["P", "F", "X"]) == ["F", "P"]
    assert forks.branch(key, "neq", ["O"]) == ["F", "P"] and forks.branch(key, "lt", ["O"]) is None
    assert forks.branch(("A", "b"), "neq", ["x"]) is None and forks.branch(("A", "b"), "in", ["x"]) == ["x"]


def test_variables_meet():
    item = lambda c, op, **k: {"table": "PART", "column": c, "op": op, **k}
    got = extraction.variables([item("p_size", "gt", value=3), item("p_size", "lte", value=9), item("p_retailprice", "lt", value=2.0), item("p_brand", "in", values=["a", "b"]), item("p_brand", "eq", value="b"), item("p_size", "gt", value=100, **{"if": {}})], TESTDATA)
    assert (got["PART", "p_size"].low, got["PART", "p_size"].high) == (4, 9)
    assert got["PART", "p_retailprice"].high == 2.0 - 1e-9 and got["PART", "p_brand"].categories == {"b"}
    assert extraction.variables([item("p_size", "range", min=5, max=None), item("p_size", "lt", value=5)], TESTDATA)["PART", "p_size"].empty
    with pytest.raises(patches.Refused):
        extraction.variables([item("nothing", "gt", value=3)], TESTDATA)


def test_bridged_and_derived():
    item = {"table": "ORDERS", "column": "o_totalprice", "op": "gt", "value": 1}
    assert extraction.bridged(item) == (R.Base("ORDERS"), R.Compare(">", R.Col("o_totalprice"), R.Lit(1)))
    over, _ = extraction.bridged(item | {"if": {"column": "o_orderstatus", "op": "eq", "value": "F"}})
    assert isinstance(over, R.Filter)
    net = extraction.Derived("LINEITEM", "net", R.Arith("*", R.Col("l_extendedprice"), R.Col("l_discount")), (1,))
    more = extraction.Derived("LINEITEM", "more", R.Arith("+", R.Col("net"), R.Lit(1)), (2,))
    assert net.errors(TESTDATA) == [] and more.errors(TESTDATA) == ["column net is missing"]
    assert extraction.derivation_order([more, net]) == [net, more] and more.errors(extraction.added(TESTDATA, net)) == []
    with pytest.raises(patches.Refused):
        extraction.derivation_order([extraction.Derived("A", "x", R.Col("y"), (1,)), extraction.Derived("A", "y", R.Col("x"), (1,))])
    assert patches.apply(TESTDATA, [net.patch()])[0].tables["LINEITEM"].column("net")
    assert extraction.Derived("NONE", "x", R.Lit(1), ()).errors(TESTDATA)[0] == "no fact states the derivation"


def test_cut_points():
    assert np.allclose(extraction.cut_points([1, 2, 1]), [-0.67448975, 0.67448975]) and extraction.cut_points([1]) == []
    assert extraction.cut_points([0, 1, 0]) == [-math.inf, math.inf]
    with pytest.raises(ValueError):
        extraction.cut_points([])


def test_audit():
    stated = {("ORDERS", "o_orderkey"): ("poisson", {"lambda": 3}), ("ORDERS", "o_custkey"): ("normal", {"mean": 0, "std": 1}), ("ORDERS", "o_totalprice"): ("lognormal", {"mu": 500, "sigma": 1}), ("ORDERS", "o_orderstatus"): ("zipf", {}), ("ORDERS", "x"): ("zipf", {})}
    assert [c.kind for c in audit.distribution_faults(TESTDATA, stated)] == ["distribution on key", "distribution on key", "linear mean", "type", "unknown column"]
    key = ("PART", "p_size")
    normal = {key: ("normal", {"mean": 0, "std": 1})}
    assert [c.kind for c in audit.range_faults(normal, [(key, Interval(4, 9))])] == ["outside range"]
    assert [c.kind for c in audit.range_faults(normal, [(key, Interval(0, 0.5))])] == ["wider than range"]
    assert [c.kind for c in audit.range_faults({}, [(key, Interval(0, 1)), (key, Interval(2, 3))])] == ["ranges"]
    assert audit.range_faults(normal, [(key, Interval(-5, 5))]) == [] and audit.support("normal", {"mean": "a"}) is None
    assert audit.support("categorical", {"weights": {"1": 1, "5": 2}}) == Interval(1, 5)
    assert audit.cross_column_share([{"op": "and", "conditions": [{"op": "lt", "column": "a", "rhs_column": "b"}, {"op": "range", "column": "a"}]}]) == 0.5
    assert audit.cross_column_share([]) is None
    assert audit.shape(TESTDATA) == {"tables": 8, "composite keys": 0, "self links": 0, "longest chain": 5}
    assert audit.support("exponential", {"rate": 2.0}) == audit.support("exponential", {"lambda": 2.0}) is not None
    low, high = (lambda i: (i.low, i.high))(audit.support("normal", {"mean": 10, "std": 2}))
    assert abs(low - 4) < 0.01 and abs(high - 16) < 0.01


def test_coverage_of_an_empty_table(spark):
    none = spark.createDataFrame([], "kind string")
    assert [tuple(r) for r in audit.coverage(none, "kind", ["a"]).collect()] == [("a", 0)]


def test_clusters_are_greedy_and_respect_vetoes():
    rng = random.Random(2)
    for n in range(1, 7):
        for _ in range(20):
            shards = [rng.randrange(3) for _ in range(n)]
            p = np.full((n, n), -np.inf)
            for i, j in itertools.combinations(range(n), 2):
                if shards[i] != shards[j]:
                    p[i, j] = p[j, i] = rng.random()
            of = merging.clusters(p)
            groups = {c: [i for i in range(n) if of[i] == c] for c in of}
            assert all(c == min(g) and len({shards[i] for i in g}) == len(g) for c, g in groups.items())
            for a, b in itertools.combinations(groups.values(), 2):  # nothing is left to gain
                assert sum(p[i, j] - 0.5 for i in a for j in b) <= 1e-12
    assert merging.clusters(np.zeros((0, 0))) == []
    p = np.array([[-np.inf, 0.9, 0.8], [0.9, -np.inf, 0.1], [0.8, 0.1, -np.inf]])
    assert merging.clusters(p) == [0, 0, 2] and merging.tensions(p, [0, 0, 2]) == [("vetoed", 0, 2)] and merging.tensions(p, [0, 0, 0]) == [("forced", 1, 2)]


def test_mixture(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.beta(3, 12, 300), rng.beta(30, 3, 40)])
    fit = merging.mixture(x)
    post = fit.posterior(np.linspace(0, 1, 101))
    assert np.all(np.diff(post) >= -1e-12) and post[10] < 0.01 and post[95] > 0.99 and abs(fit.share - 40 / 340) < 0.03
    rows = spark.createDataFrame([(float(v),) for v in x[::20]] + [(None,)], "x double")
    got = [r.p for r in rows.select(fit.column(F.col("x")).alias("p")).collect()]
    assert got[-1] is None and np.allclose(got[:-1], fit.posterior(x[::20]))
    assert merging.mixture(np.full(50, 0.3)) is None and merging.mixture(np.array([0.1, 0.9])) is None
    p = merging.same_probability(np.zeros((3, 3)), [0, 0, 1], ["A", "B", "A"])
    assert p[0, 2] == 0.95 and p[1, 2] == 0.5 and np.isneginf(p[0, 1])


def test_votes_links_and_dependencies():
    assert merging.voted([("b",), ("a",), ("a",), ()]) == (("a",), False) and merging.voted([]) == ((), True)
    links = [{"name": "has", "kind": "1:N", "participants": ["X", "B"], "facts": [2]}, {"name": "has", "kind": "M:N", "participants": ["B", "A"], "facts": [1]}]
    out, flags = merging.merged_links(links, {"X": "A"})
    assert out == [{"name": "has", "kind": "1:N", "participants": ("A", "B"), "facts": [1, 2]}] and flags == ["has: 1:N and M:N"]
    assert merging.kept_dependencies([(("a",), "b"), (("a",), "b"), (("a",), "z")], {"a", "b"}) == [(("a",), "b")]


def test_uniques_follow_patches():
    t = Table("T", (Column("id", "INTEGER"), Column("a", "VARCHAR"), Column("b", "VARCHAR")), ("id",))
    u = {"action": "upsert_unique", "table": "T", "columns": ["a", "b"]}
    c, refused = patches.apply(Catalog({"T": t}), [u, u | {"columns": ["b", "a"]}, u | {"columns": ["x"]}])
    assert c.tables["T"].unique == (("b", "a"),) and len(refused) == 1
    assert patches.apply(c, [{"action": "rename_column", "table": "T", "column": "a", "to": "c"}])[0].tables["T"].unique == (("b", "c"),)
    assert patches.apply(c, [{"action": "delete_column", "table": "T", "column": "a"}])[0].tables["T"].unique == ()
    gone, refused = patches.apply(c, [{"action": "delete_unique", "table": "T", "columns": ["a", "b"]}] * 2)
    assert gone.tables["T"].unique == () and len(refused) == 1
    junction = Catalog({"J": Table("J", (Column("aId", "INTEGER"), Column("bId", "INTEGER")), (), (("aId",), ("aId", "bId"), ("zId",)))}, [ForeignKey("J", "aId", "A"), ForeignKey("J", "bId", "B")])
    assert patches.normalised(junction).tables["J"].unique == (("a_id", "b_id"),)


def test_repeated_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "a")], "x int, y string")
    assert [tuple(r) for r in K.repeated_keys(rows, ["x", "y"]).collect()] == [(1, "a", 2)]


def test_column_map():
    link = ForeignKey("ORDERS", "o_custkey", "CUSTOMER")
    got = A.column_map(TESTDATA, {("PART", "p_size"): {1}}, {"PART": {1, 2}}, {link: {3}}, {3: {"PART"}, 4: {"REGION"}, 5: {"ORDERS", "REGION"}, 6: {"NONE"}})
    assert got[1] == [("PART", "p_size")] and got[2] == [("PART", "p_partkey")] and got[3] == [("CUSTOMER", "c_custkey"), ("ORDERS", "o_custkey")]
    assert got[4] == [("REGION", "r_regionkey")] and 6 not in got
    assert set(got[5]) == {("ORDERS", "o_custkey"), ("CUSTOMER", "c_custkey"), ("CUSTOMER", "c_nationkey"), ("NATION", "n_nationkey"), ("NATION", "n_regionkey"), ("REGION", "r_regionkey")}


def test_origins(spark):
    text = "The quick brown fox jumps over the lazy dog. Prices rose by ten percent in May. Nothing else happened there!"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    claims = spark.createDataFrame([(1, 1, "f", "brown fox"), (2, 1, "f", "prices ROSE by ten percent in May. "), (3, 1, text, "no"), (4, 1, "zebra", None), (5, 2, "f", "x"), (6, 9, "f", "x")], "claim_id long, doc_id long, fact string, origin string")
    got = {r.claim_id: (r.match, round(r.score, 9)) for r in T.origins(claims, docs).collect()}
    assert got == {1: ("verbatim", 1), 2: ("sentence", 1), 3: ("high", 1), 4: ("none", 0), 5: ("none", 0), 6: ("none", 0)}


def test_drafts_and_references(spark):
    drafts = spark.createDataFrame([(1, 1, True, 0), (1, 2, False, 3), (1, 3, False, 3), (2, 1, True, 5), (2, 2, None, None)], "u int, iteration int, rejected boolean, findings int")
    assert {(r.u, r.iteration) for r in A.best_drafts(drafts, "u").collect()} == {(1, 3), (2, 2)}
    facts = spark.createDataFrame([(1, 1, [3]), (1, 2, [1]), (2, 3, [2, 9]), (3, 4, None)], "segment int, fact_id int, refs array<int>")
    assert [tuple(r) for r in V.cross_references(facts).collect()] == [(1, 2)]


def test_generated_rows(spark):
    spec = {
        "u": {"family": "uniform", "params": {"low": -1, "high": 3}},
        "n": {"family": "normal", "params": {"mean": 5, "std": 2}},
        "e": {"family": "exponential", "params": {"lambda": 0.5}},
        "p": {"family": "poisson", "params": {"lambda": 4}, "nulls": 0.25},
        "z": {"family": "zipf", "params": {"n": 3, "s": 1}},
        "c": {"family": "categorical", "params": {"weights": {"a": 1, "b": 0, "c": 3}}},
        "k": {"parent": 7},
        "d": {"expression": R.Arith("+", R.Col("u"), R.Lit(1))},
        "w": {"if": R.Compare("=", R.Col("c"), R.Lit("a")), "then": {"expression": R.Lit(1.0)}, "else": {"expression": R.Col("d")}},
    }
    rows = G.table(spark, 40_000, "id", spec, seed=5)
    x = rows.toPandas()
    assert rows.repartition(3, "u").exceptAll(G.table(spark, 40_000, "id", spec, seed=5)).isEmpty()
    assert abs(x.u.mean() - 1) < 0.03 and abs(x.n.mean() - 5) < 0.05 and abs(x.n.std() - 2) < 0.05 and abs(x.e.mean() - 2) < 0.05
    assert abs(x.p.isna().mean() - 0.25) < 0.01 and abs(x.p.mean() - 4) < 0.05 and abs(x.p.var() - 4) < 0.15
    assert np.allclose(x.z.value_counts(normalize=True).sort_index(), np.array([6, 3, 2]) / 11, atol=0.01)
    assert set(x.c) == {"a", "c"} and abs((x.c == "a").mean() - 0.25) < 0.01 and set(x.k) == set(range(7))
    assert np.allclose(x.d, x.u + 1) and (x.w == np.where(x.c == "a", 1.0, x.d)).all()
    assert G.table(spark, 0, "id", spec).count() == 0
    kids = G.children(spark.createDataFrame([(1, 2), (2, 0), (3, None)], "id int, k int"), "id", F.col("k"), "parent")
    assert sorted(map(tuple, kids.collect())) == [(1, 1), (1, 2)]
    with pytest.raises(ValueError):
        G.draw("none", {}, "x", 0, "id")


def test_ensembles_and_cross_flags(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.beta(2, 12, 300), rng.beta(30, 2, 30)])
    fit = merging.ensemble(x)
    assert len(fit.fits) > 3 and fit.posterior(np.array([0.97]))[0] > 0.9 and fit.posterior(np.array([0.1]))[0] < 0.1
    rows = spark.createDataFrame([(0.97,), (0.5,), (None,)], "x double")
    got = [r[0] for r in rows.select(fit.column(rows["x"])).collect()]
    assert got[:2] == pytest.approx(fit.posterior(np.array([0.97, 0.5])).tolist()) and got[2] is None
    assert merging.ensemble(np.full(50, 0.4)) is None and merging.ensemble(np.array([0.1])) is None
    n = 14
    m = rng.beta(2, 12, (n, n))
    m = (m + m.T) / 2
    m[0, 1] = m[1, 0] = m[2, 4] = m[4, 2] = 0.97
    kinds = ["entity", "attribute"] * 7
    assert [f[:2] for f in merging.cross_flags(m, [f"n{i}" for i in range(n)], kinds)] == [("n0", "n1")]
    assert merging.cross_flags(np.zeros((0, 0)), [], []) == []


def test_origins_meet_documents_once(spark):
    docs = spark.createDataFrame([(1, "One two three four five six. A last sentence stands here."), (2, None)], "doc_id long, text string")
    claims = spark.createDataFrame([(1, 1, "two three four", "no such"), (2, 1, "x", "A LAST sentence stands here."), (3, 1, "x", "two three"), (4, 2, "x", "y"), (5, 9, "x", "y"), (6, 1, None, None)], "claim_id long, doc_id long, fact string, origin string")
    from relspan.operators import text

    out = text.origins(claims, docs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r.claim_id: (r.match, r.score) for r in out.collect()}
    assert {k: got[k] for k in (2, 3, 4, 5, 6)} == {2: ("sentence", 1.0), 3: ("verbatim", 1.0), 4: ("none", 0.0), 5: ("none", 0.0), 6: ("none", 0.0)}
    assert got[1][1] == text.best_span("two three four", docs.first().text, (12, 24, 40, 64, 96), 20) > 0
