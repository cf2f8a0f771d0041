"""Row counts, circles of derived columns and constraints over a stream."""

from relspan.operators import satisfy
from relspan.plans import rowcounts, sql
from relspan.plans.catalog import TESTDATA, read
from relspan.plans.freedom import over_constrained
from relspan.streaming import checks

SF = "/root/testdata/sf0.001"


def test_counts(spark):
    c = rowcounts.Counts()
    tree = sql.parse("SELECT o_custkey, COUNT(*) AS n FROM ORDERS JOIN CUSTOMER ON ORDERS.o_custkey = CUSTOMER.c_custkey WHERE o_totalprice > 100000 GROUP BY o_custkey")
    top = rowcounts.rows(tree, TESTDATA, c)
    assert c.kinds == {"ORDERS": "free", "filtered1": "filtered", "grouped1": "grouped"} and top == "grouped1" and len(c.equations) == 2
    assert not over_constrained(c.equations) and over_constrained(c.equations | {f"given {u}": {u} for u in [*c.unknowns, *c.unknowns]} | {"again": {"ORDERS"}})
    orders = read(spark, SF, "ORDERS")
    big = orders.where("o_totalprice > 100000")
    assert rowcounts.observed(c, TESTDATA, lambda t: read(spark, SF, t)) == {"ORDERS": orders.count(), "filtered1": big.count(), "grouped1": big.select("o_custkey").distinct().count()}
    assert rowcounts.cut_points(4) == ["threshold_1", "threshold_2", "threshold_3"] and rowcounts.cut_points(1) == []


def test_cycles():
    assert rowcounts.cycles({"a": ({"b": 2}, 1), "b": ({"a": 0.5}, -0.5)}) == [(frozenset("ab"), "identity")]
    assert rowcounts.cycles({"a": ({"b": 1}, 1), "b": ({"a": 1}, 0)}) == [(frozenset("ab"), "contradiction")]
    assert rowcounts.cycles({"a": ({"a": 3}, 1), "b": {"c"}, "c": {"b"}, "d": ({"a": 1}, 0)}) == [(frozenset("a"), "fixed"), (frozenset("bc"), "unverifiable")]
    assert rowcounts.cycles({"a": ({"b": 1}, 0)}) == []


def test_stream_has_the_verdicts_of_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, float(i % 5) if i % 3 else None) for i in range(60)], "k long, v double").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    rules = {"r": {"op": "range", "column": "v", "min": 1, "max": 3}, "i": {"op": "ifthen", "if": {"op": "eq", "column": "k", "value": 1}, "then": {"op": "gt", "column": "v", "value": 2}}}
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert checks.start(stream, rules, str(tmp_path / "out"), once=True).awaitTermination(60)
    order = ["constraint", "satisfied", "violated", "vacuous", "unevaluable", "applicable", "rate"]
    got = {tuple(r) for r in checks.totals(spark, str(tmp_path / "out")).select(*order).collect()}
    assert got == {tuple(r) for r in satisfy.verdicts(rows, rules).select(*order).collect()}
