"""The registered queries of the relational and statistical operators, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.operators import distributions as D
from relspan.operators import facts as A
from relspan.operators import generate as G
from relspan.operators import moments as M
from relspan.operators import packing as P
from relspan.operators import satisfy as K
from relspan.operators import scoring as S
from relspan.operators import text as T
from relspan.operators import mining
from relspan.operators import vectors as V
from relspan.plans import audit, conceptual, extraction, patches, sql
from relspan.plans.catalog import TESTDATA, read
from relspan.plans.relation import Aggregate, Arith, Base, Col, Compare, Fanout, Filter, IfThen, Join, Lit, Project, column, compiled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def relation(name: str, text: str | object, oracle: str, rounded: str = "") -> None:
    """Registers a relation, or SQL of the closed grammar, under a name. rounded: columns that both sides round to 6 digits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tree = sql.parse(text) if isinstance(text, str) else text
        out = compiled(tree, TESTDATA, lambda t: read(spark, sf_dir, t))
        for c in rounded.split():
            out = out.withColumn(c, F.round(c, 6))
        return out

    QUERIES[name], ORACLE_SQL[name] = run, oracle


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


# scans, projections, filters

relation("scan_base_table", "SELECT * FROM REGION", "SELECT r_regionkey, r_name FROM region")
relation("project_rename", "SELECT p_partkey AS part, p_brand AS brand, p_size FROM PART", "SELECT p_partkey AS part, p_brand AS brand, p_size FROM part")
relation("project_arith", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM LINEITEM", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem", "charge")
relation("try_divide_null", "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice / l_discount AS ratio FROM LINEITEM", "SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 6) AS ratio FROM lineitem", "ratio")
_ITEM = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM LINEITEM WHERE "
for _name, _where in {
    "filter_compare": "l_quantity >= 25 AND l_discount < 0.05",
    "filter_between": "l_quantity BETWEEN 10 AND 20",
    "filter_in": "l_returnflag IN ('A', 'R')",
    "filter_not_in": "l_returnflag NOT IN ('A', 'R')",
    "filter_and_or_not": "(l_quantity < 5 OR l_discount > 0.08) AND NOT l_linestatus = 'O'",
}.items():
    relation(_name, _ITEM + _where, _ITEM.lower() + _where)
relation("filter_if_then", Project(Filter(Base("LINEITEM"), IfThen(Compare("=", Col("l_returnflag"), Lit("R")), Compare(">", Col("l_quantity"), Lit(30)))), tuple((Col(c), c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))), _ITEM.lower() + "NOT l_returnflag = 'R' OR l_quantity > 30")

# joins and fan-out

relation("join_fk_pk", "SELECT l_orderkey, l_partkey, l_linenumber, o_orderdate FROM LINEITEM JOIN ORDERS ON LINEITEM.l_orderkey = ORDERS.o_orderkey", "SELECT l_orderkey, l_partkey, l_linenumber, o_orderdate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
relation("join_three_way", "SELECT l_orderkey, l_partkey, l_linenumber, o_orderpriority, c_mktsegment FROM LINEITEM JOIN ORDERS ON LINEITEM.l_orderkey = ORDERS.o_orderkey JOIN CUSTOMER ON ORDERS.o_custkey = CUSTOMER.c_custkey", "SELECT l_orderkey, l_partkey, l_linenumber, o_orderpriority, c_mktsegment FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
relation("join_right_deep", Project(Join(Base("LINEITEM"), Join(Base("ORDERS"), Base("CUSTOMER"), ("ORDERS", "o_custkey"), ("CUSTOMER", "c_custkey")), ("ORDERS", "o_orderkey"), ("LINEITEM", "l_orderkey")), tuple((Col(c), c) for c in ("l_orderkey", "l_partkey", "l_linenumber", "c_mktsegment"))), "SELECT l_orderkey, l_partkey, l_linenumber, c_mktsegment FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
relation("join_parent_first", "SELECT o_orderkey, c_name FROM CUSTOMER JOIN ORDERS ON CUSTOMER.c_custkey = ORDERS.o_custkey", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
relation("join_eliminated", "SELECT COUNT(*) AS n FROM LINEITEM JOIN ORDERS ON LINEITEM.l_orderkey = ORDERS.o_orderkey", "SELECT count(*) AS n FROM lineitem")
relation("fanout_customer_orders", Fanout(Base("CUSTOMER"), Base("ORDERS"), "o_custkey"), "SELECT c.*, coalesce(n, 0) AS child_count FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
relation("fanout_order_lines", Fanout(Base("ORDERS"), Base("LINEITEM"), "l_orderkey"), "SELECT o.*, coalesce(n, 0) AS child_count FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")

# aggregates

for _fn, _of, _sql in (
    ("SUM", "o_totalprice", "round(sum(o_totalprice), 2)"),
    ("AVG", "o_totalprice", "round(avg(o_totalprice), 6)"),
    ("COUNT", "o_custkey", "count(o_custkey)"),
    ("COUNT_DISTINCT", "o_custkey", "count(DISTINCT o_custkey)"),
    ("MIN", "o_orderdate", "min(o_orderdate)"),
    ("MAX", "o_orderdate", "max(o_orderdate)"),
    ("MEDIAN", "o_totalprice", "round(median(o_totalprice), 6)"),
    ("STDDEV", "o_totalprice", "round(stddev_samp(o_totalprice), 4)"),
    ("VARIANCE", "o_totalprice", "round(var_samp(o_totalprice) / 1e6, 4)"),
    ("MODE", "o_orderstatus", "mode(o_orderstatus)"),
):

    @query(f"agg_{_fn.lower()}", f"SELECT o_orderpriority, {_sql} AS result FROM orders GROUP BY 1")
    def _(spark, sf_dir, fn=_fn, of=_of, how=_sql):
        out = compiled(Aggregate(Base("ORDERS"), fn, of, "result", ("o_orderpriority",)), TESTDATA, lambda t: read(spark, sf_dir, t))
        if how.startswith("round"):
            digits = int(how.rstrip(")").rsplit(", ", 1)[1])
            out = out.withColumn("result", F.round(F.col("result") / F.lit(1e6 if fn == "VARIANCE" else 1.0), digits))
        return out


relation("agg_percentile", "SELECT o_orderstatus, PERCENTILE(o_totalprice, 90) AS p90 FROM ORDERS GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM orders GROUP BY 1", "p90")
relation("agg_median_string", "SELECT o_orderstatus, MEDIAN(o_orderpriority) AS middle FROM ORDERS GROUP BY o_orderstatus", "SELECT o_orderstatus, quantile_disc(o_orderpriority, 0.5) AS middle FROM orders GROUP BY 1")
relation("agg_median_date", "SELECT o_orderstatus, MEDIAN(o_orderdate) AS middle FROM ORDERS GROUP BY o_orderstatus", "SELECT o_orderstatus, quantile_disc(o_orderdate, 0.5) AS middle FROM orders GROUP BY 1")
relation("agg_group_by", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM LINEITEM GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
relation("having_agg", "SELECT o_custkey, COUNT(*) AS n FROM ORDERS GROUP BY o_custkey HAVING COUNT(*) > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
relation("where_over_agg_subquery", "SELECT * FROM (SELECT o_custkey, MAX(o_totalprice) AS top FROM ORDERS GROUP BY o_custkey) AS t WHERE top > 400000", "SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING max(o_totalprice) > 400000")
_SEGMENT = Aggregate(
    Project(
        Join(Filter(Base("LINEITEM"), Compare(">=", Col("l_quantity"), Lit(10))), Join(Base("ORDERS"), Base("CUSTOMER"), ("ORDERS", "o_custkey"), ("CUSTOMER", "c_custkey")), ("LINEITEM", "l_orderkey"), ("ORDERS", "o_orderkey")),
        ((Col("c_mktsegment"), "segment"), (Arith("*", Col("l_extendedprice"), Arith("-", Lit(1), Col("l_discount"))), "amount")),
    ),
    "SUM",
    "amount",
    "revenue",
    ("segment",),
)
_REVENUE = "SELECT c_mktsegment AS segment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 10 GROUP BY 1"


@query("segment_revenue", _REVENUE)
def segment_revenue(spark, sf_dir):
    return compiled(_SEGMENT, TESTDATA, lambda t: read(spark, sf_dir, t)).withColumn("revenue", F.round("revenue", 2))


# constraints over rows


def _csr(name: str, table: str, constraint: dict, good: str, given: str = "true", source: str | None = None) -> None:
    select = f"SELECT '{name}' AS \"constraint\", count(*) FILTER (({given}) AND ({good})) AS satisfied, count(*) FILTER (({given}) AND NOT ({good})) AS violated, count(*) FILTER (NOT ({given})) AS vacuous, count(*) FILTER (({given}) IS NULL OR (({given}) AND ({good}) IS NULL)) AS unevaluable, count(*) FILTER (({given}) AND ({good}) IS NOT NULL) AS applicable, count(*) FILTER (({given}) AND ({good})) / nullif(count(*) FILTER (({given}) AND ({good}) IS NOT NULL), 0) AS rate FROM {source or table.lower()}"

    @query(name, select)
    def _(spark, sf_dir):
        return K.verdicts(read(spark, sf_dir, table), {name: constraint}, lambda t: read(spark, sf_dir, t))


_JOIN = {"table": "ORDERS", "fk": "l_orderkey", "key": "o_orderkey"}
_csr("csr_range", "LINEITEM", {"op": "range", "column": "l_quantity", "min": 5, "max": 45}, "l_quantity BETWEEN 5 AND 45")
_csr("csr_compare_literal", "ORDERS", {"op": "neq", "column": "o_orderstatus", "value": "P"}, "o_orderstatus <> 'P'")
_csr("csr_cross_column", "LINEITEM", {"op": "gte", "column": "l_discount", "rhs_column": "l_tax"}, "l_discount >= l_tax")
_csr("csr_join_rhs", "LINEITEM", {"op": "gte", "column": "l_shipdate", "rhs_column": "o_orderdate", "rhs_join": _JOIN}, "l_shipdate >= o_orderdate", source="lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
_csr("csr_rhs_expr", "LINEITEM", {"op": "lte", "column": "l_quantity", "rhs_expr": {"op": "/", "column": "l_tax", "rhs_column": "l_discount"}}, "l_quantity <= l_tax / nullif(l_discount, 0)")
_csr("csr_ifthen", "ORDERS", {"op": "ifthen", "if": {"op": "eq", "column": "o_orderstatus", "value": "F"}, "then": {"op": "gt", "column": "o_totalprice", "value": 100000}}, "o_totalprice > 100000", "o_orderstatus = 'F'")
_csr("csr_and_or", "LINEITEM", {"op": "or", "conditions": [{"op": "lt", "column": "l_quantity", "value": 10}, {"op": "and", "conditions": [{"op": "gt", "column": "l_tax", "value": 0.02}, {"op": "eq", "column": "l_linestatus", "value": "O"}]}]}, "l_quantity < 10 OR (l_tax > 0.02 AND l_linestatus = 'O')")
_csr("csr_short_circuit_null", "LINEITEM", {"op": "and", "conditions": [{"op": "lt", "column": "l_quantity", "rhs_expr": {"op": "/", "column": "l_tax", "rhs_column": "l_discount"}}, {"op": "gt", "column": "l_quantity", "value": 1000}]}, "CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity < l_tax / l_discount AND l_quantity > 1000 END")


@query("csr_report", "SELECT sum(s) / sum(a) AS rate, 2::BIGINT AS n_evaluated, 0::BIGINT AS n_vacuous, 1::BIGINT AS n_unevaluable FROM (SELECT count(*) FILTER (l_quantity BETWEEN 5 AND 45) AS s, count(*) AS a FROM lineitem UNION ALL SELECT count(*) FILTER (l_discount >= l_tax), count(*) FROM lineitem)")
def csr_report(spark, sf_dir):
    rules = {"a": {"op": "range", "column": "l_quantity", "min": 5, "max": 45}, "b": {"op": "gte", "column": "l_discount", "rhs_column": "l_tax"}, "c": {"op": "eq", "column": "no_such_column", "value": 1}}
    return K.report(K.verdicts(read(spark, sf_dir, "LINEITEM"), rules))


@query("ref_integrity", "SELECT count(*) AS n_missing FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey")
def ref_integrity(spark, sf_dir):
    return K.missing_keys(read(spark, sf_dir, "LINEITEM"), "l_orderkey", read(spark, sf_dir, "ORDERS"), "o_orderkey")


@query("fd_check_data", "SELECT p_brand, count(DISTINCT p_type) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def fd_check_data(spark, sf_dir):
    return K.dependency_violations(read(spark, sf_dir, "PART"), ["p_brand"], "p_type")


@query("state_domain", "SELECT count(*) FILTER (o_orderstatus IN ('F', 'O')) AS inside, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS outside FROM orders")
def state_domain(spark, sf_dir):
    inside = F.col("o_orderstatus").isin("F", "O")
    return read(spark, sf_dir, "ORDERS").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@query("event_transitions", "SELECT from_state, to_state, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events) WHERE from_state IS NOT NULL GROUP BY 1, 2")
def event_transitions(spark, sf_dir):
    return K.transitions(read(spark, sf_dir, "EVENTS"), "user_id", ["ts", "event_id"], "event_type")


@query("law_of_total_variance", "WITH g AS (SELECT o_orderstatus, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, sum(n * v) / sum(n) AS within_ FROM g) SELECT round(within_ / 1e6, 4) AS \"within\", round((SELECT sum(g.n * (g.m - t.m) * (g.m - t.m)) / t.n FROM g) / 1e6, 4) AS \"between\" FROM t")
def law_of_total_variance(spark, sf_dir):
    g = read(spark, sf_dir, "ORDERS").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"), F.var_pop("o_totalprice").alias("v"))
    t = g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("w"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    return t.select(F.round(F.col("w") / 1e6, 4).alias("within"), F.round((F.col("q") / F.col("n") - F.col("m") * F.col("m")) / 1e6, 4).alias("between"))


@query("corr_matrix", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem")
def corr_matrix(spark, sf_dir):
    pairs = {"quantity_price": ("l_quantity", "l_extendedprice"), "quantity_discount": ("l_quantity", "l_discount"), "discount_tax": ("l_discount", "l_tax")}
    return read(spark, sf_dir, "LINEITEM").agg(*(F.round(F.corr(*p), 6).alias(n) for n, p in pairs.items()))


# distributions


def _estimate(name: str, table: str, of: str, family: str, oracle: str | None) -> None:
    @query(name, oracle)
    def _(spark, sf_dir):
        found = D.estimate(family, D.summarize(read(spark, sf_dir, table), [of], (family,))[of])
        return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "parameter string, value double").withColumn("value", F.round("value", 6))


_TWO = "SELECT '{}' AS parameter, round({}, 6) AS value FROM {t} UNION ALL SELECT '{}', round({}, 6) FROM {t}"
_ONE = "SELECT '{}' AS parameter, round({}, 6) AS value FROM {t}"
_estimate("est_normal", "LINEITEM", "l_quantity", "normal", _TWO.format("mean", "avg(l_quantity)", "std", "stddev_pop(l_quantity)", t="lineitem"))
_estimate("est_lognormal", "EVENTS", "value", "lognormal", _TWO.format("mu", "avg(ln(value)) FILTER (value > 0)", "sigma", "stddev_samp(ln(value)) FILTER (value > 0)", t="events"))
_estimate("est_poisson", "PART", "p_size", "poisson", _ONE.format("lambda", "avg(p_size)", t="part"))
_estimate("est_zipf", "PART", "p_size", "zipf", _ONE.format("a", "1 + 1 / ln(avg(p_size))", t="part"))
_estimate("est_exponential", "EVENTS", "value", "exponential", _ONE.format("rate", "1 / avg(value)", t="events"))
_estimate("est_uniform", "ORDERS", "o_totalprice", "uniform", _TWO.format("low", "min(o_totalprice)", "high", "max(o_totalprice)", t="orders"))


def _polygamma(order: int, x: str) -> str:
    """SQL of digamma (0) and trigamma (1): eight steps of the recurrence, and the asymptotic series behind them."""
    y, sign = f"({x} + 8)", "-" if order == 0 else "+"
    near = " + ".join(f"1 / pow({x} + {i}, {order + 1})" for i in range(8))
    if order == 0:
        far = f"ln({y}) - 0.5 / {y} - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8))"
    else:
        far = f"1 / {y} + 0.5 / pow({y}, 2) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)) - 1 / (30 * pow({y}, 9))"
    return f"({far} {sign} ({near}))"


_A, _B, _AB = _polygamma(0, "a"), _polygamma(0, "b"), _polygamma(0, "(a + b)")
_TA, _TB, _TAB = _polygamma(1, "a"), _polygamma(1, "b"), _polygamma(1, "(a + b)")
#: Newton steps towards the likeliest parameters, as recursive SQL.
_BETA = f"""WITH RECURSIVE u AS (SELECT avg(x) AS m, var_pop(x) AS v, avg(ln(x)) AS l, avg(ln(1 - x)) AS r FROM (SELECT l_discount AS x FROM lineitem WHERE l_discount > 0 AND l_discount < 1)),
s AS (SELECT 0 AS i, m * (m * (1 - m) / v - 1) AS a, (1 - m) * (m * (1 - m) / v - 1) AS b FROM u
  UNION ALL SELECT i + 1, greatest(a - (g1 * (h2 - t) + g2 * t) / ((h1 - t) * (h2 - t) - t * t), a / 5), greatest(b - (g2 * (h1 - t) + g1 * t) / ((h1 - t) * (h2 - t) - t * t), b / 5)
  FROM (SELECT i, a, b, {_A} - {_AB} - l AS g1, {_B} - {_AB} - r AS g2, {_TA} AS h1, {_TB} AS h2, {_TAB} AS t FROM s, u) WHERE i < 60)
SELECT parameter, round(CASE parameter WHEN 'alpha' THEN a ELSE b END, 6) AS value FROM s, (VALUES ('alpha'), ('beta')) p(parameter) WHERE i = 60"""
_GAMMA = f"""WITH RECURSIVE u AS (SELECT avg(x) AS m, ln(avg(x)) - avg(ln(x)) AS s FROM (SELECT value AS x FROM events WHERE value > 0)),
k AS (SELECT 0 AS i, (3 - s + sqrt((s - 3) ** 2 + 24 * s)) / (12 * s) AS a FROM u
  UNION ALL SELECT i + 1, greatest(a - (ln(a) - {_A} - s) / (1 / a - {_TA}), a / 10) FROM k, u WHERE i < 60)
SELECT parameter, round(CASE parameter WHEN 'shape' THEN a ELSE a / m END, 6) AS value FROM k, u, (VALUES ('shape'), ('rate')) p(parameter) WHERE i = 60"""
_estimate("est_beta", "LINEITEM", "l_discount", "beta", _BETA)
_estimate("est_gamma", "EVENTS", "value", "gamma", _GAMMA)
_PMF = "SELECT {c} AS label, count(*) / sum(count(*)) OVER () AS share FROM {t} GROUP BY 1"


@query("est_categorical", f"SELECT label, round(share, 6) AS share FROM ({_PMF.format(c='event_type', t='events')})")
def est_categorical(spark, sf_dir):
    return D.pmf(read(spark, sf_dir, "EVENTS"), "event_type").withColumn("share", F.round("share", 6))


@query("pmf_label", f"SELECT label, round(share, 6) AS share FROM ({_PMF.format(c='CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)', t='lineitem')})")
def pmf_label(spark, sf_dir):
    return D.pmf(read(spark, sf_dir, "LINEITEM"), "l_quantity").withColumn("share", F.round("share", 6))


@query("tvd_categorical", "WITH p AS (SELECT o_orderstatus AS label, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1), q AS (SELECT l_linestatus AS label, count(*) / sum(count(*)) OVER () AS share FROM lineitem GROUP BY 1) SELECT round(0.5 * sum(abs(coalesce(p.share, 0) - coalesce(q.share, 0))), 6) AS distance FROM p FULL JOIN q USING (label)")
def tvd_categorical(spark, sf_dir):
    return D.tvd(D.pmf(read(spark, sf_dir, "ORDERS"), "o_orderstatus"), D.pmf(read(spark, sf_dir, "LINEITEM"), "l_linestatus")).withColumn("distance", F.round("distance", 6))


@query("mre", "SELECT round((abs(avg(l_quantity) - 25) / 25 + abs(stddev_pop(l_quantity) - 15) / 15) / 2, 6) AS mre FROM lineitem")
def mre(spark, sf_dir):
    found = D.estimate("normal", D.summarize(read(spark, sf_dir, "LINEITEM"), ["l_quantity"], ("normal",))["l_quantity"])
    return spark.createDataFrame([(D.mre(found, {"mean": 25, "std": 15}),)], "mre double").withColumn("mre", F.round("mre", 6))


def _score(name: str, table: str, of: str, family: str, p: dict, oracle: str | None, how: Callable = D.nll_score) -> None:
    @query(name, oracle)
    def _(spark, sf_dir):
        out = how(read(spark, sf_dir, table), of, family, p)
        return out.select(F.round(out.columns[0], 6).alias(out.columns[0]))


_KS = "WITH c AS (SELECT {c} AS x, count(*) AS n FROM {t} GROUP BY 1), u AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS total, {f} AS f FROM c) SELECT round(max({gap}), 6) AS distance FROM u"
#: A term of the series of the normal distribution function, of z = (x - 250000) / 150000 / sqrt(2), over z.
_ERF = "(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow((x - 250000) / 150000 / sqrt(2), 2 * k) / (exp(lgamma(k + 1.0)) * (2 * k + 1))"
_BOTH = "greatest(upto / total - f, f - (upto - n) / total)"
_score("nll_exponential", "EVENTS", "value", "exponential", {"rate": 0.02}, "SELECT round(exp(avg(-0.02 * value)), 6) AS score FROM events")
_score("nll_uniform", "LINEITEM", "l_quantity", "uniform", {"low": 0.0, "high": 60.0}, "SELECT 1.0::DOUBLE AS score")
_score("ks_uniform", "LINEITEM", "l_quantity", "uniform", {"low": 0.0, "high": 50.0}, _KS.format(c="l_quantity", t="lineitem", f="x / 50", gap=_BOTH), D.ks)
_score("ks_exponential", "EVENTS", "value", "exponential", {"rate": 0.02}, _KS.format(c="value", t="events", f="1 - exp(-0.02 * x)", gap=_BOTH), D.ks)
_score("ks_normal", "ORDERS", "o_totalprice", "normal", {"mean": 250000.0, "std": 150000.0}, f"WITH c AS (SELECT o_totalprice AS x, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT x, n, sum(n) OVER (ORDER BY x) AS upto, sum(n) OVER () AS total, 0.5 + (x - 250000) / 150000 / sqrt(2 * pi()) * list_sum([{_ERF} for k in range(0, 40)]) AS f FROM c) SELECT round(max({_BOTH}), 6) AS distance FROM u", D.ks)
_score("ks_poisson", "PART", "p_size", "poisson", {"lambda": 25.0}, _KS.format(c="p_size", t="part", f="(SELECT sum(exp(k * ln(25.0) - 25 - lgamma(k + 1))) FROM range(0, 60) r(k) WHERE k <= x)", gap="abs(upto / total - f)"), D.ks)
_score("ks_zipf", "PART", "p_size", "zipf", {"a": 1.5}, _KS.format(c="p_size", t="part", f="list_sum([pow(k, -1.5) for k in range(1, x::BIGINT + 1)]) / 2.612375348685488", gap="abs(upto / total - f)"), D.ks)


@query("mine_table_stats", "SELECT 'l_quantity' AS name, round(avg((l_quantity = round(l_quantity))::INT), 6) AS share_whole, count(DISTINCT l_quantity)::DOUBLE AS n_distinct FROM lineitem UNION ALL SELECT 'l_extendedprice', round(avg((l_extendedprice = round(l_extendedprice))::INT), 6), count(DISTINCT l_extendedprice)::DOUBLE FROM lineitem")
def mine_table_stats(spark, sf_dir):
    rows = read(spark, sf_dir, "LINEITEM")
    found = D.summarize(rows, ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(n, float(s["share_whole"]), float(D.counts(rows, n).count())) for n, s in found.items()], "name string, share_whole double, n_distinct double").withColumn("share_whole", F.round("share_whole", 6))


def _mined(table: str = "events", column: str = "value") -> str:
    """AIC, BIC and KS of two families over events.value."""
    dens = {
        "exponential": ("1", "ln(rate) - rate * x", "1 - exp(-rate * x)"),
        "uniform": ("2", "-ln(high - low)", "(x - low) / (high - low)"),
    }
    parts = []
    for family, (k, ll, cdf) in dens.items():
        parts.append(f"SELECT '{column}' AS name, '{family}' AS family, sum({ll}) AS ll, {k} AS k, max(greatest(upto / n - ({cdf}), ({cdf}) - before / n)) AS ks, any_value(n) AS n FROM (SELECT x, count(*) OVER (ORDER BY x) AS upto, count(*) OVER (ORDER BY x) - count(*) OVER (PARTITION BY x) AS before, count(*) OVER () AS n FROM e), s")
    return f"WITH e AS (SELECT {column} AS x FROM {table} WHERE {column} IS NOT NULL), s AS (SELECT 1 / avg(x) AS rate, min(x) AS low, max(x) AS high FROM e) SELECT name, family, round(2 * k - 2 * ll, 3) AS aic, round(k * ln(n) - 2 * ll, 3) AS bic, round(ks, 6) AS ks FROM ({' UNION ALL '.join(parts)})"


@query("mine_column", _mined())
def mine_column(spark, sf_dir):
    """The exponential and the uniform among the families mined; the others' estimates have no SQL."""
    found = mining.mine({"EVENTS": read(spark, sf_dir, "EVENTS")}, spark, [("value", "EVENTS", "value")], keep=9).where("family in ('exponential', 'uniform')")
    return found.select(F.col("column").alias("name"), "family", F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"), F.round("ks", 6).alias("ks"))


@query("mine_schema", " UNION ALL ".join(f"SELECT '{t.upper()}' AS \"table\", * FROM ({_mined(t, c)})" for t, c in (("events", "value"), ("part", "p_retailprice"))))
def mine_schema(spark, sf_dir):
    """The same of all number columns of three tables, in one pass, for the columns that SQL is given for."""
    found = mining.mine({t: read(spark, sf_dir, t) for t in ("EVENTS", "CUSTOMER", "PART")}, spark, keep=9)
    found = found.where("family in ('exponential', 'uniform') and column in ('value', 'p_retailprice')")
    return found.select("table", F.col("column").alias("name"), "family", F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"), F.round("ks", 6).alias("ks"))


# scores of columns against specifications

_POINT, _FREE = {"tier": "point"}, {"tier": "free"}
_SPECS = {
    "LINEITEM.l_quantity": {"distribution": "uniform", "params": {"min": 2, "max": 60}, "scoring": {"min": _POINT, "max": _POINT}},
    "EVENTS.value": {"family": "exponential", "params": {"lambda": 0.02}, "scoring": {"lambda": _POINT}},
    "EVENTS.value (free)": {"family": "exponential", "params": {"lambda": 0.03}, "scoring": {"lambda": _FREE}, "free_params": {"lambda": {"min": 0.001, "max": 1.0}}},
    "ORDERS.o_totalprice": {"family": "lognormal", "params": {"mean": 12, "variance": 0.25}, "scoring": {"variance": _FREE}, "free_params": {"variance": {"min": 0.0, "max": 0.01}, "mean": {"min": 5, "max": 20}}},
    "ORDERS.o_orderstatus": {"family": "categorical", "params": {"weights": {"F": 5, "O": 4, "P": 1}}},
    "ORDERS.o_orderstatus (free)": {"family": "categorical", "params": {"weights": {"F": 1, "O": 1}}, "scoring": {"weights": _FREE}},
    "ORDERS.o_missing": {"family": "poisson", "params": {"lam": 3}},
    "NOWHERE.value": {"family": "poisson", "params": {"lam": 3}},
}
_KS_OF = "(SELECT max(greatest(upto / n - f, f - before / n)) FROM (SELECT {f} AS f, count(*) OVER (ORDER BY x) AS upto, count(*) OVER (ORDER BY x) - count(*) OVER (PARTITION BY x) AS before, count(*) OVER () AS n FROM (SELECT {c}::DOUBLE AS x FROM {t} WHERE {c} IS NOT NULL)))"
_SHARES = "(SELECT p, q FROM (SELECT o_orderstatus AS l, count(*) / sum(count(*)) OVER () AS p FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1) FULL JOIN (VALUES ('F', 0.5::DOUBLE), ('O', 0.4), ('P', 0.1)) v(l, q) USING (l))"
_CASE = f"""
SELECT 'LINEITEM.l_quantity' AS spec, (SELECT least(1.0, (abs(min(l_quantity) - 2) / 2 + abs(max(l_quantity) - 60) / 60) / 2) FROM lineitem) AS mre, 1.0::DOUBLE AS nll, {_KS_OF.format(f="least(1.0, greatest(0.0, (x - 2) / 58))", c="l_quantity", t="lineitem")} AS distance, 'ks' AS kind, NULL::BIGINT AS band_applicable, NULL::BIGINT AS band_satisfied
UNION ALL SELECT 'EVENTS.value', (SELECT least(1.0, abs(1 / avg(value) FILTER (value > 0) - 0.02) / 0.02) FROM events), (SELECT exp(avg(-0.02 * value) FILTER (value >= 0)) FROM events), {_KS_OF.format(f="1 - exp(-0.02 * x)", c="value", t="events")}, 'ks', NULL, NULL
UNION ALL SELECT 'EVENTS.value (free)', NULL, NULL, NULL, 'unscoreable_free_params', 1, (SELECT (1 / avg(value) FILTER (value > 0) BETWEEN 0.001 AND 1)::BIGINT FROM events)
UNION ALL SELECT 'ORDERS.o_totalprice', (SELECT abs(avg(ln(o_totalprice)) - 12) / 12 FROM orders WHERE o_totalprice > 0), NULL, NULL, 'unscoreable_free_params', 2, (SELECT (avg(ln(o_totalprice)) BETWEEN 5 AND 20)::BIGINT + (var_samp(ln(o_totalprice)) BETWEEN 0 AND 0.01)::BIGINT FROM orders WHERE o_totalprice > 0)
UNION ALL SELECT 'ORDERS.o_orderstatus', least(1.0, avg(abs(p - q) / q)), exp(sum(p * ln(q)) / sum(p)) / 0.5, 0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 'tvd', NULL, NULL FROM {_SHARES}
UNION ALL SELECT 'ORDERS.o_orderstatus (free)', NULL, NULL, NULL, 'unscoreable_free_params', NULL, NULL
UNION ALL SELECT unnest(['ORDERS.o_missing', 'NOWHERE.value']), 1.0, 0.0, 1.0, 'none', NULL, NULL"""
_ROUNDED = "spec, round(mre, 6) AS mre, round(nll, 6) AS nll, round(distance, 6) AS distance, kind, band_applicable, band_satisfied"


def _scores(spark, sf_dir) -> DataFrame:
    return S.score_case({t: read(spark, sf_dir, t) for t in ("LINEITEM", "ORDERS", "EVENTS")}, _SPECS, spark)


@query("case_score", f"SELECT {_ROUNDED} FROM ({_CASE})")
def case_score(spark, sf_dir):
    return _scores(spark, sf_dir).selectExpr("spec", *(f"round({c}, 6) AS {c}" for c in ("mre", "nll", "distance")), "kind", "band_applicable", "band_satisfied")


@query("score_report", f"SELECT round(avg(mre), 6) AS mre, round(avg(nll), 6) AS nll, round(avg(distance), 6) AS distance, count(distance) AS n_scoreable, count(*) FILTER (kind LIKE 'unscoreable%') AS n_unscoreable, round(sum(band_satisfied) / sum(band_applicable), 6) AS plausibility_rate, sum(band_applicable)::BIGINT AS n_band_applicable, count(*) FILTER (kind <> 'none') AS n_evaluated, count(*) FILTER (kind = 'none') AS n_missing FROM ({_CASE})")
def score_report(spark, sf_dir):
    r = S.case_report(_scores(spark, sf_dir)).drop("distance_kinds")
    return r.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in r.dtypes))


@query("score_bands", f"SELECT spec, band_applicable, band_satisfied FROM ({_CASE}) WHERE band_applicable IS NOT NULL")
def score_bands(spark, sf_dir):
    return _scores(spark, sf_dir).where("band_applicable is not null").select("spec", "band_applicable", "band_satisfied")


@query("score_categorical", f"SELECT round(avg(abs(p - q) / q), 6) AS mre, round(exp(sum(p * ln(q)) / sum(p)) / 0.5, 6) AS nll, round(0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS distance FROM {_SHARES}")
def score_categorical(spark, sf_dir):
    key = "ORDERS.o_orderstatus"
    s = S.score_case({"ORDERS": read(spark, sf_dir, "ORDERS")}, {key: _SPECS[key]}, spark)
    return s.select(*(F.round(c, 6).alias(c) for c in ("mre", "nll", "distance")))


# texts


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "DOCUMENTS")


@query("dup_text_hash", "SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_text_hash(spark, sf_dir):
    return T.repeated_texts(_docs(spark, sf_dir))


@query("source_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def source_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.source_hash(F.col("text")).alias("hash"))


@query("verbatim_match", "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def verbatim_match(spark, sf_dir):
    return T.verbatim(_docs(spark, sf_dir), read(spark, sf_dir, "BENCHMARK"))


@query("table_mention", "SELECT doc_id, name AS \"table\" FROM documents, (VALUES ('ORDER', 'orders?'), ('PART', 'parts?'), ('LICENSE', 'licenses?')) v(name, form) WHERE regexp_matches(lower(text), '\\b(' || form || ')\\b')")
def table_mention(spark, sf_dir):
    return T.mentions(_docs(spark, sf_dir), "doc_id", "text", ["ORDER", "PART", "LICENSE"])


@query("sliding_spans", "WITH w AS (SELECT conv_id, turn, regexp_split_to_array(trim(text), '\\s+') AS w FROM conversations), s AS (SELECT conv_id, turn, size, w, unnest(generate_series(0, greatest(len(w) - size, 0), size // 2)) AS start FROM w, (VALUES (12), (24), (40), (64), (96)) v(size)) SELECT conv_id, turn, size, start::INTEGER AS start, array_to_string(w[start + 1:start + size], ' ') AS span FROM s WHERE length(array_to_string(w[start + 1:start + size], ' ')) >= 20")
def sliding_spans(spark, sf_dir):
    return T.spans(read(spark, sf_dir, "CONVERSATIONS"), ["conv_id", "turn"], "text")


_WEIGHT = "(1 + ln(c)) * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1)"


@query(
    "tfidf_topk",
    f"WITH t AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')) AS term FROM benchmark) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1), r AS (SELECT item_id, term, {_WEIGHT} AS w FROM t JOIN f USING (term)), i AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM r), q AS (SELECT doc_id, term, {_WEIGHT} AS w FROM (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]*')) AS term FROM documents) GROUP BY 1, 2) JOIN f USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM q GROUP BY 1), s AS (SELECT doc_id, item_id, round(sum(q.w * i.w) / any_value(norm), 6) AS score FROM q JOIN i USING (term) JOIN n USING (doc_id) GROUP BY 1, 2) SELECT doc_id, item_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id)::INTEGER AS place FROM s QUALIFY place <= 3",
)
def tfidf_topk(spark, sf_dir):
    items = read(spark, sf_dir, "BENCHMARK")
    return T.top_matches(T.tfidf(items, "item_id", "text"), "item_id", _docs(spark, sf_dir), "doc_id", "text", items, "text")


@query("token_openings", "SELECT opening, count(*) AS n FROM (SELECT array_to_string(regexp_split_to_array(trim(lower(text)), '\\s+')[1:6], ' ') AS opening FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def token_openings(spark, sf_dir):
    return T.openings(_docs(spark, sf_dir).where("text IS NOT NULL"))


@query("discreteness", "SELECT 'l_quantity' AS name, avg((l_quantity = round(l_quantity))::INT) >= 0.95 AND count(DISTINCT l_quantity) <= 500 AS discrete FROM lineitem UNION ALL SELECT 'l_extendedprice', avg((l_extendedprice = round(l_extendedprice))::INT) >= 0.95 AND count(DISTINCT l_extendedprice) <= 500 FROM lineitem")
def discreteness(spark, sf_dir):
    rows = read(spark, sf_dir, "LINEITEM")
    found = D.summarize(rows, ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(n, bool(s["share_whole"] >= 0.95 and D.distinct_up_to(rows, n) <= 500)) for n, s in found.items()], "name string, discrete boolean")


# embeddings

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("cosine_pairs", f"SELECT a.vec_id AS query, b.vec_id AS row, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 50 = 0 AND {_COS} >= 0.3")
def cosine_pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "EMBEDDINGS")
    return V.pairs(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", "label", 0.3).withColumn("cosine", F.round("cosine", 6))


@query("similarity_stats", f"SELECT a.label AS shard, any_value(n) AS n, round(avg({_COS}), 6) AS mean_cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) c ON c.label = a.label GROUP BY 1")
def similarity_stats(spark, sf_dir):
    return V.pair_moments(read(spark, sf_dir, "EMBEDDINGS"), "embedding", "label").withColumn("mean_cosine", F.round("mean_cosine", 6))


# facts


@query("token_estimate", "SELECT doc_id, (floor(length(text) / 4) + 8)::INTEGER AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", A.token_estimate(F.col("text")).alias("tokens"))


@query("uncovered_facts", "SELECT doc_id AS fact_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncovered_facts(spark, sf_dir):
    return A.uncovered(_docs(spark, sf_dir).select(F.col("doc_id").alias("fact_id")), read(spark, sf_dir, "LABELS").select(F.col("doc_id").alias("fact_id")))


@query("fact_registry", "SELECT \"table\", string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS facts FROM (SELECT r_name AS \"table\", n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def fact_registry(spark, sf_dir):
    of = read(spark, sf_dir, "NATION").join(read(spark, sf_dir, "REGION"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.registry(of.select(F.col("r_name").alias("table"), F.col("n_nationkey").alias("fact_id"))).withColumn("facts", F.array_join("facts", ","))


@query("fact_allocation", "WITH m AS (SELECT doc_id AS fact_id, CASE name WHEN 'LICENSE' THEN 1 ELSE 0 END AS shard FROM documents, (VALUES ('ORDER', 'orders?'), ('PART', 'parts?'), ('LICENSE', 'licenses?')) v(name, form) WHERE regexp_matches(lower(text), '\\b(' || form || ')\\b')) SELECT DISTINCT fact_id, shard FROM m UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT fact_id FROM m)")
def fact_allocation(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumnRenamed("doc_id", "fact_id")
    shards = spark.createDataFrame([("ORDER", 0), ("PART", 0), ("LICENSE", 1)], "table string, shard int")
    return A.allocated(T.mentions(docs, "fact_id", "text", ["ORDER", "PART", "LICENSE"]), shards, docs)


_NORMAL = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"


@query("external_filter", f"WITH d AS (SELECT doc_id, {_NORMAL} AS t FROM documents), f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY 1) SELECT doc_id AS fact_id, CASE WHEN doc_id > first THEN 'DUPLICATE' WHEN doc_id % 7 = 0 THEN 'SELF_REFERENCE' WHEN doc_id - doc_id % 7 NOT IN (SELECT doc_id FROM labels) THEN 'INVALID_REFERENCE' END AS rejection FROM d JOIN f USING (t)")
def external_filter(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("fact_id"), F.col("text").alias("fact"), F.expr("array(doc_id - doc_id % 7)").alias("refs"), F.lit(None).cast("string").alias("kind"))
    known = read(spark, sf_dir, "LABELS").select(F.col("doc_id").alias("fact_id"))
    return A.filter_external(docs, known).select("fact_id", "rejection")


@query(
    "fact_packing",
    """WITH RECURSIVE f AS (SELECT conv_id, turn, text, (length(coalesce(text, '')) // 4 + 8)::INTEGER AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations),
    p AS (SELECT conv_id, nth, 0 AS chunk, CASE WHEN tokens > 64 THEN -1 ELSE tokens END AS used FROM f WHERE nth = 1
      UNION ALL SELECT f.conv_id, f.nth, CASE WHEN p.used = -1 OR f.tokens > 64 OR p.used + f.tokens > 64 THEN p.chunk + 1 ELSE p.chunk END,
        CASE WHEN f.tokens > 64 THEN -1 WHEN p.used = -1 OR p.used + f.tokens > 64 THEN f.tokens ELSE p.used + f.tokens END
      FROM p JOIN f ON f.conv_id = p.conv_id AND f.nth = p.nth + 1)
    SELECT conv_id AS doc_id, turn AS start, turn AS "end", turn AS fact_id, text AS fact, tokens, chunk FROM f JOIN p USING (conv_id, nth)""",
)
def fact_packing(spark, sf_dir):
    turns = read(spark, sf_dir, "CONVERSATIONS").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("start"), F.col("turn").alias("end"), F.col("turn").alias("fact_id"), F.col("text").alias("fact"))
    return P.packed(turns, 64)


@query("file_faults", "SELECT 'outside' AS fault, doc_id::VARCHAR AS value, count(*) AS n FROM documents WHERE doc_id NOT BETWEEN 0 AND 100 GROUP BY 2 UNION ALL SELECT 'repeated id', doc_id::VARCHAR, count(*) FROM documents GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'repeated text', sha256(text), count(*) FROM documents WHERE text IS NOT NULL GROUP BY 2 HAVING count(*) > 1")
def file_faults(spark, sf_dir):
    return A.file_faults(_docs(spark, sf_dir), 0, 100, key="doc_id")


@query("schema_patch_rows", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name AS name, NULL::BIGINT AS size FROM nation")
def schema_patch_rows(spark, sf_dir):
    rows, c = {"NATION": read(spark, sf_dir, "NATION")}, TESTDATA
    for p in ({"action": "rename_column", "table": "NATION", "column": "n_name", "to": "name"}, {"action": "delete_column", "table": "NATION", "column": "n_regionkey"}, {"action": "change_type", "table": "NATION", "column": "n_nationkey", "type": "VARCHAR"}, {"action": "add_column", "table": "NATION", "column": "size", "type": "INTEGER"}):
        rows, c = patches.tables(rows, c, p), patches.apply(c, [p])[0]
    return rows["NATION"]


@query("unique_faults", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_faults(spark, sf_dir):
    return K.repeated_keys(read(spark, sf_dir, "LINEITEM"), ["l_orderkey", "l_linenumber"])


@query("coverage_report", "SELECT kind, count(event_type) AS n FROM (SELECT DISTINCT event_type AS kind FROM events UNION SELECT 'refund') LEFT JOIN events ON event_type = kind GROUP BY 1")
def coverage_report(spark, sf_dir):
    return audit.coverage(read(spark, sf_dir, "EVENTS"), "event_type", ["refund"])


# extracted items


@query("derived_column", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) / nullif(l_quantity, 0) AS unit_price FROM lineitem")
def derived_column(spark, sf_dir):
    net = Arith("*", Col("l_extendedprice"), Arith("-", Lit(1), Col("l_discount")))
    item = extraction.Derived("LINEITEM", "unit_price", Arith("/", net, Col("l_quantity")), (1,))
    return item.of(read(spark, sf_dir, "LINEITEM")).select("l_orderkey", "l_linenumber", "l_partkey", "unit_price")


@query("bridged_condition", "SELECT count(*) AS n, count(*) FILTER (o_totalprice >= 100000) AS held FROM orders WHERE o_orderstatus IN ('F', 'O')")
def bridged_condition(spark, sf_dir):
    over, holds = extraction.bridged({"table": "ORDERS", "column": "o_totalprice", "op": "gte", "value": 100000, "if": {"column": "o_orderstatus", "op": "in", "values": ["F", "O"]}})
    rows = compiled(over, TESTDATA, lambda t: read(spark, sf_dir, t))
    return rows.agg(F.count("*").alias("n"), F.count_if(column(holds)).alias("held"))


@query("latent_thresholds", "SELECT grade, count(*) AS n FROM (SELECT CASE WHEN (c_acctbal - m) / s < -0.674489750196 THEN 'low' WHEN (c_acctbal - m) / s < 0.674489750196 THEN 'middle' ELSE 'high' END AS grade FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)) GROUP BY 1")
def latent_thresholds(spark, sf_dir):
    rows = read(spark, sf_dir, "CUSTOMER")
    m = rows.agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"))
    latent = (F.col("c_acctbal") - F.col("m")) / F.col("s")
    grade = extraction.by_cut_points(latent, extraction.cut_points([0.25, 0.5, 0.25]), ["low", "middle", "high"])
    return rows.crossJoin(F.broadcast(m)).groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))


# facts, drafts and segments


@query("segment_adjacency", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.5::DOUBLE ELSE 1 / (1 + abs(event_id - user_id)) END AS adjacency FROM events")
def segment_adjacency(spark, sf_dir):
    unknown = F.when(F.col("event_id") % 10 != 0, F.col("event_id"))
    return read(spark, sf_dir, "EVENTS").select("event_id", V.adjacency(unknown, F.col("user_id")).alias("adjacency"))


@query("cross_references", "WITH f AS (SELECT o_custkey AS segment, o_orderkey AS fact_id, o_orderkey + unnest([1, 2]) AS ref FROM orders) SELECT DISTINCT least(x.segment, y.o_custkey) AS a, greatest(x.segment, y.o_custkey) AS b FROM f x JOIN orders y ON x.ref = y.o_orderkey WHERE x.segment <> y.o_custkey")
def cross_references(spark, sf_dir):
    rows = read(spark, sf_dir, "ORDERS").select(F.col("o_custkey").alias("segment"), F.col("o_orderkey").alias("fact_id"), F.expr("array(o_orderkey + 1, o_orderkey + 2)").alias("refs"))
    return V.cross_references(rows)


@query("best_draft", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', event_id % 3, event_id DESC) = 1")
def best_draft(spark, sf_dir):
    rows = read(spark, sf_dir, "EVENTS").select("user_id", "event_id", F.col("event_id").alias("iteration"), (F.col("event_type") == "error").alias("rejected"), (F.col("event_id") % 3).alias("findings"))
    return A.best_drafts(rows, "user_id").select("user_id", "event_id")


@query("kept_items", "WITH i AS (SELECT l_orderkey AS item_id, list_sort(list_distinct(list(l_partkey))) AS refs FROM lineitem GROUP BY 1) SELECT min(item_id) AS item_id FROM i WHERE NOT list_has_any(refs, (SELECT list(p_partkey) FROM part WHERE p_size < 5)) GROUP BY refs")
def kept_items(spark, sf_dir):
    items = read(spark, sf_dir, "LINEITEM").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_set("l_partkey").alias("refs"))
    return A.kept_items(items, read(spark, sf_dir, "PART").where("p_size < 5").select(F.col("p_partkey").alias("fact_id"))).select("item_id")


@query("origin_match")
def origin_match(spark, sf_dir):
    """Each whole text as a fact whose origin is said to be the first sentence of the next document, so spans are scored for nearly all."""
    docs = _docs(spark, sf_dir).where("text IS NOT NULL")
    first = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.try_element_at(T.sentences(F.col("text")), F.lit(1)).alias("origin"))
    claims = docs.select(F.col("doc_id").alias("claim_id"), "doc_id", F.col("text").alias("fact")).join(first, "doc_id", "left")
    return T.origins(claims, docs)


# rows by specification


@query("generated_sums", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def generated_sums(spark, sf_dir):
    """Each customer's total is dealt anew to its orders: parts add up to it."""
    orders = read(spark, sf_dir, "ORDERS")
    whole = orders.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("total"))
    rows = G.children(whole, "o_custkey", F.col("k"), "o_custkey").join(whole.select("o_custkey", "total"), "o_custkey")
    dealt = G.split_sum(rows, "o_custkey", "total", "part", 7, "o_custkey", "number")
    return dealt.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("part"), 2).alias("total"))


@query("generated_rows")
def generated_rows(spark, sf_dir):
    n = read(spark, sf_dir, "CUSTOMER").count()
    spec = {
        "parent": {"parent": n},
        "amount": {"family": "lognormal", "params": {"mu": 3, "sigma": 0.5}},
        "items": {"family": "poisson", "params": {"lambda": 4}},
        "state": {"family": "categorical", "params": {"weights": {"open": 3, "closed": 1}}},
        "each": {"expression": Arith("/", Col("amount"), Col("items"))},
        "fee": {"if": Compare("=", Col("state"), Lit("open")), "then": {"expression": Lit(0.0)}, "else": {"family": "uniform", "params": {"low": 1, "high": 2}}},
    }
    return G.table(spark, 10 * n, "id", spec)


# conceptual models

@query("multivalued_rows", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL")
def multivalued_rows(spark, sf_dir):
    """The suppliers of an order as an attribute of many values, and then as a table of its own."""
    held = read(spark, sf_dir, "LINEITEM").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("l_suppkey"))
    return conceptual.spread(held, ["l_orderkey"], "l_suppkey")


@query("name_mentions", "WITH w AS (SELECT DISTINCT doc_id, CASE WHEN length(x) >= 4 AND x LIKE '%s' AND x NOT LIKE '%ss' AND NOT (length(x) >= 5 AND regexp_matches(x, '(ies|ses|xes|zes|ches|shes)$')) THEN x[:-2] WHEN length(x) >= 5 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN length(x) >= 5 AND regexp_matches(x, '(ses|xes|zes|ches|shes)$') THEN x[:-3] ELSE x END AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM documents)) SELECT doc_id, name FROM w JOIN (VALUES ('LICENSE', 'license'), ('OPEN_SOURCE', 'open'), ('OPEN_SOURCE', 'source'), ('THE', 'the')) n(name, word) ON w = word GROUP BY 1, 2 HAVING count(*) = CASE name WHEN 'OPEN_SOURCE' THEN 2 ELSE 1 END")
def name_mentions(spark, sf_dir):
    names = spark.createDataFrame([("LICENSE",), ("OPEN_SOURCE",), ("THE",)], "name string")
    return audit.mentions(_docs(spark, sf_dir), "doc_id", "text", names)


@query("segment_faults", "WITH s AS (SELECT item_id, text AS said FROM benchmark WHERE length(text) > 0) SELECT doc_id AS segment_id, CASE WHEN len(regexp_split_to_array(trim(said, ' '), '\\s+')) <= 3 OR length(said) < 15 THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM documents JOIN s ON item_id = doc_id WHERE NOT coalesce(contains(text, said), false)")
def segment_faults(spark, sf_dir):
    """Benchmark items taken for segments of the documents of the same number."""
    docs = _docs(spark, sf_dir)
    items = read(spark, sf_dir, "BENCHMARK").select(F.col("item_id").alias("doc_id"), "text").join(docs.select("doc_id"), "doc_id", "left_semi")
    return T.segment_faults(items.withColumn("segment_id", F.col("doc_id")), docs)


@query("registry_deletion", "SELECT r_name AS \"table\", string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS facts FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1")
def registry_deletion(spark, sf_dir):
    rows = read(spark, sf_dir, "NATION").join(read(spark, sf_dir, "REGION"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("table"), F.col("n_nationkey").alias("fact_id"))
    return A.registry(A.registry_without(rows, ["Asia"])).select("table", F.array_join(F.transform("facts", lambda x: x.cast("string")), ",").alias("facts"))


@query("generated_means", "SELECT o_custkey, true AS mean_holds, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1")
def generated_means(spark, sf_dir):
    """Values drawn anew for each customer's orders, moved to the customer's mean; and others, led by the customer's greatest."""
    orders = read(spark, sf_dir, "ORDERS").select("o_custkey", "o_orderkey", "o_totalprice")
    stated = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.max("o_totalprice").alias("t"))
    drawn = orders.join(stated, "o_custkey").withColumn("x", G.draw("normal", {"mean": 0, "std": 10}, "x", 3, "o_orderkey")).withColumn("y", G.draw("uniform", {"low": 0, "high": 1e6}, "y", 3, "o_orderkey"))
    out = G.with_maximum(G.with_mean(drawn, "o_custkey", "m", "x"), "o_custkey", "t", "y", "o_orderkey")
    return out.groupBy("o_custkey").agg((F.abs(F.avg("x") - F.avg("o_totalprice")) < 1e-6).alias("mean_holds"), F.round(F.max("y"), 2).alias("top"))


# the law of total variance, as a conflict over rows


@query(
    "total_variance_conflict",
    """WITH p AS (SELECT DISTINCT o_orderstatus AS part FROM orders),
    m AS (SELECT part, count(o_totalprice) FILTER (o_orderstatus IS NOT DISTINCT FROM part) AS k, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v,
      avg(o_totalprice) FILTER (o_orderstatus IS NOT DISTINCT FROM part) AS m1, var_pop(o_totalprice) FILTER (o_orderstatus IS NOT DISTINCT FROM part) AS v1,
      avg(o_totalprice) FILTER (o_orderstatus IS DISTINCT FROM part) AS m2, var_pop(o_totalprice) FILTER (o_orderstatus IS DISTINCT FROM part) AS v2 FROM orders, p GROUP BY part),
    s AS (SELECT *, (m - m2) / (m1 - m2) AS a, (2 * greatest(m, m1, m2) - m2) / (m1 - m2) AS b FROM m)
    SELECT part, k, round(m1, 4) AS mean, round(v1, 1) AS variance, round(m2, 4) AS rest_mean, round(v2, 1) AS rest_variance,
      a < -1e-6 OR a > 1 + 1e-6 OR abs(v - (a * v1 + (1 - a) * v2 + a * (1 - a) * (m1 - m2) ** 2)) > 1e-3 * greatest(v, a * v1 + (1 - a) * v2 + a * (1 - a) * (m1 - m2) ** 2) AS stated_conflict,
      b < -1e-6 OR b > 1 + 1e-6 OR abs(v - (b * v1 + (1 - b) * v2 + b * (1 - b) * (m1 - m2) ** 2)) > 1e-3 * greatest(v, b * v1 + (1 - b) * v2 + b * (1 - b) * (m1 - m2) ** 2) AS shifted_conflict FROM s""",
)
def total_variance_conflict(spark, sf_dir):
    """Of each order status: whether its moments, those of the rest and of the whole contradict each other as they are, and with a mean of the whole beyond both."""
    of = M.parts(read(spark, sf_dir, "ORDERS"), "o_orderstatus", "o_totalprice")
    far = F.greatest("w_mean", "mean", "r_mean") * 2
    numbers = [F.round("mean", 4).alias("mean"), F.round("variance", 1).alias("variance"), F.round("r_mean", 4).alias("rest_mean"), F.round("r_variance", 1).alias("rest_variance")]
    return of.select("part", F.col("n").alias("k"), *numbers, M.contradict(F.col("w_mean"), F.col("w_variance")).alias("stated_conflict"), M.contradict(far, F.col("w_variance")).alias("shifted_conflict"))


@query(
    "transition_verdicts",
    "SELECT from_state, to_state, count(*) AS n, CASE WHEN from_state = 'error' AND to_state = 'purchase' THEN 'forbidden' WHEN to_state = 'click' OR (from_state = 'signup' AND to_state = 'view') THEN 'allowed' ELSE 'unlisted' END AS verdict "
    "FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events) WHERE from_state IS NOT NULL GROUP BY 1, 2",
)
def transition_verdicts(spark, sf_dir):
    kinds = ("click", "error", "purchase", "signup", "view")
    allowed = [*((k, "click") for k in kinds), ("signup", "view"), ("error", "purchase")]
    return K.transition_verdicts(read(spark, sf_dir, "EVENTS"), "user_id", ["ts", "event_id"], "event_type", allowed, [("error", "purchase")])
