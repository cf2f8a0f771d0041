"""Registered queries of readers and of plans over rows, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.operators import distributions as D
from relspan.operators.satisfy import verdicts
from relspan.plans import patches, paths, rowcounts, sql
from relspan.plans.catalog import TESTDATA, Catalog, Column, ForeignKey, Table, read
from relspan.plans.relation import Base, Col, Compare, Either, Filter, IfThen, Join, Lit, Project, compiled
from relspan.sources import readers
from relspan.sources.shared import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return add


# sources: each table is written in the format and read back


@query("pipe_rows", "SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def pipe_rows(spark, sf_dir):
    path = scratch(spark, "pipe")
    read(spark, sf_dir, "NATION").select(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey", F.lit(""))).write.text(path)
    return readers.pipe_table(spark, path, ["key", "name", "region"])


@query("tab_rows", "SELECT p_partkey::VARCHAR AS key, CASE WHEN p_size > 25 THEN '' ELSE p_brand END AS brand, TRY_CAST(p_size AS DOUBLE) AS size FROM part")
def tab_rows(spark, sf_dir):
    path = scratch(spark, "tab")
    rows = read(spark, sf_dir, "PART").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 25, "\\N").otherwise(F.col("p_brand")).alias("brand"), F.col("p_size").alias("size"))
    rows.write.option("compression", "gzip").csv(path, sep="\t", header=True, quote="")
    text = readers.tab_table(spark, path)
    sizes = readers.numeric_columns(text.select("key", "size"), ["key", "size"])
    return text.select("key", "brand").join(sizes.select(F.col("key").cast("long").cast("string").alias("key"), "size"), "key")


_CASES = "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS text FROM events"


def _cases(spark, sf_dir):
    path = scratch(spark, "cases")
    rows = read(spark, sf_dir, "EVENTS")
    good = rows.where("event_id % 5 <> 0").select(F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("text"))))
    bad = rows.where("event_id % 5 = 0").select(F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "te')))
    good.union(bad).union(rows.limit(3).select(F.lit("  "))).write.text(path)
    return readers.cases(spark, path, "id long, text string")


@query("case_rows", f"{_CASES} WHERE event_id % 5 <> 0")
def case_rows(spark, sf_dir):
    return _cases(spark, sf_dir)[0]


@query("bad_lines", "SELECT '{\"id\": ' || event_id || ', \"te' AS line FROM events WHERE event_id % 5 = 0")
def bad_lines(spark, sf_dir):
    return _cases(spark, sf_dir)[1]


@query("specification_text", "SELECT string_agg(r_name || chr(10), '' ORDER BY r_regionkey) AS text FROM region")
def specification_text(spark, sf_dir):
    path = scratch(spark, "text")
    read(spark, sf_dir, "REGION").orderBy("r_regionkey").coalesce(1).select("r_name").write.text(path)
    return readers.specification(spark, f"{path}/part-*").select("text")


@query("staged_rows", "SELECT s_suppkey, s_name FROM supplier")
def staged_rows(spark, sf_dir):
    """A stage that is made once and read the second time."""
    folder = scratch(spark, "stages")
    make = lambda: read(spark, sf_dir, "SUPPLIER").select("s_suppkey", "s_name")
    readers.stage(spark, folder, "suppliers", make)

    def never() -> DataFrame:
        raise AssertionError("a complete stage is made again")

    return readers.stage(spark, folder, "suppliers", never)


@query("mined_lines", "SELECT 'o_totalprice' AS \"column\", 'uniform' AS family, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def mined_lines(spark, sf_dir):
    path = scratch(spark, "mined")
    p = D.estimate("uniform", D.summarize(read(spark, sf_dir, "ORDERS"), ["o_totalprice"], ("uniform",))["o_totalprice"])
    readers.write_mined(spark.createDataFrame([("o_totalprice", "uniform", float(p["low"]), float(p["high"]))], "`column` string, family string, low double, high double"), path)
    return spark.read.schema("`column` string, family string, low double, high double").json(path)


# relations and constraints


@query("relation_counts", "SELECT 'ORDERS' AS unknown, count(*) AS n FROM orders UNION ALL SELECT 'filtered1', count(*) FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 'grouped1', count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 100000")
def relation_counts(spark, sf_dir):
    c = rowcounts.Counts()
    rowcounts.rows(sql.parse("SELECT o_custkey, COUNT(*) AS n FROM ORDERS JOIN CUSTOMER ON ORDERS.o_custkey = CUSTOMER.c_custkey WHERE o_totalprice > 100000 GROUP BY o_custkey"), TESTDATA, c)
    return spark.createDataFrame(list(rowcounts.observed(c, TESTDATA, lambda t: read(spark, sf_dir, t)).items()), "unknown string, n long")


@query("implication_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 50000")
def implication_rows(spark, sf_dir):
    tree = Project(Filter(Base("ORDERS"), IfThen(Compare("=", Col("o_orderstatus"), Lit("F")), Compare(">", Col("o_totalprice"), Lit(50000)))), ((Col("o_orderkey"), "o_orderkey"),))
    return compiled(tree, TESTDATA, lambda t: read(spark, sf_dir, t))


_NATIONS = Catalog({"NATION": TESTDATA.tables["NATION"], "TWIN": Table("TWIN", (Column("n_nationkey", "INTEGER"), Column("n_name", "VARCHAR"), Column("twin", "INTEGER", True)), ("n_nationkey",))}, [ForeignKey("TWIN", "twin", "TWIN")])


@query("self_join", "SELECT a.n_nationkey, a.n_name, b.n_name AS twin_name FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey")
def self_join(spark, sf_dir):
    """Each nation and the nation whose key is its region's."""
    tree = Project(Join(Base("TWIN"), Base("TWIN", "b"), ("TWIN", "twin"), ("b", "n_nationkey")), ((Col("n_nationkey"), "n_nationkey"), (Col("n_name"), "n_name"), (Col("b.n_name"), "twin_name")))
    return compiled(tree, _NATIONS, lambda t: read(spark, sf_dir, "NATION").withColumnRenamed("n_regionkey", "twin"))


@query("lookup_both_sides", "SELECT count(*) FILTER (c_acctbal > o_totalprice / 100) AS satisfied, count(*) FILTER (NOT c_acctbal > o_totalprice / 100) AS violated FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_both_sides(spark, sf_dir):
    orders = read(spark, sf_dir, "ORDERS").withColumn("share", F.col("o_totalprice") / 100)
    c = {"op": "gt", "column": "c_acctbal", "lhs_join": {"table": "CUSTOMER", "fk": "o_custkey", "key": "c_custkey"}, "rhs_column": "share"}
    return verdicts(orders, {"c": c}, lambda t: read(spark, sf_dir, t)).select("satisfied", "violated")


_LOOSE = Catalog(
    TESTDATA.tables | {"ORDERS": Table("ORDERS", tuple(Column(c.name, c.type, c.nullable or c.name == "o_custkey") for c in TESTDATA.tables["ORDERS"].columns), TESTDATA.tables["ORDERS"].key)},
    TESTDATA.links,
)


@query(
    "presence_rows",
    "SELECT o_orderkey, o_totalprice < 100000 AS known, CASE WHEN o_totalprice < 100000 THEN c_name END AS c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 100000 OR c_acctbal > 5000",
)
def presence_rows(spark, sf_dir):
    """Orders whose customer is null, and those of rich ones: presence as a column of filters and of projections."""

    def tables(t: str) -> DataFrame:
        rows = read(spark, sf_dir, t)
        return rows.withColumn("o_custkey", F.when(F.col("o_totalprice") < 100000, F.col("o_custkey"))) if t == "ORDERS" else rows

    there = Col("o_custkey.is_present")
    rich = Filter(Join(Base("ORDERS"), Base("CUSTOMER"), ("ORDERS", "o_custkey"), ("CUSTOMER", "c_custkey")), Either((Compare("=", there, Lit(False)), Compare(">", Col("c_acctbal"), Lit(5000)))))
    return compiled(Project(rich, ((Col("o_orderkey"), "o_orderkey"), (there, "known"), (Col("c_name"), "c_name"))), _LOOSE, tables)


@query("path_up", "SELECT o_orderkey, n_name AS \"o_custkey.c_nationkey.n_name\" FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def path_up(spark, sf_dir):
    """The nation of each order, two links up."""
    return paths.along(TESTDATA, lambda t: read(spark, sf_dir, t), "ORDERS", "NATION", "n_name").select("o_orderkey", "`o_custkey.c_nationkey.n_name`")


@query("path_down", "SELECT n_nationkey, n_name, n_regionkey, avg(o_totalprice) AS \"CUSTOMER[c_nationkey].ORDERS[o_custkey].o_totalprice\" FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def path_down(spark, sf_dir):
    """The mean of all orders of each nation, two links down: aggregated by foreign key before each join."""
    out = paths.along(TESTDATA, lambda t: read(spark, sf_dir, t), "NATION", "ORDERS", "o_totalprice", "AVG")
    return out.select(*out.columns[:3], F.col(f"`{out.columns[3]}`"))


@query("rerooted_count", "SELECT c_custkey, count(o_orderkey) AS \"ORDERS[o_custkey].o_orderkey\" FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def rerooted_count(spark, sf_dir):
    """An aggregate by a foreign key at the grain of the parent: customers without orders have a row too."""
    out = paths.along(TESTDATA, lambda t: read(spark, sf_dir, t), "CUSTOMER", "ORDERS", "o_orderkey", "COUNT")
    return out.select("c_custkey", F.col(f"`{out.columns[-1]}`"))


# catalogs


@query("merged_tables", "SELECT coalesce(r_regionkey, n_nationkey) AS r_regionkey, r_name, n_nationkey, n_name, n_regionkey FROM region FULL JOIN nation ON r_regionkey = n_nationkey")
def merged_tables(spark, sf_dir):
    """Nations merged into regions by key: rows of either side stay."""
    rows = {t: read(spark, sf_dir, t).select(*(c.name for c in TESTDATA.tables[t].columns)) for t in ("REGION", "NATION")}
    c = Catalog({t: TESTDATA.tables[t] for t in rows})
    return patches.tables(rows, c, {"action": "merge_tables", "table": "NATION", "to": "REGION"})["REGION"]
