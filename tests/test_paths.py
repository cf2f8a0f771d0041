"""Columns over links, presence as a column, and populations, against plain joins."""

import pytest

from relspan.plans import paths
from relspan.plans.catalog import Catalog, Column, ForeignKey, Table
from relspan.plans.constraints import Distributed, comparable, complementary, population
from relspan.plans.relation import Base, Both, Col, Compare, Filter, Join, Lit, Negated, Project, Refused, compiled, known

SHOP = Catalog(
    {
        "SHOP": Table("SHOP", (Column("id", "INTEGER"), Column("name", "VARCHAR")), ("id",)),
        "SALE": Table("SALE", (Column("no", "INTEGER"), Column("shop", "INTEGER", True)), ("no",)),
        "ITEM": Table("ITEM", (Column("sale", "INTEGER"), Column("price", "FLOAT", True)), ()),
        "LONE": Table("LONE", (Column("id", "INTEGER"),), ("id",)),
    },
    [ForeignKey("SALE", "shop", "SHOP"), ForeignKey("ITEM", "sale", "SALE")],
)


@pytest.fixture(scope="module")
def tables(spark):
    rows = {
        "SHOP": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string"),
        "SALE": spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 2), (5, 9)], "no int, shop int"),
        "ITEM": spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 1.0), (2, None), (3, 100.0), (None, 3.0)], "sale int, price double"),
    }
    return lambda t: rows[t]


def test_paths_down_aggregate_before_they_join(tables):
    of = lambda fn: {r[0]: r[2] for r in paths.along(SHOP, tables, "SHOP", "ITEM", "price", fn).collect()}
    assert of("SUM") == {1: 13.0, 2: None, 3: None} and of("COUNT") == {1: 3, 2: 0, 3: 0}
    assert of("AVG") == {1: pytest.approx(13 / 3), 2: None, 3: None} and of("MIN") == {1: 1.0, 2: None, 3: None} and of("MAX")[1] == 7.0
    assert paths.along(SHOP, tables, "SHOP", "ITEM", "price", "SUM").columns == ["id", "name", "SALE[shop].ITEM[sale].price"]


def test_paths_up_keep_rows(tables):
    up = paths.along(SHOP, tables, "ITEM", "SHOP", "name")
    assert up.columns == ["sale", "price", "sale.shop.name"]
    assert sorted((r[0] or 0, r[2] or "") for r in up.collect()) == [(0, ""), (1, "a"), (1, "a"), (2, "a"), (2, "a"), (3, "")]


def test_refused_paths(tables):
    for end, column, fn in (("LONE", "id", None), ("ITEM", "price", None), ("ITEM", "price", "MODE"), ("ITEM", "no", "SUM")):
        with pytest.raises(Refused):
            paths.along(SHOP, tables, "SHOP", end, column, fn)


def test_presence(tables):
    there = Col("shop.is_present")
    rows = compiled(Project(Base("SALE"), ((Col("no"), "no"), (there, "has"))), SHOP, tables).collect()
    assert {r.no: r.has for r in rows} == {1: True, 2: True, 3: False, 4: True, 5: True}
    without = Filter(Base("SALE"), Compare("=", there, Lit(False)))
    assert [r.no for r in compiled(without, SHOP, tables).collect()] == [3] and known(without, SHOP).nullable["shop"]
    assert not known(Filter(Base("SALE"), Compare("=", there, Lit(True))), SHOP).nullable["shop"]
    assert not known(Project(Base("SALE"), ((Col("no"), "no"), (there, "has"))), SHOP).nullable["has"]
    for bad in (Col("no.is_present"), Col("gone.is_present")):
        with pytest.raises(Refused):
            compiled(Filter(Base("SALE"), Compare("=", bad, Lit(True))), SHOP, tables)


def test_comparable_populations():
    sale, joined = Base("SALE"), Join(Base("SALE"), Base("SHOP"), ("SALE", "shop"), ("SHOP", "id"))
    low, spread = Compare(">", Col("no"), Lit(2)), Distributed("no", "normal")
    of = lambda r: population(r, SHOP)
    assert of(joined).narrowed and not of(sale).narrowed  # the link may be null
    assert comparable(of(sale), of(joined), low) and not comparable(of(sale), of(joined), spread)
    one, other = Filter(sale, low), Filter(sale, Negated(low))
    assert comparable(of(one), of(other), low) and not comparable(of(one), of(other), spread) and comparable(of(one), of(one), spread)


def test_complements():
    a, b = Compare("=", Col("x"), Lit(1)), Compare("!=", Col("x"), Lit(1))
    assert complementary(a, b) and complementary(a, Negated(a)) and complementary(Negated(b), b) and not complementary(a, Negated(b))
    assert complementary(Both((a, b)), Negated(Both((a, b)))) and not complementary(a, Compare("!=", Col("x"), Lit(2))) and complementary(Negated(Negated(a)), b)
