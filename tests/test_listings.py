"""Plans that read no rows: what they give, beside it written down as SQL values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from relspan.operators import facts
from relspan.plans import audit, conceptual, conflicts, constraints, extraction, freedom, merging, patches, rowcounts, schema_eval, sharding, sql
from relspan.plans.catalog import TESTDATA, Catalog, Column, ForeignKey, Table
from relspan.plans.constraints import Distributed, Stated, comparable, faults, grain, population, softenable
from relspan.plans.relation import Aggregate, Base, Col, Compare, Fanout, Filter, Join, Lit, Negated, Project, Refused, known
from relspan.sources import readers

LISTINGS = {}
_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def listing(name, kinds, expected):
    """Rows of a function on the driver against SQL values."""
    names = ", ".join(f'"{x.split()[0]}"' for x in kinds.split(", "))
    typed = ", ".join(f'CAST("{n}" AS {_TYPES[k]})' for n, k in (x.split() for x in kinds.split(", ")))

    def add(f):
        LISTINGS[name] = f, f"SELECT {typed} FROM (VALUES {expected}) t({names})"
        return f

    return add


@listing("read_schema", "table string, column string, type string, parent string", "('SHOP', 'id', 'VARCHAR', NULL), ('SHOP', 'name', 'VARCHAR', NULL), ('SALE', 'id', 'VARCHAR', NULL), ('SALE', 'shop', 'VARCHAR', 'SHOP')")
def read_schema():
    c = readers.schema_of({"SHOP": {"attributes": ["id", "name"], "primary_key": ["id"]}, "SALE": {"attributes": ["id"], "primary_key": ["id"], "foreign_keys": {"shop": "SHOP"}}})
    to = {(f.table, f.column): f.parent for f in c.links}
    return [(t.name, x.name, x.type, to.get((t.name, x.name))) for t in c.tables.values() for x in t.columns]


@listing("illegal_relations", "shape string, refused boolean", "('table twice', true), ('projection without key', true), ('unknown table', true), ('text against number', true), ('average of text', true), ('a filter', false)")
def illegal_relations():
    join = lambda a, b, x, y: Join(Base("ORDERS", a), Base("CUSTOMER", b), (a or "ORDERS", x), (b or "CUSTOMER", y))
    shapes = {
        "table twice": Join(join(None, None, "o_custkey", "c_custkey"), Base("CUSTOMER"), ("ORDERS", "o_custkey"), ("CUSTOMER", "c_custkey")),
        "projection without key": Project(Base("CUSTOMER"), ((Col("c_name"), "c_name"),)),
        "unknown table": Base("NOWHERE"),
        "text against number": Filter(Base("CUSTOMER"), Compare(">", Col("c_name"), Lit(3))),
        "average of text": Aggregate(Base("CUSTOMER"), "AVG", "c_name", "a"),
        "a filter": Filter(Base("CUSTOMER"), Compare(">", Col("c_acctbal"), Lit(3))),
    }
    out = []
    for name, tree in shapes.items():
        try:
            known(tree, TESTDATA)
            out.append((name, False))
        except Refused:
            out.append((name, True))
    return out


@listing("nullability", "column string, nullable boolean", "('customer_id', true), ('region', true), ('order_id', false), ('filtered customer_id', false)")
def nullability():
    shop = Catalog({"CUSTOMER": Table("CUSTOMER", (Column("id", "INTEGER"), Column("region", "VARCHAR")), ("id",)), "ORDERING": Table("ORDERING", (Column("order_id", "INTEGER"), Column("customer_id", "INTEGER", True)), ("order_id",))}, [ForeignKey("ORDERING", "customer_id", "CUSTOMER")])
    j = Join(Base("ORDERING"), Base("CUSTOMER"), ("ORDERING", "customer_id"), ("CUSTOMER", "id"))
    k = known(j, shop)
    n = known(Filter(j, Compare("=", Col("customer_id"), Lit(1))), shop)
    return [(c, k.nullable[c]) for c in ("customer_id", "region", "order_id")] + [("filtered customer_id", n.nullable["customer_id"])]


@listing("constraint_faults", "constraint string, n int", "('normal over text', 1), ('unknown column', 1), ('negative deviation', 1), ('unknown family', 1), ('a count of 0 or more', 1), ('sound', 0), ('unknown relation', 1)")
def constraint_faults():
    price = Base("ORDERS")
    stated = {
        "normal over text": Stated(price, Distributed("o_orderstatus", "normal")),
        "unknown column": Stated(price, Distributed("x", "normal")),
        "negative deviation": Stated(price, Distributed("o_totalprice", "normal", (("std", -1.0),))),
        "unknown family": Stated(price, Distributed("o_totalprice", "odd")),
        "a count of 0 or more": Stated(Fanout(Base("CUSTOMER"), price, "o_custkey"), Compare(">=", Col("child_count"), Lit(0))),
        "sound": Stated(price, Distributed("o_totalprice", "normal", (("std", 1.0),))),
        "unknown relation": Stated(Base("X"), Compare(">", Col("x"), Lit(1))),
    }
    return [(k, len(faults(s, TESTDATA))) for k, s in stated.items()]


@listing("softenable_conditions", "condition string, soft boolean", "('distribution', true), ('moment', true), ('plain', false)")
def softenable_conditions():
    o = Base("ORDERS")
    return [("distribution", softenable(Stated(o, Distributed("o_totalprice", "normal")))), ("moment", softenable(Stated(Aggregate(o, "AVG", "o_totalprice", "m"), Compare("=", Col("m"), Lit(1.0))))), ("plain", softenable(Stated(o, Compare(">", Col("o_totalprice"), Lit(0)))))]


@listing("populations", "pair string, by_row boolean, by_distribution boolean", "('same', true, true), ('narrowed', true, false), ('complements', true, false), ('other table', false, false), ('joined', true, true)")
def populations():
    o, p = Base("ORDERS"), Compare("=", Col("o_orderstatus"), Lit("F"))
    joined = Join(o, Base("CUSTOMER"), ("ORDERS", "o_custkey"), ("CUSTOMER", "c_custkey"))
    pairs = {"same": (o, o), "narrowed": (o, Filter(o, p)), "complements": (Filter(o, p), Filter(o, Negated(p))), "other table": (o, Base("PART")), "joined": (o, joined)}
    row, soft = p, Distributed("o_totalprice", "normal")
    return [(k, *(comparable(population(a, TESTDATA), population(b, TESTDATA), c) for c in (row, soft))) for k, (a, b) in pairs.items()]


@listing("grains", "relation string, table string, kind string", "('rows', 'ORDERS', 'rows'), ('by own key', 'ORDERS', 'rows'), ('by foreign key', 'CUSTOMER', 'rows'), ('mode by foreign key', 'ORDERS', 'groups'), ('by status', 'ORDERS', 'groups'), ('whole', 'ORDERS', 'one'), ('fan-out', 'CUSTOMER', 'rows')")
def grains():
    o = Base("ORDERS")
    by = lambda fn, *b: Aggregate(o, fn, "o_totalprice", "x", b)
    shapes = {"rows": o, "by own key": by("SUM", "o_orderkey"), "by foreign key": by("SUM", "o_custkey"), "mode by foreign key": by("MODE", "o_custkey"), "by status": by("SUM", "o_orderstatus"), "whole": by("SUM"), "fan-out": Fanout(Base("CUSTOMER"), o, "o_custkey")}
    return [(n, g.table, g.kind) for n, r in shapes.items() for g in [grain(r, TESTDATA)]]


@listing("implied_moments", "family string, mean double, variance double", "('normal', 3.0, 4.0), ('lognormal', 1.648721, 4.670774), ('beta', 0.4, 0.04), ('poisson', 6.0, 6.0), ('uniform', 5.0, 3.0)")
def implied_moments():
    given = {"normal": {"mean": 3.0, "std": 2.0}, "lognormal": {"mu": 0.0, "sigma": 1.0}, "beta": {"alpha": 2.0, "beta": 3.0}, "poisson": {"lambda": 6.0}, "uniform": {"low": 2.0, "high": 8.0}}
    return [(f, *(round(conflicts.implied(f, p)[k], 6) for k in ("MEAN", "VARIANCE"))) for f, p in given.items()]


@listing("freedom_blocks", "kind string, equations int, unknowns int", "('over', 2, 1), ('loose', 1, 2), ('square', 2, 2)")
def freedom_blocks():
    found = freedom.blocks({"a": {"x"}, "b": {"x"}, "c": {"y", "z"}, "d": {"v", "w"}, "e": {"w"}})
    return [(b.kind, len(b.equations), len(b.unknowns)) for b in found]


@listing("derived_cycles", "columns string, says string", "('a b', 'contradiction'), ('c d', 'identity'), ('e', 'fixed'), ('f g', 'unverifiable')")
def derived_cycles():
    derived = {"a": ({"b": 1}, 1), "b": ({"a": 1}, 0), "c": ({"d": 2}, 1), "d": ({"c": 0.5}, -0.5), "e": ({"e": 3}, 1), "f": {"g"}, "g": {"f"}}
    return [(" ".join(sorted(c)), s) for c, s in rowcounts.cycles(derived)]


@listing("conflict_groups", "group string", "('a c d'), ('b'), ('e')")
def conflict_groups():
    return [(" ".join(sorted(g)),) for g in freedom.grouped({"a": {"t"}, "b": {"u"}, "c": {"t", "v"}, "d": {"v"}, "e": set()})]


@listing("branches", "condition string, categories string", "('eq', 'P'), ('in', 'F P'), ('neq', 'F P'), ('neq of unknown', NULL), ('lt', NULL)")
def branches():
    key = ("ORDERS", "o_orderstatus")
    f = extraction.Forks([(key, ["F", "O"]), (key, ["O", "P"])])
    got = {"eq": f.branch(key, "eq", ["P"]), "in": f.branch(key, "in", ["P", "F", "X"]), "neq": f.branch(key, "neq", ["O"]), "neq of unknown": f.branch(("A", "b"), "neq", ["x"]), "lt": f.branch(key, "lt", ["O"])}
    return [(k, None if v is None else " ".join(v)) for k, v in got.items()]


@listing("condition_texts", "text string, op string, values string", "('T.c = ''a''', 'eq', 'a'), ('T.c != b', 'neq', 'b'), ('T.c IN (''a'', ''b'')', 'in', 'a b'), ('T.c > 3', NULL, NULL)")
def condition_texts():
    out = []
    for text in ("T.c = 'a'", "T.c != b", "T.c IN ('a', 'b')", "T.c > 3"):
        got = extraction.parse_condition(text)
        out.append((text, *((None, None) if got is None else (got[1], " ".join(got[2])))))
    return out


@listing("merged_bounds", "column string, low double, high double, categories string", "('p_size', 4.0, 9.0, NULL), ('p_brand', NULL, NULL, 'b')")
def merged_bounds():
    item = lambda c, op, **k: {"table": "PART", "column": c, "op": op, **k}
    got = extraction.variables([item("p_size", "gt", value=3), item("p_size", "lte", value=9), item("p_brand", "in", values=["a", "b"]), item("p_brand", "eq", value="b")], TESTDATA)
    plain = lambda x: None if x in (float("inf"), float("-inf")) else float(x)
    return [(c, plain(v.low), plain(v.high), None if v.categories is None else " ".join(sorted(v.categories))) for (_, c), v in got.items()]


@listing("raw_sql_in_trees", "text string, tree string", "('SELECT * FROM ORDERS o WHERE o_totalprice > 5', 'SELECT * FROM ORDERS WHERE o_totalprice > 5')")
def raw_sql_in_trees():
    text = "SELECT * FROM ORDERS o WHERE o_totalprice > 5"
    return [(text, sql.to_sql(sql.normalized(sql.RawSQL(text))))]


@listing("schema_match", "against string, f1 double", "('itself', 1.0), ('without links', 0.0), ('nothing', 0.0)")
def schema_match():
    a = Catalog({t: Table(t, (Column("id", "INTEGER"),), ("id",)) for t in ("A", "B")}, [ForeignKey("A", "id", "B")])
    found = {"itself": schema_eval.shape(TESTDATA, TESTDATA), "without links": schema_eval.shape(Catalog(a.tables), a), "nothing": schema_eval.shape(Catalog({}), a)}
    return [(k, float(s.f1)) for k, s in found.items()]


@listing("capacity", "measure string, value double", "('recall', 0.666667), ('precision', 0.75)")
def capacity():
    t = Table("SALE", (Column("sale_id", "INTEGER"), Column("price", "FLOAT"), Column("colour", "VARCHAR")), ("sale_id",))
    got = schema_eval.capacity(Catalog({"SALE": t}), {"SALE": {1}, "SALE.price": {2}}, {1: {"STRUCTURAL"}, 2: set(), 3: {"LOGICAL"}, 4: {"METADATA"}})
    return [(k, round(got[k], 6)) for k in ("recall", "precision")]


@listing("dependency_kinds", "kind string, n int", "('enforced', 1), ('partial', 1), ('transitive', 1), ('unenforced', 1), ('cross_table', 1), ('unresolved', 1)")
def dependency_kinds():
    two = Catalog({"LINE": Table("LINE", tuple(Column(n, "INTEGER") for n in "abcd"), ("a", "b"))})
    stated = [(["Line.a", "Line.b"], ["Line.c"]), (["Line.a"], ["Line.c"]), (["Line.c"], ["Line.d"]), (["Line.a", "Line.c"], ["Line.d"]), (["Line.c"], ["Other.x"]), (["Gone.x"], ["Gone.y"])]
    got = schema_eval.dependencies(two, stated)
    return [(k, len(got[k])) for k in ("enforced", "partial", "transitive", "unenforced", "cross_table", "unresolved")]


@listing("score_means", "measure string, value double", "('a', 2.0), ('b', NULL)")
def score_means():
    return [(k, None if v is None else float(v)) for k, v in schema_eval.means([{"a": 1, "b": None}, {"a": None}, {"a": 3}]).items()]


@listing("distribution_faults", "column string, kind string", "('ORDERS.o_orderkey', 'distribution on key'), ('ORDERS.o_custkey', 'distribution on key'), ('ORDERS.o_totalprice', 'linear mean'), ('ORDERS.o_orderstatus', 'type'), ('ORDERS.x', 'unknown column')")
def distribution_faults():
    stated = {("ORDERS", "o_orderkey"): ("poisson", {"lambda": 3}), ("ORDERS", "o_custkey"): ("normal", {"mean": 0, "std": 1}), ("ORDERS", "o_totalprice"): ("lognormal", {"mu": 500, "sigma": 1}), ("ORDERS", "o_orderstatus"): ("zipf", {}), ("ORDERS", "x"): ("zipf", {})}
    return [(c.subject, c.kind) for c in audit.distribution_faults(TESTDATA, stated)]


@listing("catalog_shape", "measure string, n int", "('tables', 8), ('composite keys', 0), ('self links', 0), ('longest chain', 5)")
def catalog_shape():
    return list(audit.shape(TESTDATA).items())


@listing("normalised_catalog", "table string, column string, type string", "('SHOP', 'shop_id', 'UUID'), ('SALE_ITEM', 'sale_id', 'INTEGER'), ('SALE_ITEM', 'shop_id', 'UUID')")
def normalised_catalog():
    c = Catalog({"Shop": Table("Shop", (Column("ShopId", "UUID"), Column("shop id", "UUID")), ("ShopId",)), "Sale Item": Table("Sale Item", (Column("SaleID", "INTEGER"), Column("Shop-ID", "INTEGER")), ("SaleID",))})
    c = patches.aligned(patches.wired(patches.normalised(c)))
    return [(t.name, x.name, x.type) for t in c.tables.values() for x in t.columns]


@listing("patched_catalog", "table string, columns int, links int", "('AREA', 2, 0), ('CUSTOMER', 5, 1), ('NATION', 3, 1), ('ORDERS', 7, 2), ('SHOP', 1, 0)")
def patched_catalog():
    steps = [
        {"action": "add_table", "table": "SHOP", "columns": [("shop_id", "INTEGER")], "key": ["shop_id"]},
        {"action": "add_link", "table": "ORDERS", "column": "shop_id", "parent": "SHOP"},
        {"action": "rename_table", "table": "REGION", "to": "AREA"},
        *({"action": "delete_table", "table": t} for t in ("SUPPLIER", "LINEITEM", "PART", "EVENTS", "NONE")),
    ]
    c, _ = patches.apply(TESTDATA, steps)
    return sorted((t.name, len(t.columns), sum(f.table == t.name for f in c.links)) for t in c.tables.values())


@listing("fact_columns", "fact int, column string", "(1, 'PART.p_size'), (2, 'PART.p_partkey'), (3, 'CUSTOMER.c_custkey'), (3, 'ORDERS.o_custkey')")
def fact_columns():
    link = ForeignKey("ORDERS", "o_custkey", "CUSTOMER")
    got = facts.column_map(TESTDATA, {("PART", "p_size"): {1}}, {"PART": {1, 2}}, {link: {3}}, {})
    return [(f, f"{t}.{c}") for f, of in sorted(got.items()) for t, c in of]


@listing("merged_entities", "entity int, cluster int", "(0, 0), (1, 0), (2, 2)")
def merged_entities():
    import numpy as np

    p = np.array([[-np.inf, 0.9, 0.8], [0.9, -np.inf, 0.1], [0.8, 0.1, -np.inf]])
    return list(enumerate(merging.clusters(p)))


@listing("merged_links", "name string, kind string, participants string, flag string", "('has', '1:N', 'A B', 'has: 1:N and M:N')")
def merged_links():
    links = [{"name": "has", "kind": "1:N", "participants": ["X", "B"], "facts": [2]}, {"name": "has", "kind": "M:N", "participants": ["B", "A"], "facts": [1]}]
    out, flags = merging.merged_links(links, {"X": "A"})
    return [(x["name"], x["kind"], " ".join(x["participants"]), flags[0]) for x in out]


_ACCEPTED = ["SELECT o_orderkey FROM ORDERS WHERE o_totalprice > 1000 AND o_orderstatus IN ('F', 'O')", "SELECT o_custkey, AVG(o_totalprice) AS mean FROM ORDERS GROUP BY o_custkey", "SELECT * FROM LINEITEM LEFT JOIN ORDERS ON LINEITEM.l_orderkey = ORDERS.o_orderkey"]
_REFUSED = [
    "SELECT DISTINCT o_custkey FROM ORDERS",
    "SELECT o_orderkey FROM ORDERS ORDER BY o_orderkey",
    "SELECT o_orderkey FROM ORDERS LIMIT 5",
    "SELECT 1",
    "SELECT * FROM ORDERS RIGHT JOIN CUSTOMER ON ORDERS.o_custkey = CUSTOMER.c_custkey",
    "SELECT * FROM ORDERS CROSS JOIN CUSTOMER",
    "SELECT * FROM ORDERS JOIN CUSTOMER ON ORDERS.o_custkey > CUSTOMER.c_custkey",
    "SELECT * FROM ORDERS JOIN CUSTOMER ON ORDERS.o_custkey = CUSTOMER.c_custkey AND ORDERS.o_orderkey = CUSTOMER.c_custkey",
    "SELECT o_orderkey FROM ORDERS UNION SELECT l_orderkey FROM LINEITEM",
    "SELECT o_orderkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM ORDERS",
    "SELECT o_orderkey FROM ORDERS WHERE o_orderstatus IN (SELECT 1)",
    "SELECT o_orderkey FROM ORDERS WHERE EXISTS (SELECT 1)",
    "SELECT o_orderkey FROM ORDERS WHERE o_orderstatus LIKE 'F'",
    "SELECT o_orderkey FROM ORDERS WHERE o_orderstatus IS NULL",
    "SELECT o_orderkey, o_totalprice + 1 FROM ORDERS",
    "SELECT UPPER(o_orderstatus) AS s FROM ORDERS",
    "SELECT SUM(o_totalprice) FROM ORDERS",
    "SELECT o_custkey, SUM(o_totalprice) AS s, COUNT(*) AS n FROM ORDERS GROUP BY o_custkey",
]


@pytest.mark.parametrize("text", _ACCEPTED)
def test_sql_round_trips(text):
    assert sql.parse(sql.to_sql(sql.parse(text))) == sql.parse(text)


@pytest.mark.parametrize("text", _REFUSED)
def test_sql_is_refused(text):
    assert sql.try_parse(text)[0] is None


_MODEL = conceptual.Model(
    [
        conceptual.Entity("Building", (conceptual.Attribute("code"), conceptual.Attribute("floors", "INTEGER")), ("code",)),
        conceptual.Entity("Room", (conceptual.Attribute("number", "INTEGER"), conceptual.Attribute("area", "FLOAT", True)), ("number",), "Building"),
        conceptual.Entity("Person", (conceptual.Attribute("name"), conceptual.Attribute("phone", multivalued=True), conceptual.Attribute("age", "INTEGER", derived=True))),
        conceptual.Entity("Badge", (conceptual.Attribute("serial", "UUID"),), ("serial",)),
        conceptual.Entity("Course", (conceptual.Attribute("title"),)),
    ],
    [
        conceptual.Relationship("works in", (conceptual.Participant("Person", least=0), conceptual.Participant("Building", most=1)), "1:N"),
        conceptual.Relationship("carries", (conceptual.Participant("Person", least=0, most=1), conceptual.Participant("Badge", least=1, most=1)), "1:1"),
        conceptual.Relationship("Enrolment", (conceptual.Participant("Person"), conceptual.Participant("Course")), "M:N", (conceptual.Attribute("grade", "FLOAT", True),)),
        conceptual.Relationship("teaches", (conceptual.Participant("Person", "teacher"), conceptual.Participant("Course"), conceptual.Participant("Building")), "M:N"),
        conceptual.Relationship("manages", (conceptual.Participant("Person", least=0), conceptual.Participant("Person", "boss", most=1)), "1:N"),
    ],
)


@listing("mapped_schema", "table string, column string, type string, nullable boolean, in_key boolean, parent string", """('BUILDING', 'code', 'VARCHAR', false, true, NULL), ('BUILDING', 'floors', 'INTEGER', false, false, NULL),
    ('ROOM', 'number', 'INTEGER', false, true, NULL), ('ROOM', 'area', 'FLOAT', true, false, NULL), ('ROOM', 'code', 'VARCHAR', false, true, 'BUILDING'),
    ('PERSON', 'person_id', 'INTEGER', false, true, NULL), ('PERSON', 'name', 'VARCHAR', false, false, NULL), ('PERSON', 'code', 'VARCHAR', true, false, 'BUILDING'), ('PERSON', 'boss_person_id', 'INTEGER', true, false, 'PERSON'),
    ('BADGE', 'serial', 'UUID', false, true, NULL), ('BADGE', 'person_id', 'INTEGER', false, false, 'PERSON'),
    ('COURSE', 'course_id', 'INTEGER', false, true, NULL), ('COURSE', 'title', 'VARCHAR', false, false, NULL),
    ('PERSON_PHONE', 'phone', 'VARCHAR', false, true, NULL), ('PERSON_PHONE', 'person_id', 'INTEGER', false, true, 'PERSON'),
    ('ENROLMENT', 'person_id', 'INTEGER', false, true, 'PERSON'), ('ENROLMENT', 'course_id', 'INTEGER', false, true, 'COURSE'), ('ENROLMENT', 'grade', 'FLOAT', true, false, NULL),
    ('PERSON_COURSE_BUILDING', 'teacher_person_id', 'INTEGER', false, true, 'PERSON'), ('PERSON_COURSE_BUILDING', 'course_id', 'INTEGER', false, true, 'COURSE'), ('PERSON_COURSE_BUILDING', 'code', 'VARCHAR', false, true, 'BUILDING')""")
def mapped_schema():
    return conceptual.listed(conceptual.mapped(_MODEL))


def conflict_kinds():
    """The kinds of conflict among constraints over several tables."""
    S_, O = constraints.Stated, Base("ORDERS")
    price = lambda fn, v: S_(Aggregate(Base("PART"), fn, "p_retailprice", "m"), Compare("=", Col("m"), Lit(v)))
    L = lambda *p, **k: S_(Base("LINEITEM"), constraints.Correlated(tuple(p), **k))
    stated = [
        S_(O, constraints.Distributed("o_totalprice", "normal", (("mean", 5.0),))),
        S_(O, constraints.Distributed("o_totalprice", "lognormal")),
        S_(Base("PART"), constraints.Distributed("p_size", "poisson", (("lambda", 5.0),))),
        S_(Base("PART"), constraints.Distributed("p_size", "poisson", (("lambda", 6.0),))),
        S_(Base("PART"), constraints.Distributed("p_retailprice", "uniform", (("low", 0.0), ("high", 10.0)))),
        price("AVG", 5.0),
        price("VARIANCE", 3.0),
        S_(Aggregate(O, "AVG", "o_totalprice", "m"), Compare(">", Col("m"), Lit(7.0))),
        S_(Aggregate(O, "AVG", "o_totalprice", "m"), Compare("<", Col("m"), Lit(6.0))),
        L(("l_quantity", "l_tax", 0.5), copula="student_t", nu=2.0),
        L(("l_quantity", "l_tax", 0.6)),
        L(("l_quantity", "l_extendedprice", 0.9), ("l_tax", "l_extendedprice", -0.9)),
        S_(O, constraints.StateSequence("o_orderstatus", (("O", "P"), ("P", "F")), (("O", "P"),))),
        S_(O, constraints.StateSequence("o_orderstatus", (("F", "O"),), (), True)),
    ]
    found = sorted({c.kind for c in constraints.evaluate(stated, TESTDATA).conflicts})
    return found


def test_kinds_of_conflict():
    assert conflict_kinds() == sorted(["distributed_family_mismatch", "distributed_parameter_mismatch", "correlated_value_mismatch", "correlated_precondition_violation", "correlated_infeasible_matrix", "moment_value_mismatch", "moment_vs_distributed_mismatch", "state_sequence_direct_contradiction", "state_sequence_cycle"])


@pytest.mark.parametrize("name", sorted(LISTINGS))
def test_listing(name):
    f, expected = LISTINGS[name]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=key)
    assert plain(f()) == plain(duckdb.sql(expected).fetchall())


def test_shard_stubs(spark):
    links = spark.createDataFrame([(f.table, f.parent) for f in TESTDATA.links], "table string, parent string")
    shards = spark.createDataFrame([("LINEITEM", 0), ("ORDERS", 0), ("CUSTOMER", 0), ("NATION", 1), ("PART", 1)], "table string, shard int")
    got = {tuple(r) for r in facts.stubs(links, shards).select("shard", "table").collect()}
    assert got == {(0, "PART"), (0, "SUPPLIER"), (0, "NATION"), (1, "REGION")}


def test_shard_sweep(spark):
    """Every setting of a sweep divides the catalog so that each fact is whole in some shard."""
    stated = {"a": {("ORDERS", "o_totalprice"), ("CUSTOMER", "c_acctbal")}, "b": {("LINEITEM", "l_quantity"), ("PART", "p_size")}, "c": {("REGION", "r_name"), ("EVENTS", "value")}}
    found = sharding.sweep(spark, TESTDATA, stated, grid=(0.1, 30.0))
    whole = F.lit(True)
    for cells in stated.values():
        whole = whole & F.exists(F.split("structure", r"\|"), _held(cells))
    one = found.agg(F.sum("n").alias("settings"), F.every(whole).alias("all_facts_held")).first()
    assert one.settings == 8 and one.all_facts_held


def _held(cells):
    def of(shard):
        out = F.lit(True)
        for t, c in cells:
            out = out & F.array_contains(F.split(shard, ","), f"{t}.{c}")
        return out

    return of
