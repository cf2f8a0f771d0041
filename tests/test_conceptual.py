"""Conceptual models: their faults, and the catalogs they map to."""

from collections import Counter

import pytest

from relspan.plans.catalog import ForeignKey
from relspan.plans.conceptual import Attribute, Dependency, Entity, Model, Participant, Relationship, faults, key_of, mapped, rendered, review, spread
from relspan.plans.extraction import parse_condition
from relspan.plans.relation import Aggregate, Base, Filter, Join, Refused
from relspan.plans.sql import RawSQL, normalized, parse

ID = Attribute("id", "INTEGER")


def two(kind, a, b, **more):
    return Model([Entity("A", (Attribute("a"),)), Entity("B", (Attribute("b"),))], [Relationship("r", (Participant("A", **a), Participant("B", **b)), kind, **more)])


def test_faults():
    assert not faults(two("1:N", {}, {"most": 1}))
    for kind, a, b in (("1:N", {}, {}), ("1:N", {"most": 1}, {"most": 1}), ("1:1", {}, {"most": 1}), ("M:N", {"most": 1}, {}), ("1:N", {"most": 50}, {"most": 1}), ("1:N", {"least": 2}, {"most": 1}), ("N:1", {}, {"most": 1})):
        assert len(faults(two(kind, a, b))) == 1, (kind, a, b)
        with pytest.raises(Refused):
            mapped(two(kind, a, b))
    assert len(faults(Model([Entity("A", (ID, Attribute("ID"))), Entity("a", (), ("x",), "Z")], [Relationship("r", (Participant("A"), Participant("C")), "M:N"), Relationship("s", (), "M:N")]))) == 6


def test_keys():
    m = Model([Entity("A", (Attribute("code"), Attribute("at", "DATE"), Attribute("n", "INTEGER")), ("code",)), Entity("B", (Attribute("n", "INTEGER"), Attribute("code", "FLOAT")), ("code",)), Entity("C", (Attribute("x"), Attribute("y")))], [], [Dependency((("C", "x"),), (("C", "y"),))])
    a, b, c = m.entities
    assert key_of(a, m) == () and key_of(b, m) == () and key_of(c, m) == ("x",)
    assert mapped(m).tables["A"].key == ("a_id",) and mapped(m).tables["C"].key == ("x",)


def test_weak_entities_lend_their_keys_on():
    m = Model([Entity("Desk", (Attribute("n", "INTEGER"),), ("n",), "Room"), Entity("Room", (Attribute("door"),), ("door",), "House"), Entity("House", (Attribute("street"),), ("street",))])
    c = mapped(m)
    assert c.tables["ROOM"].key == ("door", "street") and c.tables["DESK"].key == ("n", "door", "street")
    assert ForeignKey("DESK", "door", "ROOM", "door") in c.links and ForeignKey("ROOM", "street", "HOUSE") in c.links and not c.errors()
    with pytest.raises(Refused):
        mapped(Model([Entity("A", (ID,), (), "B"), Entity("B", (ID,), (), "A")]))


def test_sides_of_relationships():
    c = mapped(two("1:N", {"least": 0}, {"most": 1}, attributes=(Attribute("since", "DATE"),)))
    assert [x.name for x in c.tables["A"].columns] == ["a_id", "a", "b_id", "since"] and c.tables["A"].column("b_id").nullable
    c = mapped(two("1:N", {"most": 1}, {"least": 1}))
    assert c.links == [ForeignKey("B", "a_id", "A")] and not c.tables["B"].column("a_id").nullable
    assert mapped(two("1:1", {"least": 1, "most": 1}, {"least": 0, "most": 1})).tables["A"].unique == (("b_id",),)
    assert mapped(two("1:1", {"most": 1}, {"most": 1})).links == [ForeignKey("B", "a_id", "A")]
    assert mapped(two("M:N", {}, {})).tables["R"].key == ("a_id", "b_id")
    self_ = Model([Entity("A", (Attribute("a"),))], [Relationship("likes", (Participant("A"), Participant("A")), "M:N"), Relationship("made by", (Participant("A"), Participant("A", most=1)), "1:N")])
    c = mapped(self_)
    assert c.tables["A_2"].key == ("a1_a_id", "a2_a_id") and c.tables["A"].column("made_by_a_id")


def test_values_of_many(spark):
    m = Model([Entity("A", (Attribute("tag", multivalued=True), Attribute("rate", "FLOAT", multivalued=True)))])
    c = mapped(m)
    assert c.tables["A_TAG"].key == ("tag", "a_id") and c.tables["A_RATE"].key == ("rate_id", "a_id")
    rows = spark.createDataFrame([(1, ["x", "y", "x", None]), (2, []), (3, None)], "a_id long, tag array<string>")
    assert sorted(tuple(r) for r in spread(rows, ["a_id"], "tag").collect()) == [(1, "x"), (1, "y")]


def test_reviews_and_renderings():
    m, warned = Model([Entity("A", (Attribute("b_id"), Attribute("a_id"))), Entity("B", (ID,))]), Counter()
    seen = [review(m, {"A": {"f1"}}, {"f1", "f2"}, warned) for _ in range(3)]
    assert [len(w) for _, w in seen] == [1, 1, 0] and all(e == ["nothing cites f2"] for e, _ in seen)
    text = rendered(mapped(two("1:N", {"least": 0}, {"most": 1})))
    assert text.splitlines() == ["A (key: a_id)", "  a_id: INTEGER", "  a: VARCHAR", "  b_id: INTEGER, nullable, refers to B.b_id", "B (key: b_id)", "  b_id: INTEGER", "  b: VARCHAR"]


def test_conditions_as_text():
    key = ("T", "c")
    assert parse_condition(" T.c = 'it''s' ") == (key, "eq", ["it's"]) and parse_condition("T.c==x") == (key, "eq", ["x"])
    assert parse_condition("T.c <> \"y z\"") == (key, "neq", ["y z"]) and parse_condition("T.c in ('a', b,'c')") == (key, "in", ["a", "b", "c"])
    for odd in ("", None, "c = 1", "T.c > 3", "T.c NOT IN ('a')", "T.c IN ()", "T.c IN 'a'", "T.c = 'a', 'b'", "T.c = 'a' AND T.d = 1", "T.c ="):
        assert parse_condition(odd) is None, odd


def test_texts_inside_trees():
    inner = "SELECT * FROM ORDERS o JOIN CUSTOMER c ON o.o_custkey = c.c_custkey WHERE o_totalprice > 5"
    tree = normalized(Aggregate(RawSQL(inner), "COUNT", "*", "n"))
    assert tree == Aggregate(parse("SELECT * FROM ORDERS JOIN CUSTOMER ON ORDERS.o_custkey = CUSTOMER.c_custkey WHERE o_totalprice > 5"), "COUNT", "*", "n")
    twice = Join(Base("S"), Base("S", "b"), ("S", "boss"), ("b", "id"))
    assert normalized(twice) == twice and isinstance(tree.source, Filter)
    with pytest.raises(Refused):
        normalized(Filter(RawSQL("SELECT * FROM A, B"), None))
