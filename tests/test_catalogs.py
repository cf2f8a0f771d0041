"""Plans over catalogs: matching, patches and freedom, against brute force or by hand."""

import itertools
import random

from relspan.plans import freedom, patches, schema_eval
from relspan.plans.catalog import TESTDATA, Catalog, Column, ForeignKey, Table


def test_assignment_is_the_best_of_all():
    rng = random.Random(1)
    for n, m in itertools.product(range(1, 6), repeat=2):
        for _ in range(10):
            gain = [[rng.choice([0, 0.25, 0.5, rng.random()]) for _ in range(m)] for _ in range(n)]
            got = schema_eval.assign(gain)
            assert len(got) == min(n, m) == len(set(got.values()))
            if n <= m:
                best = max(sum(gain[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
            else:
                best = max(sum(gain[i][j] for j, i in enumerate(p)) for p in itertools.permutations(range(n), m))
            assert abs(sum(gain[i][j] for i, j in got.items()) - best) < 1e-9
    assert schema_eval.assign([]) == {}


def test_shape_of_itself_reversed_and_cut():
    same = schema_eval.shape(TESTDATA, TESTDATA)
    assert (same.f1, same.table_recall, same.score) == (1, 1, 1) and all(t == m for t, (m, _) in same.pairs.items())
    turned = Catalog(TESTDATA.tables, [ForeignKey("REGION", "r_regionkey", "NATION"), *TESTDATA.links[1:]])
    got = schema_eval.shape(turned, TESTDATA)
    assert got.recall < 1 and got.precision < 1
    a = Catalog({t: Table(t, (Column("id", "INTEGER"),), ("id",)) for t in ("A", "B")}, [ForeignKey("A", "id", "B")])
    none = schema_eval.shape(Catalog(a.tables), a)
    assert (none.precision, none.recall, none.f1) == (0, 0, 0) and none.missing
    assert schema_eval.shape(Catalog({}), a).table_recall == 0
    assert schema_eval.kind("varchar(20)") == "TEXT" and schema_eval.kind("DECIMAL(8,2)") == "NUMERIC" and schema_eval.kind(None) == "TEXT"


def test_capacity_and_dependencies():
    t = Table("SALE", (Column("sale_id", "INTEGER"), Column("price", "FLOAT"), Column("colour", "VARCHAR")), ("sale_id",))
    c = Catalog({"SALE": t})
    got = schema_eval.capacity(c, {"SALE": {1}, "SALE.price": {2}}, {1: {"STRUCTURAL"}, 2: set(), 3: {"LOGICAL"}, 4: {"METADATA"}})
    assert got["recall"] == 2 / 3 and got["precision"] == 3 / 4 and got["uncovered"] == [3] and got["unsupported"] == ["SALE.colour"]
    assert schema_eval.unfounded(c, {"SALE.price": {2}}) == set() and schema_eval.unfounded(c, {}) == set()
    two = Catalog({"LINE": Table("LINE", tuple(Column(n, "INTEGER") for n in "abcd"), ("a", "b"))})
    stated = [(["Line.a", "Line.b"], ["Line.c"]), (["Line.a"], ["Line.c"]), (["Line.c"], ["Line.d"]), (["Line.a", "Line.c"], ["Line.d"]), (["Line.c"], ["Other.x"]), (["Gone.x"], ["Gone.y"]), (["c"], ["d"])]
    got = schema_eval.dependencies(two, stated)
    assert [len(got[k]) for k in ("enforced", "partial", "transitive", "unenforced", "cross_table", "unresolved")] == [1] * 6 and got["score"] == 0.25
    assert schema_eval.dependencies(two, [])["score"] is None
    assert schema_eval.dependencies(two, [(["Row.a", "Row.b"], ["Row.c"])], {"Row": "Line"})["score"] == 1
    assert schema_eval.means([{"a": 1, "b": None}, {"a": None}, {"a": 3}]) == {"a": 2, "b": None}


def test_matching_and_blocks():
    rng = random.Random(2)
    for _ in range(300):
        n, m = rng.randint(0, 5), rng.randint(0, 5)
        eq = {f"e{i}": {f"u{j}" for j in range(m) if rng.random() < 0.4} for i in range(n)}
        to = freedom.matching(eq)
        assert all(u in eq[e] for e, u in to.items()) and len(set(to.values())) == len(to)
        most = max((k for k in range(min(n, m) + 1) for es in itertools.combinations(eq, k) for us in itertools.permutations([f"u{j}" for j in range(m)], k) if all(u in eq[e] for e, u in zip(es, us))), default=0)
        assert len(to) == most
        parts = freedom.blocks(eq, {f"u{j}" for j in range(m)})
        assert sorted(e for b in parts for e in b.equations) == sorted(eq) and sum(len(b.unknowns) for b in parts) == m
        for b in parts:
            assert (b.freedom < 0, b.freedom == 0, b.freedom > 0) == (b.kind == "over", b.kind == "square", b.kind == "loose")
    assert freedom.grouped({"a": {"t"}, "b": {"u"}, "c": {"t", "v"}, "d": {"v"}, "e": set()}) == [{"a", "c", "d"}, {"b"}, {"e"}]


def test_patches():
    c, why = patches.apply(TESTDATA, [
        {"action": "add_table", "table": "SHOP", "columns": [("shop_id", "INTEGER")], "key": ["shop_id"]},
        {"action": "add_link", "table": "ORDERS", "column": "shop_id", "parent": "SHOP"},
        {"action": "rename_table", "table": "REGION", "to": "AREA"},
        {"action": "rename_column", "table": "CUSTOMER", "column": "c_custkey", "to": "cust"},
        {"action": "delete_table", "table": "SUPPLIER"},
        {"action": "delete_table", "table": "NONE"},
        {"action": "explode", "table": "ORDERS"},
    ])
    assert len(why) == 2 and "SUPPLIER" not in c.tables and c.tables["CUSTOMER"].key == ("cust",)
    assert ForeignKey("ORDERS", "shop_id", "SHOP") in c.links and ForeignKey("NATION", "n_regionkey", "AREA") in c.links and all("SUPPLIER" not in (f.table, f.parent) for f in c.links)
    assert not c.errors() and "SUPPLIER" in TESTDATA.tables
    c, why = patches.apply(TESTDATA, [{"action": "delete_link", "table": "ORDERS", "column": "o_custkey"}, {"action": "set_key", "table": "LINEITEM", "key": ["l_orderkey", "l_linenumber"]}, {"action": "merge_tables", "table": "SUPPLIER", "to": "CUSTOMER"}])
    assert not why and c.tables["LINEITEM"].key == ("l_orderkey", "l_linenumber") and c.tables["CUSTOMER"].column("s_name").nullable and ForeignKey("LINEITEM", "l_suppkey", "CUSTOMER") in c.links


def test_normalised_wired_aligned():
    c = Catalog({"Shop": Table("Shop", (Column("ShopId", "UUID"), Column("shop id", "UUID")), ("ShopId",)), "Sale Item": Table("Sale Item", (Column("SaleID", "INTEGER"), Column("Shop-ID", "INTEGER")), ("SaleID",))})
    c = patches.aligned(patches.wired(patches.normalised(c)))
    assert set(c.tables) == {"SHOP", "SALE_ITEM"} and len(c.tables["SHOP"].columns) == 1
    assert c.links == [ForeignKey("SALE_ITEM", "shop_id", "SHOP")] and c.tables["SALE_ITEM"].column("shop_id").type == "UUID" and not c.errors()
