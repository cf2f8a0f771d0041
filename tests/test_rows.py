"""Sources, facts, vectors and patched rows on small inputs, empty ones and nulls included."""

import gzip

import numpy as np
import pytest

from relspan.operators import facts, packing, vectors
from relspan.plans import patches
from relspan.plans.catalog import Catalog, Column, Table
from relspan.sources import readers


def listed(df):
    return [tuple(r) for r in df.collect()]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tbl").write_text('1|one "x"|\n2||\n')
    assert listed(readers.pipe_table(spark, str(tmp_path / "a.tbl"), ["k", "v"])) == [("1", 'one "x"'), ("2", "")]
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write('id\tname\ttimes\nt1\tsay "hi\t\\N\nt2\t\\N\t7.5\n')
    rows = readers.tab_table(spark, str(tmp_path / "b.tsv.gz"))
    assert listed(rows) == [("t1", 'say "hi', ""), ("t2", "", "7.5")] and readers.tab_table(spark, str(tmp_path / "b.tsv.gz"), 1).count() == 1
    assert listed(readers.numeric_columns(rows, ["times"])) == [(None,), (7.5,)]


def test_cases_and_specification(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": 1, "text": "a"}\n\n{"id": 2, "tex\n   \n{"id": 3}\n')
    good, bad = readers.cases(spark, str(tmp_path / "c.jsonl"), "id int, text string")
    assert listed(good) == [(1, "a"), (3, None)] and listed(bad) == [('{"id": 2, "tex',)]
    assert readers.cases(spark, str(tmp_path / "c.jsonl"), "id int", 1)[0].count() == 1
    (tmp_path / "s.txt").write_text("two\nlines\n")
    assert readers.specification(spark, str(tmp_path / "s.txt")).first().text == "two\nlines\n"


def test_schema_and_stage(spark, tmp_path):
    c = readers.schema_of({"SHOP": {"attributes": ["id", "name"], "primary_key": ["id"]}, "SALE": {"attributes": ["id"], "primary_key": ["id"], "foreign_keys": {"shop": "SHOP"}}})
    assert not c.errors() and c.link("SALE", "shop", "SHOP", "id") and c.tables["SHOP"].column("name").type == "VARCHAR"
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for resume in (True, True, False):
        assert readers.stage(spark, f"file://{tmp_path}", "one", make, resume).count() == 3
    assert len(calls) == 2
    readers.write_mined(spark.range(1), str(tmp_path / "mined"))
    assert spark.read.json(str(tmp_path / "mined")).count() == 1 and readers.report_line({"b": 1, "a": None}) == '{"a": null, "b": 1}'


def test_filter_and_tags(spark):
    rows = [(1, "A  b", [9]), (2, "a B", [9]), (3, "c", [3, 9]), (4, "d", [5]), (5, None, None), (6, "Snow is a measure", [9])]
    ext = spark.createDataFrame([(*r, None) for r in rows], "fact_id int, fact string, refs array<int>, kind string")
    got = {r.fact_id: (r.rejection, r.kind) for r in facts.filter_external(ext, spark.createDataFrame([(9,)], "fact_id int"), ["ledger"]).collect()}
    assert got == {1: (None, None), 2: ("DUPLICATE", None), 3: ("SELF_REFERENCE", None), 4: ("INVALID_REFERENCE", None), 5: ("INVALID_REFERENCE", None), 6: (None, "TECHNICAL_DEFINITION")}
    tags = spark.createDataFrame([("One of: x", True, ["LOGICAL"]), (None, False, None)], "fact string, is_external boolean, tags array<string>")
    assert [set(r.tags) for r in facts.tagged(tags).collect()] == [{"LOGICAL", "METADATA", "STRUCTURAL"}, set()]


def test_packing(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), int(s), int(s), i, "x" * int(rng.choice([0, 20, 60, 300]))) for i, (d, s) in enumerate(rng.integers(0, 9, (300, 2)))]
    want = {}
    for d in {r[0] for r in rows}:
        chunk, used = [], 0
        chunks = []
        for s in sorted({r[1] for r in rows if r[0] == d}):
            seg = [(r[3], len(r[4]) // 4 + 8) for r in sorted(rows, key=lambda r: r[3]) if r[:2] == (d, s)]
            whole = sum(t for _, t in seg)
            if whole > 64:
                if chunk:
                    chunks.append(chunk)
                part, size = [], 0
                for i, t in seg:
                    if part and size + t > 64:
                        chunks.append(part)
                        part, size = [], 0
                    part, size = [*part, i], size + t
                chunks.append(part)
                chunk, used = [], 0
            else:
                if chunk and used + whole > 64:
                    chunks.append(chunk)
                    chunk, used = [], 0
                chunk, used = chunk + [i for i, _ in seg], used + whole
        for n, c in enumerate([*chunks, chunk] if chunk else chunks):
            want |= {i: n for i in c}
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, fact_id int, fact string")
    assert {r.fact_id: r.chunk for r in packing.packed(df, 64).collect()} == want
    assert packing.packed(df.limit(0), 64).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    v = [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(60)] + [(60, [0.0] * 4, 1), (61, None, 2), (62, [1.0] * 4, None)]
    df = spark.createDataFrame(v, "k int, v array<double>, s int")
    m = np.array([x[1] for x in v[:61]])
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    cos = unit @ unit.T
    want = {(i, j) for i in range(0, 61, 10) for j in range(61) if v[i][2] != v[j][2] and cos[i, j] >= 0.2}
    got = {(r.query, r.row) for r in vectors.pairs(df.where("k % 10 = 0"), df, "k", "v", "s", 0.2).collect()}
    assert got == want
    assert vectors.pairs(df.limit(0), df, "k", "v", "s", 0.2).count() == 0
    ids = [i for i in range(61) if v[i][2] == 1]
    mean = (cos[np.ix_(ids, ids)].sum() - np.trace(cos[np.ix_(ids, ids)])) / (len(ids) * (len(ids) - 1))
    assert abs({r.shard: r.mean_cosine for r in vectors.pair_moments(df, "v", "s").collect()}[1] - mean) < 1e-9


def test_merged_rows(spark):
    c = Catalog({"A": Table("A", (Column("id", "INTEGER"), Column("x", "INTEGER")), ("id",)), "B": Table("B", (Column("id", "INTEGER"), Column("y", "INTEGER")), ("id",))})
    rows = {"A": spark.createDataFrame([(1, 2), (2, 3)], "id long, x long"), "B": spark.createDataFrame([(1, 7)], "id long, y long")}
    out = patches.tables(rows, c, {"action": "merge_tables", "table": "B", "to": "A"})
    assert list(out) == ["A"] and sorted(listed(out["A"])) == [(1, 2, 7), (2, 3, None)]
    c.tables["B"] = Table("B", (Column("b_id", "INTEGER"), Column("y", "INTEGER"), Column("x", "INTEGER")), ("b_id",))
    rows["B"] = spark.createDataFrame([(1, 7, 70), (9, 8, 80)], "b_id long, y long, x long")
    out = patches.tables(rows, c, {"action": "merge_tables", "table": "B", "to": "A"})
    assert out["A"].columns == ["id", "x", "b_id", "y"]
    assert sorted(listed(out["A"]), key=lambda r: r[0]) == [(1, 2, 1, 7), (2, 3, None, None), (9, 80, 9, 8)]


def test_means_maxima_and_trials(spark):
    from relspan.operators import generate as G

    rows = spark.createDataFrame([(1, 1, 5.0, 10.0), (1, 2, 7.0, 10.0), (1, 3, 7.0, 10.0), (2, 4, 50.0, 10.0), (2, 5, None, 10.0), (None, 6, 1.0, 4.0), (3, 7, 2.0, None)], "g long, k long, x double, to double")
    mean = {r.k: r.x for r in G.with_mean(rows, "g", "to", "x").collect()}
    assert mean == {1: pytest.approx(5 + 11 / 3), 2: pytest.approx(7 + 11 / 3), 3: pytest.approx(7 + 11 / 3), 4: 10.0, 5: None, 6: 4.0, 7: 2.0}
    top = {r.k: r.x for r in G.with_maximum(rows, "g", "to", "x", "k").collect()}
    assert top == {1: 5.0, 2: 10.0, 3: 7.0, 4: 10.0, 5: None, 6: 4.0, 7: None}
    spec = {"x": {"family": "uniform", "params": {"low": 0, "high": 1}}}
    r = G.trial(spark, 95, "id", spec, {"half": {"op": "lt", "column": "x", "value": 0.5}}).first()
    whole = G.table(spark, 95, "id", spec).where("id < 10 AND x < 0.5").count()
    assert (r.applicable, r.satisfied) == (10, whole)
