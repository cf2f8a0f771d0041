"""Operators 11 to 13 and near copies: queries against their SQL and against brute force, with odd rows."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from relspan.llm import langid, minhash, queries, ranked, similar, simhash, vector_codes
from tests.llm.test_llm import jaccard_roots, roots, words
from tests.oracle import compare


def mutated(rng, base, edits):
    new = base.split()
    for _ in range(edits):
        new[rng.randrange(len(new))] = words(rng, 1)
    return " ".join(new)


def many_texts(rng):
    line = words(rng, 14)
    out = ["", None, " \n ", "one", "ONE", "one two", "one two three", "Straße É", "straße É", words(rng, 2500)]
    out.append(f"{out[-1]} {words(rng, 60)}")
    for n in (4, 5, 6, 8, 12, 20, 60, 200):
        base = words(rng, n)
        out += [base, base.upper(), *(mutated(rng, base, e) for e in (1, 1, 2, 3, 5, 9)), " ".join(base.split()[:-1])]
    out += [f"{line} {words(rng, 10)}" for _ in range(60)]
    base = words(rng, 90)
    return out + [mutated(rng, base, rng.randint(1, 6)) for _ in range(70)]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """documents, benchmark and embeddings in single files, which both engines read."""
    at, rng = tmp_path_factory.mktemp("tables"), random.Random(23)
    texts = many_texts(rng)
    ids = [i * 3 for i in range(len(texts))]
    rng.shuffle(ids)
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": ["en"] * len(ids), "score": [1] * len(ids)}), at / "documents.parquet", row_group_size=50)
    items = [texts[9][:400], texts[30], texts[-1], "a b c", "", None, "one ONE two", " ".join(t for t in texts[-30:])]
    pq.write_table(pa.table({"item_id": list(range(len(items))), "text": items, "rank": items}), at / "benchmark.parquet")
    gen = np.random.default_rng(5)
    vectors = [v.tolist() for v in gen.normal(0, 0.2, (700, 16)).astype(np.float32)]
    vectors[40:80] = [vectors[3]] * 40
    vectors[100], vectors[101], vectors[102], vectors[103] = None, [None, *vectors[0][1:]], [float("nan"), *vectors[0][1:]], [float("-inf"), *vectors[0][1:]]
    kind = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("error", pa.string())])
    labels = [None if i % 7 == 0 else i % 5 for i in range(700)]
    pq.write_table(pa.table({"vec_id": [999 - i for i in range(700)], "embedding": vectors, "label": labels, "error": ["x"] * 700}, kind), at / "embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["op11_minhash", "op12_ranked_search", "op13_vector_codes"])
def test_query_is_its_sql(spark, tables, name):
    compare(queries.QUERIES[name](spark, tables[0]), tables[1], queries.ORACLE_SQL[name])


def plain_sets(texts, width):
    w = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(x[i : i + width]) for i in range(max(len(x) - width + 1, 1))} if x else set() for x in w]


@pytest.mark.parametrize(("tile", "few"), [(8, 3), (8, 16), (1024, 16)])
def test_minhash_is_brute_force(spark, monkeypatch, tile, few):
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "SMALL", few)
    texts = many_texts(random.Random(tile))
    rows = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    s = plain_sets(texts, 2)
    root = roots(len(s), [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])])
    assert [(rows[i].n_shingles, rows[i].component_id, rows[i].kept) for i in range(len(s))] == [(len(s[i]), root[i], root[i] == i) for i in range(len(s))]


def test_registers_estimate_jaccard():
    gen = np.random.default_rng(1)
    for n in (5, 40, 2000):
        found = []
        for _ in range(30):
            a = gen.integers(0, 1 << 63, n, np.uint64)
            b = a.copy()
            b[: n // 5] = gen.integers(0, 1 << 63, n // 5, np.uint64)
            one, two = minhash.registers(a), minhash.registers(b)
            differing = np.bitwise_count(minhash.compressed(one[None]) ^ minhash.compressed(two[None])).sum()
            found.append((np.mean(one == two), minhash.estimated(differing)))
        truth = (n - n // 5) / (n + n // 5)
        assert np.allclose(np.mean(found, axis=0), truth, atol=0.05)
    assert minhash.registers(np.array([7], np.uint64)).shape == (512,)


def test_short_sets_keep_their_links(spark):
    """Sets of 4 to 12 five-word shingles, where one word more or less is just within 0.8."""
    rng, out = random.Random(8), ["w311420 w390408 w48042 w319286 w141742 w582888 w505254 w227991 w756349"]
    out.append(out[0].rsplit(" ", 1)[0])
    for _ in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(8, 16))]
        out += [" ".join(base), " ".join(base[:-1]), " ".join(base[1:]), " ".join([*base[:-2], base[-1]])]
    rows = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3)).collect()}
    root = jaccard_roots(out)
    assert root[1] == 0 and [rows[i] for i in range(len(out))] == root


def test_near_copies_with_boilerplate_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 8)
    monkeypatch.setattr(simhash, "common", lambda docs, width: np.sort(similar.shingle_hashes(line, 5))[::-1].copy())
    rng = random.Random(14)
    line, base = words(rng, 14), words(rng, 80)
    out = [f"{line} {words(rng, 12)}" for _ in range(60)] + [mutated(rng, base, rng.randint(0, 4)) for _ in range(60)]
    rows = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")).collect()}
    assert [rows[i] for i in range(len(out))] == jaccard_roots(out)


def test_small_groups_are_large_ones():
    gen = np.random.default_rng(8)
    n = 60
    rows = {"fp": np.arange(n), "comp": gen.integers(0, 20, n), "n": gen.integers(8, 11, n), "sketch": gen.integers(0, 1 << 8, (n, 1)).astype(np.uint64)}
    group, role = np.sort(gen.integers(0, 9, n)), gen.integers(1, 4, n)
    differ = lambda a, b: (np.bitwise_count(a["sketch"][..., 0] ^ b["sketch"][..., 0]).astype(np.int32), (a["n"] + b["n"]) % 5 != 0)
    x, y, far, more = similar._small(group, role, rows, 2, 80, differ)
    across = lambda a, b: differ({k: v[:, None] for k, v in a.items()}, {k: v[None] for k, v in b.items()})
    for g in set(group.tolist()):
        left, right = (np.flatnonzero((group == g) & (role & bit > 0)) for bit in (2, 1))
        i, j, d, m = similar.partners({k: v[left] for k, v in rows.items()}, {k: v[right] for k, v in rows.items()}, 2, 80, across)
        own = np.isin(x, left) & (group[x] == g)
        assert sorted(zip(x[own], far[own], more[own], strict=True)) == sorted(zip(left[i], d, m, strict=True))
        assert not (rows["comp"][x[own]] == rows["comp"][y[own]]).any()


def test_parities_are_a_bound():
    gen = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(gen.integers(0, 400, gen.integers(1, 300)).astype(np.uint64) << np.uint64(20)) for _ in range(2))
        odd = int(np.bitwise_count(simhash.parities(a) ^ simhash.parities(b)).sum())
        assert odd <= len(np.setxor1d(a, b))


def test_pairs_that_cannot_be_similar():
    """Parities of each size are a bound, and rule out nearly all sets of similarity 0.7, small and large, before whole sets are made again."""
    gen = np.random.default_rng(5)

    def sketch(s):
        return {"n": np.array([len(s)]), "sketch": np.concatenate([minhash.compressed(minhash.registers(s)[None])[0], similar.parities(s, minhash.PARITY)])[None]}

    for size, other in [(100, 100), (150, 150), (5000, 5000), (40000, 36000)]:
        for likeness, kept in [(0.81, True), (0.7, False)]:
            both = int(likeness / (1 + likeness) * (size + other)) + 1
            whole = gen.integers(0, 1 << 63, size + other - both).astype(np.uint64)
            a, b = np.unique(whole[:size]), np.unique(whole[size - both :])
            assert similar.similar(a, b, 80) == kept
            assert similar.can_be_similar(*(similar.wide_parities(s).tobytes() for s in (a, b)), len(a) + len(b), 80) == kept
            if kept or size < 200:
                assert minhash._differ(80)(sketch(a), sketch(b))[1].tolist() == [kept]
    assert similar.can_be_similar(*[similar.wide_parities(np.empty(0, np.uint64)).tobytes()] * 2, 0, 80)


def test_strips_of_shingles_change_nothing():
    rng = random.Random(4)
    for t in ["", "a", "A b", words(rng, 40), " ".join(["a"] * 9), "A  b\n\n c\td é"]:
        for width in (1, 2, 5):
            want = np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(s), 42) for s in plain_sets([t], width)[0]], np.uint64))
            for strip in (1, 7, 1 << 20):
                assert similar.shingle_hashes(t, width, strip).tolist() == want.tolist()


def test_wand_skips_and_loses_nothing():
    gen = np.random.default_rng(2)
    docs = [np.sort(gen.choice(4000, n, replace=False)).astype(np.int32) for n in (3900, 2500, 40, 12, 900, 5)]
    impacts = [gen.integers(1, top, len(d)) for d, top in zip(docs, (30, 60, 5000, 9000, 400, 8000), strict=True)]
    total = np.zeros(4000, np.int64)
    for d, x in zip(docs, impacts, strict=True):
        total[d] += x
    heap, ids = ranked.Heap(10), np.arange(4000)[::-1].copy()
    scored = ranked.wand(docs, impacts, np.array([x.max() for x in impacts]), ids, heap)
    best = sorted(zip(-total, ids, strict=True))[:10]
    assert list(zip(-heap.score, heap.doc, strict=True)) == best and scored < 1500


def test_bounds_spare_groups():
    """Scanned groups are few after the first round, and assignments are those of all distances, ties included."""
    gen = np.random.default_rng(9)
    x = gen.integers(-40, 40, (3000, 4)) + 300 * gen.integers(0, 12, (3000, 1))
    book = x[:200].copy()
    group = vector_codes.groups_of(book)
    near, up, low, error = vector_codes.Assigner(book, group, None).assign(x, None, None, None)
    for _ in range(3):
        moved = book + gen.integers(-2, 3, book.shape)
        a = vector_codes.Assigner(moved, group, book)
        seen = []
        scan = a._scan
        a._scan = lambda x, rows, *rest: (seen.append((rest[2][rows] <= rest[1][rows, None]).mean() * len(rows) / len(x)), scan(x, rows, *rest))  # noqa: B023
        near, up, low, error = a.assign(x, near, up, low)
        d = ((x[:, None] - moved[None]) ** 2).sum(axis=2)
        assert (near == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all() and sum(seen) < 0.5
        book = moved


def test_codes_of_odd_vectors(spark):
    kind = "VEC_ID string, vec_id long, embedding array<double>, label string, code string"
    rows = [("a", 1, [0.5], "x", "c"), ("a", None, [0.1, 0.2, 0.3, 0.4, -0.00001], None, "c"), ("a", 1, [0.5], "x", "c"), ("b", 2, None, "x", "c"), ("b", 3, [], None, "c"), ("b", 4, [1e300, -1e300], "y", "c")]
    out = vector_codes.compress(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id or -1, r.error) for r in out) == [(-1, 0), (1, 0), (1, 0), (3, 0), (4, 0)] and len({r.code for r in out}) == 4
    assert vector_codes.compress(spark.createDataFrame(rows[3:4], kind)).count() == 0


def test_search_of_odd_rows(spark):
    docs = spark.createDataFrame([("x", None, "word one", 1), ("y", 7, "word", 1), ("y", 7, "word", 1), ("z", 8, None, 1), ("z", 9, " ,. ", 1)], "DOC_ID string, doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, "Word", "a"), (1, "one", "b"), (1, "one", "b"), (None, "word", "c"), (3, "", "d"), (4, None, "e")], "item_id long, text string, doc_id string")
    out = sorted(((r.item_id or 0), r.rank, r.doc_id or 0) for r in ranked.search(docs, items).collect())
    assert out == [(0, 1, 7), (0, 2, 7), (0, 3, 0), (1, 1, 0), (1, 1, 7), (1, 2, 7), (1, 3, 0)]
    assert ranked.search(docs.limit(0), items).count() == 0 and ranked.search(docs, items.limit(0)).count() == 0


def test_minhash_of_odd_rows(spark):
    same = "the same text over and over again"
    rows = [("x", None, same, 1), ("y", 7, same, 1), ("y", 7, same, 1), ("z", 7, None, 1), ("z", 8, "", 1), ("w", 9, "", 1)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "DOC_ID string, doc_id long, text string, fp long")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in out) == [(0, 6, 0, True), (7, 0, 7, True), (7, 6, 0, False), (7, 6, 0, False), (8, 0, 8, True), (9, 0, 9, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_unknown_languages_go(spark):
    rng = random.Random(6)
    english = "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all she they were my are".split()
    french = "de la le et les des en un du une que est pour qui dans sur pas au plus par avec se son il ne ce elle mais comme ou nous vous leur cette".split()
    rows = [(i, " ".join(rng.choices(english if i % 2 else french, k=30)), "en" if i % 2 else "fr") for i in range(200)]
    odd = {900: "Η γλώσσα αυτή δεν είναι γνωστή εδώ και πρέπει να φύγει", 901: "这是一种未知的语言 所以必须离开 " * 3, 902: "qqqq zzzz xxxx " * 4, 907: "A.", 903: "123", 904: None, 905: "the people were here", 906: "elle est dans la maison"}
    docs = spark.createDataFrame(rows + [(i, t, None) for i, t in odd.items()], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.accepted(docs).collect()}
    assert kept == {r[0] for r in rows} | {905, 906, 907}  # what is too short to judge stays
