"""Operators against brute force, round trips and held-out accuracy, with odd rows in every table."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from relspan.llm._common import pick
from relspan.llm import bpe, bpe_codec, chat, components, decontam, fingerprints, langid, lm_score, quality, simhash, suffix_dedup, token_counts

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage = words(rng, 45)
    out = [words(rng, rng.randint(1, 120)) for _ in range(30)]
    out += [out[3], out[3], f"{words(rng, 9)} {passage} {words(rng, 7)}", f"{words(rng, 3)} {passage}", "", None, " \n ", "Ünïcødé 日本語 👍🏽", "a" * 700, "en " * 300, out[5][:-3] + "zz", words(rng, 9000), f"{words(rng, 20)} <|endoftext|> x"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND).repartition(4)


def odd(spark):
    """Null and repeated ids, nulls, and columns whose names clash with those of results and of other columns."""
    kind = "DOC_ID string, doc_id long, text string, Text string, lang string, key string, rank string, fp string, component_id string, n_chars long"
    same = "the same text over and over again, the same text over and over again, the same text over and over again, yes"
    rows = [("x", None, same, "n", None, "k", "r", "f", "c", 1), ("y", 7, same, "n", "en", "k", "r", "f", "c", None), ("y", 7, same, "n", "en", "k", "r", "f", "c", None), ("z", 7, None, "n", "en", "k", "r", "f", "c", 0), ("z", 8, "", None, "", None, None, None, None, None)]
    return spark.createDataFrame(rows, kind)


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_token_counts_are_the_librarys(docs, texts, library):
    rows = got(token_counts.token_counts(docs, limit=100))
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(rows[3 * i]) == (3 * i, len((t or "").encode()), n, n > 100)


def test_codec_is_the_librarys_on_hard_joins(library):
    rng = random.Random(1)
    parts = ["'s", "'ll", " ", "  ", "\n", "the", "é", "日本", "<|endoftext|>", "<|end", "...", "'", "123", "٣", "a" * 300, " ", "'ve'", "👍🏽", "\r\n", "   \n  "]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(120)] + ["", " " * 3000, "'l" * 900, "'s" * 700]
    for t, ids in zip(many, bpe_codec.Codec("byte_bpe_50k.json")(many), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_codec_round_trip_and_digests(docs, texts):
    encoded = bpe_codec.encode(docs)
    back, digest = got(bpe_codec.decode(encoded)), got(bpe_codec.digests(docs))
    for i, t in enumerate(texts):
        assert back[3 * i].text == (t or "")
        assert digest[3 * i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert digest[3 * i].ids_sha256 == hashlib.sha256(np.array(back[3 * i].ids, "<u4").tobytes()).hexdigest()


def test_chats_read_back(spark):
    probe = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", probe), (-1, 1, "assistant", probe), (1, 0, "user", "a\\<|end|>\\"), (1, 1, "assistant", None), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (2, None, None, "\\[INST]["), (None, 3, "user<|text|>", "<<SYS>><|turn|>")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    out = got(chat.digest_chats(chat.format_chats(table)), "conv_id")
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, turns in by.items():
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[-1].valid and out[1].valid and not out[2].valid and not out[None].valid
    assert chat.digest_chats(chat.format_chats(table.limit(0))).count() == 0


def test_escaping_hides_control_strings():
    t = chat.Template()
    for n in range(1, 5):
        for parts in itertools.product(["\\", "<", "[INST]", "<|end|>", "</s>", "a"], repeat=n):
            text = "".join(parts)
            written = t.escape(text)
            assert t.unescape(written) == text and not any(c in written for c in t.controls)


def test_fingerprints(docs, texts):
    rows = got(fingerprints.compare_edited(docs))
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, follow = t or "", texts[(i + 1) % len(texts)] or ""
        new = t[: len(t) - len(t) // 4] + follow[: len(t) // 4]
        r = rows[3 * i]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(t)
        assert fingerprints.read(r.fingerprint) == fingerprints.fingerprint(t)
        if len(t) > 400 and len(set(t)) > 3:
            assert r.near_edited > 0.6
    assert rows[30 * 3].near_next == 1.0  # a copy follows


def plain_chunks(data):
    """Chunk by chunk: the gear hash of the 32 bytes before an end, or all since the start of the text."""
    out, start = {}, 0
    while start < len(data):
        end = min(start + fingerprints.MOST, len(data))
        for p in range(start + fingerprints.LEAST, end):
            h = 0
            for x in data[max(0, p - 32) : p]:
                h = (2 * h + int(fingerprints._GEAR[x])) % 2**32
            if h < 2**32 // (fingerprints.MEAN * 3 if p - start < fingerprints.MEAN else fingerprints.MEAN // 3):
                end = p
                break
        out[xxhash.xxh32_intdigest(data[start:end])] = end - start
        start = end
    return out


def plain_likeness(a, b):
    shares = [sum(n for d, n in x.items() if d in y) / sum(x.values()) if x else float(not y) for x, y in ((a, b), (b, a))]
    return min(shares)


def test_chunks_resist_shifts():
    rng = random.Random(5)
    text = words(rng, 900)
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint("inserted " + text)
    assert fingerprints.likeness(a, b) > 0.95 and fingerprints.likeness(a, fingerprints.fingerprint(words(rng, 900))) < 0.05


def removed(texts, span):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        cover = bytearray(len(data))
        for p in range(len(data) - span + 1):
            w = data[p : p + span]
            if w in seen:
                cover[p : p + span] = b"\1" * span
            seen.add(w)
        left = bytes(x for x, c in zip(data, cover, strict=True) if not c)
        out.append((len(data), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"group": 1}])
def test_suffix_dedup_is_brute_force(docs, texts, how):
    rows = got(suffix_dedup.dedup(docs, digests=True, **how))
    for i, want in enumerate(removed(texts, 100)):
        assert tuple(rows[3 * i])[1:] == want


@pytest.mark.parametrize("how", [{}, {"group": 1}])
def test_suffix_dedup_compares_bytes_and_splits_hot_grams(spark, docs, texts, monkeypatch, how):
    """Hashes that collide, and grams that are all hot, change nothing."""
    good = suffix_dedup.sample

    def weak(*args):
        found = good(*args)
        return found | {"piece": found["n"] * 100 + found["a"], "gram": found["gram"] % 50}

    monkeypatch.setattr(suffix_dedup, "hot_grams", lambda *_: np.arange(20))
    line = words(random.Random(9), 30)
    many = [*texts, *(f"{words(random.Random(i), 20)} {line} {words(random.Random(i + 99), 20)}" for i in range(60)), *([texts[4]] * 9)]
    rows = got(suffix_dedup.dedup(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").repartition(5), digests=True, sampler=weak, **how))
    for i, want in enumerate(removed(many, 100)):
        assert tuple(rows[i])[1:] == want


def test_very_long_text_is_cut_in_strips(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rng = random.Random(8)
    once = words(rng, 500)
    texts = [once + words(rng, 20) + once[50:1500], once[300:900]]
    found = suffix_dedup.sample([t.encode() for t in texts], 100, 40)
    assert len(found["lo"])
    rows = got(suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), digests=True))
    assert [tuple(rows[i])[1:] for i in (0, 1)] == removed(texts, 100)


def test_multikey_groups():
    rng = np.random.default_rng(0)
    table = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    part = suffix_dedup.multikey_groups(table)
    by = {}
    for row, p in zip(map(tuple, table), part, strict=True):
        assert by.setdefault(row, p) == p
    assert len(set(by.values())) == len(by)


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_strips_change_nothing(texts):
    rng = random.Random(4)
    for t in [t or "" for t in texts] + [words(rng, n) for n in (2, 3, 4, 5, 9)] + [" ".join(["a"] * 9), "A  b\n\n c\td"]:
        for strip in (1, 7, 40):
            assert simhash.simhash(t, 3, strip) == plain_simhash(t)
            assert quality.features(t, strip).tolist() == quality.features(t).tolist()


def test_near_duplicates_are_brute_force(docs, texts):
    rows = got(simhash.near_duplicates(docs))
    fps = [plain_simhash(t) for t in texts]
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for i in range(len(fps)):
        assert tuple(rows[3 * i]) == (3 * i, f"{fps[i]:016x}", 3 * root[i])


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_bit_sliced_links(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(radius)
    fps = set()
    for base in [rng.getrandbits(64) for _ in range(12)]:
        for _ in range(12):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius)
    at = {f: i for i, f in enumerate(signed)}
    mine = roots(len(fps), [(at[r.a], at[r.b]) for r in links.collect()])
    assert mine == roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius])


def word_sets(texts, width=5):
    w = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(x[i : i + width]) for i in range(max(len(x) - width + 1, 1))} for x in w]


def jaccard_roots(texts):
    s = word_sets(texts)
    return roots(len(s), [(i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])])


def test_one_of_each_is_brute_force_at_jaccard(spark):
    rng = random.Random(12)
    line, out = words(rng, 14), []
    for n in (5, 8, 12, 20, 60, 200, 200, 200):
        base = words(rng, n).split()
        out.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 4, 6):
            new = list(base)
            for at in rng.sample(range(n), min(edits, n)):
                new[at] = words(rng, 1)
            out.append(" ".join(new))
    out += [f"{line} {words(rng, 10)}" for _ in range(80)] + ["a b", "A b", "a c", "", None, " ", words(rng, 3000)]
    out.append(out[-1] + " " + words(rng, 200))
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3)
    rows, root = got(simhash.near_copies(docs)), jaccard_roots(out)
    assert [rows[i].component_id for i in range(len(out))] == root
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(root))
    sets = word_sets(out)
    far = [(i, j) for i in range(len(out)) for j in range(i) if root[i] == root[j] and (plain_simhash(out[i]) ^ plain_simhash(out[j])).bit_count() > 3 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(far) > 5  # what three words and 3 bits leave


@pytest.mark.parametrize("held", [16, 1 << 20])
def test_connected_components(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(140)] + [(400 + i, 401 + i) for i in range(40)] + [(5, 5)]
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = roots(500, edges)
    assert {(r.node, r.root) for r in rows} == {(x, root[x]) for e in edges if e[0] != e[1] for x in e} and len(rows) == len({r.node for r in rows})


def plain_alignment(a, b):
    best, above = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        row = [0.0]
        for j, y in enumerate(b):
            row.append(max(0.0, above[j] + (decontam.MATCH if x == y else decontam.MISMATCH), above[j + 1] + decontam.GAP, row[-1] + decontam.GAP))
        best, above = max(best, *row), row
    return best


def test_alignment_is_plain_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(1, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        score, lo, hi = decontam.align(a, b)
        assert score == pytest.approx(plain_alignment(a, b))
        assert plain_alignment(a, b[lo:hi]) == pytest.approx(score)


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_decontamination(spark, most):
    rng = random.Random(4)
    items = [words(rng, 30, "abcdefghijklmnop") for _ in range(6)]
    edited = items[1].split()
    for i in (3, 11, 19, 26):
        edited[i] = "changed"
    del edited[8]
    texts = [words(rng, 80), f"{words(rng, 20)} {items[0].upper()}! {words(rng, 9)}", f"{words(rng, 5)} {' '.join(edited)}", None, "", " ".join(items[2].split()[:5]), items[3]]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, score int")
    bench = spark.createDataFrame([*enumerate(items), (6, None), (7, ""), (8, "one")], "item_id long, text string")
    out = decontam.contaminated(docs, bench, most=most).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, 0), (2, 1), (6, 3)}
    assert next(r for r in out if r.doc_id == 1).score == 1.0
    assert sorted(r.doc_id for r in decontam.clean(docs, bench, most=most).collect()) == [0, 3, 4, 5]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.clean(docs.limit(0), bench).count() == 0


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_contaminated(texts, items, threshold=0.5):
    """Smith-Waterman of every whole text with every item."""
    out = set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            a, b = plain_words(item), plain_words(t)
            share = plain_alignment(a, b) / len(a) if a else 0.0
            if share >= threshold:
                out.add((i, j, round(share, 6)))
    return out


def edited(rng, item, filler):
    """An item with words inserted, replaced and left out."""
    out = []
    rate = rng.choice([0.1, 0.3, 0.5, 0.8])
    for w in item.split():
        kind = rng.random()
        if kind < rate / 3:
            out += [rng.choice(filler)] if rng.random() < 0.7 else []
        else:
            out.append(w)
        if rng.random() < rate:
            out += [rng.choice(filler) for _ in range(rng.choice([1, 1, 1, 2, 17]))]
    return " ".join(out)


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_decontamination_is_alignment_over_whole_texts(spark, most):
    rng = random.Random(21)
    filler = [words(rng, 1) for _ in range(40)]
    items = [" ".join(rng.choices(filler + [words(rng, 1, "xyzuvw") for _ in range(30)], k=n)) for n in (1, 2, 3, 4, 7, 12, 20, 20, 33)]
    items.append(" ".join(f"w{i}" for i in range(20)))
    texts = []
    for _ in range(90):
        around = [" ".join(rng.choices(filler, k=rng.randint(0, 40))) for _ in range(3)]
        texts.append(" ".join([around[0], edited(rng, rng.choice(items), filler), around[1], edited(rng, rng.choice(items), filler), around[2]]))
    z = " ".join(["z"] * 30)
    pairs = " zz ".join(f"w{i} w{i + 1}" for i in range(4, 20, 2))
    texts += [f"{z} w0 w1 w2 w3 {' '.join(['y'] * 17)} {pairs} {z}", " q ".join(f"w{i}" for i in range(20)), " ".join(rng.choices(filler, k=30)) + " W0_w1-W2, W3! w4 w5 w6 w7 w8 w9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = plain_contaminated(texts, items)
    out = decontam.contaminated(docs, bench, most=most).collect()
    assert {(r.doc_id, r.item_id, round(r.score, 6)) for r in out} == want and len(out) == len(want) > 150
    assert (90, 9, 0.625) in want and (91, 9, 0.525) in want
    assert {r.doc_id for r in decontam.clean(docs, bench, most=most).collect()} == set(range(len(texts))) - {i for i, _, _ in want}


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(12))
    kind = "DOC_ID string, doc_id long, Text string, text string, item_id long, score string"
    long = " ".join(["filler"] * 400_000) + " " + item + " tail" * 9
    docs = spark.createDataFrame([("a", None, "n", item, 1, "s"), ("a", 4, item, "nothing", 1, "s"), ("a", 5, None, f"x {item} y {item}", 1, "s"), ("a", 5, None, f"x {item} y {item}", 1, "s"), ("a", 6, None, None, 1, None), ("a", 7, None, " ", 1, None), ("a", 8, None, long, 1, None)], kind)
    bench = spark.createDataFrame([("t", 1, item), ("t", 1, item), ("t", None, item), (item, 2, None), (item, 3, "..")], "TEXT string, item_id long, text string")
    out = decontam.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.score) for r in out) == sorted((d, i, 1.0) for d in (0, 5, 5, 8) for i in (0, 1, 1))
    assert {(r.start, r.end) for r in out if r.doc_id == 5} == {(2, 2 + len(item))}
    assert {long[r.start : r.end] for r in out if r.doc_id == 8} == {item}
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r[1] for r in left.collect()) == [4, 6, 7]
    with pytest.raises(ValueError):
        decontam.clean(docs, bench, threshold=0.0)


def test_languages(spark):
    rng = random.Random(6)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ção", "ê", "nt"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(12)), lang) for i in range(240) for lang in [rng.choice(list(parts))]]
    rows += [(900, None, "aa"), (901, "123 !?", "bb"), (902, "lomika", None), (None, "schung", "bb")]
    out = got(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= out[i].score <= 1 for i in range(240))
    held = [i for i in range(240) if out[i].held_out]
    assert len(held) > 30 and np.mean([out[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[902].lang_pred == "aa"
    assert langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"


def test_hyperdimensional_bundles():
    v, known = langid.bundles(["Ab, ab", None, "12"])
    codes = langid.grams("Ab, ab")
    assert known.tolist() == [True, False, False] and [chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in codes.tolist()] == [" ab", "ab ", "b a", " ab", "ab "]
    one = np.roll(langid.letter(32), 2) * np.roll(langid.letter(97), 1) * langid.letter(98)
    assert (langid.vectors(codes[:1])[0] == one).all() and (v[0] == langid.vectors(codes).sum(axis=0)).all()


def test_quality(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, 40) if i % 4 else " | ".join(words(rng, 3).upper() for _ in range(9)), int(i % 4 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    out = got(quality.assess(docs, labels))
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and np.mean([out[i].predicted == rows[i][2] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    assert got(quality.assess(docs, labels.limit(0)))[500].score == 0.5


def plain_network(network, target, around):
    """Log likelihoods one by one, from the definition."""
    out = []
    for i, t in enumerate(target.tolist()):
        h = np.tanh(network.bias + sum(network.vectors[around[k, i]] * network.places[k] for k in range(len(around))))
        c, m = divmod(t, lm_score.MEMBERS)
        first, second = h @ network.class_w + network.class_b, h @ network.member_w[c] + network.member_b[c]
        out.append(first[c] - np.log(np.exp(first).sum()) + second[m] - np.log(np.exp(second).sum()))
    return np.array(out)


def test_network_is_its_definition_and_gradient():
    rng = np.random.default_rng(0)
    target, around, _ = lm_score.windows([rng.integers(0, 130, 40).astype(np.int32), rng.integers(0, 9, 7).astype(np.int32)])
    network = lm_score.Network(kind=np.float64)
    for name in network.SHAPES:
        getattr(network, name)[...] += rng.normal(0, 0.2, getattr(network, name).shape)
    g = {}
    assert np.allclose(network.log_likelihoods(target, around, g), plain_network(network, target, around))
    whole = {n: np.zeros(s) for n, s in network.SHAPES.items()}
    for n in ("class_w", "class_b", "bias", "places"):
        whole[n] += g[n]
    for c, _, w, b in g["members"]:
        whole["member_w"][c] += w
        whole["member_b"][c] += b
    for _, rows in g["vectors"]:
        whole["vectors"] += rows
    for name in network.SHAPES:
        values, slopes = getattr(network, name).reshape(-1), whole[name].reshape(-1)
        for at in {*np.argsort(-abs(slopes))[:6].tolist(), *rng.integers(0, len(values), 4).tolist()}:
            was = values[at]
            values[at] = was + 1e-5
            up = network.log_likelihoods(target, around).sum()
            values[at] = was - 1e-5
            down = network.log_likelihoods(target, around).sum()
            values[at] = was
            assert slopes[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_network_learns():
    rng = np.random.default_rng(0)
    target, around, _ = lm_score.windows([np.tile(rng.integers(0, 40, 50), 20).astype(np.int32)])
    network = lm_score.Network()
    start = network.log_likelihoods(target, around).mean()
    for _ in range(60):
        network.learn(target, around)
    assert network.log_likelihoods(target, around).mean() > start + 1


@pytest.mark.parametrize("counted", [0, 30])
def test_scores_are_plain_sums(spark, docs, texts, monkeypatch, counted):
    choose = lm_score.choose
    monkeypatch.setattr(lm_score, "choose", lambda counts: choose(counts, 20, counted))
    split = [re.findall(r"[^\W_]+|[^\w\s]+", (t or "").lower()) for t in texts]
    counts = Counter(w for s in split for w in s)
    found = choose(spark.createDataFrame([(w, lm_score.kind(w), n) for w, n in counts.items()], "word string, kind int, n long"), 20, counted)
    assert 0 < len(found.numbered) <= 20 and len(found.counted) <= counted and found.others.count() == len(counts) - len(found.numbered) - len(found.counted)
    assert min(counts[w] for w in found.numbered) >= max(n for w, n in counts.items() if w not in found.numbered)
    network = lm_score.train(docs, found.numbered)
    rare = {w: n for w, n in counts.items() if w not in found.numbered}
    kinds = [sum(n + 0.5 for w, n in rare.items() if lm_score.kind(w) == k) for k in range(3)]
    rows = got(lm_score.score(docs))
    for i, s in enumerate(split):
        numbers = [found.numbered.index(w) + 3 if w in found.numbered else lm_score.kind(w) for w in s]
        r = rows[3 * i]
        assert (r.n_tokens, r.n_rare) == (len(s), sum(w in rare for w in s))
        if not s:
            assert r.score is None and r.log_likelihood == 0
            continue
        target, around, _ = lm_score.windows([np.array(numbers, np.int32)])
        want = plain_network(network, target, around).sum()
        own = Counter(w for w in s if w in rare)
        for w, m in own.items():
            want += m * np.log((rare[w] - m + 0.5) / (kinds[lm_score.kind(w)] - sum(x for v, x in own.items() if lm_score.kind(v) == lm_score.kind(w))))
        assert r.log_likelihood == pytest.approx(want, rel=1e-3) and r.score == pytest.approx(r.log_likelihood / len(s))


def test_copies_vouch_for_each_other(spark):
    rng = random.Random(13)
    common = [words(rng, 1) for _ in range(40)]
    once = [" ".join(rng.choice([rng.choice(common), words(rng, 1, "stuvwxyz")]) for _ in range(60)) for _ in range(200)]
    rows = got(lm_score.score(spark.createDataFrame(list(enumerate(once + once[:20])), "doc_id long, text string")))
    assert min(rows[i].score for i in range(20)) > max(rows[i].score for i in range(20, 200))
    assert all(rows[i].score == pytest.approx(rows[200 + i].score) for i in range(20))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, texts):
    """Tables for the registered queries."""
    at, rng = tmp_path_factory.mktemp("tables"), random.Random(17)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ção", "ê", "nt"]}
    rows = [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    for i in range(200, 320):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(20)) + (" !!! BUY" * 6 if i % 3 == 0 else ""), lang, "t", 9))
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200, 320)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, texts[4]), (1, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    talks = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} says <|end|> {t}") for c in range(5) for t in range(4)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at), {r[0]: r for r in rows}, talks


def run(spark, folder, name, key="doc_id"):
    from relspan.llm import queries

    rows = queries.QUERIES[name](spark, folder[0]).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_op1_op5(spark, folder, library):
    counts, codes = run(spark, folder, "op1_token_counts"), run(spark, folder, "op5_bpe_codec")
    assert set(counts) == set(codes) == set(folder[1])
    for i, r in folder[1].items():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        assert tuple(counts[i])[1:4] == (len((r[1] or "").encode()), len(ids), len(ids) > 1024)
        assert codes[i].n_tokens == len(ids) and codes[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert codes[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain_quality(rows, held):
    """The model from its definition: ratios by counting, the dual solved to the end by many passes, margins of the held-out rows."""
    names = [set(quality.features(t or "").tolist()) for t, _ in rows]
    ratio = {}
    size = [quality.SPACE + sum(len(x) for x, (_, y) in zip(names, rows, strict=True) if y == c) for c in (0, 1)]
    seen = [Counter(f for x, (_, y) in zip(names, rows, strict=True) if y == c for f in x) for c in (0, 1)]
    for f in set().union(*names):
        ratio[f] = np.log((1 + seen[1][f]) / size[1]) - np.log((1 + seen[0][f]) / size[0])
    other = np.log(1 / size[1]) - np.log(1 / size[0])
    vectors = []
    for x in names + [set(quality.features(t or "").tolist()) for t in held]:
        v = {f: ratio.get(f, other) for f in x}
        norm = max(sum(u * u for u in v.values()) ** 0.5, 1e-9)
        vectors.append({f: u / norm for f, u in v.items()} | {"bias": 1.0})
    y = np.array([1 if c else -1 for _, c in rows])
    gram = np.array([[sum(u * b.get(f, 0.0) for f, u in a.items()) for b in vectors] for a in vectors])
    k = len(rows)
    cost = np.array([1 / (2 * np.mean(y == c)) for c in y])
    alpha = np.zeros(k)
    for _ in range(300):
        for i in range(k):
            alpha[i] = np.clip(alpha[i] - (y[i] * (gram[i, :k] @ (alpha * y)) - 1) / gram[i, i], 0, cost[i])
    return gram[k:, :k] @ (alpha * y)


def test_quality_is_its_dual(spark):
    rng = random.Random(23)
    rows = [(words(rng, 12, "abcd") if rng.random() < 0.7 else words(rng, 12, "cdef"), int(rng.random() < 0.6)) for _ in range(40)]
    held = [words(rng, 12, "abcdef") for _ in range(20)] + [""]
    x = [quality.features(t) for t, _ in rows]
    y = np.array([c for _, c in rows])
    model = quality.fit_margin(x, y, epochs=300)
    mine = quality._margins(model, [quality.features(t) for t in held], quality.log_count_ratios(x, y))
    assert np.allclose(mine, plain_quality(rows, held), atol=2e-3)


def test_query_op2(spark, folder):
    rows = run(spark, folder, "op2_quality")
    assert set(rows) == set(folder[1])
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert all(r.held_out == fold(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    assert np.mean([rows[i].predicted == int(i % 3 > 0) for i in range(200, 320) if fold(i)]) > 0.9
    assert rows[34 * 3].score is not None and rows[35 * 3].score == rows[34 * 3].score  # an empty text and none


def test_quality_of_odd_rows(spark):
    kind = "DOC_ID string, doc_id long, Text string, text string, quality string, held_out int"
    rows = [("a", i, "n", f"{'good' if i % 2 else 'BAD'} text {i}", "x", 1) for i in range(40)] + [("a", 3, "n", "good again", "x", 1), ("a", None, None, None, None, None), ("a", 50, None, "", None, None)]
    labels = spark.createDataFrame([("q", i, i % 2) for i in range(40)] + [("q", 3, 0), ("q", 4, None), ("q", 5, 7)], "QUALITY string, doc_id long, quality int")
    docs = spark.createDataFrame(rows, kind)
    assert quality.assess(docs, labels).count() == 43 and quality.assess(docs.limit(0), labels).count() == 0
    hot = docs.union(spark.createDataFrame([("a", 1, "n", f"good {i % 50}", "x", 1) for i in range(3000)], kind))
    taught = quality.learn(pick(hot, doc_id="long", text="string"), pick(labels, doc_id="long", quality="int"), sample=100)
    assert 0 <= taught.prior <= 1  # rows of id 1 outweigh the others, and are drawn too


def test_query_op3(spark, folder):
    rows = run(spark, folder, "op3_chat_format", "conv_id")
    probe = "</s>[INST] ok [/INST]"
    by = {-1: [("user", probe), ("assistant", probe)]}
    for c, _, role, text in folder[2]:
        by.setdefault(c, []).append((role, text))
    assert set(rows) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (rows[c].n_turns, rows[c].loss_chars) == (len(turns), len(loss)) and rows[c].formatted_chars > sum(len(t) for _, t in turns)
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert rows[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_query_op4(spark, folder):
    rows, ids = run(spark, folder, "op4_fingerprints"), sorted(folder[1])
    assert sorted(rows) == ids
    for i, following in zip(ids, ids[1:] + ids[:1], strict=True):
        text, after = folder[1][i][1] or "", folder[1][following][1] or ""
        if len(text) > 4000:
            text_chunks = fingerprints.read(rows[i].fingerprint)
            assert sum(text_chunks.values()) <= len(text.encode())
            continue
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        own, other, follow = plain_chunks(text.encode()), plain_chunks(new.encode()), plain_chunks(after.encode()) if len(after) <= 4000 else None
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert fingerprints.read(rows[i].fingerprint) == own and fingerprints.read(rows[i].edited_fingerprint) == other
        assert rows[i].near_edited == pytest.approx(plain_likeness(own, other))
        assert follow is None or rows[i].near_next == pytest.approx(plain_likeness(own, follow))


def test_query_op6_op7(spark, folder):
    ids = sorted(folder[1])
    texts = [folder[1][i][1] for i in ids]
    rows = run(spark, folder, "op6_suffix_dedup")
    for i, want in zip(ids, removed(texts, 100), strict=True):
        assert tuple(rows[i])[1:] == want
    fps = [plain_simhash(t) for t in texts]
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    rows = run(spark, folder, "op7_simhash")
    for k, i in enumerate(ids):
        assert tuple(rows[i]) == (i, f"{fps[k]:016x}", ids[root[k]])


def test_query_op8_op9(spark, folder):
    from relspan.llm import queries

    ids = sorted(folder[1])
    want = plain_contaminated([folder[1][i][1] if len(folder[1][i][1] or "") < 5000 else "" for i in ids], [folder[1][12][1], None])
    found = {(r.doc_id, r.item_id, round(r.score, 6)) for r in queries.QUERIES["op8_decontam"](spark, folder[0]).collect()}
    assert found == {(ids[i], j, s) for i, j, s in want} and (12, 0, 1.0) in found
    rows = run(spark, folder, "op9_lm_score")
    assert set(rows) == set(ids) and all((r.score is None) == (r.n_tokens == 0) for r in rows.values())


def plain_bundle(text):
    """Letter by letter: what is no letter is one space between words, and stands at both ends."""
    line = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
    total = np.zeros(langid.DIM)
    if line.strip():
        for a, b, c in zip(line, line[1:], line[2:], strict=False):
            total += np.roll(langid.letter(ord(a)), 2).astype(float) * np.roll(langid.letter(ord(b)), 1) * langid.letter(ord(c))
    return total


def test_query_op10(spark, folder):
    rows = run(spark, folder, "op10_language")
    assert set(rows) == set(folder[1])
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in rows}
    small = {i: plain_bundle(r[1]) for i, r in folder[1].items()}
    sums = {}
    for i, r in folder[1].items():
        if not held[i]:
            sums[r[2]] = sums.get(r[2], 0) + small[i]
    for i, r in rows.items():
        v = small[i]
        assert r.held_out == held[i]
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {lang: float(v @ p) / np.linalg.norm(v) / np.linalg.norm(p) for lang, p in sums.items()}
        best = max(cosines.values())
        assert cosines[r.lang_pred] == pytest.approx(best, abs=1e-5) and r.score == pytest.approx(max(best, 0), abs=1e-5)


def test_odd_rows_and_empty_tables(spark, docs):
    table = odd(spark)
    empty = docs.limit(0)
    per_row = [token_counts.token_counts, bpe_codec.encode, bpe_codec.digests, fingerprints.fingerprints, fingerprints.compare_edited, simhash.near_duplicates, suffix_dedup.dedup, langid.identify, lm_score.score]
    for f in per_row:
        assert f(table).count() == 5, f
        assert f(empty).count() == 0, f
    assert suffix_dedup.dedup_rows(table).columns == table.columns and suffix_dedup.dedup_rows(table).count() == 5
    assert langid.accepted(table).columns == table.columns
    one = simhash.one_of_each(table)
    assert one.columns == table.columns and one.count() == 2
    for f in (suffix_dedup.dedup_rows, langid.accepted, simhash.one_of_each):
        assert f(empty).count() == 0 and f(empty).columns == empty.columns


def test_pipeline_stages_keep_columns_and_decide(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item = words(rng, 25, "abcdefghijklmnop")
    base = [words(rng, 60) for _ in range(12)]
    texts = [*base, base[2], f"{words(rng, 10)} {item}", "123 456", None, base[4][:180] + " " + words(rng, 30)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = got(docs)
    assert set(left) == {*range(12), 16} and len(left[16].text) == left[16].n_chars < len(texts[16])
    before = corpus_pipeline.tables()
    final = got(corpus_pipeline.run(spark, str(tmp_path)))
    assert len(corpus_pipeline.tables()) == len(before) + 1  # what the last stage reads
    assert {i: r.n_tokens for i, r in final.items()} == {i: r.n_tokens for i, r in got(token_counts.token_counts(docs)).items()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    def tables(name, docs, bench):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        return f"{tmp_path}/{name}"

    rng = random.Random(31)
    item = words(rng, 25, "abcdefghijklmnop")
    same, other = words(rng, 60), words(rng, 60)
    rows = [("a", 1, "n", same, "en", 1), ("a", 1, "n", same, "en", 1), ("b", 1, "n", other, "en", 1), ("c", None, "n", words(rng, 50), None, None), ("d", 2, None, None, None, None), ("e", 3, None, "", "en", 0), ("f", 4, "n", f"{words(rng, 8)} {item}", "en", 2)]
    docs = spark.createDataFrame(rows, "row string, doc_id long, key string, text string, lang string, n_chars long")
    bench = spark.createDataFrame([("x", 0, item), ("x", None, None)], "score string, item_id long, text string")
    ids = lambda at: sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, at).collect())
    assert ids(tables("odd", docs, bench)) == [0, 1, 1]  # one of the rows that repeat, the other text of id 1, and the null id
    assert ids(tables("all", docs, bench.limit(0))) == [0, 1, 1, 4]
    assert ids(tables("none", docs.limit(0), bench)) == []
