"""Removal of repeated byte strings with a distributed, sampled suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.llm._common import NULL_ID, forget, pick, prepare, settled, sliced, stored, tasks, uncollected

#: Bytes of the strings at whose start the sampled suffixes are, below SPAN.
GRAM = 40
#: So many leads of GRAM bytes are broadcast at most; beyond, AQE splits the hot ones' joins.
LEADS = 100_000
#: Bytes of text that are sketched at once; positions in them take 24 bits.
BLOCK = 256 << 10
_POSITION = np.uint64((1 << 24) - 1)


class _Rolling:
    """Hashes of any substring: sums of random byte values times powers, modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(rng.integers(0, 2**63)) * 8 + 5
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 2**64))):
                a = np.full(size, base % 2**64, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.inverse[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_first, _second = _Rolling(61), _Rolling(62)


def sample(texts: list[bytes], span: int, gram: int) -> dict[str, np.ndarray]:
    """The sampled suffixes of some documents.

    Of each `span` bytes of a document the gram with the least hash (the first
    such) is an anchor, so equal strings of that length have their anchors at
    equal places. Windows in a row with one anchor are a piece: `n` windows from
    `lo` on, anchor `a` bytes behind lo. gram: hash of the bytes at the anchor;
    piece: hash of all the piece's bytes. doc: index of the text.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = {k: np.empty(0, np.int64) for k in ("gram", "piece", "doc", "lo", "n", "a")}
    if len(data) < span:
        return empty
    one, two = _first.prefix(data), _second.prefix(data)
    grams = len(data) - gram + 1
    hashes = _first.of(one, slice(0, grams), slice(gram, gram + grams))
    least = (hashes & ~_POSITION) | np.arange(grams, dtype=np.uint64)
    width, have = span - gram + 1, 1
    while have < width:  # least[i]: over `have` grams from i on
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & _POSITION).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int8)
    long = sizes >= span
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, starts[long] + sizes[long] - span + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    lo = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    hi = np.flatnonzero(ends)
    doc = np.searchsorted(starts, lo, "right") - 1
    n, a = hi - lo + 1, anchor[lo] - lo
    piece = _second.of(two, lo, hi + span) ^ mixed((n * 1_000_003 + a).astype(np.uint64))
    return {"gram": hashes[anchor[lo]].view(np.int64), "piece": piece.view(np.int64), "doc": doc, "lo": lo - starts[doc], "n": n, "a": a}


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals lo to hi (excluded) in each doc, touching ones joined."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    far = int(hi.max()) + 1
    _, rank = np.unique(doc, return_inverse=True)
    reach = np.maximum.accumulate(hi + rank * far) - rank * far
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], reach[last]


def multikey_groups(words: np.ndarray) -> np.ndarray:
    """A number for each row of big-endian words, equal for equal rows only.

    Multikey quicksort with 8-byte characters: rows are parted by the word at
    the present depth, what is equal there goes on to the next word, and rows
    that have become alone in their part are left. All parts of a depth are
    parted at once.
    """
    part = np.zeros(len(words), np.int64)
    active, used = np.arange(len(words)), 1
    for depth in range(words.shape[1]):
        if not len(active):
            break
        char = words[active, depth]
        order = np.lexsort((char, part[active]))
        active, char = active[order], char[order]
        old = part[active]
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (char[1:] != char[:-1])))
        label = np.cumsum(new) - 1
        part[active] = used + label
        used += int(label[-1]) + 1
        active = active[np.bincount(label)[label] > 1]
    return part


def repeats(key: np.ndarray, doc: np.ndarray, rank: np.ndarray, lo: np.ndarray, pieces: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the piece, start in its doc) of each window that another one before it equals; key: numbers of equal grams."""
    n = np.array([len(p) - span + 1 for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum([0, *(len(p) for p in pieces[:-1])])
    owner = np.repeat(np.arange(len(pieces)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    windows = np.zeros((len(owner), -(-span // 8) * 8), np.uint8)
    windows[:, :span] = np.lib.stride_tricks.sliding_window_view(data, span)[starts[owner] + offset]
    group = multikey_groups(np.concatenate([key[owner][:, None].astype(np.uint64), windows.view(">u8")], axis=1))
    at = lo[owner] + offset
    order = np.lexsort((at, rank[owner], doc[owner], group))
    g, d, r, p = group[order], doc[owner][order], rank[owner][order], at[order]
    same = np.concatenate(([False], g[1:] == g[:-1]))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))
    late = same & ((d != d[head]) | (r != r[head]) | (p != p[head]))
    return owner[order][late], p[late]


def _keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """key (doc_id, or the least long for null), rank (0 unless texts differ under one id), doc_id, text, and, if whole, the row."""
    if whole:
        names = docs.columns
        flat = docs.toDF(*(f"_in{i}" for i in range(len(names))))
        at = {c: ([i for i, n in enumerate(names) if n == c] or [i for i, n in enumerate(names) if n.lower() == c])[0] for c in ("doc_id", "text")}
        rest = F.struct(*(F.lit(None).cast("string").alias(c) if i == at["text"] else F.col(c) for i, c in enumerate(flat.columns)))
        rows = flat.select(F.col(f"_in{at['doc_id']}").cast("long").alias("doc_id"), F.col(f"_in{at['text']}").cast("string").alias("text"), rest.alias("row"))
    else:
        rows = pick(docs, doc_id="long", text="string")
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    twice = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    if twice.isEmpty():
        return rows.withColumn("rank", F.lit(0).cast("int"))
    from pyspark.sql import Window

    hashed = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = hashed.join(twice, "key", "left_semi").select("key", "hash").distinct()
    ranks = texts.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("hash")))
    return hashed.join(ranks, ["key", "hash"], "left").withColumn("rank", F.coalesce("rank", F.lit(0))).drop("hash")


_PIECE = "gram long, key long, rank int, lo long, n int, a int"
_LOCAL = f"{_PIECE}, hot boolean"
_FOUND = f"kind int, {_PIECE}"


def _record(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.strip().split() for f in names.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _sketch(span: int, gram: int, hot: np.ndarray, sampler: Callable = sample):
    """Pieces of keyed texts, and intervals to remove (a: -1, n: length) of pieces whose bytes another one earlier in the batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=4 << 20):
            key, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [(text or "").encode("utf-8") for text in batch.column(3).to_pylist()]
            units: list[tuple[int, int, bytes]] = []
            found: list[dict[str, np.ndarray]] = []
            size = 0

            def flush() -> None:
                nonlocal units, size
                s = sampler([u[2] for u in units], span, gram)
                row, base = (np.array([u[i] for u in units], np.int64) for i in (0, 1))
                s["lo"] = s["lo"] + base[s["doc"]]
                s["doc"] = row[s["doc"]]
                found.append(s)
                units, size = [], 0

            for i, data in enumerate(texts):
                for at in range(0, max(len(data) - span + 1, 0), BLOCK):  # a very long text in strips of windows
                    units.append((i, at, data[at : at + BLOCK + span - 1]))
                    size += len(units[-1][2])
                    if size >= BLOCK:
                        flush()
            if units:
                flush()
            if not found:
                continue
            s = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
            order = np.lexsort((s["lo"], rank[s["doc"]], key[s["doc"]], s["piece"], s["gram"]))
            g, p, row, lo, n, a = (s[k][order] for k in ("gram", "piece", "doc", "lo", "n", "a"))
            same = np.concatenate(([False], (g[1:] == g[:-1]) & (p[1:] == p[:-1])))
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))
            end = lo + n + span - 1
            at = np.flatnonzero(same)
            for i, h in zip(at.tolist(), head[at].tolist(), strict=True):  # equal hashes: are the bytes?
                if texts[row[i]][lo[i] : end[i]] != texts[row[h]][lo[h] : end[h]]:
                    same[i] = False
            d, r = key[row], rank[row]
            late = same & ((d != d[head]) | (r != r[head]) | (lo != lo[head]))
            first = ~same
            yield _record(_LOCAL, g[first], d[first], r[first], lo[first], n[first], a[first], np.isin(g[first], hot))
            owners, at = np.unique(np.stack([d[late], r[late]], axis=1), axis=0, return_inverse=True)
            at, lo, hi = merged(at.ravel(), lo[late], end[late])
            d, r = owners[at, 0], owners[at, 1]
            yield _record(_LOCAL, mixed(d.astype(np.uint64) * np.uint64(31) + lo.astype(np.uint64)).view(np.int64), d, r, lo, hi - lo, np.full(len(d), -1), np.zeros(len(d), bool))

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by gram: kind 1, intervals to remove (n: length); kind 0, pieces of grams that have several, or are hot."""
    waiting, told = None, False  # the last piece, and whether it was given out
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        ready = columns[5] < 0
        if ready.any():
            yield _record(_FOUND, np.ones(ready.sum()), *(x[ready] for x in columns[:6]))
            columns = [x[~ready] for x in columns]
        if not len(columns[0]):
            continue
        if waiting is not None:
            columns = [np.concatenate(([w], x)) for w, x in zip(waiting, columns, strict=True)]
        equal = columns[0][1:] == columns[0][:-1]
        out = columns[6].astype(bool)
        out[1:] |= equal
        out[:-1] |= equal
        last = bool(out[-1])
        if waiting is not None and told:
            out[0] = False
            last = last or len(out) == 1
        told, waiting = last, [x[-1] for x in columns]
        yield _record(_FOUND, np.zeros(out.sum()), *(x[out] for x in columns[:6]))


class DocFilter:
    """Fixed-size Bloom filter over (key, rank): which documents to join at all. Its 2 MB hold at every size."""

    BITS = 24

    def __init__(self, rows: DataFrame):
        at = F.pmod(F.xxhash64("key", "rank"), F.lit(1 << self.BITS))
        words = rows.select(at.alias("at")).selectExpr("at div 32 as word", "shiftleft(1L, cast(at % 32 as int)) as bit")
        got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**19 rows
        self.table = np.zeros(1 << (self.BITS - 5), np.uint32)
        self.table[got.column(0).to_numpy()] = got.column(1).to_numpy().astype(np.uint32)

    def placed(self, docs: DataFrame) -> DataFrame:
        """docs with a last column `at`, which has() reads."""
        return docs.withColumn("at", F.pmod(F.xxhash64("key", "rank"), F.lit(1 << self.BITS)))

    def has(self, at: np.ndarray) -> np.ndarray:
        """Which of the places may be those of rows in the filter."""
        return (self.table[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)

    def split(self, docs: DataFrame, rest: bool) -> DataFrame:
        """The rows that may be in the filter, or the rest, unchanged."""
        has, marked = self.has, self.placed(docs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(has(batch.column(batch.num_columns - 1).to_numpy()) != rest))

        return marked.mapInArrow(uncollected(run), marked.schema).drop("at")


def hot_grams(docs: DataFrame, span: int, gram: int, n: int, of: int = 64) -> np.ndarray:
    """Grams that a probe, every of-th document by hash, has so often that a task would mostly hold them: 16 a task at most.

    Only where their pieces are sent depends on it, no result does.
    """
    probe = docs.where(F.pmod(F.xxhash64("key", "rank"), F.lit(of)) == 0).select("key", "rank", "doc_id", "text")
    counts = probe.mapInArrow(uncollected(_sketch(span, gram, np.empty(0, np.int64))), _LOCAL).where("a >= 0").groupBy("gram").agg(F.count("*").alias("n"))
    counts = stored(counts.where("n >= 8"), "probe")
    total = counts.agg(F.sum("n")).first()[0] or 0
    got = counts.where(F.col("n") > max(32, total // (16 * n))).select("gram").toArrow()
    forget(counts)
    return np.sort(got.column(0).to_numpy())


def repeated_spans(docs: DataFrame, span: int = 100, gram: int = GRAM, group: int | None = None, sampler: Callable = sample) -> DataFrame:
    """(key, rank, spans): the bytes to remove of each keyed document that has any, as intervals lo, hi. See dedup()."""
    spark = prepare(docs.sparkSession)
    n = tasks(spark, docs)
    hot = hot_grams(docs, span, gram, n)
    local = docs.select("key", "rank", "doc_id", "text").mapInArrow(uncollected(_sketch(span, gram, hot, sampler)), _LOCAL)
    salt = F.when(F.col("hot"), F.xxhash64("key", "rank", "lo")).otherwise(F.lit(0))
    found = stored(local.repartition(n, "gram", salt).sortWithinPartitions("gram").mapInArrow(uncollected(_met), _FOUND), "pieces")
    pieces = found.where("kind = 0")
    wanted = pieces.groupBy("key", "rank").agg(F.collect_list(F.struct("lo", "n", "a")).alias("pieces"))
    held = DocFilter(pieces.select("key", "rank")).split(docs.select("key", "rank", "text"), rest=False).join(wanted, ["key", "rank"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            tail, head, key, rank, lo = [], [], [], [], []
            for k, r, text, own in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                data = text.encode("utf-8")
                for x in own:
                    at = x["lo"]
                    middle = at + x["a"]
                    tail.append(data[middle : at + x["n"] + span - 1])
                    head.append(data[at:middle])
                    lo.append(at)
                key += [k] * len(own)
                rank += [r] * len(own)
            yield _record(_SUFFIX, tail, head, key, rank, lo)

    suffixes = stored(held.mapInArrow(uncollected(cut), _SUFFIX), "suffixes")
    ordered = suffixes.repartitionByRange(n, "tail", "head", "key", "rank", "lo").sortWithinPartitions("tail", "head", "key", "rank", "lo")
    told = stored(ordered.mapInArrow(uncollected(_distinct(gram)), f"part int, kind int, {_SUFFIX}"), "distinct")
    whole = told.where("kind = 0").select("key", "rank", "lo", (F.col("lo") + F.octet_length("head") + F.octet_length("tail")).alias("hi"))
    whole = whole.union(_boundaries(told, lambda r: len(r["head"]) + len(r["tail"])))

    others = told.where("kind = 3").select(F.substring("tail", 1, gram).alias("lead"), "tail", "head", "key", "rank", "lo")
    count = others.count()
    if group is None:
        group = min(4096, max(64, count // (4 * n)))
    sizes = others.groupBy("lead").agg(F.count("*").alias("size")).where(F.col("size") > group).select("lead", F.lit(True).alias("large"))
    # at most count / group leads are that large: few enough to be sent to all tasks, which no hot lead then fills
    dealt = others.join(F.broadcast(sizes) if count // group <= LEADS else sizes, "lead", "left")
    small = dealt.where("large is null").select("lead", "tail", "head", "key", "rank", "lo").repartitionByRange(n, "lead").sortWithinPartitions("lead", "key", "rank", "lo")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tail, key, rank, lo = [], [], [], []
            for t, h, k, r, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = h + t
                count = len(data) - span + 1
                tail += [data[i : i + span] for i in range(count)]
                key += [k] * count
                rank += [r] * count
                lo += range(at, at + count)
            yield _record(_SUFFIX, tail, [b""] * len(tail), key, rank, lo)

    large = dealt.where("large").select("tail", "head", "key", "rank", "lo").mapInArrow(uncollected(windows), _SUFFIX)
    large = large.repartitionByRange(n, "tail", "key", "rank", "lo").sortWithinPartitions("tail", "key", "rank", "lo")
    seen = stored(large.mapInArrow(uncollected(_distinct(span)), f"part int, kind int, {_SUFFIX}"), "suffix-order")
    across = seen.where("kind = 0").select("key", "rank", "lo", (F.col("lo") + span).alias("hi")).union(_boundaries(seen, lambda r: span))

    spans = found.where("kind = 1").select("key", "rank", "lo", (F.col("lo") + F.col("n")).alias("hi")).union(whole)
    spans = spans.union(small.mapInArrow(uncollected(_within(span)), "key long, rank int, lo long, hi long")).union(across)
    return spans.groupBy("key", "rank").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


_SUFFIX = "tail binary, head binary, key long, rank int, lo long"


def _distinct(gram: int):
    """Compares each row's bytes with those of the row before, over a partition of a total order of (tail, head, key, rank, lo).

    kind 0: the bytes are those of an earlier row. kind 3: the first of its
    bytes whose first `gram` bytes of tail others have too, or may have in
    another partition. kinds 1 and 2: the partition's first and last row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        first: tuple | None = None  # the first row of the present bytes
        waiting: tuple | None = None  # a first of its bytes that has no neighbour yet
        lead, opening, row = None, True, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if first is None:
                    out.append((1, row))
                elif row[0] == first[0] and row[1] == first[1]:
                    if row[2:] != first[2:]:
                        out.append((0, row))
                    continue
                first = row
                if row[0][:gram] == lead:
                    if waiting is not None:
                        out.append((3, waiting))
                        waiting = None
                    out.append((3, row))
                else:
                    opening = lead is None
                    lead, waiting = row[0][:gram], row
                    if opening:
                        out.append((3, row))
                        waiting = None
            yield _record(f"part int, kind int, {_SUFFIX}", [me] * len(out), [k for k, _ in out], *([r[i] for _, r in out] for i in range(5)))
        if row is not None:
            last = [(2, row)] + ([(3, waiting)] if waiting is not None else [])
            yield _record(f"part int, kind int, {_SUFFIX}", [me] * len(last), [k for k, _ in last], *([r[i] for _, r in last] for i in range(5)))

    return run


def _boundaries(told: DataFrame, length) -> DataFrame:
    """Intervals of rows that begin a partition with the bytes that another one ends with. Two rows a partition reach the driver."""
    late, before = [], None
    for r in sorted(told.where("kind in (1, 2)").collect(), key=lambda r: (r["part"], r["kind"])):
        own, at = (bytes(r["tail"]), bytes(r["head"])), (r["key"], r["rank"], r["lo"])
        if r["kind"] == 1 and before is not None and own == before[0] and at != before[1]:
            late.append((*at, r["lo"] + length(r)))
        before = own, at
    return told.sparkSession.createDataFrame(late, "key long, rank int, lo long, hi long")


def _within(span: int, most: int = 1024):
    """Compares the pieces of each gram, over rows sorted by it; about `most` pieces, or one gram's, at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(leads: list, key: np.ndarray, rank: np.ndarray, lo: np.ndarray, pieces: list) -> pa.RecordBatch:
            numbers = np.cumsum([0, *(a != b for a, b in zip(leads[1:], leads, strict=False))])
            owner, at = repeats(numbers, key, rank, lo, pieces, span)
            owners, which = np.unique(np.stack([key[owner], rank[owner]], axis=1), axis=0, return_inverse=True)
            which, a, b = merged(which.ravel(), at, at + span)
            return _record("key long, rank int, lo long, hi long", owners[which, 0], owners[which, 1], a, b)

        leads, rows, pieces = [], [], []
        for batch in batches:
            leads += batch.column(0).to_pylist()
            rows.append(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (3, 4, 5)], axis=1))
            pieces += [h + t for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            while len(leads) >= most:
                end = most
                while end < len(leads) and leads[end] == leads[end - 1]:
                    end += 1
                if end == len(leads):
                    end = next((i for i in range(most - 1, 0, -1) if leads[i] != leads[i - 1]), 0)
                    if not end:
                        break
                table = np.concatenate(rows)
                yield out(leads[:end], table[:end, 0], table[:end, 1], table[:end, 2], pieces[:end])
                leads, rows, pieces = leads[end:], [table[end:]], pieces[end:]
        if leads:
            table = np.concatenate(rows)
            yield out(leads, table[:, 0], table[:, 1], table[:, 2], pieces)

    return run


def kept(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside all spans, and how many maximal runs were removed."""
    out, at, runs = [], 0, 0
    for lo, hi in sorted(spans):
        if hi <= at:
            continue
        if lo > at or runs == 0:
            runs += 1
        out.append(data[at : max(lo, at)])
        at = hi
    return b"".join([*out, data[at:]]), runs


def dedup(docs: DataFrame, span: int = 100, digests: bool = False, **how) -> DataFrame:
    """Removes from whole texts, as UTF-8, each byte covered by a string of `span` bytes that also starts earlier.

    Earlier: in a document with a smaller doc_id, or further left in the same
    one; matches never cross documents, and strings are judged on the input.
    Returns for each row of docs doc_id, n_bytes, n_removed, n_spans (maximal
    runs removed), and text (the bytes left; such as are no UTF-8 any more are
    dropped) or, with digests, kept_sha256 (of the bytes left, in hex).

    A null text counts as empty; a null doc_id is the smallest. Rows that share
    a doc_id are ordered by a hash of their text; such with one text too are
    one document, each with its result. Shorter texts are left as they are.

    Method. Suffixes are sampled where the least hash of all grams of some
    `span` bytes lies, so equal strings meet at equal grams; a piece is the text
    around one whose windows share it. Hashes only choose what is compared:
    pieces whose gram occurs nowhere else are left, and copies of a piece in one
    batch are found by hash and then compared. All others are sent as bytes,
    from the gram on, in ranges whose splitters are sampled; each range is
    sorted, and each piece is compared with the one before it, across the
    boundaries of ranges too, so a group of copies may fill many. What is left
    are different pieces that share a gram: their windows of `span` bytes are
    sorted by multikey quicksort, and equal ones are found next to each other.
    A gram with over `group` different pieces (a quarter of a task's even share,
    64 to 4096) is dealt by its windows and their places instead, again with
    comparisons across boundaries. Grams that a probe shows to be hot do not
    meet in one task either.
    """
    docs = _keyed(docs).select("key", "rank", "doc_id", "text")
    spans = settled(lambda: repeated_spans(docs, span, **how), "spans", docs.sparkSession)
    chosen = DocFilter(spans.select("key", "rank"))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    joined = chosen.split(docs, rest=False).join(spans, ["key", "rank"], "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    rest = chosen.split(docs, rest=True).select("doc_id", "text", none.alias("spans"))
    last = "kept_sha256" if digests else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8")
                left, runs = kept(data, [(x["lo"], x["hi"]) for x in own or ()])
                out.append((len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest() if digests else left.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", last])

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} string"
    return joined.mapInArrow(uncollected(run), schema).union(rest.mapInArrow(uncollected(run), schema))


def dedup_rows(docs: DataFrame, span: int = 100, **how) -> DataFrame:
    """The rows of docs with all their columns, texts without what dedup() removes, and n_chars, if there, set to the new length.

    Rows stay, even those whose text becomes empty; a null text stays null.
    """
    keyed = _keyed(docs, whole=True)
    spans = settled(lambda: repeated_spans(keyed, span, **how), "spans", docs.sparkSession)
    chosen = DocFilter(spans.select("key", "rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept(t.encode("utf-8"), [(x["lo"], x["hi"]) for x in own or ()])[0].decode("utf-8", "ignore") for t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], names=["text", "row"])

    joined = chosen.split(keyed, rest=False).join(spans, ["key", "rank"], "left")
    row = joined.schema["row"]
    changed = joined.where("spans is not null").select("text", "spans", "row").mapInArrow(uncollected(run), T.StructType([T.StructField("text", T.StringType()), row]))
    out = changed.unionByName(joined.where("spans is null").select("text", "row")).unionByName(chosen.split(keyed, rest=True).select("text", "row"))
    names = docs.columns
    at = [i for i, n in enumerate(names) if n == "text"] or [i for i, n in enumerate(names) if n.lower() == "text"]
    columns = []
    for i, field in enumerate(docs.schema.fields):
        value = F.col("text") if i == at[0] else F.col(f"row._in{i}")
        if field.name == "n_chars":
            value = F.length("text").cast(field.dataType)
        columns.append(value.alias(f"_out{i}"))
    return out.select(*columns).toDF(*names)
