"""SimHash near-duplicates: bit-sliced comparison of fingerprints, linked into components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.llm._common import NULL_ID, forget, pick, prepare, settled, stored, tasks, uncollected
from relspan.llm import similar
from relspan.llm.components import connected_components
from relspan.llm.similar import set_key, shingle_hashes
from relspan.llm.suffix_dedup import DocFilter

BITS = 64
_space = re.compile(rb"[\x20\x09-\x0D]").search
#: Buckets with more fingerprints than TILE are compared in pairs of tiles, each in a group of its own.
TILE = 2048
#: (query, word) items that are compared at once.
ITEMS = 1 << 15
#: Bit planes between two looks whether a block has left the radius.
STRIDE = 8
#: Radius within which near_copies() proposes its first pairs; no link depends on it.
NEAR = 14
#: Bits of parities(), a power of two.
PARITY = 1024


def simhash(text: str, width: int = 3, strip: int = 1 << 20) -> int:
    """Of the text with A-Z in lower case: bit b is set if it is in over half the shingles' XXH64 (seed 42).

    A long text goes strip by strip: no more than a strip's words and hashes are held at once.
    """
    data = text.encode("utf-8").lower()
    total, count, at, words = np.zeros(BITS, np.int64), 0, 0, []
    digest = xxhash.xxh64_intdigest
    while at < len(data):
        cut = _space(data, at + strip)
        end = cut.start() if cut else len(data)
        words += data[at:end].split()
        at = end
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1))
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], "<u8")
        count += len(h)
        for i in range(0, len(h), 1 << 16):
            total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words = words[len(words) - width + 1 :]
    if not count:
        return digest(b" ".join(words), 42) if words else 0
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long): one row for each row of docs, without a shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t or "", width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, doc_id="long", text="string").mapInArrow(uncollected(run), "doc_id long, fp long")


def bands(radius: int, count: int) -> list[int]:
    """Masks of bits such that fingerprints within the radius agree on all bits of one mask at least.

    The bits are cut into blocks; at most `radius` of them hold a difference,
    so some choice of the others agrees. More blocks make masks with more bits,
    and more of them; the more fingerprints, the more bits pay. Two bits over
    the logarithm of their count keep chance meetings rare.
    """
    best = None
    for blocks in range(radius + 1, radius + 5):
        edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
        masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
        best = masks
        if min(m.bit_count() for m in masks) >= np.log2(max(count, 2)) + 2:
            break
    return best


def planes(fps: np.ndarray) -> np.ndarray:
    """Row b: bit b of all fingerprints, 64 to a word."""
    n = -len(fps) % 64
    bits = np.unpackbits(np.concatenate([fps, np.zeros(n, np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def close(vertical: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, other) within the radius; item i compares fps[query[i]] with the lanes of word[i].

    Differences come as bit planes and go, two at a time, through a carry-save
    adder into vertical counters, so each operation serves 64 distances. After
    every STRIDE planes, items all of whose lanes exceed the radius are left.
    """
    width = int(radius + 1).bit_length()
    counters, over = [np.zeros(len(query), np.uint64) for _ in range(width)], ~lanes

    def add(carry: np.ndarray, level: int) -> None:
        nonlocal over
        for k in range(level, width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry

    def exceeded() -> np.ndarray:
        more, same = over.copy(), ~np.uint64(0)
        for k in range(width - 1, -1, -1):
            if radius >> k & 1:
                same = same & counters[k]
            else:
                more |= same & counters[k]
                same = same & ~counters[k]
        return more

    for b in range(0, BITS, 2):
        x, y = (vertical[c][word] ^ (np.uint64(0) - (fps[query] >> np.uint64(c) & np.uint64(1))) for c in (b, b + 1))
        half = counters[0] ^ x
        carry = (counters[0] & x) | (half & y)
        counters[0] = half ^ y
        add(carry, 1)
        if (b + 2) % STRIDE == 0:
            over = exceeded()
            alive = np.flatnonzero(~over)
            if len(alive) < len(query):
                query, word, over = query[alive], word[alive], over[alive]
                counters = [c[alive] for c in counters]
            if not len(query):
                break
    found = ~over
    hit = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, lane = np.nonzero(hit)
    return query[i], word[i] * 64 + lane


class Forest:
    """Links among the rows of a batch, thinned to those that join two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b = a[apart], b[apart]
            high, low = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
            np.minimum.at(self.root, high, low)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def forest(group: np.ndarray, fps: np.ndarray, radius: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Forest:
    """Connects the rows of each group within the radius, and that near() accepts; groups are runs of equal numbers.

    Words whose rows are all in the tree of the query already are not compared again.
    """
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(group)))
    end = np.repeat(start + size, size)
    rows, vertical, trees = np.arange(len(fps)), planes(fps), Forest(len(fps))
    words = np.arange(0, len(fps), 64)
    first, last = (rows + 1) // 64, (end - 1) // 64  # words with partners behind the row
    count = np.where(rows + 1 < end, last - first + 1, 0)
    ends = np.cumsum(count)
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ITEMS, "right")))
        n = count[at:upto]
        query = np.repeat(rows[at:upto], n)
        word = np.repeat(first[at:upto], n) + np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        low, high = np.minimum.reduceat(trees.root, words)[word], np.maximum.reduceat(trees.root, words)[word]
        apart = (low != high) | (low != trees.root[query])
        query, word = query[apart], word[apart]
        lo, hi = np.clip(query + 1 - 64 * word, 0, 64), np.clip(end[query] - 64 * word, 0, 64)
        lanes = _ones(hi) & ~_ones(lo)
        if len(query):
            a, b = close(vertical, fps, query, word, lanes, radius)
            if near is not None:
                good = near(a, b)
                a, b = a[good], b[good]
            trees.add(a, b)
        at = upto
    return trees


def local_links(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fp, fp) links of a forest that connects what lies within the radius in each group; groups are runs of equal numbers."""
    root = forest(group, fps, radius).root
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[child], fps[root[child]]


def _ones(n: np.ndarray) -> np.ndarray:
    """Words whose lowest n bits are set, n from 0 to 64."""
    return np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1))


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fps.fp within the radius.

    fps: distinct fingerprints. Each goes to a bucket for every mask of bands();
    only buckets with two members are kept, large ones are cut into tiles, and
    each pair of tiles is a group of its own, so none has more than 2 * TILE
    rows. Groups give forests, never all pairs.
    """
    spark = prepare(fps.sparkSession)
    masks = bands(radius, fps.count())
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("band", "value"))
    many = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    met = rows.join(many, ["band", "value"]).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(1)), "tiles").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumn("group", F.xxhash64("band", "value", F.least("tile", "other"), F.greatest("tile", "other")))
    met = met.select("group", "fp").repartition(tasks(spark), "group").sortWithinPartitions("group", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = local_links(group, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in (0, 1)])
            size += batch.num_rows
            if size >= 16 * TILE:
                group, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(group, group[-1], "left"))  # the last group may go on
                if cut:
                    yield out(group[:cut], fp[:cut])
                held, size = [[group[cut:], fp[cut:]]], len(group) - cut
        if size:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs.

    A text, A-Z in lower case, gives words [^\\x20\\x09-\\x0D]+ and shingles of
    `width` words, repeats included (fewer words: one of all; none, or a null
    text: fingerprint zero, which links like any other). Fingerprints within
    `radius` bits link; component_id is the least doc_id that links reach.
    A null doc_id counts as the least: it stays null, and its component's id
    is null. Rows that repeat are rows of their own. No rows give no rows.

    Fingerprints are written once to the shared folder. Equal ones are merged
    before anything is compared, so a group of copies costs one comparison,
    and what is shuffled are fingerprints and links, not texts.
    """
    marked = stored(fingerprints(docs, width), "fingerprints")
    least = marked.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("least"))
    distinct = stored(least, "distinct")
    roots = connected_components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(ids, "root").select("fp", "component")
    out = marked.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.expr(f"nullif(component, {NULL_ID})").alias("component_id"))


def wide_simhash(shingles: np.ndarray) -> np.ndarray:
    """Two words of fingerprint: the SimHash of the set, and that of its hashes mixed once more."""
    mixed = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    total = [np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for h in (shingles, mixed)]
    return np.packbits(2 * np.concatenate(total) > len(shingles), bitorder="little").view("<u8")


def parities(shingles: np.ndarray) -> np.ndarray:
    """PARITY bits of similar.parities()."""
    return similar.parities(shingles, PARITY)


def _differ(percent: int) -> Callable:
    """SimHash distances, and whether sets can be similar by their parities."""

    def differ(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
        words = [np.bitwise_count(left["sketch"][..., w] ^ right["sketch"][..., w]).astype(np.int32) for w in range(2 + PARITY // 64)]
        return words[0] + words[1], similar.able(sum(words[2:]), left["n"] + right["n"], percent)

    return differ


def common(docs: DataFrame, width: int, of: int = 16) -> np.ndarray:
    """Hashes of shingles that a probe, every of-th document by a hash of its text, has most often, 65,536 at most, rarest first.

    They come last in the order of shingles. Any order gives the same links; this one keeps boilerplate from bringing sets together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], names=["h"])

    probe = pick(docs, text="string").where(F.pmod(F.xxhash64("text"), F.lit(of)) == 0).dropDuplicates()
    counts = probe.mapInArrow(uncollected(run), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 4")
    got = counts.orderBy(F.desc("n"), "h").limit(1 << 16).toArrow().column(0).to_numpy()
    return got[::-1].copy().view(np.uint64)


def prefix(shingles: np.ndarray, hot: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(percent * n / 100) + 1 of a set's n hashes, in their order but for the hot ones (sorted; rank by rarity), which come last.

    Two similar sets have one in common.
    """
    count = len(shingles) - -(-percent * len(shingles) // 100) + 1 if len(shingles) else 0
    if not len(hot):
        return shingles[:count]
    at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
    late = hot[at] == shingles
    return np.concatenate([shingles[~late], shingles[late][np.argsort(rank[at[late]], kind="stable")]])[:count]


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, fingerprint, component_id as of near_duplicates(), where texts link whose sets of shingles have that Jaccard similarity.

    Equal sets are merged first; texts without a word are all equal. Two
    similar sets have one of their first shingles in common (prefix()), so sets
    meet in a bucket for each of those. There, 64-bit SimHashes compared
    bit-sliced within NEAR propose the first pairs; after that, all pairs of
    different components that meet are decided by whole sets, nearest SimHashes
    first, but those that cannot be similar by their sizes or by parities,
    both proven bounds. No similar pair is lost. See similar.components(). The
    fingerprint is the key of the set.
    """
    prepare(docs.sparkSession)
    last = common(docs, width)
    order = np.argsort(last)
    hot, rank = last[order], order

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                s = shingle_hashes(text, width)
                sketch = np.concatenate([wide_simhash(s), parities(s)]).tobytes()
                for column, value in zip(rows, (set_key(s), len(s), sketch, similar.wide_parities(s).tobytes(), prefix(s, hot, rank, percent).view(np.int64)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], names=["doc_id", "fp", "n", "sketch", "wide", "prefix"])

    marked = stored(pick(docs, doc_id="long", text="string").mapInArrow(uncollected(mark), "doc_id long, fp long, n int, sketch binary, wide binary, prefix array<long>"), "shingles")
    distinct = stored(similar.least_ids(marked), "distinct")
    ids = stored(marked.select("doc_id", "fp"), "ids")
    forget(marked)
    buckets = distinct.select(F.explode("prefix").alias("bucket"), "fp")
    found = similar.components(buckets, distinct, similar.sets_again(docs, distinct, lambda t: shingle_hashes(t, width)), percent, 2 + PARITY // 64, _differ(percent), first=lambda met: _sliced(met, percent))
    out = similar.named(ids, distinct, found)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.expr(f"nullif(component, {NULL_ID})").alias("component_id"))


def _sliced(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of a bucket whose SimHashes are within NEAR bits: links of a forest for each bucket, large ones tile by tile."""
    tile = F.pmod(F.xxhash64("fp", F.lit(2)), F.ceil(F.col("size") / TILE))
    rows = met.select(F.xxhash64("bucket", tile).alias("group"), "fp", "n", F.substring("sketch", 1, 8).alias("sketch")).repartition(tasks(met.sparkSession), "group").sortWithinPartitions("group", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            group, fp, n, first = columns

            def sized(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])

            root = forest(group, first, NEAR, sized).root
            child = np.flatnonzero(root != np.arange(len(fp)))
            a, b = np.unique(np.sort(np.stack([fp[child], fp[root[child]]]), axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([*(batch.column(i).to_numpy() for i in range(2)), batch.column(2).to_numpy().astype(np.int64), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64)])
            size += batch.num_rows
            if size >= 16 * TILE and held[-1][0][-1] != held[0][0][0]:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))  # the last group may go on
                yield out([x[:cut] for x in whole])
                held, size = [[x[cut:] for x in whole]], len(whole[0]) - cut
        if size:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    return rows.mapInArrow(uncollected(run), "a long, b long")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each component of near_copies(): the least doc_id.

    Rows that repeat that id and their text leave one; rows of that id with
    another text stay, unless their component has a lesser id. Only documents
    that a fixed-size filter takes for dropped ones are shuffled to be sure,
    unless ids repeat.
    """
    names = docs.columns
    at = ([i for i, c in enumerate(names) if c == "doc_id"] or [i for i, c in enumerate(names) if c.lower() == "doc_id"])[0]
    flat = docs.toDF(*(f"_in{i}" for i in range(len(names))))

    def others() -> DataFrame:
        marked = near_copies(docs, width, percent).where("not component_id <=> doc_id")
        return marked.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), "fingerprint")

    dropped = settled(others, "dropped", docs.sparkSession)
    key = F.coalesce(F.col(f"_in{at}").cast("long"), F.lit(NULL_ID))
    ids = pick(docs, doc_id="long").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if ids.isEmpty():
        dropped = dropped.withColumn("rank", F.lit(0))
        keyed, chosen = flat.withColumn("key", key).withColumn("rank", F.lit(0)), DocFilter(dropped)
        out = chosen.split(keyed, rest=False).join(dropped.select("key"), "key", "left_anti").select(*flat.columns)
        return out.union(chosen.split(keyed, rest=True).select(*flat.columns)).toDF(*names)
    text = ([i for i, c in enumerate(names) if c == "text"] or [i for i, c in enumerate(names) if c.lower() == "text"])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_fp", pa.array([f"{set_key(shingle_hashes(t, width)) % (1 << 64):016x}" for t in batch.column(text).to_pylist()], pa.string()))

    own = flat.mapInArrow(run, T.StructType([*flat.schema.fields, T.StructField("_fp", T.StringType())])).withColumn("_key", key)
    out = own.join(dropped, (F.col("_key") == F.col("key")) & (F.col("_fp") == F.col("fingerprint")), "left_anti").dropDuplicates(["_key", f"_in{text}"])
    return out.drop("_key", "_fp").toDF(*names)
