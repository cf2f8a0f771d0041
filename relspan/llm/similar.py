"""Components of similar sets, exactly: buckets bring sets together, sketches order the pairs, whole sets decide."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspan.llm._common import NULL_ID, forget, pick, prepare, stored, tasks, uncollected
from relspan.llm.components import connected_components
from relspan.llm.suffix_dedup import DocFilter

#: A group of sets that are compared has at most about twice so many.
TILE = 1024
#: Groups of at most so many rows are compared many at once.
SMALL = 16
#: Partners of a set that are looked at in the first round; MORE times as many in each further one.
PARTNERS, MORE = 2, 8
_space = re.compile(rb"[\x20\x09-\x0D]").search


def shingle_hashes(text: str | None, width: int, strip: int = 1 << 20) -> np.ndarray:
    """XXH64 (seed 42) of the text's distinct shingles in order: A-Z as a-z, words [^\\x20\\x09-\\x0D]+, fewer words are one shingle, none give none.

    A long text goes strip by strip: besides the hashes no more than a strip's words are held.
    """
    data = (text or "").encode("utf-8").lower()
    words: list[bytes] = []
    found: list[np.ndarray] = []
    at, count = 0, 0
    while at < len(data):
        cut = _space(data, at + strip)
        end = cut.start() if cut else len(data)
        words += data[at:end].split()
        at = end
        if len(words) >= width:
            own = {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
            found.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in own), np.uint64, len(own))))
            words, count = words[len(words) - width + 1 :] if width > 1 else [], count + 1
    if not found:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64) if words else np.empty(0, np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def set_key(shingles: np.ndarray) -> int:
    """Sets with this key in common are equal, but for collisions of 64 bits."""
    return int(np.array(xxhash.xxh64_intdigest(shingles.tobytes(), 7), np.uint64).view(np.int64))


def parities(shingles: np.ndarray, bits: int) -> np.ndarray:
    """That many bits, a power of two from 64 on: whether the number of the set's hashes that fall on each is odd. Sets whose bits differ in d places differ in d elements or more."""
    odd = np.bincount((shingles >> np.uint64(20) & np.uint64(bits - 1)).astype(np.intp), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def wide_parities(shingles: np.ndarray) -> np.ndarray:
    """parities() of as many bits as the set needs: two to four an element, a thirtieth of the set."""
    return parities(shingles, 1 << max(6, (2 * len(shingles) - 1).bit_length()))


def able(differing: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with so many parities that differ, and so many elements in all, can be similar.

    With intersection i and union u, 100 i >= percent u is (100 + percent) (u - i) <= (100 - percent) (u + i).
    """
    return (100 + percent) * differing <= (100 - percent) * sizes


def can_be_similar(a: bytes, b: bytes, size: int, percent: int) -> bool:
    """able() of two sets with `size` elements in all, by wide_parities(): the halves of the longer ones add up to shorter ones."""
    x, y = (np.frombuffer(s, np.uint64) for s in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return bool(able(int(np.bitwise_count(x ^ y).sum()), size, percent))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection of two sets is at least percent times their union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def partners(left: dict, right: dict, k: int, percent: int, compare: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each left row its k nearest right rows of another component: left rows, right rows, distances, and whether there were more.

    compare gives the distances of some left rows to all right rows and which
    of these pairs can be similar at all; sizes alone rule out others.
    """
    found: list[tuple] = []
    step = max(1, (1 << 20) // max(len(right["fp"]), 1))
    for start in range(0, len(left["fp"]), step):
        own = {name: v[start : start + step] for name, v in left.items()}
        low, high = np.minimum(own["n"][:, None], right["n"][None]), np.maximum(own["n"][:, None], right["n"][None])
        able = (own["comp"][:, None] != right["comp"][None]) & (100 * low >= percent * high)
        if not able.any():
            continue
        distance, possible = compare(own, right)
        able &= possible
        if "keys" in own:
            row, col = np.nonzero(able)
            for lo in range(0, len(row), 1 << 15):
                r, c = row[lo : lo + (1 << 15)], col[lo : lo + (1 << 15)]
                met = _met_before({n: own[n][r] for n in ("keys", "band")}, {n: right[n][c] for n in ("keys", "band")})
                able[r[met], c[met]] = False
        far = np.where(able, distance.astype(np.int32), np.int32(1 << 30))
        count = able.sum(axis=1)
        if k < far.shape[1]:
            nearest = np.argpartition(far, k - 1, axis=1)[:, :k]
            row = np.repeat(np.arange(len(far)), k)
            col = nearest.reshape(-1)
        else:
            row, col = np.nonzero(able)
        good = far[row, col] < 1 << 30
        row, col = row[good], col[good]
        found.append((row + start, col, far[row, col], (count > k)[row]))
    if not found:
        return tuple(np.empty(0, t) for t in (int, int, np.int32, bool))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _met_before(left: dict, right: dict) -> np.ndarray:
    """Whether pairs of rows of one bucket share a bucket of an earlier place in their lists, where they are compared; 0 is none."""
    return ((left["keys"] == right["keys"]) & (left["keys"] != 0) & (np.arange(left["keys"].shape[1]) < left["band"][:, None])).any(axis=1)


def _small(group: np.ndarray, role: np.ndarray, rows: dict, k: int, percent: int, differ: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """partners() of many groups of few rows at once: rows so many places apart are compared in one go, for each number of places."""
    found: list[tuple] = []
    for step in range(1, SMALL):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            break
        j = i + step
        low, high = np.minimum(rows["n"][i], rows["n"][j]), np.maximum(rows["n"][i], rows["n"][j])
        able = (rows["comp"][i] != rows["comp"][j]) & (100 * low >= percent * high)
        i, j = i[able], j[able]
        one, other = ({n: v[at] for n, v in rows.items()} for at in (i, j))
        distance, possible = differ(one, other)
        if "keys" in rows:
            possible = possible & ~_met_before(one, other)
        for x, y in ((i, j), (j, i)):
            good = possible & (role[x] & 2 > 0) & (role[y] & 1 > 0)
            found.append((x[good], y[good], distance[good]))
    if not found:
        return tuple(np.empty(0, t) for t in (int, int, np.int32, bool))
    x, y, far = (np.concatenate(v) for v in zip(*found, strict=True))
    order = np.lexsort((y, far, x))
    x, y, far = x[order], y[order], far[order]
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, int)
    count = np.diff(np.append(start, len(x)))
    nth = np.arange(len(x)) - np.repeat(start, count)
    near = nth < k
    return x[near], y[near], far[near].astype(np.int32), np.repeat(count > k, count)[near]


def _candidates(k: int, percent: int, words: int, differ: Callable) -> Callable:
    """Reads rows (group, role, fp, comp, n, sketch, and maybe all buckets of the set and this one's place among them) sorted by group; gives pairs (a, b, ca, cb, apart, more).

    differ gives, of rows of one shape and rows of another that is broadcast to
    it, the distances, and which pairs can be similar at all.
    """

    def across(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
        return differ({n: left[n][:, None] for n in ("n", "sketch")}, {n: right[n][None] for n in ("n", "sketch")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            group, role, fp, comp, n, sketch = columns[:6]
            start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            size = np.diff(np.append(start, len(group)))
            few = np.repeat(size <= SMALL, size)
            rows = {"fp": fp, "comp": comp, "n": n.astype(np.int64), "sketch": sketch} | dict(zip(("keys", "band"), columns[6:], strict=False))
            own = {name: v[few] for name, v in rows.items()}
            x, y, apart, more = _small(group[few], role[few], own, k, percent, differ)
            yield _found(own, own, x, y, apart, more)
            for at, count in zip(start[size > SMALL], size[size > SMALL], strict=True):
                part = slice(at, at + count)
                left, right = ({name: v[part][(role[part] & bit) > 0] for name, v in rows.items()} for bit in (2, 1))
                yield _found(left, right, *partners(left, right, k, percent, across))

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append([*(batch.column(i).to_numpy() for i in range(5)), np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(batch.num_rows, words)])
                if batch.num_columns > 6:
                    held[-1] += [batch.column(6).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(7).to_numpy()]
                size += batch.num_rows
            if size >= 16 * TILE and held[-1][0][-1] != held[0][0][0]:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))  # the last group may go on
                yield from out([c[:cut] for c in whole])
                held, size = [[c[cut:] for c in whole]], len(whole[0]) - cut
        if size:
            yield from out([np.concatenate(c) for c in zip(*held, strict=True)])

    return uncollected(run)


def _found(left: dict, right: dict, i: np.ndarray, j: np.ndarray, apart: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    columns = [left["fp"][i], right["fp"][j], left["comp"][i], right["comp"][j], apart, more]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "ca", "cb", "apart", "more"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(ca, cb) of the pairs (a, b, ca, cb) whose whole sets are similar."""
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("one"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("ca", "cb", "one", "two")
    return both.mapInArrow(uncollected(run), "ca long, cb long")


def possible(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) that can_be_similar() by rows (fp, n, wide); of the others no set is made again."""
    left = rows.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    right = rows.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [can_be_similar(a, b, n, percent) for a, b, n in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6)), strict=True)]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", "wa", "wb", (F.col("na").cast("long") + F.col("nb")).alias("size"))
    return both.mapInArrow(uncollected(run), "a long, b long, ca long, cb long")


def components(buckets: DataFrame, rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, words: int, differ: Callable, first: Callable[[DataFrame], DataFrame] | None = None, keys: str | None = None) -> DataFrame:
    """(fp, comp) of the sets that meet another: comp is the same for all that links of similar sets reach.

    buckets: (bucket, fp), where any two similar sets meet at least once. rows:
    (fp, n, sketch, wide) of distinct sets, n their sizes, sketches of `words` 64-bit
    words, wide_parities(); differ as in _candidates(). sets_of gives (fp, shingles) of rows that hold fp. first gives pairs
    (a < b) to begin with of met sets (bucket, size, fp, n, sketch), else each
    set's nearest partners in each bucket begin. keys: a column of rows with the
    list of all buckets of a set, of one length and in one order of kinds; a
    pair that meets in several of them is then proposed in the first only, but
    in the first round.

    Rounds: each set proposes its nearest partners of other components, in all
    its buckets; whole sets decide; components are joined. Few partners suffice
    where sets are alike, so a bucket soon is one component and is left.
    Partners grow by MORE a round, and it ends only when no set had further
    ones: then every pair across components that meets and can be similar has
    been decided by its whole sets. Large buckets are cut into tiles; only sets
    outside of the bucket's largest component are sent to all of them, so no
    group is larger than two tiles and a hot bucket is spread. From round to
    round only the buckets of several components, and the sets in them, are kept.
    """
    spark = prepare(rows.sparkSession)
    parts = tasks(spark, rows)
    many = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = stored(buckets.join(many, "bucket").join(rows.select("fp", "n", "sketch"), "fp").select("bucket", "size", "fp", "n", "sketch"), "met")
    labels = stored(met.select("fp").distinct().withColumn("comp", F.col("fp")).withColumn("weight", F.lit(1).cast("long")), "labels")
    tested, k, single = None, PARTNERS, first is None
    open_, own = met.select("bucket", "size", "fp"), rows

    def decided(pairs: DataFrame) -> DataFrame:
        """Links of pairs, by the whole sets of those that are in one that can be similar."""
        pairs = stored(possible(pairs, own, percent), "possible")
        needed = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        sets = stored(sets_of(needed), "sets")
        links = stored(verified(pairs, sets, percent), "links")
        forget(sets)
        forget(pairs)
        return links

    if first is not None:
        tested = stored(first(met).select("a", "b").distinct(), "tested")
        labels = _joined(labels, decided(tested.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))))
        k *= MORE
    columns = ["group", "role", "fp", "comp", "n", "sketch"]
    while True:
        if single:  # each set is a component of its own; large buckets are compared tile by tile, and there is another round
            tile = F.pmod(F.xxhash64("fp", F.lit(4)), F.ceil(F.col("size") / TILE))
            group = F.when(F.col("size") > TILE, F.xxhash64("bucket", tile)).otherwise(F.col("bucket"))
            dealt = met.select(group.alias("group"), F.lit(3).alias("role"), "fp", F.col("fp").alias("comp"), "n", "sketch")
            large = not met.where(F.col("size") > TILE).limit(1).isEmpty()
        else:
            several = _several(open_, labels)
            narrow = stored(_of(several, own, keys), "open")
            for table in (met,) if own is rows else (own, open_):
                forget(table)
            open_, own, keys = several.select("bucket", "size", "fp"), narrow, None if keys is None else "keys"
            dealt = _dealt(several, own.drop("wide"))
            large = False
        rows_ = dealt.repartition(parts, "group").sortWithinPartitions("group")
        found = rows_.mapInArrow(_candidates(k, percent, words, differ), "a long, b long, ca long, cb long, apart int, more boolean")
        found = found.groupBy("a", "b").agg(F.any_value("ca").alias("ca"), F.any_value("cb").alias("cb"), F.min("apart").alias("apart"), F.bool_or("more").alias("more"))
        nth = Window.partitionBy("a").orderBy("apart", "b")
        found = stored(found.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1), "found")
        count, more = found.agg(F.count("*"), F.bool_or(F.col("more") | (F.col("nth") > k))).first()
        if count:
            lesser, greater = F.least("a", "b"), F.greatest("a", "b")
            turned = F.col("a") > F.col("b")
            pairs = found.where(F.col("nth") <= k).select(lesser.alias("a"), greater.alias("b"), F.when(turned, F.col("cb")).otherwise(F.col("ca")).alias("ca"), F.when(turned, F.col("ca")).otherwise(F.col("cb")).alias("cb")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stored(pairs, "pairs")
            links = decided(pairs)
            if not links.isEmpty():
                labels = _joined(labels, links)
            pairs = pairs.select("a", "b")
            tested = pairs if tested is None else tested.union(pairs)
        forget(found)
        if not more and not large:
            break
        k, single = k * MORE, False
    return labels.select("fp", "comp")


def _several(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (bucket, size, fp) of buckets with several components, with comp and weight of labels. Components only grow, so the next round's are among them."""
    grouped = met.join(labels, "fp")
    wide = grouped.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    return stored(grouped.join(wide, "bucket"), "several")  # few, once most sets are joined


def _of(several: DataFrame, rows: DataFrame, keys: str | None) -> DataFrame:
    """(fp, n, sketch, wide) of the sets in several, and, as keys, their buckets in order, 0 for those that are not in several: sets of different components do not meet there."""
    if keys is None:
        return rows.select("fp", "n", "sketch", "wide").join(several.select("fp").distinct(), "fp", "left_semi")
    buckets = several.groupBy("fp").agg(F.collect_list("bucket").alias("buckets"))
    kept = F.transform(keys, lambda k: F.when(F.array_contains("buckets", k), k).otherwise(F.lit(0).cast("long")))
    return rows.join(buckets, "fp").select("fp", "n", "sketch", "wide", kept.alias("keys"))


def _dealt(several: DataFrame, rows: DataFrame) -> DataFrame:
    """The groups of a round: buckets with several components, large ones cut so that rows outside of the largest component meet all others.

    Sketches, and keys, are joined to them last.
    """
    major = several.groupBy("bucket").agg(F.max(F.struct("weight", "comp"))["comp"].alias("major"))
    open_ = several.join(major, "bucket").withColumn("minor", F.col("comp") != F.col("major"))
    small = open_.where(F.col("size") <= TILE).withColumn("role", F.when(F.col("minor"), 3).otherwise(1)).withColumn("group", F.col("bucket"))
    large = open_.where(F.col("size") > TILE)
    minors = large.where("minor").groupBy("bucket").agg(F.count("*").alias("minors"))
    large = large.join(minors, "bucket").withColumn("mt", F.ceil(F.col("minors") / TILE).cast("int")).withColumn("bt", F.ceil(F.col("size") / TILE).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("mt")).cast("int")
    tile = F.pmod(F.xxhash64("fp", F.lit(4)), F.col("bt")).cast("int")
    right = large.withColumn("role", F.lit(1)).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("mt") - 1))).withColumn("group", F.xxhash64("bucket", "x", tile))
    left = large.where("minor").withColumn("role", F.lit(2)).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("bt") - 1))).withColumn("group", F.xxhash64("bucket", own, "x"))
    columns = ["group", "role", "fp", "comp", "bucket"]
    every = small.select(columns).union(right.select(columns)).union(left.select(columns)).join(rows, "fp")
    band = [(F.array_position("keys", F.col("bucket")) - 1).cast("int").alias("band")] if "keys" in rows.columns else []
    return every.select("group", "role", "fp", "comp", "n", "sketch", *(("keys", *band) if band else ()))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (fp, comp, weight) with components joined by links (ca, cb) of components."""
    roots = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    named = labels.join(roots, F.col("comp") == F.col("node"), "left").select("fp", F.coalesce("root", "comp").alias("comp"))
    return stored(named.join(named.groupBy("comp").agg(F.count("*").alias("weight")), "comp").select("fp", "comp", "weight"), "labels")


def sets_again(docs: DataFrame, distinct: DataFrame, hashes: Callable[[str | None], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    """sets_of() for components(): makes the sets of some of distinct (fp, least) again, each from the text of its least document."""

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = stored(distinct.select("fp", "least").join(wanted, "fp"), "chosen")
        keyed = pick(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), F.lit(0).alias("rank"), "text")
        near = DocFilter(chosen.select(F.col("least").alias("key"), F.lit(0).alias("rank")))
        has = near.has

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # chosen and made in one step: a task then has one Python worker, not two
                batch = batch.filter(pa.array(has(batch.column(3).to_numpy())))
                found = [hashes(t) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_key(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["least", "fp", "shingles"])

        made = near.placed(keyed).mapInArrow(uncollected(run), "least long, fp long, shingles binary")
        return made.join(chosen, ["least", "fp"]).dropDuplicates(["least", "fp"]).select("fp", "shingles")

    return sets_of


def least_ids(marked: DataFrame) -> DataFrame:
    """(fp, least, ...) of distinct sets: the least doc_id, a null one counting as the least, and any of the other columns."""
    rest = [F.any_value(c).alias(c) for c in marked.columns if c not in ("doc_id", "fp")]
    return marked.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("least"), *rest)


def named(marked: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, fp, component) of every row of marked: the least id of the component of its set."""
    comp = distinct.select("fp", "least").join(found, "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    ids = comp.groupBy("comp").agg(F.min("least").alias("component"))
    return marked.select("doc_id", "fp", *[c for c in ("n",) if c in marked.columns]).join(comp.join(ids, "comp").select("fp", "component"), "fp")
