"""Ranked lexical search: WAND over inverted lists of document shards, heaps of shards merged."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspan.llm._common import NULL_ID, forget, pick, prepare, settled, sliced, stored, tasks, uncollected

#: Fixed bounds of a shard: documents, and bytes of text.
SHARD_DOCS, SHARD_BYTES = 4096, 32 << 20
#: About so many items are searched at once.
ITEMS = 256
#: Documents that are looked at together once one of them is a pivot.
WINDOW = 512
#: Bits of the filter that tells which terms some item has.
FILTER = 24
#: Words that a worker keeps the filter's answer for.
KNOWN = 1 << 18
#: Letters and digits of ASCII and all bytes beyond it belong to terms, A-Z as a-z; the rest becomes a space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order, repeats included."""
    return (text or "").encode("utf-8").translate(_TERMS).split()


class _Known(dict):
    """Whether a term may be one of the items', by the filter; answers are kept for a bounded number of terms."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= KNOWN:
            self.clear()
        at = xxhash.xxh64_intdigest(term) & ((1 << FILTER) - 1)
        self[term] = found = bool(self.table[at >> 3] >> (at & 7) & 1)
        return found


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, ident, term: the distinct terms of each item; ident tells items of one id with different texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, idents, terms = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(terms_of(text))
                ids += [item] * len(own)
                idents += [xxhash.xxh64_intdigest((text or "").encode()) >> 1] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(idents, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "ident", "term"])

    return pick(items, item_id="long", text="string").mapInArrow(run, "item_id long, ident long, term binary").distinct()


def term_filter(terms: DataFrame) -> np.ndarray:
    """A fixed-size filter over terms, 2 MB at every size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (FILTER - 3), np.uint8)
        for batch in batches:
            for term in batch.column(0).to_pylist():
                at = xxhash.xxh64_intdigest(term) & ((1 << FILTER) - 1)
                table[at >> 3] |= 1 << (at & 7)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used].astype(np.int32))], names=["at", "bits"])

    got = terms.select("term").mapInArrow(run, "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**21 rows
    table = np.zeros(1 << (FILTER - 3), np.uint8)
    table[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return table


def shards(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Inverted lists of shards of bounded size: rows (shard, term, a, b, n, size).

    With a term: its documents' numbers in the shard and its occurrences in
    each (32-bit integers), n of them. Without: the ids of the shard's documents
    and how many terms each has (64-bit), n documents that have any and size
    terms in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, number, size = _Known(wanted), 0, 0
        ids: list[int] = []
        counts: list[int] = []
        lists: dict[bytes, tuple[list[int], list[int]]] = {}

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            own, held = np.array(counts, np.int64), list(lists.items())
            name = (TaskContext.get().partitionId() << 32) + number
            for start in range(-1, len(held), 4096):
                part = held[max(start, 0) : start + 4096]
                a, b, n, total = [np.array(x, np.int32).tobytes() for _, (x, _) in part], [np.array(x, np.int32).tobytes() for _, (_, x) in part], [len(x) for _, (x, _) in part], [0] * len(part)
                term = [t for t, _ in part]
                if start < 0:
                    term, a, b, n, total = [None, *term], [np.array(ids, np.int64).tobytes(), *a], [own.tobytes(), *b], [int((own > 0).sum()), *n], [int(own.sum()), *total]
                columns = [pa.array([name] * len(term), pa.int64()), pa.array(term, pa.binary()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64()), pa.array(total, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "term", "a", "b", "n", "size"])
            number, size = number + 1, 0
            ids.clear()
            counts.clear()
            lists.clear()

        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                at = len(ids)
                ids.append(NULL_ID if doc is None else doc)
                counts.append(len(words))
                for term, count in Counter(words).items():
                    if known[term]:
                        held = lists.get(term)
                        if held is None:
                            held = lists[term] = ([], [])
                        held[0].append(at)
                        held[1].append(count)
                size += len(text or "")
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield from shard()
        if ids:
            yield from shard()

    return pick(docs, doc_id="long", text="string").mapInArrow(uncollected(run), "shard long, term binary, a binary, b binary, n long, size long")


class Heap:
    """The best documents of an item so far: greater scores first, of equal ones lesser ids."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """No document with a lesser score can enter."""
        return max(int(self.score[-1]), 1) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


def wand(docs: list[np.ndarray], impacts: list[np.ndarray], most: np.ndarray, ids: np.ndarray, heap: Heap) -> int:
    """Puts the best documents of a shard into the heap; gives how many were scored.

    Each list has ascending documents and what the term adds to each; most
    holds the lists' greatest impacts. Lists are ordered by their next document
    and their greatest impacts added up; where the sum reaches the least score
    of the heap is the pivot, and no document before it can enter, so all lists
    skip to it. From there a window of documents is looked at together, and
    again only those are scored whose terms' greatest impacts reach the heap.
    """
    at = [0] * len(docs)
    scored = 0
    while True:
        live = [t for t in range(len(docs)) if at[t] < len(docs[t])]
        if not live:
            return scored
        nexts = np.array([docs[t][at[t]] for t in live])
        order = np.argsort(nexts, kind="stable")
        reach = np.flatnonzero(np.cumsum(most[live][order]) >= heap.least())
        if not len(reach):
            return scored
        pivot = int(nexts[order[reach[0]]])
        number, term, worth = [], [], []
        for t in live:
            own = docs[t]
            lo = at[t] + int(np.searchsorted(own[at[t] :], pivot)) if own[at[t]] < pivot else at[t]
            hi = lo + int(np.searchsorted(own[lo:], pivot + WINDOW))
            at[t] = hi
            if hi > lo:
                number.append(own[lo:hi])
                term.append(np.full(hi - lo, most[t]))
                worth.append(impacts[t][lo:hi])
        near = np.concatenate(number) - pivot
        able = np.bincount(near, np.concatenate(term), WINDOW) >= heap.least()
        chosen = able[near]
        total = np.bincount(near[chosen], np.concatenate(worth)[chosen], WINDOW).astype(np.int64)  # below 2**53: exact
        best = np.flatnonzero(able & (total >= heap.least()))
        scored += int(able.sum())
        if len(best):
            heap.add(total[best], ids[best + pivot])


def _measures(counts: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with so many terms."""
    if 50 * int(counts.max(initial=0)) * docs < 1 << 63:
        return 50 + (50 * counts * docs) // max(total, 1)
    return np.array([50 + (50 * int(n) * docs) // total for n in counts], np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item with the greatest scores above 0, ties to lesser ids.

    Terms, weights and scores are stated in README and `op12`. Null and empty
    texts have no terms: such documents count nowhere, such items get no rows.
    A null doc_id orders as the least; rows that repeat a doc_id are documents
    of their own. Items that repeat an id with another text are ranked each on
    their own, such that repeat both once. No documents or no items: no rows.

    Texts are read once. Shards of bounded size hold inverted lists of terms
    that a fixed-size filter takes for some item's; lists meet the items' terms
    by a join on the term. A group is a shard and a block of some 256 items;
    groups of one block in a task share heaps, so thresholds carry over.
    """
    spark = prepare(docs.sparkSession)
    terms = stored(item_terms(items), "item-terms")
    lists = stored(shards(docs, term_filter(terms)), "lists")
    n, total = lists.where("term is null").agg(F.sum("n"), F.sum("size")).first()
    n, total = n or 0, total or 0
    kind = "item_id long, rank int, doc_id long, score long"
    if not n:
        return spark.createDataFrame([], kind)

    def ranked() -> DataFrame:
        blocks = max(1, math.ceil((terms.select("item_id", "ident").distinct().count()) / ITEMS))
        df = lists.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
        block = F.pmod(F.xxhash64("item_id", "ident"), F.lit(blocks)).cast("int")
        users = terms.withColumn("block", block).groupBy("term", "block").agg(F.collect_list(F.struct("item_id", "ident")).alias("items"))  # a block has some ITEMS items
        users = users.join(df, "term").select("term", "block", "items", weight.alias("w"))
        named = lists.where("term is not null").select("shard", "term", "a", "b").join(users, "term").select("block", "shard", "a", "b", "w", "items")
        own = lists.where("term is null").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        own = own.select("block", "shard", "a", "b", F.lit(-1).cast("long").alias("w"), F.array().cast("array<struct<item_id: bigint, ident: bigint>>").alias("items"))
        parts = tasks(spark, lists)
        work = own.unionByName(named).withColumn("slot", F.pmod(F.xxhash64("shard"), F.lit(parts)))
        work = work.repartition(parts, "block", "slot").sortWithinPartitions("block", "slot", "shard", "w")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heaps: dict[tuple, Heap] = {}
            at, rows = None, []

            def found() -> pa.RecordBatch:
                flat = [(item, ident, doc, score) for (item, ident), h in heaps.items() for doc, score in zip(h.doc.tolist(), h.score.tolist(), strict=True)]
                heaps.clear()
                return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(4)], names=["item_id", "ident", "doc_id", "score"])

            def shard() -> None:
                if not rows:
                    return
                ids, m = np.frombuffer(rows[0][0], np.int64), _measures(np.frombuffer(rows[0][1], np.int64), n, total)
                docs_, impacts, by_item = [], [], {}
                for a, b, w, users_ in rows[1:]:
                    doc, tf = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32).astype(np.int64)
                    for user in users_:
                        by_item.setdefault((user["item_id"], user["ident"]), []).append(len(docs_))
                    docs_.append(doc)
                    impacts.append(w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])))
                most = np.array([x.max() for x in impacts], np.int64)
                for item, own_ in by_item.items():
                    wand([docs_[t] for t in own_], [impacts[t] for t in own_], most[own_], ids, heaps.setdefault(item, Heap(k)))
                rows.clear()

            for batch in batches:
                for block_, shard_, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if (block_, shard_) != at:
                        shard()
                        if at is not None and block_ != at[0]:
                            yield found()
                        at = (block_, shard_)
                    rows.append(row)
            shard()
            yield found()

        best = work.mapInArrow(uncollected(run), "item_id long, ident long, doc_id long, score long")
        order = Window.partitionBy("item_id", "ident").orderBy(F.desc("score"), "doc_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", F.expr(f"nullif(doc_id, {NULL_ID})").alias("doc_id"), "score")

    out = settled(ranked, "ranked", spark)
    forget(lists)
    forget(terms)
    return out
