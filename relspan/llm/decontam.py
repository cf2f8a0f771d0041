"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._common import filtered, forget, pick, prepare, stored, uncollected

#: Bytes of benchmark text that a worker holds at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 8 << 20
#: Alignment scores, and the share of an item's own score from which a document counts as contaminated.
MATCH, MISMATCH, GAP, THRESHOLD = 1.0, -0.5, -0.5, 0.5
#: So many words of a seed's two may lie apart, in the item and in the text.
REACH = 2
#: So many seeds of an item must be hit before its window is looked at (fewer where an item has fewer to demand).
DEMAND = 3
_words = re.compile(r"[^\W_]+").findall
_spans = re.compile(r"[^\W_]+").finditer
_break = re.compile(r"[\W_]").search


@dataclass
class Block:
    """Some items, as numbers of words, and their seeds.

    A seed is two words of an item in order, at most REACH apart. Seeds lose no
    alignment that reaches the threshold: let one match m of an item's n words
    with e gaps and mismatches, so m - e / 2 >= t n. Between two matches in a
    row at most REACH apart on both sides lies at most one error, between any
    others two or more; of these there are at most e / 2 <= m - t n. So at
    least t n - 1 of the m - 1 are seeds, each at its own place of the item.
    Among any n - 1 - (t n - 1) + k places at least k are hit then: the rarest
    so many are looked up, whatever the corpus, and a window that k of them hit
    is aligned if it holds t n - 1 seeds in all. Items of which one word can
    reach the threshold have their words as seeds.
    """

    ids: list[int]
    items: list[np.ndarray]
    numbers: dict[str, int]
    threshold: float = THRESHOLD
    need: list[int] = field(default_factory=list)  # of each item: seeds that an alignment has at least
    demand: np.ndarray | None = None  # of each item: how many rare ones
    codes: np.ndarray | None = None  # sorted codes of rare seeds
    first: np.ndarray | None = None  # of each code: where its places begin
    at_item: np.ndarray | None = None
    at_word: np.ndarray | None = None

    def number(self, text: str | None, strip: int = 1 << 20) -> np.ndarray:
        """The text's words as numbers, 0 for those in no item; long texts strip by strip, so that no list of all words is held."""
        text, get, out, at = (text or "").lower(), self.numbers.get, [], 0
        while at < len(text):
            end = len(text)
            if end > at + strip:
                cut = _break(text, at + strip)
                end = cut.start() if cut else end
            out.append(np.array([get(w, 0) for w in _words(text, at, end)], np.int32))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and first places of two words at most REACH apart, both of them in some item."""
        base, at = len(self.numbers) + 1, np.flatnonzero(ids)
        codes, places = [], []
        for d in range(1, REACH + 1):
            p = at[at < len(ids) - d]
            p = p[ids[p + d] > 0]
            codes.append(ids[p].astype(np.int64) * base + ids[p + d])
            places.append(p)
        return np.concatenate(codes), np.concatenate(places)

    def singles(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(ids)
        return ids[at].astype(np.int64), at

    def sow(self, counts: dict[str, int], total: int) -> None:
        """Chooses the places of each item whose seeds are rarest by the frequency of their words in all documents."""
        share = np.ones(len(self.numbers) + 1)
        for w, i in self.numbers.items():
            share[i] = max(counts.get(w, 0), 1) / max(total, 1)
        found: list[tuple[int, int, int]] = []
        demand = []
        for i, item in enumerate(self.items):
            n = len(item)
            need = math.ceil(self.threshold * n - 1 - 1e-9)
            self.need.append(need)
            if need <= 0:
                demand.append(1)
                codes, at = self.singles(item)
            else:
                codes, at = self.pairs(item)
                k = min(DEMAND, need)
                demand.append(k)
                chance = np.zeros(n)
                for d in range(1, REACH + 1):
                    chance[: n - d] += share[item[: n - d]] * share[item[d:]]
                rare = np.argsort(chance[: n - 1], kind="stable")[: n - 1 - need + k]
                chosen = np.isin(at, rare)
                codes, at = codes[chosen], at[chosen]
            found += zip(codes.tolist(), [i] * len(codes), at.tolist(), strict=True)
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.codes, first = np.unique(table[:, 0], return_index=True)
        self.first = np.append(first, len(table))
        self.at_item, self.at_word, self.demand = table[:, 1], table[:, 2], np.array(demand, np.int64)

    def hits(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """By item that enough of its rare seeds hit: where in the document it would begin if a seed of it lies in line."""
        if not len(self.codes):
            return {}
        codes, places = self.pairs(ids)
        if min(self.need) <= 0:
            more = self.singles(ids)
            codes, places = np.concatenate([codes, more[0]]), np.concatenate([places, more[1]])
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[at] == codes)
        if not len(hit):
            return {}
        at, places = at[hit], places[hit]
        n = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        begin = np.repeat(places, n) - self.at_word[place]
        item = self.at_item[place]
        own = np.unique(item * (1 << 32) + self.at_word[place]) >> 32
        enough = np.bincount(own, minlength=len(self.items)) >= self.demand
        keep = enough[item]
        if not keep.any():
            return {}
        item, begin = item[keep], begin[keep]
        order = np.lexsort((begin, item))
        item, begin = item[order], begin[order]
        ends = np.flatnonzero(np.diff(item, append=-1)) + 1
        return {int(item[b - 1]): begin[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    def worth(self, i: int, text: np.ndarray) -> bool:
        """Whether a stretch of text holds as many seeds of an item as an alignment up to the threshold has."""
        if self.need[i] <= 0:
            return True
        codes, at = self.pairs(self.items[i])
        return len(np.unique(at[np.isin(codes, self.pairs(text)[0])])) >= self.need[i]

    def best(self, ids: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, share of its own score, first word, end word) of the best alignment with each item, for those up to the threshold.

        An alignment reaches at most so many inserted words beyond a seed of it
        as the threshold lets it pay for; of equally good ones the first is told.
        """
        out = []
        for i, begins in self.hits(ids).items():
            item = self.items[i]
            slack = math.ceil((1 - self.threshold) * MATCH * len(item) / -GAP) + 1
            split = np.flatnonzero(np.diff(begins) > 2 * slack + len(item)) + 1
            found = (0.0, 0, 0)
            for group in np.split(begins, split):
                lo, hi = max(0, int(group[0]) - slack), min(len(ids), int(group[-1]) + len(item) + slack)
                if self.worth(i, ids[lo:hi]):
                    new = align(item, ids[lo:hi], lo)
                    found = new if new[0] > found[0] else found
            share = found[0] / (MATCH * len(item))
            if share >= self.threshold:
                out.append((self.ids[i], share, found[1], found[2]))
        return out


def align(item: np.ndarray, text: np.ndarray, base: int = 0) -> tuple[float, int, int]:
    """Smith-Waterman over words with linear gaps: the best score, and the first and end word of the text it takes."""
    n = len(text)
    ramp = np.arange(n + 1) * -GAP
    row, start = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, base, base)
    for w in item:
        same = (text == w) & (text > 0)
        diagonal, up = row[:-1] + np.where(same, MATCH, MISMATCH), row[1:] + GAP
        new, origin = np.zeros(n + 1), np.arange(n + 1)
        take = np.maximum(diagonal, up)
        positive = take > 0
        new[1:] = np.where(positive, take, 0)
        origin[1:] = np.where(positive, np.where(diagonal >= up, start[:-1], start[1:]), origin[1:])
        lifted = new + ramp  # gaps along the row: the greatest of what lies left, less their cost
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= reach, np.arange(n + 1), 0))
        row, start = reach - ramp, origin[source]
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (float(row[at]), base + int(start[at]), base + at)
    return best


def _in_turn(held: list[Broadcast]) -> Iterator:
    """The values of broadcasts; of several, a worker keeps none but the present one in memory."""
    for b in held:
        yield b.value
        if len(held) > 1:
            b.__dict__.pop("_value", None)


def blocks(benchmark: DataFrame, threshold: float, most: int) -> Iterator[Block]:
    """The benchmark's items in blocks of about `most` bytes, so that what a worker or the driver holds is bounded."""
    rows = pick(benchmark, item_id="long", text="string").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // most))
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        got = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        words = [_words(t.lower()) for _, t in got]
        numbers = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        yield Block([i for i, _ in got], [np.array([numbers[w] for w in ws], np.int32) for ws in words], numbers, threshold)


def count_words(docs: DataFrame, held: list[Broadcast], most: int = 300_000) -> DataFrame:
    """word, n: how often the words of the blocks occur in all documents; of the word '', how many words there are.

    One pass; each task adds up first and hands on what it has whenever that is `most` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], names=["word", "n"])

        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    found = _words(text.lower())
                    seen[""] += len(found)
                    seen.update(found)
            known = {""}.union(*(block.numbers.keys() & seen.keys() for block in _in_turn(held)))
            counts.update({w: seen[w] for w in known})
            if len(counts) > most:
                yield out()
                counts.clear()
        yield out()

    return docs.select("text").mapInArrow(uncollected(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prepared(docs: DataFrame, benchmark: DataFrame, threshold: float, most: int) -> list[Broadcast]:
    """The blocks, with the seeds that counts of words over all documents make the rarest. Documents are read once, however many blocks there are."""
    if threshold <= 0:
        raise ValueError("every document reaches a threshold of 0")
    spark = prepare(docs.sparkSession)
    sc, raw, out = spark.sparkContext, [], []
    for block in blocks(benchmark, threshold, most):
        raw.append(sc.broadcast(block))
    counts = stored(count_words(pick(docs, text="string"), raw), "words")
    for b in raw:
        block = b.value
        own = spark.createDataFrame([(w,) for w in ["", *block.numbers]], "word string")
        got = {r["word"]: r["n"] for r in counts.join(own, "word", "left_semi").collect()}
        block.sow(got, got.pop("", 0))
        out.append(sc.broadcast(block))
        b.__dict__.pop("_value", None)
    forget(counts)
    return out


def _places(text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
    return {i: m.span() for i, m in enumerate(_spans(text)) if i in wanted}


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, start, end: each document and each item whose best alignment with it reaches the threshold.

    Words are runs of letters and digits in lower case. score: the alignment's
    share of the item's score with itself (1: all of it is there; an edited
    word costs one and a half of its words' shares). Results are those of
    Smith-Waterman over whole texts: the seeds lose no alignment that reaches
    the threshold, whatever is inserted, left out or replaced. start, end: the
    code points, in the text as lower-cased, that the best alignment takes; of
    equally good ones, the first.

    Rows that repeat are reported each, likewise items, null ids included. Null,
    empty or wordless texts and items never match; empty tables give no rows.
    Columns are matched by their exact names first, other columns are ignored.

    No shuffle but of word counts: the items are a stated query set and
    broadcast, of a large benchmark in blocks of `most` bytes, one of which a
    worker holds at a time; documents stay where they are read, and are read
    twice in all.
    """
    schema = "doc_id long, item_id long, score double, start long, end long"
    rows = pick(docs, doc_id="long", text="string")
    held = prepared(docs, benchmark, threshold, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block in _in_turn(held):
                for doc, text in zip(ids, texts, strict=True):
                    best = block.best(block.number(text))
                    if best:
                        spans = _places(text.lower(), {x for _, _, a, b in best for x in (a, b - 1)})
                        found += [(doc, item, score, spans[a][0], spans[b - 1][1]) for item, score, a, b in best]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["doc_id", "item_id", "score", "start", "end"])

    return rows.mapInArrow(uncollected(run), schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that no item aligns with up to the threshold (see contaminated()). No shuffle of texts.

    Rows with null, empty or wordless texts stay, rows that repeat stay or go alike.
    """
    held = prepared(docs, benchmark, threshold, most)

    def keep(texts: list[str | None]) -> list[bool]:
        out = np.ones(len(texts), bool)
        for block in _in_turn(held):
            for i in np.flatnonzero(out).tolist():
                out[i] = not block.best(block.number(texts[i]))
        return out.tolist()

    return filtered(docs, "text", keep)
