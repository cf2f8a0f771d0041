"""LM scoring: masked pseudo-likelihood by a bidirectional window network in numpy."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._common import forget, pick, prepare, stored, tasks, uncollected

#: A token is predicted as its class, then as a member of it; so many tokens have numbers of their own.
CLASSES, MEMBERS = 32, 32
#: The first numbers stand for rarer words: of letters, with digits, and marks. Which of them it is, counts say.
KINDS = 3
#: Workers hold the counts of so many rare words; those of any others, however many, are joined by a shuffle.
COUNTED = 1 << 16
#: What each distinct rare word counts besides its occurrences, and the binary digits behind the point of sums over rare words.
SMOOTH, FRACTION = 0.5, 32
#: Size of vectors; tokens on either side that predict one; tokens in a step; step size; parameters that are averaged at once.
DIM, SIDE, STEP, RATE, CHUNK = 16, 2, 16384, 0.5, 4096
_words = re.compile(r"[^\W_]+|[^\w\s]+").findall
_space = re.compile(r"\s").search
_EDGE = CLASSES * MEMBERS  # stands before and behind a text
_PLACES = [k for k in range(-SIDE, SIDE + 1) if k]


def kind(word: str) -> int:
    """0: letters only, 1: letters or digits, 2: marks."""
    return 0 if word.isalpha() else 1 if word[0].isalnum() else 2


def pieces(text: str, strip: int = 1 << 20) -> Iterator[list[str]]:
    """What white space parts, in lower case; of a long text, strip by strip."""
    text, at = text.lower(), 0
    while at < len(text):
        cut = _space(text, at + strip)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


class Vocabulary(dict):
    """Numbers of the words of what white space parts, as bytes: KINDS and on for those that are given, else that of the word's kind.

    What was asked for is kept until there are `most` parts or `size` characters of them, and one text's strip.
    There, words without a number have a negative one, which read() turns into their kind's.
    """

    def __init__(self, words: Iterable[str], most: int = 400_000, size: int = 16 << 20):
        super().__init__()
        self.numbers = {w: (i + KINDS).to_bytes(4, "little") for i, w in enumerate(words)}
        self.most, self.size, self.held = most, size, 0
        self.late: dict[str, bytes] = {}
        self.words: list[str] = []

    def __missing__(self, part: str) -> bytes:
        self.held += len(part)
        code = self.numbers.get(part)
        if code is None:
            if part.isalnum():
                code = self._late(part)
            else:
                numbers = self.numbers
                code = b"".join([numbers.get(w) or self._late(w) for w in _words(part)])
        self[part] = code
        return code

    def _late(self, word: str) -> bytes:
        code = self.late.get(word)
        if code is None:
            code = self.late[word] = (-1 - KINDS * len(self.words) - kind(word)).to_bytes(4, "little", signed=True)
            self.words.append(word)
        return code

    def read(self, text: str, rare: Counter | None = None) -> np.ndarray:
        """Numbers of the text's tokens: runs of letters and digits, and of marks. Words without one are counted in `rare`."""
        out = []
        for parts in pieces(text):
            if len(self) > self.most or self.held > self.size:
                self.clear()
                self.late.clear()
                self.words.clear()
                self.held = 0
            ids = np.frombuffer(b"".join(map(self.__getitem__, parts)), "<i4")
            late = np.flatnonzero(ids < 0)
            if len(late):
                word, kinds = np.divmod(-1 - ids.take(late), KINDS)
                if rare is not None:
                    rare.update(map(self.words.__getitem__, word.tolist()))
                ids = ids.copy()
                ids[late] = kinds
            out.append(ids)
        return np.concatenate(out) if out else np.empty(0, "<i4")


class Network:
    """The vectors of the tokens around, each scaled by its place, are added up and squashed; two softmaxes read it."""

    SHAPES = {"vectors": (_EDGE + 1, DIM), "places": (len(_PLACES), DIM), "bias": (DIM,), "class_w": (DIM, CLASSES), "class_b": (CLASSES,), "member_w": (CLASSES, DIM, MEMBERS), "member_b": (CLASSES, MEMBERS)}

    def __init__(self, flat: np.ndarray | None = None, kind: type = np.float32):
        rng, at = np.random.default_rng(9), 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            if flat is None:
                value = np.ones(shape) + rng.normal(0, 0.1, shape) if name == "places" else rng.normal(0, 0.1, shape) if name in ("vectors", "class_w", "member_w") else np.zeros(shape)
            else:
                value = flat[at : at + n].reshape(shape)
            setattr(self, name, value.astype(kind))
            at += n

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.SHAPES])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        scaled = self.vectors * self.places[:, None]
        total = scaled[0].take(around[0], axis=0)
        for k in range(1, len(_PLACES)):
            total += scaled[k].take(around[k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def log_likelihoods(self, target: np.ndarray, around: np.ndarray, gradient: dict | None = None) -> np.ndarray:
        """Of each target given the tokens around it. What goes into `gradient` is that of their sum: by parameter, of
        members (class, targets in it, weights, bias), of vectors (how often each is meant, rows) by place."""
        order = np.argsort(target.astype(np.uint16), kind="stable")  # 16 bits: a radix sort
        target, around = target.take(order), around.take(order, axis=1)
        h = self.hidden(around)
        cls, member = np.divmod(target, MEMBERS)
        at = np.arange(len(target))
        p, total = _powers(h @ self.class_w, self.class_b)
        hit = at * CLASSES + cls
        out = p.ravel().take(hit) / total
        if gradient is not None:
            p /= total[:, None]
            p.ravel()[hit] -= 1
            back = p @ self.class_w.T
            gradient["members"] = []
        bounds = np.concatenate(([0], np.cumsum(np.bincount(cls, minlength=CLASSES))))
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            i, j = bounds[c : c + 2].tolist()
            q, total = _powers(h[i:j] @ self.member_w[c], self.member_b[c])
            hit = at[: j - i] * MEMBERS + member[i:j]
            out[i:j] *= q.ravel().take(hit) / total
            if gradient is not None:
                q /= total[:, None]
                q.ravel()[hit] -= 1
                back[i:j] += q @ self.member_w[c].T
                gradient["members"].append((c, j - i, -(h[i:j].T @ q), -_down(q)))
        if gradient is not None:
            gradient["class_w"], gradient["class_b"] = -(h.T @ p), -_down(p)
            back *= h * h - 1
            gradient["bias"] = _down(back)
            gradient["vectors"], gradient["places"] = [], np.empty_like(self.places)
            columns, n = np.ascontiguousarray(back.T, np.float64), len(self.vectors)
            for k in range(len(_PLACES)):
                total = np.stack([np.bincount(around[k], column, n) for column in columns], axis=1)
                gradient["places"][k] = (total * self.vectors).sum(axis=0)
                gradient["vectors"].append((np.bincount(around[k], minlength=n), total * self.places[k]))
        logs = np.empty(len(out))
        logs[order] = np.log(np.maximum(out, 1e-30))
        return logs

    def learn(self, target: np.ndarray, around: np.ndarray, rate: float = RATE) -> np.ndarray:
        """Takes a step up the gradient of the mean; rare classes and vectors take longer ones than their share."""
        g: dict = {}
        out = self.log_likelihoods(target, around, g)
        n = len(target)
        for name in ("class_w", "class_b", "bias"):
            getattr(self, name)[...] += rate / n * g[name]
        for c, own, w, b in g["members"]:
            step = rate / max(own, n / CLASSES)
            self.member_w[c] += step * w
            self.member_b[c] += step * b
        for count, rows in g["vectors"]:
            self.vectors += (rate / np.sqrt(np.maximum(count, 1) * n))[:, None] * rows
        self.places += rate / n * g["places"]
        return out


def _powers(x: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp() of x + bias, in place, and the sums of its rows; logits are held within 60, where 32 bits are safe without their maximum."""
    x += bias
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _down(x: np.ndarray) -> np.ndarray:
    """Sums of columns, as a product: several times as fast as sum()."""
    return np.ones(len(x), x.dtype) @ x


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets, the tokens around each (a row a place), and which doc each target is of; edges stand around each text."""
    pad = np.full(SIDE, _EDGE, np.int32)
    flat = np.concatenate([pad, *(x for d in docs for x in (d, pad))])
    sizes = np.array([len(d) for d in docs], np.int64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    at = np.arange(len(owner)) + SIDE * (owner + 1)
    return flat[at], np.stack([flat[at + k] for k in _PLACES]), owner


def _groups(batches: Iterator[pa.RecordBatch], column: int, read: Callable, most: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches with about `most` tokens, and the numbers that read() gives of each row's value."""
    for batch in batches:
        start, size, held = 0, 0, []
        for i, value in enumerate(batch.column(column).to_pylist()):
            held.append(read(value))
            size += len(held[-1])
            if size >= most:
                yield batch.slice(start, i + 1 - start), held
                start, size, held = i + 1, 0, []
        if held:
            yield batch.slice(start), held


def count_words(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """word, kind, n: how often each word of all texts occurs. Tasks add up first, and hand on what they have at `most` pieces of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            counts: Counter = Counter()
            for part, n in seen.items():
                for w in _words(part):
                    counts[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*map(kind, counts)], pa.int32()), pa.array([*counts.values()], pa.int64())], names=["word", "kind", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for parts in pieces(text or ""):
                    seen.update(parts)
                    if len(seen) > most:
                        yield out()
        yield out()

    return texts.mapInArrow(uncollected(run), "word string, kind int, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """What choose() makes of the counts of all words."""

    numbered: list[str]
    counted: dict[str, int]  # KINDS * count + kind
    kinds: list[tuple[int, int]]  # of each kind of rare words: occurrences, distinct words
    others: DataFrame  # word, kind, n


def choose(counts: DataFrame, numbered: int = CLASSES * MEMBERS - KINDS, counted: int = COUNTED) -> Words:
    """The commonest words get numbers; of the next the counts are held; all others stay a table.

    Counts fall in classes an eighth of a doubling wide, and whole classes are
    taken from the top while they make no more than `numbered`, then `counted`
    words. So what reaches the driver and the workers is bounded, and a word of
    the table has at most about the counted-th part of all tokens, which bounds
    every group that later steps make of it. Words that occur once have no number.
    """
    classed = counts.withColumn("level", F.floor(F.log2("n") * 8).cast("int"))
    sizes = {r["level"]: r["words"] for r in classed.groupBy("level").agg(F.count("*").alias("words")).collect()}  # at most 8 * 63

    def lowest(below: int, most: int, floor: int) -> int:
        for level in sorted((x for x in sizes if floor <= x < below), reverse=True):
            most -= sizes[level]
            if most < 0:
                break
            below = level
        return below

    first = lowest(1 << 30, numbered, 1)
    second = lowest(first, counted, 0)
    names = [r["word"] for r in classed.where(F.col("level") >= first).orderBy(F.desc("n"), "word").select("word").collect()]
    held = {r["word"]: KINDS * r["n"] + r["kind"] for r in classed.where((F.col("level") >= second) & (F.col("level") < first)).collect()}
    kinds = {r["kind"]: (r["n"], r["words"]) for r in classed.where(F.col("level") < first).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    return Words(names, held, [kinds.get(k, (0, 0)) for k in range(KINDS)], classed.where(F.col("level") < second).select("word", "kind", "n"))


def train(docs: DataFrame, words: list[str], rounds: int = 1) -> Network:
    """A network fitted to all tokens of all documents.

    In each round every task starts from the present network, takes gradient
    steps over its own documents, and gives its parameters, weighted by its
    tokens, in chunks; the mean of each chunk, added up in order of tasks, is
    the next network's. What is shuffled are parameters for each task; one
    network reaches the driver. Equal tables in equal partitions give equal
    networks.
    """
    network = Network()
    for _ in range(rounds):
        network = _mean(_steps(docs, network, words), network)
    return network


_STEPS = "at int, task int, weight long, values binary, doc_id long, ids binary, rare array<struct<word: string, m: long>>"


def _steps(docs: DataFrame, network: Network, numbered: list[str], words: Words | None = None) -> DataFrame:
    """at, task, weight, values: chunks of what each task's steps make of the network.

    With words also doc_id, ids, rare of each document: its tokens' numbers as
    32-bit integers, those of counted words behind the numbered ones', and how
    often it has each word without one; so no text is read again for its score.
    """
    spark = prepare(docs.sparkSession)
    counted = [] if words is None else [*words.counted]
    shared = spark.sparkContext.broadcast((network.flat(), numbered, counted, np.arange(KINDS + len(numbered), dtype=np.int32) if words is None else _seen_as(words)))
    keep = words is not None

    def rows(names: str, columns: list[pa.Array]) -> pa.RecordBatch:
        own, n = dict(zip(names.split(), columns, strict=True)), len(columns[0])
        kinds = {"at": pa.int32(), "task": pa.int32(), "weight": pa.int64(), "values": pa.binary(), "doc_id": pa.int64(), "ids": pa.binary(), "rare": pa.list_(pa.struct([("word", pa.string()), ("m", pa.int64())]))}
        return pa.RecordBatch.from_arrays([own.get(name, pa.nulls(n, kind)) for name, kind in kinds.items()], names=[*kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, numbered, counted, seen_as = shared.value
        network, vocabulary, seen, rng = Network(flat), Vocabulary(chain(numbered, counted)), 0, np.random.default_rng(9)
        rare: list[Counter] = []

        def read(text: str | None) -> np.ndarray:
            if keep:
                rare.append(Counter())
            return vocabulary.read(text or "", rare[-1] if keep else None)

        for batch, held in _groups(batches, 1, read):
            target, around, _ = windows([seen_as.take(h) for h in held])
            order = rng.permutation(len(target))
            for i in range(0, len(order), STEP):
                part = order[i : i + STEP]
                network.learn(target[part], around[:, part])
            seen += len(target)
            if keep:
                left = pa.StructArray.from_arrays([pa.array([*chain.from_iterable(rare)], pa.string()), pa.array([m for own in rare for m in own.values()], pa.int64())], names=["word", "m"])
                offsets = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
                yield rows("doc_id ids rare", [batch.column(0), pa.array([h.tobytes() for h in held], pa.binary()), pa.ListArray.from_arrays(offsets, left)])
                rare.clear()
        if seen:
            flat = network.flat()
            chunks = [flat[i : i + CHUNK].astype("<f4").tobytes() for i in range(0, len(flat), CHUNK)]
            me, n = TaskContext.get().partitionId(), len(chunks)
            yield rows("at task weight values", [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, me, np.int32)), pa.array(np.full(n, seen, np.int64)), pa.array(chunks, pa.binary())])

    return pick(docs, doc_id="long", text="string").mapInArrow(uncollected(run), _STEPS)


def _mean(steps: DataFrame, network: Network) -> Network:
    """The mean of the tasks' networks, by tokens; without any, the network as it was."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, weight = None, None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(total / weight).tobytes()], pa.binary())], names=["at", "values"])

        for batch in batches:
            for chunk, n, values in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if chunk != at:
                    if at is not None:
                        yield out()
                    at, total, weight = chunk, 0.0, 0
                total = total + n * np.frombuffer(values, "<f4").astype(np.float64)
                weight += n
        if at is not None:
            yield out()

    n = tasks(steps.sparkSession)
    chunks = steps.where("at is not null").select("at", "task", "weight", "values")
    means = chunks.repartition(n, "at").sortWithinPartitions("at", "task").mapInArrow(mean, "at int, values binary")
    got = sorted((r["at"], bytes(r["values"])) for r in means.collect())  # one network's parameters, of a fixed number
    return Network(np.frombuffer(b"".join(v for _, v in got), np.float64)) if got else network


def _seen_as(words: Words) -> np.ndarray:
    """The network's number of each number in ids: of counted words, that of their kind."""
    held = np.fromiter(words.counted.values(), np.int64, len(words.counted)) % KINDS
    return np.concatenate((np.arange(KINDS + len(words.numbered)), held)).astype(np.int32)


def score(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """doc_id, score, log_likelihood, n_tokens, n_rare: one row for each row of docs.

    Every token of the whole text is masked in turn and predicted from SIDE
    tokens on both sides; log_likelihood is the sum of their conditional log
    probabilities (natural logarithm), score its mean by token. The words of
    the vocabulary are predicted by the network, each by its own number; any
    other as a rare word of its kind, times the word's share in the rare words
    of that kind in all other documents (each distinct one counts SMOOTH more),
    so a document does not vouch for its own words, but its copies elsewhere do.
    n_rare: how many tokens have no number.

    A text that is null or has no token has 0 tokens, sum 0 and a null score.
    Learns from the same documents, all of them: what is counted, and joined by
    a shuffle, grows with their vocabulary, what is broadcast does not. Rows that
    repeat, with one id or several, are documents of their own, which vouch for
    each other; an empty table gives no rows. Sums over shuffled rows are of
    whole numbers, so they do not depend on the order.
    """
    spark = prepare(docs.sparkSession)
    words = choose(stored(count_words(pick(docs, text="string")), "words"))
    seen_as, start = _seen_as(words), Network()
    steps = stored(_steps(docs, start, words.numbered, words), "tokens")
    network = _mean(steps, start)
    for _ in range(rounds - 1):
        network = _mean(_steps(docs, network, words.numbered), network)
    tokens = steps.where("at is null").select("doc_id", "ids", "rare")
    held_counts, held_kinds = np.divmod(np.fromiter(words.counted.values(), np.int64, len(words.counted)), KINDS)
    shared = spark.sparkContext.broadcast((network.flat(), seen_as, held_counts, held_kinds, np.array(words.kinds, float)))
    first = KINDS + len(words.numbered)  # the number of the first counted word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, seen_as, held_counts, held_kinds, kinds = shared.value
        network = Network(flat)
        for batch, held in _groups(batches, 1, lambda ids: np.frombuffer(ids, "<i4")):
            target, around, owner = windows([seen_as.take(h) for h in held])
            total = np.zeros(len(held))
            for i in range(0, len(target), STEP):
                found = network.log_likelihoods(target[i : i + STEP], around[:, i : i + STEP])
                total += np.bincount(owner[i : i + STEP], found, len(held))
            rare = target < KINDS
            own = np.bincount(owner[rare] * KINDS + target[rare], minlength=len(held) * KINDS).reshape(-1, KINDS)
            all_ids = np.concatenate(held)
            at = np.flatnonzero(all_ids >= first)
            both, m = np.unique(owner[at] * len(seen_as) + all_ids[at], return_counts=True)
            doc, of = np.divmod(both, len(seen_as))
            kind_of, count = held_kinds[of - first], held_counts[of - first]
            share = (count - m + SMOOTH) / (kinds[kind_of, 0] + SMOOTH * kinds[kind_of, 1] - own[doc, kind_of])
            total += np.bincount(doc, m * np.log(share), len(held))
            n = np.array([len(h) for h in held], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), *(pa.array(own[:, k].copy()) for k in range(KINDS)), batch.column(2)], names=["doc_id", "n_tokens", "known", *(f"own{k}" for k in range(KINDS)), "rare"])

    owns = [F.col(f"own{k}") for k in range(KINDS)]
    fields = ", ".join(f"own{k} long" for k in range(KINDS))
    scored = tokens.mapInArrow(uncollected(run), f"doc_id long, n_tokens long, known double, {fields}, rare array<struct<word: string, m: long>>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    forget(steps)
    each = scored.where(F.size("rare") > 0).select("row", *owns, F.inline("rare")).join(words.others, "word")
    of_kind = F.element_at(F.array(*(F.lit(n + SMOOTH * d) - own for own, (n, d) in zip(owns, words.kinds, strict=True))), F.col("kind") + 1)
    part = F.col("m") * F.log((F.col("n") - F.col("m") + SMOOTH) / of_kind)
    sums = each.groupBy("row").agg(F.sum(F.round(part * (1 << FRACTION)).cast("long")).alias("part"))
    total = F.col("known") + F.coalesce(F.col("part"), F.lit(0)) / F.lit(float(1 << FRACTION))
    out = scored.drop("rare").join(sums, "row", "left").withColumn("log_likelihood", total)
    score_ = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select("doc_id", score_.alias("score"), "log_likelihood", "n_tokens", sum(owns[1:], owns[0]).alias("n_rare"))
