"""Product codes of vectors: codebooks by Yinyang's form of Lloyd's rounds, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._common import drop, pick, prepare, stored, tables, trim

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Entries are clustered into so many groups, each with one lower bound a part of a vector.
GROUPS = 16
#: Integers stay within this, so that squared distances of up to 128 components fit in 64 bits.
LIMIT = 1 << 27
#: Bounds are kept in single precision; they are loosened by this share whenever they are rounded.
SLACK = np.float32(1e-5)
_STATE = "vec_id long, label string, x binary, nearest binary, upper binary, lower binary, error long"


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, label, x (integers floor(1024 * component)) of the rows whose vector has no null and no infinite component."""
    rows = pick(rows, vec_id="long", embedding="array<double>", label="string")
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    floor = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return rows.where(good).select("vec_id", "label", floor.alias("x"))


def groups_of(book: np.ndarray, count: int = GROUPS) -> np.ndarray:
    """The group of each entry of a codebook, by a few rounds of clustering from spread-out entries; no result depends on it."""
    count = min(count, len(book))
    centre = book[np.linspace(0, len(book) - 1, count).astype(int)].astype(float)
    group = np.zeros(len(book), int)
    for _ in range(5):
        group = ((book[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(count):
            if (group == g).any():
                centre[g] = book[group == g].mean(axis=0)
    return group


class Assigner:
    """Nearest entries of one part's codebook, for blocks of vectors whose bounds are known from the round before.

    Distances are taken in double precision, where they are exact up to some
    size; entries that come within the error of the least distance are compared
    again in 64-bit integers, ties going to the lower index.
    """

    def __init__(self, book: np.ndarray, group: np.ndarray, before: np.ndarray | None):
        self.book, self.group, self.real = book, group, book.astype(np.float64)
        self.square = (self.real**2).sum(axis=1)
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max(initial=-1)) + 1)]
        if before is not None:
            self.drift = np.sqrt(((book - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
            self.most = np.array([self.drift[m].max(initial=0) for m in self.members])

    def assign(self, x: np.ndarray, nearest: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """nearest, upper bounds, lower bounds by group, exact squared distances of the rows of x. Only groups whose bound fails are scanned."""
        n, groups = len(x), len(self.members)
        if nearest is None:
            nearest, upper, lower = np.zeros(n, np.intp), np.full(n, np.inf, np.float32), np.zeros((n, groups), np.float32)
        else:
            nearest, lower = nearest.astype(np.intp), np.maximum(lower - self.most.astype(np.float32) * (1 + SLACK), 0)
            upper = (upper + self.drift[nearest].astype(np.float32)) * (1 + SLACK)
            loose = np.flatnonzero(lower.min(axis=1) <= upper)
            upper[loose] = self._up(np.sqrt(self._exact(x[loose], nearest[loose])))
        open_ = np.flatnonzero(lower.min(axis=1) <= upper)
        if len(open_):
            self._scan(x, open_, nearest, upper, lower)
        return nearest, upper, lower, self._exact(x, nearest)

    @staticmethod
    def _up(d: np.ndarray) -> np.ndarray:
        return (d * (1 + 2 * float(SLACK))).astype(np.float32)

    @staticmethod
    def _down(d: np.ndarray) -> np.ndarray:
        return (d * (1 - 2 * float(SLACK))).astype(np.float32)

    def _exact(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((x - self.book[entry]) ** 2).sum(axis=1)

    def _scan(self, x: np.ndarray, rows: np.ndarray, nearest: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        real = x[rows].astype(np.float64)
        size = (real**2).sum(axis=1)
        error = 64 * np.finfo(float).eps * (size + self.square.max()) * max(x.shape[1], 1)
        old = nearest[rows].copy()
        far = np.full(len(rows), np.inf)
        best, second = far.copy(), far.copy()  # the least and the next distance over all that was looked at
        entry = old.copy()
        known = np.isfinite(upper[rows])
        best[known] = self._exact(x[rows[known]], old[known])
        least = {}
        for g, members in enumerate(self.members):
            at = np.flatnonzero(lower[rows, g] <= upper[rows])
            if not len(at) or not len(members):
                lower[rows[at], g] = np.inf
                continue
            d = np.maximum(size[at, None] - 2 * real[at] @ self.real[members].T + self.square[members], 0)
            d[known[at, None] & (members[None] == old[at, None])] = np.inf  # counted already
            order = np.argpartition(d, 1, axis=1)[:, :2] if len(members) > 1 else np.zeros((len(at), 1), int)
            two = np.sort(np.take_along_axis(d, order, axis=1), axis=1)
            first, next_ = two[:, 0], two[:, 1] if len(members) > 1 else np.full(len(at), np.inf)
            least[g] = (at, first, next_)
            who = members[d.argmin(axis=1)]
            less = first < best[at]
            second[at] = np.minimum(np.where(less, best[at], first), np.minimum(second[at], np.where(less, next_, second[at])))
            best[at] = np.where(less, first, best[at])
            entry[at] = np.where(less, who, entry[at])
            lower[rows[at], g] = self._down(np.sqrt(np.maximum(first - error[at], 0)))
        tied = np.flatnonzero(second <= best + 2 * error)
        for start in range(0, len(tied), 2048):
            part = tied[start : start + 2048]
            exact = ((x[rows[part], None, :] - self.book[None]) ** 2).sum(axis=2)
            entry[part] = exact.argmin(axis=1)
        # a group's bound holds for all its entries but the nearest: where that one was its least, the next one counts
        for g, (at, first, next_) in least.items():
            own = self.group[entry[at]] == g
            bound = np.where(own & (entry[at] != old[at]), np.where(np.isin(at, tied), 0, next_), np.where(own & ~known[at], np.where(np.isin(at, tied), 0, next_), first))
            lower[rows[at], g] = self._down(np.sqrt(np.maximum(bound - error[at], 0)))
        moved = np.flatnonzero(known & (entry != old))
        if len(moved):  # the entry that was nearest is one of its group again
            back = self._down(np.sqrt(self._exact(x[rows[moved]], old[moved])))
            lower[rows[moved], self.group[old[moved]]] = np.minimum(lower[rows[moved], self.group[old[moved]]], back)
        nearest[rows] = entry
        upper[rows] = self._up(np.sqrt(self._exact(x[rows], entry)))


def _column(values: np.ndarray, n: int) -> pa.Array:
    """n binary values of equal size."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (data.nbytes // max(n, 1))).astype(np.int32)), pa.py_buffer(data)])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The rows of a binary column as a matrix."""
    out = np.frombuffer(b"".join(column.to_pylist()), kind)
    return out.reshape(len(column), width)


def _assigned(rows: DataFrame, books: list[np.ndarray], groups: list[np.ndarray], before: list[np.ndarray] | None, width: int) -> DataFrame:
    """Rows with the nearest entries, bounds and errors against the codebooks; rows are those of integers() or of the round before."""
    size = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Assigner(b, g, None if before is None else before[p]) for p, (b, g) in enumerate(zip(books, groups, strict=True))]
        ends = np.cumsum([0, *(len(a.members) for a in parts)])
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            if before is None:
                lists = batch.column(2)
                count = np.diff(lists.offsets.to_numpy())
                x = np.zeros((n, width), np.int32)
                x[np.repeat(np.arange(n), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] = lists.flatten().to_numpy()
                nearest = upper = lower = None
            else:
                x = _matrix(batch.column(2), np.int32, width)
                nearest, upper = _matrix(batch.column(3), np.uint8, PARTS), _matrix(batch.column(4), np.float32, PARTS)
                lower = _matrix(batch.column(5), np.float32, int(ends[-1]))
            found = [a.assign(x[:, p * size : (p + 1) * size].astype(np.int64), *((None,) * 3 if nearest is None else (nearest[:, p], upper[:, p].copy(), lower[:, ends[p] : ends[p + 1]]))) for p, a in enumerate(parts)]
            near, up, low, error = (list(v) for v in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _column(x, n), _column(np.stack(near, axis=1).astype(np.uint8), n), _column(np.stack(up, axis=1), n), _column(np.concatenate(low, axis=1), n), pa.array(np.sum(error, axis=0))],
                names=["vec_id", "label", "x", "nearest", "upper", "lower", "error"],
            )
        trim()

    return rows.mapInArrow(run, _STATE)


def _moved(state: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks with each used entry replaced by its parts' floored mean. Tasks add up their own vectors before anything is shuffled."""
    size, entries = width // PARTS, len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS, entries, size), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, nearest = _matrix(batch.column(0), np.int32, width), _matrix(batch.column(1), np.uint8, PARTS)
            for p in range(PARTS):
                count[p] += np.bincount(nearest[:, p], minlength=entries)
                order = np.argsort(nearest[:, p], kind="stable")
                at = nearest[order, p]
                start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                if size:
                    total[p, at[start]] += np.add.reduceat(x[order, p * size : (p + 1) * size].astype(np.int64), start, axis=0)
        part, entry = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * size, pa.int32()), pa.array(total[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), lists], names=["part", "entry", "n", "total"])

    own = state.select("x", "nearest").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    flat = own.select("part", "entry", F.posexplode(F.concat(F.array("n"), "total")).alias("at", "value"))
    out = [b.copy() for b in books]
    rows = flat.groupBy("part", "entry", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # 4 * 256 entries at most
    value = {(r["part"], r["entry"], r["at"]): int(r["value"]) for r in rows}
    for (part, entry, at), total in value.items():
        if at:
            out[part][entry, at - 1] = total // value[part, entry, 0]
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code (an index of two hex digits a part), error, label_error, codebooks_sha256 of each vector kept.

    A row whose vector is null or holds a null, NaN or infinite component is
    dropped. Components become floor(1024 * x), held within 2^27 either way. A
    vector shorter than the longest, whose size is rounded up to a multiple of
    four, counts as if zeros followed. Codebooks start as the parts of the
    `entries` smallest vec_ids (of equal ids the lesser integers come first; a
    null id is greatest), or of all, if there are fewer. Rows that repeat are
    rows of their own. label_error adds up the errors of equal labels, nulls
    together; a sum beyond 64 bits is null. No vectors give no rows.

    Each round is written to the shared folder with every part's nearest entry,
    an upper bound of its distance and a lower bound for each group of entries:
    after the entries have moved, only groups whose bound, less the group's
    greatest move, is within the upper bound are looked at again. What reaches
    the driver are codebooks and sums for their entries.
    """
    spark = prepare(vectors.sparkSession)
    rows = integers(vectors)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    kind = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if width is None:
        return spark.createDataFrame([], kind)
    width = -(-max(width, 1) // PARTS) * PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    book = np.array([r["x"] + [0] * (width - len(r["x"])) for r in first], np.int64)
    books = [book[:, p * width // PARTS : (p + 1) * width // PARTS].copy() for p in range(PARTS)]
    groups = [groups_of(b) for b in books]
    state, before = stored(_assigned(rows, books, groups, None, width), "codes"), books
    for _ in range(rounds):
        old = tables()[-1]
        before, books = books, _moved(state, books, width)
        state = stored(_assigned(state, books, groups, before, width), "codes")
        drop(spark, [old])
    label = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    code = F.lower(F.hex("nearest"))
    out = state.select("vec_id", code.alias("code"), "error", label.alias("label"))
    sums = out.groupBy("label").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as long)").alias("label_error"))
    return out.join(sums, "label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
