"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._common import pick, prepare, uncollected
from relspan.llm.langid import held_out

#: Features are hashed to so many numbers.
SPACE = 1 << 18
#: A classifier is fitted on at most about so many labelled rows, drawn by hash of doc_id.
SAMPLE = 12_000
_UPPER, _LOWER, _DIGIT = (re.compile(p) for p in (r"[A-ZÀ-ÖØ-Þ]+", r"[^\W\d_A-ZÀ-ÖØ-Þ]+", r"\d+"))
_space = re.compile(r"\s").search
_shapes: dict[str, str] = {}


def shape(word: str) -> str:
    """The word with runs of capitals, small letters and digits as X, x and 9."""
    found = _shapes.get(word)
    if found is None:
        if len(_shapes) > 200_000:
            _shapes.clear()
        found = _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word)))
        if len(word) < 100:
            _shapes[word] = found
    return found


def features(text: str, strip: int = 1 << 20) -> np.ndarray:
    """Numbers of the n-grams that the text has: words, and one to three shapes of words in a row.

    A word that repeats the one before it is marked in its shape. A long text
    goes strip by strip, so that no more than a strip's n-grams are held as text.
    """
    out, at, word, before = [], 0, "", []
    digest = xxhash.xxh32_intdigest
    while True:
        cut = _space(text, at + strip)
        part = text[at : cut.start() if cut else len(text)]
        words = part.split()
        shapes = [shape(w) for w in words]
        shapes = [s + "=" if w == v else s for s, w, v in zip(shapes, words, [word, *words], strict=False)]
        found = {f"w {w}" for w in set(part.lower().split())}
        found.update(f"1 {a}" for a in set(shapes))
        shapes = before + shapes
        found.update(f"2 {a} {b}" for a, b in set(zip(shapes, shapes[1:], strict=False)))
        found.update(f"3 {a} {b} {c}" for a, b, c in set(zip(shapes, shapes[1:], shapes[2:], strict=False)))
        out.append(np.unique(np.fromiter((digest(f) % SPACE for f in found), np.int32, len(found))))
        if not cut:
            return out[0] if len(out) == 1 else np.unique(np.concatenate(out))
        at, word, before = cut.start(), words[-1] if words else word, shapes[-2:]


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """By feature: log of its share among the indicators of class 1 over that of class 0, each count raised by 1."""
    counts = [1.0 + np.bincount(np.concatenate([np.empty(0, np.int32), *(x for x, y in zip(rows, labels, strict=True) if y == c)]).astype(np.int64), minlength=SPACE) for c in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def fit_margin(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 2) -> tuple[np.ndarray, float]:
    """A linear model with hinge loss on scaled indicators, by dual coordinate descent.

    Each step sets one row's dual variable, kept between 0 and cost, to its
    best value with the others fixed, and the weights follow. Scaled rows are
    divided by their norm. Returns the weights, scaled by the ratios, and bias.
    """
    ratio = log_count_ratios(rows, labels)
    values = [ratio[x] / max(np.linalg.norm(ratio[x]), 1e-9) for x in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    sign, alpha, w, b = np.where(labels == 1, 1.0, -1.0), np.zeros(len(rows)), np.zeros(SPACE), 0.0
    share = np.clip(np.array([np.mean(labels == 0), np.mean(labels == 1)]), 1e-3, None)
    most = cost / (2 * share[labels.astype(int)])  # both classes weigh the same
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = sign[i] * (float(w[x] @ v) + b) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * v
                b += step
                alpha[i] = new
    return w * ratio, b


def _margins(model: tuple[np.ndarray, float], rows: list[np.ndarray], ratio: np.ndarray) -> np.ndarray:
    return np.array([float(model[0][x].sum()) / max(np.linalg.norm(ratio[x]), 1e-9) + model[1] for x in rows])


class Classifier:
    """Margins by naive Bayes support vectors, made probabilities by a logistic curve fitted out of fold."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, folds: int = 3):
        self.prior = float(np.mean(labels)) if len(labels) else 0.5
        self.weights = None
        if len(set(labels.tolist())) < 2:
            return
        part = np.arange(len(rows)) % folds
        out = np.zeros(len(rows))
        for k in range(folds):
            inside = np.flatnonzero(part != k)
            if len(set(labels[inside].tolist())) < 2:
                return
            own, y = [rows[i] for i in inside], labels[inside]
            out[part == k] = _margins(fit_margin(own, y), [rows[i] for i in np.flatnonzero(part == k)], log_count_ratios(own, y))
        self.slope, self.offset = logistic(out, labels)
        weights, self.bias = fit_margin(rows, labels)
        self.weights = weights.astype(np.float32)
        self.squares = (log_count_ratios(rows, labels) ** 2).astype(np.float32)

    def __call__(self, x: np.ndarray) -> float:
        if self.weights is None:
            return self.prior
        margin = float(self.weights[x].sum(dtype=np.float64)) / max(float(np.sqrt(self.squares[x].sum(dtype=np.float64))), 1e-9) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, by damped Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        gradient = x.T @ (p - labels) + 1e-3 * np.array([a, b])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fits on rows (doc_id, text) that have a label (doc_id, quality).

    At most about `sample` labels are used; where there are more, those with
    the least hash of doc_id. That bounds what is broadcast (ids and labels).
    If ids repeat so that more than twice as many rows have them, rows are
    drawn by hash of id and text, and rows that repeat teach once. That bounds
    what reaches the driver (their features).
    """
    prepare(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality", F.xxhash64("doc_id", F.lit(2)).alias("at"))
    count = known.count()
    if count > sample:
        known = known.where(F.col("at") < _least(sample / count))
    known = F.broadcast(known.select("doc_id", "quality"))
    rows = docs.join(known, "doc_id").select("doc_id", "text", "quality")
    count = docs.select("doc_id").join(known, "doc_id").count()
    often = count > 2 * sample
    if often:
        rows = rows.where(F.xxhash64("doc_id", "text", "quality", F.lit(3)) < _least(sample / count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "quality", "x"])

    taught = rows.mapInArrow(uncollected(run), "doc_id long, quality int, x binary")
    got = sorted((r["doc_id"], r["quality"], bytes(r["x"])) for r in (taught.distinct() if often else taught).collect())
    return Classifier([np.frombuffer(x, np.int32) for _, _, x in got], np.array([y for _, y, _ in got], np.int64))


def _least(share: float) -> int:
    """What that share of all hashes is below."""
    return int(-(2**63) + 2**64 * share)


def assess(docs: DataFrame, labels: DataFrame, fold: int = 0, of: int = 5, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs.

    Learns labels.quality (0 or 1; other values and nulls teach nothing) of
    rows that are not held out; held out are those whose crc32(doc_id as text)
    mod `of` is `fold`. score is the probability of label 1 from the text
    alone, predicted is 1 from `threshold` on. A null text counts as empty
    and gets a score too. With labels of one class, or none, every score is
    that class's share, or 0.5. Where an id repeats, each of its rows counts
    with each of its labels. No shuffle of texts.
    """
    rows = pick(docs, doc_id="long", text="string").withColumn("held_out", held_out(fold, of))
    known = pick(labels, doc_id="long", quality="int").where(~held_out(fold, of))
    model = learn(rows.where("not held_out").select("doc_id", "text"), known, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model(features(t or "")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(uncollected(run), "doc_id long, held_out boolean, score double, predicted int")
