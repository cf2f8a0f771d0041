"""Language ID with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.llm._common import filtered, pick, prepare, uncollected

#: Length of the vectors, letters in an n-gram, documents and n-grams that are multiplied at once.
DIM, ORDER, DOCS, GRAMS = 1024, 3, 96, 2048
UNKNOWN = "und"
#: Cosine below which a text of JUDGED n-grams or more counts as of no learned language: those of unrelated texts deviate
#: from 0 by DIM ** -0.5 = 0.031. Of a few n-grams even a learned language may know none.
FLOOR, JUDGED = 0.1, 24
_BITS = 21  # of a code point in an n-gram's code


@lru_cache(maxsize=65536)
def letter(point: int) -> np.ndarray:
    """The letter's random vector of -1 and 1, the same in every process."""
    return np.random.default_rng([10, point]).integers(0, 2, DIM, np.int8) * np.int8(2) - np.int8(1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """An n-gram's vector: its letters' vectors, each permuted (rotated) by its place, bound by multiplication."""
    out = None
    for place in range(ORDER):
        points, at = np.unique((codes >> (_BITS * (ORDER - 1 - place))) & ((1 << _BITS) - 1), return_inverse=True)
        table = np.roll(np.stack([letter(int(p)) for p in points]), ORDER - 1 - place, axis=1)
        out = table[at] if out is None else out * table[at]
    return out


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            out[p] = ord(low) if len(low) == 1 else p
    return out


def grams(text: str | None) -> np.ndarray:
    """Codes of the text's n-grams over lower-case letters, with one space for whatever stands between words."""
    if not text:
        return np.empty(0, np.int64)
    points = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not points.any():
        return np.empty(0, np.int64)
    points = np.concatenate(([0], points, [0]))
    points = points[(points != 0) | (np.concatenate(([1], points[:-1])) != 0)].astype(np.int64)
    points[points == 0] = 32
    code = np.zeros(len(points) - ORDER + 1, np.int64)
    for place in range(ORDER):
        code = code << _BITS | points[place : len(points) - ORDER + 1 + place]
    return code


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's vector, the sum of its n-grams' vectors, and whether it has a letter."""
    codes = [grams(t) for t in texts]
    sizes = np.array([len(c) for c in codes])
    out = np.zeros((len(texts), DIM), np.float64)
    if not sizes.sum():
        return out, sizes > 0
    distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
    row = np.repeat(np.arange(len(texts)), sizes)
    for lo in range(0, len(distinct), GRAMS):
        part = (at >= lo) & (at < lo + GRAMS)
        n = min(GRAMS, len(distinct) - lo)
        counts = np.bincount(row[part] * n + at[part] - lo, minlength=len(texts) * n).reshape(len(texts), n)
        out += counts.astype(np.float32) @ vectors(distinct[lo : lo + n]).astype(np.float32)
    return out, sizes > 0


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of all rows (text, lang) and their prototypes: the sum of the bundles of their documents.

    Each task adds up its documents' vectors; the sums, DIM integers a
    language and task, are what is shuffled. Rows without lang or without a
    letter teach nothing.
    """
    spark = prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list] = {}
            for t, lang in zip(texts, langs, strict=True):
                by.setdefault(lang, []).append(t)
            for lang, own in by.items():
                for i in range(0, len(own), DOCS):
                    v, _ = bundles(own[i : i + DOCS])
                    sums[lang] = sums.get(lang, 0) + np.rint(v.sum(axis=0)).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], names=["lang", "dim", "value"])

    rows = pick(docs, text="string", lang="string").where("lang is not null and text is not null")
    total = rows.mapInArrow(uncollected(run), "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v"))
    found = sorted((r["lang"], [x["value"] for x in r["v"]]) for r in total.collect())  # DIM numbers a language
    kept = [(lang, np.array(v, np.float64)) for lang, v in found if any(v)]
    return [lang for lang, _ in kept], np.array([v / np.linalg.norm(v) for _, v in kept]).reshape(len(kept), DIM)


def predicted(texts: list[str | None], languages: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, as classify() says."""
    v, known = bundles(texts)
    if not languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    cosines = (v @ prototypes.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    score = np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0.0)
    return [languages[b] if k else UNKNOWN for b, k in zip(cosines.argmax(axis=1), known, strict=True)], score


def classify(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """Adds lang_pred and score to the columns of docs, which must have text and neither of these.

    lang_pred: the language whose prototype has the greatest cosine with the
    text's vector (ties: the first in order of names); score: that cosine, 0
    if negative. A text that is null or has no letter, or any text where no
    language was learned, gets `und` and 0. No shuffle.
    """
    prepare(docs.sparkSession)
    names, text = docs.columns, docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, DOCS):
                batch = whole.slice(i, DOCS)
                preds, scores = predicted(batch.column(text).to_pylist(), languages, prototypes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(uncollected(run), schema)


def held_out(fold: int, of: int):
    """Whether crc32 of doc_id as text leaves the remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of == fold


def identify(docs: DataFrame, fold: int = 2, of: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs.

    Learns from text and lang of the rows that are not held out (crc32 of
    doc_id mod `of` is not `fold`), whole texts of all of them; predicts from
    text alone. Rows of one id share its fold; extra columns are ignored; an
    empty table gives no rows.
    """
    rows = pick(docs, doc_id="long", text="string", lang="string").withColumn("held_out", held_out(fold, of))
    languages, prototypes = learn(rows.where("not held_out"))
    return classify(rows.select("doc_id", "held_out", "text"), languages, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, fold: int = 2, of: int = 4, floor: float = FLOOR) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a learned language, as its score tells.

    The languages are learned as in identify(). A text goes if identify() calls
    it `und` (null, without a letter, or no language learned), or if it has
    JUDGED n-grams and its score, the cosine with the nearest language, is below
    the floor.
    """
    rows = pick(docs, doc_id="long", text="string", lang="string").withColumn("held_out", held_out(fold, of))
    languages, prototypes = learn(rows.where("not held_out"))

    def keep(texts: list[str | None]) -> list[bool]:
        found = (predicted(texts[i : i + DOCS], languages, prototypes) for i in range(0, len(texts), DOCS))
        told = [(p, s) for preds, scores in found for p, s in zip(preds, scores, strict=True)]
        return [p != UNKNOWN and (s >= floor or len(grams(t)) < JUDGED) for t, (p, s) in zip(texts, told, strict=True)]

    return filtered(docs, "text", keep)
