"""Document fingerprints: digest sets of content-defined chunks, compared by containment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._common import NULL_ID, pick, prepare, tasks

#: Chunk sizes in bytes. Cuts are rarer before MEAN and likelier after it, which draws sizes towards it.
LEAST, MEAN, MOST = 8, 32, 128
_GEAR = np.random.default_rng(4).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks: gear hash over 32 bytes, strict below MEAN, lax above, none below LEAST, forced at MOST."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    lax = np.flatnonzero(h < np.uint32(2**32 // (MEAN // 3)))
    strict = (h[lax] < np.uint32(2**32 // (MEAN * 3))).tolist()
    out, at = [], 0
    for p, hard in zip((lax + 1).tolist(), strict, strict=True):
        while p - at > MOST:
            at += MOST
            out.append(at)
        if p - at >= (LEAST if hard else MEAN):
            at = p
            out.append(at)
    while n - at > MOST:
        at += MOST
        out.append(at)
    return out if at == n else [*out, n]


def fingerprint(text: str) -> dict[int, int]:
    """Length in bytes by digest, of the text's distinct chunks."""
    data = text.encode("utf-8")
    ends = chunk_ends(data)
    return {xxhash.xxh32_intdigest(data[a:b]): b - a for a, b in zip([0, *ends], ends, strict=False)}


def written(chunks: dict[int, int]) -> str:
    """The fingerprint as a string: digests and lengths in hex, in order of digests."""
    return ",".join(f"{d:08x}{n:x}" for d, n in sorted(chunks.items()))


def read(fingerprint_: str) -> dict[int, int]:
    return {int(x[:8], 16): int(x[8:], 16) for x in fingerprint_.split(",") if x}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's length that b has too; 1 if a is empty and b too, 0 if only a is."""
    total = sum(a.values())
    if not total:
        return float(not b)
    return sum(a[d] for d in a.keys() & b.keys()) / total


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The lesser of both containments."""
    return min(containment(a, b), containment(b, a))


def edited(text: str, following: str) -> str:
    """The text with its last quarter (of code points, rounded down) replaced by the start of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint: one row for each row of docs; a null text counts as empty. No shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([written(fingerprint(t)) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, halo, doc_id, text), to be read in this order within a partition.

    Documents are dealt in ranges of doc_id whose bounds are sampled quantiles,
    so no task needs more than its range; each bucket's last document finds the
    next one in a halo row, a copy of the first document of the next bucket
    that has any (of the first of all, after the last). Shuffles texts once.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id="long", text="string").withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    n = tasks(spark, docs)
    bounds = sorted({int(x) for x in rows.approxQuantile("key", [i / (4 * n) for i in range(1, 4 * n)], 1 / (8 * n))}) if n > 1 else []
    rows = rows.withColumn("bucket", _bucket(bounds))
    firsts = [tuple(r) for r in rows.groupBy("bucket").agg(F.min("key")).collect()]  # at most 4 * n
    firsts.sort()
    if not firsts:
        return rows.select("bucket", F.lit(False).alias("halo"), "doc_id", "text")
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}  # the first's is the last bucket
    places = spark.createDataFrame([(k, b) for k, b in before.items()], "first long, to int")
    own = rows.select("bucket", F.lit(False).alias("halo"), "doc_id", "text")
    halo = rows.join(F.broadcast(places), F.col("key") == F.col("first")).select(F.col("to").alias("bucket"), F.lit(True).alias("halo"), "doc_id", "text")
    return own.unionByName(halo).repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "halo", "doc_id", "text")


def _bucket(bounds: list[int]):
    """How many bounds are at most the key, by halving steps over one constant array: the expression does not grow with the bounds' number."""
    if not bounds:
        return F.lit(0)
    table, n = F.array(*map(F.lit, bounds)), len(bounds)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) <= F.col("key")), at + step).otherwise(at))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike it is to that and to the next document.

    doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next: one row for each row of docs.
    The next document is that with the next doc_id; rows with one id follow one
    another in order of text, a null id is the least, and the last is followed
    by the first (one document alone: by itself). A null text counts as empty.
    Two empty texts are alike to 1, an empty and another to 0.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, doc_id, text, fingerprint of the row before, if it still lacks its next
        for batch in batches:
            out = []
            for bucket, halo, doc, text in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                text = text or ""
                chunks = fingerprint(text)
                if last and last[0] == bucket:
                    new = edited(last[2], text)
                    of_new = fingerprint(new)
                    out.append((last[1], len(last[2]), hashlib.sha256(new.encode("utf-8")).hexdigest(), written(last[3]), written(of_new), likeness(last[3], of_new), likeness(last[3], chunks)))
                last = None if halo else (bucket, doc, text, chunks)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
