"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relspan.llm import bpe
from relspan.llm._common import pick, prepare, sliced, uncollected

#: Chunks in code points: cuts are likely from LEAST on, one in MEAN, forced at MOST.
LEAST, MEAN, MOST = 64, 256, 1024
#: A task holds at most so many distinct pre-tokens, and so many code points of chunks.
HELD_WORDS, HELD_CHARS = 120_000, 1_000_000
_GEAR = np.random.default_rng(5).integers(0, 2**32, 4096, dtype=np.uint32)


def cuts(text: str) -> list[int]:
    """Ends of the text's chunks. A cut depends on the 32 code points before it and on the last cut."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = _GEAR[points & np.uint32(4095)]
    for k in (1, 2, 4, 8, 16):  # h[i] = sum of gear[i - j] << j for j under 32
        h[k:] += h[:-k] << np.uint32(k)
    out, at = [], 0
    for p in (np.flatnonzero(h < np.uint32(2**32 // MEAN)) + 1).tolist():
        while p - at > MOST:
            at += MOST
            out.append(at)
        if p - at >= LEAST:
            at = p
            out.append(at)
    while n - at > MOST:
        at += MOST
        out.append(at)
    return out if at == n else [*out, n]


class Codec:
    """Encodes texts; a chunk that was met before is not encoded again.

    A chunk's encoding starts and ends wherever the cuts fall, so the tokens at
    its ends can differ from those of the whole text. The start of a pre-token
    depends only on where the last one ended and on the text from there on, so
    two encodings that share one pre-token boundary agree from there on, and a
    boundary with bpe.LOOKAHEAD code points behind it in its chunk is settled.
    Joins are repaired by that: from the last settled boundary on the left,
    the text is encoded again, further and further, until a boundary falls on
    one of the right chunk.
    """

    def __init__(self, vocabulary: str):
        self.bpe = bpe.resolve(vocabulary)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, tuple[list[bytes], list[int]]] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if new:
            ids, counts = self.bpe.merge([w.encode("utf-8") for w in new])
            raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            self.words.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def prime(self, texts: list[str]) -> list[list[list[str]]]:
        """The chunks of each segment of each text; those not held are encoded together."""
        if self.held > HELD_CHARS:
            self.chunks.clear()
            self.held = 0
        if len(self.words) > HELD_WORDS:
            self.words.clear()
        out = []
        for text in texts:
            segments = []
            for segment, _ in self.bpe.segments(text):
                ends = cuts(segment)
                segments.append([segment[a:b] for a, b in zip([0, *ends], ends, strict=False)])
            out.append(segments)
        new = {c: self.bpe.pretokens(c) for c in {c for segments in out for s in segments for c in s} if c not in self.chunks}
        self.learn(set(chain.from_iterable(new.values())))
        of = self.words.__getitem__
        for c, words in new.items():
            self.chunks[c] = list(map(of, words)), list(accumulate(map(len, words)))
            self.held += len(c)
        return out

    def join(self, segment: str, chunks: list[str]) -> list[bytes | str]:
        """The ids of a whole segment from those of its chunks; at the joins, pre-tokens yet to be encoded."""
        out: list[bytes | str] = []
        start, entry, i = 0, 0, 0  # of chunk i; the pre-token of it from which it agrees
        while i < len(chunks):
            ids, ends = self.chunks[chunks[i]]
            if i + 1 == len(chunks):
                out += ids[entry:]
                break
            settled = len(chunks[i]) - bpe.LOOKAHEAD
            last = len(ends)
            while last > entry and ends[last - 1] > settled:
                last -= 1
            out += ids[entry:last]
            left = start + (ends[last - 1] if last else 0)  # the last settled boundary
            i, start = i + 1, start + len(chunks[i])
            found, reach = False, 16
            while not found:
                size = len(chunks[i])
                upto = min(size, reach)
                final = i + 1 == len(chunks) and upto == size
                new, theirs, at = self.bpe.pretokens(segment[left : start + upto]), self.chunks[chunks[i]][1], left - start
                for k, w in enumerate(new):
                    at += len(w)
                    if at >= 0 and (final or at + bpe.LOOKAHEAD <= upto) and (at == 0 or theirs[(j := bisect_left(theirs, at))] == at):
                        out += new[: k + 1]
                        entry, found = j + 1 if at else 0, True
                        break
                if not found and final:
                    return out + new
                if not found and upto == size:
                    i, start, reach = i + 1, start + size, 16
                else:
                    reach *= 2
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        joined = []
        for text, segments in zip(texts, self.prime(texts), strict=True):
            parts: list[bytes | str] = []
            for (segment, special), chunks in zip(self.bpe.segments(text), segments, strict=True):
                parts += self.join(segment, chunks)
                if special >= 0:
                    parts.append(special.to_bytes(4, "little"))
            joined.append(parts)
        self.learn({p for parts in joined for p in parts if type(p) is str})
        return [b"".join([self.words[p] if type(p) is str else p for p in parts]) for parts in joined]


@lru_cache(maxsize=1)
def held_codec(vocabulary: str) -> Codec:
    """The one of this Python worker, kept for its next tasks."""
    return Codec(vocabulary)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids (array of int), n_tokens: the token ids of every whole text.

    Special strings inside a text become their ids, as the tokenizers library
    does by default. A null text counts as empty and has no ids. Rows never
    depend on each other, ids may be null or repeat, and extra columns are
    ignored. No shuffle: chunks are shared among the documents of a task, and
    what it holds of them is bounded.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_codec(vocabulary)
        for batch in sliced(batches, most=1 << 20):
            ids = codec([t or "" for t in batch.column(1).to_pylist()])
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(np.diff(ends), pa.int64())],
                names=["doc_id", "ids", "n_tokens"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(uncollected(run), "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Adds text, as the tokenizers library's decode with skip_special_tokens=False gives it, to rows of doc_id, ids.

    Null ids count as none and give an empty text; so do null members.
    """
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.resolve(vocabulary)
        for batch in batches:
            texts = [table.decode([i for i in x or () if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return pick(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, keeping digests only.

    ids_sha256: hex of the ids as little-endian unsigned 32-bit integers.
    decoded_sha256: hex of the decoded text in UTF-8. Nulls as in encode().
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_codec(vocabulary)
        for batch in sliced(batches, most=1 << 20):
            ids = codec([t or "" for t in batch.column(1).to_pylist()])
            decoded = [codec.bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(uncollected(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
