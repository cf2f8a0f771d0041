"""Token counts of whole texts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from relspan.llm import bpe
from relspan.llm._common import pick, prepare, sliced, uncollected

#: Counts of so many distinct pre-tokens are held by a task; then it starts anew.
HELD = 300_000


class Counter:
    """Counts tokens; each distinct pre-token is merged once while it is held."""

    def __init__(self, vocabulary: str, held: int = HELD):
        self.bpe, self.held, self.known = bpe.resolve(vocabulary), held, {}

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.held:
            self.known.clear()
        words, extra = [], []
        for text in texts:
            parts = self.bpe.segments(text)
            extra.append(len(parts) - 1)
            words.append(self.bpe.pretokens(parts[0][0]) if len(parts) == 1 else [w for p, _ in parts for w in self.bpe.pretokens(p)])
        new = [w for w in set(chain.from_iterable(words)) if w not in self.known]
        if new:
            _, counts = self.bpe.merge([w.encode("utf-8") for w in new])
            self.known.update(zip(new, counts.tolist(), strict=True))
        of = self.known.__getitem__
        return [n + sum(map(of, w)) for n, w in zip(extra, words, strict=True)]


@lru_cache(maxsize=1)
def counter(vocabulary: str, held: int) -> Counter:
    """The one of this Python worker, kept for its next tasks."""
    return Counter(vocabulary, held)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, held: int = HELD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit): one row for each row of docs.

    vocabulary: a path of a byte-level BPE file in the tokenizers library's JSON
    form, or the name of one of the public files. Special strings inside a text
    are single tokens, as that library counts them by default.
    A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat;
    rows never depend on each other. Extra columns are ignored.
    Rows stay in their partitions: no shuffle, and a lost task is redone alone.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, held)
        for batch in sliced(batches, most=4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(uncollected(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
