"""MinHash near-duplicates: HyperMinHash registers, banded and compressed, estimate before whole sets decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm import similar
from relspan.llm._common import NULL_ID, forget, pick, prepare, settled, stored, uncollected

#: Registers of a sketch; a register holds a count of leading zeros and so many bits of the mantissa behind them.
REGISTERS, MANTISSA = 512, 10
#: Bands of so many registers: sets of similarity 0.8 meet in none of 64 with a chance of 4e-9.
BANDS, ROWS = 64, 6
#: Pairs whose estimated similarity is below this are not verified. At 0.8 the estimate deviates by 0.027, so by seven deviations.
FLOOR = 0.6
#: Bits of parities in a sketch.
PARITY = 512
_LOW = np.uint64((1 << 48) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (leading zeros << MANTISSA | mantissa) of a set that is not empty.

    A hash chooses a register by 9 bits; the least of the 48 bits behind them
    stays, as its count of leading zeros and the bits after its first one.
    Registers that no element chose are filled from further rounds of hashing,
    the first one with an element counting, so small sets agree register by
    register as often as large ones: with the chance of their similarity.
    """
    best = np.full(REGISTERS, ~np.uint64(0))
    start = 0
    while True:
        rounds = max(1, min(-(-9 * REGISTERS // len(hashes)), 1 << 13))
        seed = np.arange(start, start + rounds, dtype=np.uint64)
        x = _mixed(hashes[None, :] ^ _mixed(seed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[:, None])
        value = (seed[:, None] << np.uint64(48)) | ((x >> np.uint64(7)) & _LOW)
        np.minimum.at(best, (x >> np.uint64(55)).reshape(-1).astype(np.intp), value.reshape(-1))
        start += rounds
        if start >= 1 << 16 or (best != ~np.uint64(0)).all():
            break
    value = best & _LOW
    zeros = 48 - np.frexp(value.astype(np.float64))[1]
    mantissa = ((value << (zeros + 1).astype(np.uint64)) & _LOW) >> np.uint64(48 - MANTISSA)
    return ((zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)).astype(np.uint16)


def bands(sketches: np.ndarray) -> np.ndarray:
    """A key for each band of each row of registers; sets whose registers of a band are equal have its key in common."""
    cut = sketches[:, : BANDS * ROWS].reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2])
    for i in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return key.view(np.int64)


def compressed(sketches: np.ndarray) -> np.ndarray:
    """One bit of each register, 8 words a set."""
    return np.packbits((sketches & 1).astype(bool), axis=1, bitorder="little").view("<u8")


def estimated(differing: np.ndarray) -> np.ndarray:
    """Similarity from differing bits of compressed registers: unequal registers agree in half the cases, which is corrected for."""
    return 1 - 2 * differing / REGISTERS


def _differ(percent: int) -> Callable:
    """Reads sketches of compressed registers and parities."""

    def differ(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
        """Differing bits of compressed registers, and whether the similarity estimated from them is FLOOR or more and parities let it be."""
        words = [np.bitwise_count(left["sketch"][..., w] ^ right["sketch"][..., w]).astype(np.int32) for w in range((REGISTERS + PARITY) // 64)]
        differing = sum(words[: REGISTERS // 64])
        return differing, (estimated(differing) >= FLOOR) & similar.able(sum(words[REGISTERS // 64 :]), left["n"] + right["n"], percent)

    return differ


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    A text, A-Z in lower case, gives words [^\\x20\\x09-\\x0D]+ and the set of
    its distinct shingles of `width` words; with fewer words, one of all. Sets
    link where 100 * intersection >= percent * union; component_id is the least
    doc_id that links reach, kept says whether it is the document's own. Null,
    empty and wordless texts have no shingles and link with nothing. A null
    doc_id counts as the least: it stays null, so does its component's id, and
    it is kept. Rows that repeat are rows of their own, and link. No rows give
    no rows.

    Equal sets are merged before anything is compared. Bands of registers bring
    sets together; estimates from compressed registers, corrected for chance
    agreement, order the pairs and drop those far below, parities those that
    cannot be similar; whole sets, made again from the texts, decide. See similar.components().
    """
    spark = prepare(docs.sparkSession)

    def hashes(text: str | None) -> np.ndarray:
        return similar.shingle_hashes(text, width)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashes(t) for t in batch.column(1).to_pylist()]
            sketches = np.stack([registers(s) if len(s) else np.zeros(REGISTERS, np.uint16) for s in sets]) if sets else np.zeros((0, REGISTERS), np.uint16)
            keys = bands(sketches)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
            columns = [pa.array([similar.set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), lists, pa.array([np.concatenate([x, similar.parities(s, PARITY)]).tobytes() for x, s in zip(compressed(sketches), sets, strict=True)], pa.binary()), pa.array([similar.wide_parities(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "fp", "n", "bands", "sketch", "wide"])

    def linked() -> DataFrame:
        marked = stored(pick(docs, doc_id="long", text="string").mapInArrow(uncollected(mark), "doc_id long, fp long, n int, bands array<long>, sketch binary, wide binary"), "sketches")
        distinct = stored(similar.least_ids(marked.where("n > 0")), "distinct")
        sizes = stored(marked.select("doc_id", "fp", "n"), "sizes")
        forget(marked)
        buckets = distinct.select(F.explode("bands").alias("bucket"), "fp")
        found = similar.components(buckets, distinct, similar.sets_again(docs, distinct, hashes), percent, (REGISTERS + PARITY) // 64, _differ(percent), keys="bands")
        full = similar.named(sizes.where("n > 0"), distinct, found).select("doc_id", "n", "component")
        return full.union(sizes.where("n = 0").select("doc_id", "n", F.coalesce("doc_id", F.lit(NULL_ID))))

    out = settled(linked, "linked", spark)
    own = F.coalesce("doc_id", F.lit(NULL_ID))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.expr(f"nullif(component, {NULL_ID})").alias("component_id"), (F.col("component") == own).alias("kept"))
