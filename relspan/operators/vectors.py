"""Cosines over embeddings: a stated set of query rows against all rows, in blocks, and moments of similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def blocks(rows: DataFrame, key: str, vector: str, shard: str, size: int = BLOCK) -> DataFrame:
    """block, keys, shards, vectors: rows dealt by the hash of their unique key into blocks of about that size."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"), F.struct(F.col(key).cast("long").alias("k"), F.col(shard).cast("string").alias("s"), F.col(vector).cast("array<double>").alias("v")).alias("r"))
    packed = dealt.groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return packed.select("block", F.col("r.k").alias("keys"), F.col("r.s").alias("shards"), F.col("r.v").alias("vectors"))


def _unit(v) -> np.ndarray:
    m = np.stack([np.asarray(x, dtype=np.float64) for x in v])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def pairs(queries: DataFrame, rows: DataFrame, key: str, vector: str, shard: str, least: float) -> DataFrame:
    """query, row, cosine of every query and every row of another shard with a cosine of at least that.

    A null vector or shard meets nothing; a zero vector has cosine 0 to all. Every
    block of rows meets every block of queries once; one pair of blocks is a task's
    unit, so memory is that of two blocks and the products between them.
    """
    a = blocks(queries.where(F.col(shard).isNotNull()), key, vector, shard).toDF("qb", "qk", "qs", "qv")
    b = blocks(rows.where(F.col(shard).isNotNull()), key, vector, shard)
    n = max(1, a.count())
    met = b.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(a, "qb").select("keys", "shards", "vectors", "qk", "qs", "qv")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                score = _unit(r.qv) @ _unit(r.vectors).T
                other = np.asarray(r.qs, dtype=object)[:, None] != np.asarray(r.shards, dtype=object)[None, :]
                i, j = np.nonzero((score >= least) & other)
                yield pd.DataFrame({"query": np.asarray(r.qk)[i], "row": np.asarray(r.keys)[j], "cosine": score[i, j]})

    return met.mapInPandas(run, "query long, row long, cosine double")


def pair_moments(rows: DataFrame, vector: str, shard: str) -> DataFrame:
    """shard, n, mean_cosine: over all ordered pairs of different rows of a shard, from sums of unit vectors alone.

    The cosines of all pairs add up to |sum of unit vectors|^2, so no pair is ever
    made: n vectors give one sum of each coordinate. A shard of one row has no pair
    and a null mean; null vectors are left out, zero vectors have cosine 0 to all.
    """
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(shard).alias("shard"), v.alias("v"), norm.alias("norm"))
    parts = rows.select("shard", (F.col("norm") > 0).cast("long").alias("whole"), F.posexplode("v").alias("i", "x"), "norm")
    sums = parts.groupBy("shard", "i").agg(F.sum(F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0)).alias("s"), F.count("*").alias("n"), F.sum("whole").alias("whole"))
    total = sums.groupBy("shard").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"), F.max("whole").alias("whole"))
    return total.select("shard", "n", F.when(F.col("n") > 1, (F.col("q") - F.col("whole")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def adjacency(a: Column, b: Column) -> Column:
    """1 / (1 + gap) of two places in a text; 0.5 where one is unknown (null or below 0)."""
    known = (a >= 0) & (b >= 0)
    return F.when(known, F.lit(1.0) / (F.lit(1.0) + F.abs(a - b))).otherwise(0.5)


def cross_references(facts: DataFrame) -> DataFrame:
    """a, b: segments a < b of which one has a fact that refers to a fact of the other. facts: segment, fact_id, refs (array)."""
    owners = facts.select(F.col("fact_id").alias("ref"), F.col("segment").alias("to")).distinct()
    met = facts.select("segment", F.explode("refs").alias("ref")).distinct().join(owners, "ref").where("segment <> to")
    return met.select(F.least("segment", "to").alias("a"), F.greatest("segment", "to").alias("b")).distinct()
