"""Connected components of a graph given by its edges, by rounds of joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm._common import forget, prepare, stored

#: Links that a task joins on its own, at most: 16 MB of them.
HELD = 1 << 20


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of links (a, b) but the least of each component, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        apart = p != q
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(p[apart], q[apart]), np.minimum(p[apart], q[apart]))
        while not np.array_equal(up := root[root], root):
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as links to the least node that they reach."""
    held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if held:
        v, u = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], names=["v", "u"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node that can be reached.

    First, tasks of HELD links at most join their own and keep a link for each
    node; if one task held them all, that is the result. Else two steps
    alternate until nothing changes. Large star: every node links
    its greater neighbours to the least node it knows. Small star: every node
    links its lesser neighbours to the least of them. Both keep components and
    need about the logarithm of a component's width in rounds. Each round is
    written to the shared folder, which cuts lineage. Least neighbours are
    aggregated before the shuffle and joined back, so no node's neighbours are
    gathered in one place. Null ends and self-links are ignored.
    """
    prepare(edges.sparkSession)
    every = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    parts = math.ceil(every.count() / HELD)
    dealt = every.repartition(2 * parts, "v") if parts > 1 else every.coalesce(1)
    now = stored(dealt.mapInArrow(_local, "v long, u long").distinct(), "forest")
    forget(every)
    mark = _mark(now) if parts > 1 else (0,)
    while mark[0]:
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("v").alias("x")).agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, F.col("v") == F.col("x")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = stored(large, "large")
        least = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        joined = large.join(least, F.col("v") == F.col("x"))
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(least.select(F.col("x").alias("v"), F.col("m").alias("u"))).distinct()
        new = stored(small, "small")
        new_mark = _mark(new)
        forget(large)
        forget(now)
        now = new
        if new_mark == mark:
            break
        mark = new_mark
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """How many edges there are, and sums that two different sets hardly share."""
    r = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(r)
