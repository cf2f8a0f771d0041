"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.functions.workers import importable, one_machine

#: Stands for a null document id wherever ids are ordered or joined.
NULL_ID = -(2**63)
#: Python workers get their rows in batches of at most so many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 20_000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches of this session, which stays so, and lets Python workers import this package, on a cluster by sending it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return importable(spark)


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns with these types, whatever other columns there are.

    A name is matched exactly, else without regard to case; of several matches
    the first counts, and a column that is missing is null.
    """
    names = df.columns
    flat = df.toDF(*(f"_in{i}" for i in range(len(names))))
    out = []
    for name, kind in types.items():
        hits = [i for i, c in enumerate(names) if c == name] or [i for i, c in enumerate(names) if c.lower() == name.lower()]
        out.append((F.col(f"_in{hits[0]}") if hits else F.lit(None)).cast(kind).alias(name))
    return flat.select(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, below spark.checkpoint.dir.

    Where that is unset, a folder of this machine serves a local session; a
    cluster's executors could not read one another's, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'relspan-checkpoints')}"
    return f"{root.rstrip('/')}/relspan-{spark.sparkContext.applicationId}"


#: Paths of the tables that stored() wrote and forget() has not deleted.
_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """The tables there are."""
    return list(_written)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables, once nothing reads them any more."""
    for path in paths:
        if path in _written:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _written.remove(path)


def settled(make: Callable[[], DataFrame], name: str, spark: SparkSession) -> DataFrame:
    """Stores what make() gives, and deletes the tables that it stored on its way."""
    before = tables()
    out = stored(make(), name)
    drop(spark, [p for p in tables()[:-1] if p not in before])
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that stored() gave."""
    files = df.inputFiles()[:1]
    drop(df.sparkSession, [p for p in _written if files and f"/{p.rsplit('/', 1)[1]}/" in files[0]])


def tasks(spark: SparkSession, df: DataFrame | None = None) -> int:
    """How many tasks a shuffle of df's rows is dealt to."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, df.rdd.getNumPartitions()) if df is not None else n


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes of the column; a longer row comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= most:
            yield batch
            continue
        start, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(col).to_pylist()):
            if i > start and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        yield batch.slice(start)


def trim() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task, and the next ones need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def uncollected(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Runs without cyclic garbage collection: lists of millions of strings are no cycles, and walking them is slow."""

    def quiet(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            trim()

    return quiet


def filtered(df: DataFrame, column: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of df for whose values of the column keep() is true, with all columns as they are, whatever their names."""
    prepare(df.sparkSession)
    names = df.columns
    at = ([i for i, c in enumerate(names) if c == column] or [i for i, c in enumerate(names) if c.lower() == column.lower()])[0]
    flat = df.toDF(*(f"_in{i}" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return flat.mapInArrow(uncollected(run), flat.schema).toDF(*names)
