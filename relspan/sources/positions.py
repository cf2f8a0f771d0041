"""Where rows stand in their files, so that "the first row" means the same however files are split."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT = "__at"


def file_order(rows: DataFrame) -> tuple[DataFrame, Column]:
    """rows, still whole, and an order of them: by file, by where in the file a split began, by the row within it.

    Splits of other sizes give other values and the same order. Rows that were
    not just read from files have no file; they are in the order of their
    partitions, which a shuffle does not keep.
    """
    within = F.monotonically_increasing_id().alias("row")
    try:
        placed = rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), within).alias(AT))
    except AnalysisException:
        placed = rows.select("*", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), within).alias(AT))
    return placed, F.col(AT)


def first_rows(rows: DataFrame, key: str, values: list[str], order: list[str] | None = None) -> DataFrame:
    """key, values: of each key the row that comes first, by the columns in order or else in the files; its nulls count.

    A key column that is among the values comes once. Keys may be null: those
    rows are one group. One aggregate, with a partial one before the shuffle, so
    a key that many rows share is no burden.
    """
    wanted = list(dict.fromkeys([key, *values]))
    if order:
        placed, at = rows, F.struct(*order)
    else:
        placed, at = file_order(rows.select(*wanted))
    picked = placed.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(wanted))), at).alias("__row"))
    return picked.select("__key", *(F.col(f"__row.c{i}").alias(c) for i, c in enumerate(wanted)))
