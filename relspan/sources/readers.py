"""Sources and sinks beside Parquet: delimited text, JSON lines, schema dictionaries, specifications, stage artifacts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.plans.catalog import Catalog, Column, ForeignKey, Table

BAD = "_bad"


def pipe_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of text fields that each end in a pipe. A missing or empty field is the empty string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_end"]])
    return spark.read.schema(schema).csv(path, sep="|", quote="").drop("_end").fillna("")


def tab_table(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    r"""Tab-separated text with a header line, gzipped or not; `\N` becomes the empty string. first: that many rows of it."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", nullValue="\\N", emptyValue="")
    rows = rows.fillna("")
    return rows if first is None else rows.limit(first)


def numeric_columns(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The columns as doubles; what is no number is null. Others are pruned from the scan."""
    return rows.select(*(F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in columns))


def cases(spark: SparkSession, path: str, schema: str, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (rows, bad): rows that parse, and the lines that don't. Blank lines are in neither.

    A null, empty or missing field of a good line is null. first limits the rows
    only, in the order of the file. Both sides parse the text themselves, so that
    neither depends on which columns the other reads.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    declared = T._parse_datatype_string(schema)
    full = T.StructType([*declared.fields, T.StructField(BAD, T.StringType())])
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    good = parsed.where(F.col(f"r.{BAD}").isNull()).select(*(F.col(f"r.`{c}`").alias(c) for c in declared.names))
    bad = parsed.where(F.col(f"r.{BAD}").isNotNull()).select(F.col("value").alias("line"))
    return (good if first is None else good.limit(first)), bad


def schema_of(declared: dict) -> Catalog:
    """A catalog from {table: {"attributes": [...], "primary_key": [...], "foreign_keys": {column: table}}}; attributes are VARCHAR.

    Names are kept as they stand; catalog.errors() tells what does not fit. A key
    or foreign key column that is no attribute becomes one.
    """
    tables, links = {}, []
    for name, of in declared.items():
        key, foreign = tuple(of.get("primary_key") or ()), of.get("foreign_keys") or {}
        names = dict.fromkeys([*(of.get("attributes") or ()), *key, *foreign])
        tables[name] = Table(name, tuple(Column(c, "VARCHAR", c not in key) for c in names), key)
        links += [ForeignKey(name, c, parent) for c, parent in foreign.items()]
    return Catalog(tables, links)


def specification(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row for each whole text file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_mined(found: DataFrame, path: str) -> None:
    """Mined families (column, family and the rest) as JSON lines, one for each column."""
    found.write.mode("overwrite").json(path)


def stage(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], resume: bool = True) -> DataFrame:
    """What make() returns, by way of a table in the folder; with resume, a complete table there is read and make() not called.

    Complete means that the writer left its marker file, so a table that a lost
    driver cut short is made again.
    """
    path = f"{folder}/{name}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    if not (resume and done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report_line(values: dict) -> str:
    """One line of JSON with sorted keys, so that equal reports are equal texts."""
    return json.dumps(values, sort_keys=True, ensure_ascii=False)
