"""Constraints over a stream of rows: the verdicts of each micro-batch, kept by batch.

An extension: the constraints themselves know no time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relspan.operators import satisfy


def start(stream: DataFrame, constraints: dict[str, dict], folder: str, once: bool = False) -> StreamingQuery:
    """Writes the verdicts of each micro-batch under folder/verdicts/batch=N; progress is kept in folder/progress.

    A batch that is run again after a loss overwrites its own rows, so none counts
    twice. once: takes what is there and ends.
    """

    def one(batch: DataFrame, n: int) -> None:
        satisfy.verdicts(batch, constraints).write.mode("overwrite").parquet(f"{folder}/verdicts/batch={n}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals(spark, folder: str) -> DataFrame:
    """constraint, satisfied, violated, vacuous, unevaluable, applicable, rate over all batches so far."""
    counts = ["satisfied", "violated", "vacuous", "unevaluable", "applicable"]
    out = spark.read.parquet(f"{folder}/verdicts").groupBy("constraint").agg(*(F.sum(c).alias(c) for c in counts))
    return out.withColumn("rate", F.try_divide("satisfied", "applicable"))
