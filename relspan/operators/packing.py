"""Greedy packing under a budget, without a pass in order: every place knows where the next chunk would start, and doubled jumps find the starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspan.functions.running import running_sums
from relspan.operators.facts import token_estimate
from relspan.sources.shared import stored


def _next_starts(units: DataFrame, limit: int) -> DataFrame:
    """doc, at, to: for each unit (doc, at, segment, weight, upto) the first one of its segment that no chunk from it can hold, or null.

    That is the unit whose tokens the place upto - weight + limit falls in.
    Places are cut into blocks of `limit`; a unit is there in every block it
    reaches, so a block holds at most as many units as it has places, and the
    last unit that begins up to a place in its block is the one.
    """
    begin = F.col("upto") - F.col("weight")
    block = lambda c: F.floor(c / F.lit(limit))
    none = F.lit(None).cast("struct<at: bigint, segment: bigint>")
    covers = units.select("doc", F.explode(F.sequence(block(begin), block(F.col("upto") - 1))).alias("block"), begin.alias("place"), F.lit(0).alias("kind"), F.struct("at", "segment").alias("unit"), none.alias("asks"))
    asks = units.select("doc", block(begin + limit).alias("block"), (begin + limit).alias("place"), F.lit(1).alias("kind"), none.alias("unit"), F.struct("at", "segment").alias("asks"))
    in_block = Window.partitionBy("doc", "block").orderBy("place", "kind")
    met = covers.union(asks).withColumn("hit", F.last("unit", True).over(in_block)).where("kind = 1")
    same = F.col("hit.segment") == F.col("asks.segment")
    ends = units.groupBy(F.col("doc").alias("d"), F.col("segment").alias("s")).agg(F.max("upto").alias("end"), F.max("at").alias("last"))
    at = F.col("asks.at")
    after = F.when(F.col("hit.at") != at, F.col("hit.at")).when(at < F.col("last"), at + 1)  # a unit over the limit holds its own place
    both = met.join(ends, F.col("doc").eqNullSafe(F.col("d")) & (F.col("asks.segment") == F.col("s")))
    return both.select("doc", at.alias("at"), F.when(F.col("place") < F.col("end"), after).alias("to"))


def _starts(units: DataFrame, limit: int) -> DataFrame:
    """doc, at of the units that begin a chunk: those reached from the first of a segment by jumps of 1, 2, 4 and so on. A round of joins for each doubling."""
    reached = stored(units.where("opens").select("doc", "at"), "starts")
    jumps = stored(_next_starts(units, limit).where("to is not null"), "jumps")
    while True:
        j = jumps.select(F.col("doc").alias("jd"), F.col("at").alias("ja"), "to")
        found = reached.join(j, F.col("doc").eqNullSafe(F.col("jd")) & (F.col("at") == F.col("ja"))).select("doc", F.col("to").alias("at"))
        new = stored(found, "found")
        if new.isEmpty():
            return reached
        reached = stored(reached.union(new), "starts")
        further = jumps.select("doc", "at", F.col("to").alias("mid")).join(j, F.col("doc").eqNullSafe(F.col("jd")) & (F.col("mid") == F.col("ja"))).select("doc", "at", "to")
        jumps = stored(further, "jumps")


def packed(facts: DataFrame, limit: int, doc: str = "doc_id", chars: float = 4.0) -> DataFrame:
    """The facts (doc, start, end, fact_id, fact, and more) with tokens and chunk, from 0 in each document, in order of start, end and fact_id.

    Facts of one span stay together unless the span alone is over the limit;
    then it has chunks of its own and is cut between facts. A fact over the
    limit is a chunk of its own. Facts of a
    document that repeat start, end and fact_id share a chunk's place: they are
    told apart by their text, equal ones by nothing, and stay together. No facts
    give no rows. A document is cut over as many tasks as it has ranges.
    """
    sized = facts.withColumn("tokens", token_estimate(F.col("fact"), chars))
    key = F.xxhash64("fact").alias("__text")
    rows = sized.select("*", F.col(doc).alias("__doc"), key)
    each = rows.groupBy(F.col("__doc").alias("doc"), "start", "end", "fact_id", "__text").agg(F.sum("tokens").alias("weight"))
    spans = each.groupBy("doc", "start", "end").agg(F.sum("weight").alias("whole"), F.min(F.struct("fact_id", "__text")).alias("lead"))
    on = [F.col("doc").eqNullSafe(F.col("sd")), F.col("start").eqNullSafe(F.col("ss")), F.col("end").eqNullSafe(F.col("se"))]
    named = spans.select(F.col("doc").alias("sd"), F.col("start").alias("ss"), F.col("end").alias("se"), (F.col("whole") > limit).alias("big"), "whole", "lead")
    both = each.join(named, on).select("doc", "start", "end", "fact_id", "__text", "weight", "big", "lead")
    # a unit is a span within the limit, else a fact of one beyond it
    alone = both.where("big").select("doc", "start", "end", "fact_id", "__text", "weight", "big", F.struct("fact_id", "__text").eqNullSafe(F.col("lead")).alias("leads"))
    together = named.where("not big").select(F.col("sd").alias("doc"), F.col("ss").alias("start"), F.col("se").alias("end"), F.lit(None).cast(both.schema["fact_id"].dataType).alias("fact_id"), F.lit(None).cast("long").alias("__text"), F.col("whole").alias("weight"), "big", F.lit(False).alias("leads"))
    order = ["start", "end", "fact_id", "__text"]
    units = running_sums(alone.unionByName(together), ["doc"], order, {"at": F.lit(1).cast("long"), "upto": F.col("weight"), "bigs": F.col("leads").cast("long")})
    units = units.withColumn("segment", 2 * F.col("bigs") - F.col("big").cast("long"))
    first = units.groupBy(F.col("doc").alias("fd"), F.col("segment").alias("fs")).agg(F.min("at").alias("first"))
    units = units.join(first, F.col("doc").eqNullSafe(F.col("fd")) & (F.col("segment") == F.col("fs"))).withColumn("opens", F.col("at") == F.col("first")).drop("fd", "fs", "first")
    units = stored(units, "units")
    starts = _starts(units, limit).select(F.col("doc").alias("d"), F.col("at").alias("a"), F.lit(1).cast("long").alias("one"))
    marked = units.join(starts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("at") == F.col("a")), "left").select("doc", "start", "end", "fact_id", "__text", "big", "at", F.coalesce("one", F.lit(0)).alias("one"))
    placed = running_sums(marked, ["doc"], ["at"], {"chunks": F.col("one")}).select(F.col("doc").alias("pd"), F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("fact_id").alias("pf"), F.col("__text").alias("pt"), F.col("big").alias("pb"), (F.col("chunks") - 1).cast("int").alias("chunk"))
    span = F.col("__doc").eqNullSafe(F.col("pd")) & F.col("start").eqNullSafe(F.col("ps")) & F.col("end").eqNullSafe(F.col("pe"))
    whole = rows.join(placed.where("not pb"), span)
    cut = rows.join(placed.where("pb"), span & F.col("fact_id").eqNullSafe(F.col("pf")) & F.col("__text").eqNullSafe(F.col("pt")))
    columns = [*facts.columns, "tokens", "chunk"]
    return whole.select(*columns).union(cut.select(*columns))
