"""Facts about a schema as rows: coverage, allocation to shards, filters, tags and packing under a token budget.

A fact is a row of fact_id and fact (its text); more columns are named where
they are read. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspan.plans.catalog import Catalog, ForeignKey

# Fixed values.
ENUM_MARKERS = ["allowed values", "can be one of", "one of:", "enum"]
DEFINITION_MARKERS = ["defined as", "stands for", "is a measure"]
DOMAIN_MARKERS = ["domain pattern", "standard schema", "common tables", "typical entities", "industry standard"]
ARCHITECTURE_MARKERS = ["oltp", "olap", "star schema", "snowflake", "ledger", "audit", "temporal", "event", "operational scheduling"]
HINT_MARKERS = ["constraint", "threshold", "budget", "pricing", "rate", "discount", "capacity", "limit", "cap"]
FACT_OVERHEAD = 8


def _any(text: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def normal(c: Column) -> Column:
    """Lower case, blanks joined and trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def token_estimate(c: Column, chars: float = 4.0) -> Column:
    """Tokens that a fact's line takes in a prompt: characters by chars, plus a fixed overhead."""
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / F.lit(chars)).cast("int") + F.lit(FACT_OVERHEAD)


def tagged(facts: DataFrame) -> DataFrame:
    """Column tags (array) with METADATA added where is_external, STRUCTURAL and LOGICAL where the text lists allowed values; no tag twice."""
    lists, tags = _any(F.lower(F.coalesce("fact", F.lit(""))), ENUM_MARKERS), F.coalesce("tags", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    more = F.concat(F.when(F.col("is_external"), F.array(F.lit("METADATA"))).otherwise(none), F.when(lists, F.array(F.lit("STRUCTURAL"), F.lit("LOGICAL"))).otherwise(none))
    return facts.withColumn("tags", F.array_union(tags, more))


def kind(text: Column, architecture: list[str] = ARCHITECTURE_MARKERS) -> Column:
    """What an external fact is by its words: the first list that has one of them; null if none has. architecture: that list's words."""
    t = normal(text)
    found = F.when(_any(t, DEFINITION_MARKERS), "TECHNICAL_DEFINITION")
    if architecture:
        found = found.when(_any(t, architecture), "ARCHITECTURE_PATTERN")
    return found.when(_any(t, DOMAIN_MARKERS), "DOMAIN_PATTERN").when(_any(t, HINT_MARKERS), "DOMAIN_CONSTRAINT_HINT")


def filter_external(external: DataFrame, original: DataFrame, architecture: list[str] = ARCHITECTURE_MARKERS) -> DataFrame:
    """The external facts (fact_id, fact, refs array, kind) with a column rejection, null where accepted, and kind filled in where null.

    In order of rejection: DUPLICATE (a lesser fact_id has the same normalised
    text), SELF_REFERENCE, INVALID_REFERENCE (no ref is the fact_id of an original
    row). The first of a text counts as seen even if it is itself rejected. Texts
    are grouped by hash with their least id first, so a text that many rows share
    is not collected.
    """
    rows = external.withColumn("_h", F.sha2(normal(F.col("fact")), 256))
    firsts = rows.groupBy("_h").agg(F.min("fact_id").alias("_first"))
    refs = rows.select("fact_id", F.explode("refs").alias("_ref")).distinct()
    known = original.select(F.col("fact_id").alias("_ref")).distinct()
    backed = refs.join(known, "_ref", "left_semi").select("fact_id").distinct().withColumn("_backed", F.lit(True))
    out = rows.join(firsts, "_h").join(backed, "fact_id", "left")
    why = (
        F.when(F.col("fact_id") > F.col("_first"), "DUPLICATE")
        .when(F.coalesce(F.array_contains("refs", F.col("fact_id")), F.lit(False)), "SELF_REFERENCE")
        .when(F.col("_backed").isNull(), "INVALID_REFERENCE")
    )
    return out.withColumn("rejection", why).withColumn("kind", F.coalesce("kind", kind(F.col("fact"), architecture))).drop("_h", "_first", "_backed")


def uncovered(required: DataFrame, *cited: DataFrame) -> DataFrame:
    """fact_id of required rows that none of the others cites."""
    out = required.select("fact_id").distinct()
    for c in cited:
        out = out.join(c.select("fact_id").where("fact_id IS NOT NULL").distinct(), "fact_id", "left_anti")
    return out


def registry(provenance: DataFrame) -> DataFrame:
    """table, facts (sorted ids): from rows of table and fact_id."""
    return provenance.groupBy("table").agg(F.sort_array(F.collect_set("fact_id")).alias("facts"))


def registry_renamed(provenance: DataFrame, old: str, new: str) -> DataFrame:
    """Facts of a table under another name; merging is renaming to a table that exists."""
    return provenance.withColumn("table", F.when(F.col("table") == old, new).otherwise(F.col("table"))).distinct()


def registry_without(provenance: DataFrame, tables: list[str]) -> DataFrame:
    """What is left of provenance when the tables are deleted, in any case."""
    return provenance.where(~F.upper(F.col("table")).isin([t.upper() for t in tables]))


def facts_of(provenance: DataFrame, tables: list[str]) -> DataFrame:
    """fact_id: the facts that any of the tables comes from, once each."""
    return provenance.where(F.upper(F.col("table")).isin([t.upper() for t in tables])).select("fact_id").distinct()


def allocated(mentions: DataFrame, shards: DataFrame, facts: DataFrame) -> DataFrame:
    """fact_id, shard of every fact: shards that hold a table it mentions; a fact that mentions none goes to the least shard.

    mentions: fact_id, table. shards: table, shard. A fact that mentions tables of
    several shards is in each of them.
    """
    owned = mentions.join(shards, "table").select("fact_id", "shard").distinct()
    least = shards.agg(F.min("shard").alias("shard"))
    orphans = facts.select("fact_id").distinct().join(owned, "fact_id", "left_anti").crossJoin(F.broadcast(least))
    return owned.unionByName(orphans.select("fact_id", "shard"))


def stubs(links: DataFrame, shards: DataFrame) -> DataFrame:
    """shard, table: parents outside a shard that its tables refer to, so that its keys have a table. links: table, parent. shards: table, shard."""
    needed = links.join(shards, "table").select("shard", F.col("parent").alias("table")).distinct()
    return needed.join(shards, ["shard", "table"], "left_anti")


def best_drafts(drafts: DataFrame, unit: str) -> DataFrame:
    """One row for each unit: no rejected draft if there is another, of these the one with fewest findings, of these the latest iteration.

    drafts: unit, iteration, rejected (boolean), findings. One pass that combines before the shuffle.
    """
    order = F.struct(F.coalesce("rejected", F.lit(False)), F.coalesce("findings", F.lit(0)), -F.col("iteration"))
    best = drafts.groupBy(unit).agg(F.min_by(F.struct(*(c for c in drafts.columns if c != unit)), order).alias("d"))
    return best.select(unit, "d.*")


def kept_items(items: DataFrame, fixed: DataFrame) -> DataFrame:
    """Items (item_id, refs array) that cite no fixed fact, one for each set of refs (the least item_id). fixed: fact_id."""
    hit = items.select("item_id", F.explode("refs").alias("fact_id")).join(fixed.select("fact_id").distinct(), "fact_id", "left_semi").select("item_id").distinct()
    left = items.join(hit, "item_id", "left_anti").withColumn("_set", F.sort_array(F.array_distinct("refs")))
    firsts = left.groupBy("_set").agg(F.min("item_id").alias("item_id"))
    return left.join(firsts.select("item_id"), "item_id", "left_semi").drop("_set")


def file_faults(rows: DataFrame, low: int, high: int, text: str = "text", key: str = "case_id") -> DataFrame:
    """fault, value, n across files: ids outside [low, high], ids used twice, texts used twice (by SHA-256; null texts aside)."""
    ids = rows.where(F.col(key).isNotNull())
    outside = ids.where(~F.col(key).between(low, high)).groupBy(key).agg(F.count("*").alias("n")).select(F.lit("outside").alias("fault"), F.col(key).cast("string").alias("value"), "n")
    twice = ids.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated id"), F.col(key).cast("string"), "n")
    texts = rows.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated text"), "value", "n")
    return outside.union(twice).union(texts)


def column_map(c: Catalog, columns: dict[tuple[str, str], set[int]], tables: dict[str, set[int]], links: dict[ForeignKey, set[int]], mentioned: dict[int, set[str]]) -> dict[int, list[tuple[str, str]]]:
    """The columns that each fact touches, sorted.

    Facts of columns touch these; facts of a table that no column of it has touch
    its key; facts of links touch both ends. A fact that is in none of them touches
    what it mentions: one table's key, or the ends of links on the shortest paths
    from the least table to the others.
    """
    out: dict[int, set[tuple[str, str]]] = {}
    for at, facts in columns.items():
        for f in facts:
            out.setdefault(f, set()).add(at)
    for name, facts in tables.items():
        own = set().union(*(columns.get((name, x.name), set()) for x in c.tables[name].columns))
        for f in facts - own:
            out.setdefault(f, set()).update((name, k) for k in c.tables[name].key)
    for link, facts in links.items():
        for f in facts:
            out.setdefault(f, set()).update(_ends(c, link))
    for f, names in mentioned.items():
        names = sorted(n for n in names if n in c.tables)
        if f in out or not names:
            continue
        if len(names) == 1:
            found = {(names[0], k) for k in c.tables[names[0]].key}
        else:
            found = set().union(*(_ends(c, x) for n in names[1:] for x in _path(c, names[0], n)))
        if found:
            out[f] = found
    return {f: sorted(at) for f, at in out.items()}


def _ends(c: Catalog, link: ForeignKey) -> set[tuple[str, str]]:
    parent = c.tables.get(link.parent)
    return {(link.table, link.column), (link.parent, parent.key[0])} if parent and parent.key else set()


def _path(c: Catalog, a: str, b: str) -> list[ForeignKey]:
    """Links, taken either way, on a shortest path between two tables; none if there is none."""
    came: dict[str, tuple[str, ForeignKey] | None] = {a: None}
    edge = [a]
    while edge and b not in came:
        step = []
        for t in edge:
            for x in c.links:
                other = x.parent if x.table == t else x.table if x.parent == t else None
                if other is not None and other not in came:
                    came[other] = (t, x)
                    step.append(other)
        edge = step
    out = []
    while b in came and came[b] is not None:
        b, x = came[b]
        out.append(x)
    return out
