"""Text matching: hashes, mentions, sliding spans and TF-IDF."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.functions.workers import importable

_terms = re.compile("[a-z][a-z0-9]*").findall
_blanks = re.compile(r"[ \t\n\x0b\f\r]+").split


def source_hash(c: Column) -> Column:
    """The first 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def repeated_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """hash, n: of texts that occur more than once."""
    return docs.groupBy(F.sha2(F.col(text), 256).alias("hash")).agg(F.count("*").alias("n")).where("n > 1")


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9]*"), F.lit(0))


def openings(docs: DataFrame, words: int = 6, text: str = "text") -> DataFrame:
    """opening, n: of the first words that several texts share."""
    first = F.array_join(F.slice(F.split(F.trim(F.lower(F.col(text))), r"\s+"), 1, words), " ")
    return docs.select(first.alias("opening")).groupBy("opening").agg(F.count("*").alias("n")).where("n > 1")


def spans(rows: DataFrame, key: list[str], text: str, sizes: tuple[int, ...] = (12, 24, 40, 64, 96), least: int = 20) -> DataFrame:
    """Windows of words: key, size, start, span. A step is half a window; a shorter text is one window; spans under `least` characters go."""
    out = rows.select(*key, F.split(F.trim(F.col(text)), r"\s+").alias("w"))
    out = out.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    last = F.greatest(F.size("w") - F.col("size"), F.lit(0))
    out = out.withColumn("start", F.explode(F.sequence(F.lit(0), last, F.greatest(F.floor(F.col("size") / 2).cast("int"), F.lit(1)))))
    out = out.withColumn("span", F.array_join(F.expr("slice(w, start + 1, size)"), " ")).where(F.length("span") >= least)
    return out.select(*key, "size", "start", "span")


def tfidf(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, weight: (1 + ln c) * (ln((1 + n) / (1 + df)) + 1), scaled to unit length by row."""
    found = rows.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("c")).persist()  # read three times
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    n = rows.agg(F.count("*").alias("n_rows"))
    raw = found.join(df, "term").crossJoin(F.broadcast(n)).select(key, "term", ((F.lit(1.0) + F.ln("c")) * (F.ln((F.lit(1.0) + F.col("n_rows")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


#: So many terms of an index are sent to every task at most; a larger one is joined by a shuffle.
POSTINGS = 2_000_000


def top_matches(index: DataFrame, key: str, queries: DataFrame, query_key: str, text: str, corpus: DataFrame, corpus_text: str, k: int = 3) -> DataFrame:
    """query_key, key, score, place: the k rows of the corpus with the greatest cosine to each query; ties by key.

    index: tfidf() of the corpus, whose document frequencies weigh queries too.
    Cosines are sums over shared terms, so texts that share none never meet. An
    index of up to POSTINGS terms goes to every task, which keeps the best k of
    each query where the query is; a larger one is joined by term.
    """
    n = corpus.count()
    index = index.persist()  # read twice
    if index.count() <= POSTINGS:
        held = index.toArrow()
        index.unpersist()
        return _matched(held, n, key, queries, query_key, text, k, index.schema[key].dataType)
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select(query_key, F.explode(terms(F.col(text))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("c"))
    raw = asked.join(df, "term").select(query_key, "term", ((F.lit(1.0) + F.ln("c")) * (F.ln(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))).alias("w"))
    norm = raw.groupBy(query_key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = raw.join(index, "term").groupBy(query_key, key).agg(F.sum(F.col("w") * F.col("weight")).alias("s")).join(norm, query_key)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scored.select(query_key, key, F.round(F.col("s") / F.col("norm"), 6).alias("score")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _matched(index: pa.Table, n: int, key: str, queries: DataFrame, query_key: str, text: str, k: int, kind: T.DataType) -> DataFrame:
    """top_matches() with the index in every task: keys in order, so that ties are by place."""
    keys, row = np.unique(index.column(key).to_numpy(zero_copy_only=False), return_inverse=True)
    names, term = np.unique(index.column("term").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    order = np.argsort(term, kind="stable")
    row, weight = row[order], index.column("weight").to_numpy()[order]
    edges = np.searchsorted(term[order], np.arange(len(names) + 1))
    idf = np.log((1.0 + n) / (1.0 + np.diff(edges))) + 1.0
    held = importable(queries.sparkSession).sparkContext.broadcast(({t: i for i, t in enumerate(names.tolist())}, keys, row, weight, edges, idf))
    schema = T.StructType([queries.schema[query_key], T.StructField(key, kind), T.StructField("score", T.DoubleType()), T.StructField("place", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, keys, row, weight, edges, idf = held.value
        get = numbers.get
        for batch in batches:
            at, who, scores, places = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                counts = Counter(filter(None.__ne__, map(get, _terms((t or "").lower()))))
                if not counts:
                    continue
                ids = np.fromiter(counts, np.int64, len(counts))
                w = (1.0 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * idf[ids]
                size = edges[ids + 1] - edges[ids]
                place = np.repeat(edges[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                total = np.bincount(row[place], np.repeat(w, size) * weight[place], len(keys)) / np.sqrt(w @ w)
                met = np.flatnonzero(np.bincount(row[place], minlength=len(keys)))
                best = met[np.lexsort((met, -np.round(total[met], 6)))][:k]
                at += [i] * len(best)
                who.append(best)
                scores.append(np.round(total[best], 6))
                places += range(1, len(best) + 1)
            which = np.concatenate([np.empty(0, np.int64), *who])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys[which]), pa.array(np.concatenate([np.empty(0), *scores])), pa.array(places, pa.int32())], names=[query_key, key, "score", "place"])

    return queries.select(query_key, text).mapInArrow(run, schema)


def tier(score: Column) -> Column:
    """How sure a match by score is."""
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").when(score >= 0.25, "low").otherwise("none")


def variants(name: str) -> list[str]:
    """Singular and plural of a table's name in words."""
    word = name.lower().replace("_", " ")
    one = word[:-3] + "y" if word.endswith("ies") else word[:-1] if word.endswith("s") and not word.endswith("ss") else word
    many = one[:-1] + "ies" if one.endswith("y") and one[-2:-1] not in "aeiou" else one + ("es" if one.endswith(("s", "x", "ch", "sh")) else "s")
    return sorted({one, many})


def mentions(rows: DataFrame, key: str, text: str, tables: list[str]) -> DataFrame:
    """key, table: whole-word mentions of a table in either number, in any case."""
    found = F.array(*(F.when(F.lower(F.col(text)).rlike(r"\b(" + "|".join(variants(t)) + r")\b"), F.lit(t)) for t in tables))
    return rows.select(key, F.explode(F.array_compact(found)).alias("table"))


#: Texts of items that are broadcast at once, in bytes.
BLOCK = 8 << 20


def verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: documents that hold an item's text to the letter.

    The words between an item's first and last are whole words of the document
    too. Of an item with four words or more, the longest two of them in a row
    are its seed; documents are looked up by their pairs of words, without
    their texts, and only what shares a seed is searched. Shorter items are
    searched for in every document, in blocks of at most BLOCK bytes. Ids must
    be unique; null texts and empty items match nothing.
    """
    words = F.split(F.col("text"), r"\s+")
    inner = F.expr("slice(w, 2, greatest(size(w) - 2, 0))")
    pairs = F.expr("transform(sequence(1, greatest(size(w) - 1, 1)), i -> concat_ws(' ', element_at(w, i), try_element_at(w, i + 1)))")
    longest = F.expr("array_max(transform(pairs, p -> struct(length(p) AS n, p AS pair))).pair")
    asked = items.where("length(text) > 0").select("item_id", F.col("text").alias("item"), words.alias("w"))
    long = asked.where("size(w) >= 4").select("item_id", "item", inner.alias("w")).withColumn("pairs", pairs).select("item_id", "item", longest.alias("pair"))
    said = docs.where("text IS NOT NULL").select("doc_id", words.alias("w")).where("size(w) >= 2").select("doc_id", F.explode(F.array_distinct(pairs)).alias("pair"))
    met = said.join(long.select("item_id", "pair"), "pair").select("doc_id", "item_id").distinct()
    out = met.join(docs.select("doc_id", "text"), "doc_id").join(long.select("item_id", "item"), "item_id").where(F.contains("text", "item")).select("doc_id", "item_id")
    short = asked.where("size(w) < 4").select("item_id", "item")
    size = short.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    parts = -(-size // BLOCK)
    for part in range(parts):
        own = short.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        out = out.union(docs.join(F.broadcast(own), F.contains(docs["text"], F.col("item"))).select("doc_id", "item_id"))
    return out


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sentences(c: Column) -> Column:
    """The text's sentences, trimmed: ends are ., ! or ? before white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), F.trim), lambda s: F.length(s) > 0)


#: Spans of all sizes are held together for texts of so many terms at most; of longer texts those of one size at a time, made twice.
HELD_TERMS = 1 << 17


def best_span(fact: str, text: str, sizes: tuple[int, ...], least: int) -> float | None:
    """The greatest cosine of a fact to a span of the text, by weights from that text's spans; None if it has no span, or shares no term with one."""
    words = _blanks(text.strip(" "))
    numbers: dict[str, int] = {}
    of_word = {w: [numbers.setdefault(t, len(numbers)) for t in _terms(w.lower())] for w in dict.fromkeys(words)}
    own = [*map(of_word.__getitem__, words)]
    flat = np.fromiter(chain.from_iterable(own), np.int64)
    edges = np.cumsum([0, *map(len, own)])
    lengths = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)  # of words and the blanks behind them
    count = {numbers[t]: c for t, c in Counter(_terms(fact.lower())).items() if t in numbers}
    if not count or not numbers:
        return None

    def spans_of(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(span, term, how often) of the spans of a size that are long enough, and how many these are."""
        first = np.arange(0, max(len(words) - size, 0) + 1, max(size // 2, 1))
        last = np.minimum(first + size, len(words))
        good = lengths[last] - lengths[first] - 1 >= least
        lo, hi = edges[first[good]], edges[last[good]]
        n = hi - lo
        place = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        code = np.repeat(np.arange(len(n)), n) * len(numbers) + flat[place]
        code.sort()
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, np.int64)
        span = code[first] // len(numbers)
        return span, code[first] - span * len(numbers), np.diff(np.append(first, len(code))), int(good.sum())

    df, total, held = np.zeros(len(numbers)), 0, {}
    for size in sizes:
        made = spans_of(size)
        if len(flat) <= HELD_TERMS:
            held[size] = made
        _, term, _, n = made
        df += np.bincount(term, minlength=len(numbers))
        total += n
    idf = np.log((total + 1.0) / (df + 1.0)) + 1.0
    asked, logs = np.zeros(len(numbers)), np.log(np.arange(1.0, max(sizes) * max(map(len, of_word.values())) + 1.0)) + 1.0
    logs = np.concatenate(([0.0], logs))  # by how often a term occurs in a span
    for t, c in count.items():
        if df[t]:
            asked[t] = (np.log(c) + 1.0) * idf[t]
    norm, best = np.sqrt(asked @ asked), None
    for size in sizes:
        span, term, c, n = held.pop(size, None) or spans_of(size)
        w = logs[c] * idf[term]
        dot, own_norm = np.bincount(span, w * asked[term], n), np.sqrt(np.bincount(span, w * w, n))
        met = dot > 0
        if met.any():
            found = float((dot[met] / (own_norm[met] * norm)).max())
            best = found if best is None else max(best, found)
    return best


def span_scores(claims: DataFrame, docs: DataFrame, sizes: tuple[int, ...] = (12, 24, 40, 64, 96), least: int = 20) -> DataFrame:
    """claim_id, score: best_span() of each claim's fact in its document; claims without one have no row.

    A claim needs nothing but its own document, so texts are joined once and
    scored where they are; a text longer than HELD_TERMS is held with its spans of one size at a time.
    """
    met = claims.select("claim_id", "doc_id", "fact").join(docs.select("doc_id", "text"), "doc_id").where("text IS NOT NULL AND fact IS NOT NULL")
    return _scored(met.select("claim_id", F.lit(None).cast("string").alias("sure"), "fact", "text"), sizes, least).where("score IS NOT NULL").select("claim_id", "score")


def _scored(rows: DataFrame, sizes: tuple[int, ...] = (12, 24, 40, 64, 96), least: int = 20) -> DataFrame:
    """claim_id, sure, score: best_span() of each of rows (claim_id, sure, fact, text), null without a fact or a text."""
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            scores = [None if f is None or t is None else best_span(f, t, sizes, least) for f, t in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["claim_id", "sure", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["claim_id"], T.StructField("sure", T.StringType()), T.StructField("score", T.DoubleType())]))


# Up to so many words, or below so many characters, a text is short.
SHORT_WORDS, SHORT_CHARS = 3, 15


def segment_faults(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """segment_id, severity: of segments (segment_id, doc_id, text) that their document does not hold to the letter.

    LOW for short ones, else MEDIUM; null and empty segments claim nothing and
    are left out. A document that is missing, or has no text, holds nothing.
    """
    said = segments.where(F.length("text") > 0).select("segment_id", "doc_id", F.col("text").alias("said"))
    met = said.join(docs.select("doc_id", "text"), "doc_id", "left").where(~F.coalesce(F.contains("text", "said"), F.lit(False)))
    short = (F.size(F.split(F.trim("said"), r"\s+")) <= SHORT_WORDS) | (F.length("said") < SHORT_CHARS)
    return met.select("segment_id", F.when(short, "LOW").otherwise("MEDIUM").alias("severity"))


def origins(claims: DataFrame, docs: DataFrame, **how) -> DataFrame:
    """claim_id, match, score of claims (claim_id unique, doc_id, fact, origin) against their documents (doc_id unique, text).

    verbatim: the document holds the origin to the letter; sentence: it is one of
    its sentences in any case; else the tier of the best span's score. An empty or
    null origin matches neither; a missing document or null text scores 0. Claims
    meet their documents once, and those that neither matches are scored there.
    """
    met = claims.join(docs.select("doc_id", "text"), "doc_id", "left")
    said = F.length("origin") > 0
    whole = F.exists(F.transform(sentences(F.col("text")), F.lower), lambda s: s == F.lower(F.trim("origin")))
    told = met.select("claim_id", "fact", "text", F.when(said & F.contains("text", "origin"), "verbatim").when(said & whole, "sentence").alias("sure"))
    rest = F.col("sure").isNull()
    out = _scored(told.select("claim_id", "sure", *(F.when(rest, F.col(c)).alias(c) for c in ("fact", "text"))), **how)
    score = F.when(F.col("sure").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return out.select("claim_id", F.coalesce("sure", tier(score)).alias("match"), score.alias("score"))
