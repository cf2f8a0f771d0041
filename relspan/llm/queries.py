"""The queries opN_<name> of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relspan.llm import bpe_codec, chat, decontam, fingerprints, langid, lm_score, minhash, quality, ranked, simhash, suffix_dedup, token_counts, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    kind = "conv_id long, turn long, role string, text string"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], kind)
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest_chats(chat.format_chats(rows))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_table(spark, sf_dir, "documents"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), digests=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_quality, op3_chat_format, op4_fingerprints, op5_bpe_codec, op6_suffix_dedup, op7_simhash, op8_decontam, op9_lm_score, op10_language, op11_minhash, op12_ranked_search, op13_vector_codes)}

#: DuckDB SQL for those that SQL can express.
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op11_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words),
keyed AS MATERIALIZED (SELECT doc_id, s, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS least FROM sets),
chosen AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS shingle FROM keyed WHERE n > 0 AND doc_id = least),
edges AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM chosen a JOIN chosen b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
root AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept
FROM (SELECT doc_id, n, CASE WHEN n = 0 THEN doc_id ELSE coalesce(root, least) END AS c FROM keyed LEFT JOIN root ON a = least)"""

ORACLE_SQL["op12_ranked_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM asked) GROUP BY term), total),
worth AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS points
  FROM counts JOIN weights USING (term) JOIN lengths USING (doc_id), total),
scores AS (SELECT item_id, doc_id, sum(points)::BIGINT AS score FROM asked JOIN worth USING (term) GROUP BY item_id, doc_id),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50"""


def _codes_sql(entries: int = 256, rounds: int = 4) -> str:
    """Assignments and means of each round as tables of their own."""
    steps = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS v, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT v, vec_id, label, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS x FROM kept, range(4) AS t(p))",
        f"book0 AS (SELECT p, v - 1 AS e, x FROM parts WHERE v <= {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"near{r} AS MATERIALIZED (SELECT v, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (SELECT a.v, a.p, b.e, "
            f"list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts a JOIN book{r} b USING (p)) GROUP BY v, p)"
        )
        if r < rounds:
            steps.append(
                f"mean{r} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, floor_div AS m FROM (SELECT n.p, n.e, i, CASE WHEN sum(a.x[i]) >= 0 THEN sum(a.x[i])::BIGINT // count(*) "
                f"ELSE -((-sum(a.x[i])::BIGINT + count(*) - 1) // count(*)) END AS floor_div FROM near{r} n JOIN parts a USING (v, p), range(1, (SELECT max(len(x)) + 1 FROM parts)) AS t(i) GROUP BY n.p, n.e, i)) GROUP BY p, e)"
            )
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m USING (p, e))")
    last = f"near{rounds}"
    return (
        "WITH " + ",\n".join(steps) + f""",
coded AS (SELECT v, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM {last} GROUP BY v),
hash AS (SELECT sha256(string_agg(c, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, list_aggregate(x, 'string_agg', ',') AS c FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (v), hash"""
    )


ORACLE_SQL["op13_vector_codes"] = _codes_sql()
