"""What the findings of round 3 asked for: steps of a task, rounds of components, readings of texts."""

import numpy as np

from relspan.llm import lm_score, similar


def test_sets_are_made_again_by_one_python_step(spark):
    texts = [f"a{i} b{i} c{i} d" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def hashes(text):
        return similar.shingle_hashes(text, 2)

    keys = [similar.set_key(hashes(t)) for t in texts]
    distinct = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "fp long, least long")
    made = similar.sets_again(docs, distinct, hashes)(distinct.where("least < 7").select("fp"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {(r.fp, bytes(r.shingles)) for r in made.collect()} == {(keys[i], hashes(texts[i]).tobytes()) for i in range(7)}


def test_rounds_keep_only_what_can_still_meet(spark):
    met = spark.createDataFrame([(1, 2, 10), (1, 2, 11), (2, 2, 11), (2, 2, 12), (3, 2, 12), (3, 2, 13)], "bucket long, size long, fp long")
    labels = spark.createDataFrame([(10, 10, 3), (11, 10, 3), (12, 10, 3), (13, 13, 1)], "fp long, comp long, weight long")
    rows = spark.createDataFrame([(fp, 5, b"s", b"w", keys) for fp, keys in ((10, [1, 7]), (11, [1, 2]), (12, [3, 2]), (13, [3, 8]))], "fp long, n int, sketch binary, wide binary, bands array<long>")
    several = similar._several(met, labels)
    assert {(r.bucket, r.fp) for r in several.collect()} == {(3, 12), (3, 13)}
    assert {(r.fp, tuple(r["keys"])) for r in similar._of(several, rows, "bands").collect()} == {(12, (3, 0)), (13, (3, 0))}
    assert {r.fp for r in similar._of(several, rows, None).collect()} == {12, 13}
    one, other = np.array([[0, 5, 3], [4, 5, 3]]), np.array([[0, 6, 3], [4, 6, 3]])
    assert similar._met_before({"keys": one, "band": np.array([2, 2])}, {"keys": other}).tolist() == [False, True]


def test_texts_are_read_twice_for_scores(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, f"the cat{i % 3} sat on mat{i}, twice" if i % 5 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).mapInArrow(count, "doc_id long, text string")
    assert len(lm_score.score(docs).collect()) == 40
    assert seen.value == 80


def test_steps_keep_tokens_and_rare_words(spark):
    words = lm_score.Words(["the", "a"], {"cat": 3 * 4, "x1": 3 * 2 + 1}, [(6, 2), (2, 1), (0, 0)], None)
    docs = spark.createDataFrame([(1, "The cat, x1 the dog the-dog"), (2, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in lm_score._steps(docs, lm_score.Network(), words.numbered, words).where("at is null").collect()}
    assert np.frombuffer(got[1].ids, "<i4").tolist() == [3, 5, 2, 6, 3, 0, 3, 2, 0]
    assert {(x.word, x.m) for x in got[1].rare} == {(",", 1), ("-", 1), ("dog", 2)} and not got[2].rare and not got[2].ids
    assert lm_score._seen_as(words).tolist() == [0, 1, 2, 3, 4, 0, 1]
