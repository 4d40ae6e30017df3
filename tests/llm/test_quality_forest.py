"""Quality rules against brute force: statistics, common words, threshold; rows not seen, ties, repeated rows."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annolith.llm import quality_forest as qf

MARKS = ".,;:!?\"'()"


def tables(spark, sf):
    return [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")]


def brute_statistics(text, common):
    """The rules of one text, character by character and word by word."""
    if not text.split():
        return [0.0] * len(qf.RULES)
    size = len(text.encode()) - text.count(" ") - text.count("\n") + qf.PRIOR_WORDS * qf.PRIOR_LENGTH
    words = text.lower().split()
    n = len(words) + qf.PRIOR_WORDS
    seen, repeated = set(), 0
    for gram in zip(words, words[1:], words[2:]):
        repeated += gram in seen
        seen.add(gram)
    lines = text.split("\n")
    known = sum(w.strip(MARKS) in common for w in words)
    return [
        sum(c in "#$%&*<>[\\]^`{}~" for c in text) / size,
        sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / size,
        text.count("|") / n,
        sum(c in "!?" for c in text) / n,
        float(np.log(size / n)),
        (known + qf.PRIOR_WORDS * qf.PRIOR_COMMON) / n,
        (len(lines) - len(set(lines))) / (len(lines) + qf.PRIOR_LINES),
        repeated / n,
    ]


def test_judgement_is_brute_force(spark, sf_dir):
    docs, labels = tables(spark, sf_dir)
    forest = qf.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    own = {r.doc_id: r.quality for r in labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).collect() if r.doc_id in texts}
    held = {}
    for i in own:
        for w in {w.strip(MARKS) for w in texts[i].lower().split()} - {""}:
            held[w] = held.get(w, 0) + 1
    assert forest.common == sorted(w for w, n in held.items() if n >= qf.COMMON_SHARE * len(own))
    got = {r.doc_id: r for r in qf.judge(docs, forest).collect()}
    assert all([got[i][r] for r in qf.RULES] == pytest.approx(brute_statistics(t, set(forest.common)), abs=1e-9) for i, t in texts.items())
    score = {i: forest.scores(np.array([[got[i][r] for r in qf.RULES]]))[0] for i in texts}
    assert all(got[i].score == pytest.approx(score[i]) and got[i].keep == (got[i].score <= forest.threshold) for i in texts if texts[i].strip())
    # the least threshold among scores that loses at most that share of good rows
    good = sorted(got[i].score for i, q in own.items() if q != 0)
    loses = lambda t: sum(s > t + 1e-12 for s in good)
    if forest.threshold == float("inf"):  # no bad row is above it
        assert max(got[i].score for i, q in own.items() if q == 0) <= good[len(good) - 1 - int(qf.CLEAN_LOSS * len(good))]
        return
    assert loses(forest.threshold) <= qf.CLEAN_LOSS * len(good) < loses(max(s for s in good if s < forest.threshold - 1e-9))


def test_statistics_do_not_depend_on_the_other_texts_of_a_batch(spark, sf_dir):
    texts = [r.text for r in tables(spark, sf_dir)[0].limit(150).collect()] + ["c d", "a b c d", "a b c d b c d", "b c d a b c"]
    together = qf.statistics(pa.array(texts), ["a", "the"])
    assert np.allclose(together, np.concatenate([qf.statistics(pa.array([t]), ["a", "the"]) for t in texts]), atol=1e-12)


def test_rejects_bad_rows_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("the test tables are not here")
    docs, labels = tables(spark, sf)
    forest = qf.train(docs, labels.where("doc_id % 2 = 0"))
    rows = qf.judge(docs, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_common_words_come_from_the_corpus_in_any_language(spark):
    rows = [(i, f"kaj la {i} estas domo nova{i}") for i in range(50)] + [(99, "rare words only"), (100, None), (101, "")]
    assert qf.common_words(spark.createDataFrame(rows, "doc_id long, text string")) == ["domo", "estas", "kaj", "la"]


def test_ties_and_repeated_rows(spark, sf_dir):
    docs, labels = tables(spark, sf_dir)
    forest = qf.train(docs, labels)
    twice = docs.union(docs).withColumn("score", F.lit("x")).withColumn("keep", F.lit(1))
    got = qf.judge(twice, forest).groupBy("doc_id").agg(F.countDistinct("keep").alias("n"), F.count("*").alias("rows"))
    assert got.where("n <> 1 or rows <> 2").count() == 0
    assert qf.keep_good(twice, forest).columns == twice.columns
    one = qf.judge(docs.where("length(trim(text)) > 0"), forest).first()
    forest.threshold = one.score  # a tie with the threshold is kept
    assert qf.judge(docs, forest).where(F.col("doc_id") == one.doc_id).first().keep
    assert qf.calibrate(np.array([0.5, 0.5, 0.5, 0.9]), np.array([True, True, True, False])) == 0.5


def test_training_takes_every_labelled_row(spark):
    """21,000 labelled rows, more than were once sampled; a word and odd good rows among those of the greatest id hashes."""
    n = 21_000
    late = {r.id for r in spark.range(n).orderBy(F.xxhash64("id").desc()).limit(1_000).collect()}

    def text(i):
        if i in late:
            return f"la domo {i % 97} estas" + " ##!! ABC" * (i % 11)
        return f"la domo {i % 97}" + " kaj" * (i % 7) if i % 50 else "| " * 30

    docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string").repartition(6)
    bad = {i for i in range(0, n, 50)} - late
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in range(n)], "doc_id long, quality int")
    forest = qf.train(docs, labels, trees=20)
    assert "estas" in forest.common  # in 1,000 of 21,000 rows, all of them late
    got = qf.judge(docs, forest).collect()
    assert forest.threshold == qf.calibrate(np.array([r.score for r in got]), np.array([r.doc_id not in bad for r in got]))
    again = qf.train(docs.repartition(3), labels.repartition(2), trees=20)  # rows in another order
    assert (again.common, again.threshold) == (forest.common, forest.threshold) and np.array_equal(again.at, forest.at)


def test_subsamples_are_drawn_from_all_rows(spark):
    values = [(i, *[float(i + j) for j in range(len(qf.RULES))], True, 1) for i in range(3_000)]
    known = spark.createDataFrame(values, ", ".join(["doc_id long", *[f"{r} double" for r in qf.RULES], "good boolean", "copy int"])).repartition(5)
    own = qf.draw(known, 60, 200)
    assert all(len(np.unique(x[:, 0])) == 200 for x in own)
    seen = np.bincount(np.concatenate(own)[:, 0].astype(int), minlength=3_000)
    assert (seen > 0).mean() > 0.95 and seen.max() < 20  # drawn four times on average
    assert [len(x) for x in qf.draw(known.limit(50), 3, 200)] == [50, 50, 50] and [len(x) for x in qf.draw(known.limit(0), 3, 200)] == [0, 0, 0]
    few = known.limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(900))))  # rows that differ in nothing but their number
    assert [len(x) for x in qf.draw(few, 4, 200)] == [200] * 4


def test_threshold_of_a_table_is_that_of_its_rows(spark):
    rng = np.random.default_rng(4)
    for score in (rng.random(5_000), np.round(rng.random(5_000), 2), np.full(40, 0.25), 0.5 + rng.random(3_000) * 1e-13):
        good = rng.random(len(score)) < 0.8
        table = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good)], "score double, good boolean")
        for loss in (0.0, 0.003, 0.2):
            assert qf.calibrate_table(table, loss) == qf.calibrate(score, good, loss)
        assert qf.calibrate_table(table.where("good")) == qf.calibrate_table(table.where("not good")) == float("inf")


def test_labels_looked_up_or_joined(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (0, "d"), (7, None), (9, "e"), (3, "f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (9, 2), (None, 1), (3, None), (8, 0)], "doc_id long, quality int")
    want = [(1, "a", False), (1, "b", False), (7, None, True), (9, "e", True)]
    for held in (0, 100):
        assert sorted((tuple(r) for r in qf.labelled(docs, labels, held).collect()), key=str) == sorted(want, key=str)
    assert qf.labelled(docs, labels.limit(0)).count() == 0
