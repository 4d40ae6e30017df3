"""Soft-membership mixing: the fit against a dense solver, targets met, clean rows kept, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.llm import linear, mixing
from annolith.llm.shared import written


def corpus(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    vocab = {0: [f"calm{i}" for i in range(40)], 1: [f"junk{i}" for i in range(40)], 2: [f"vile{i}" for i in range(40)]}
    rows, labels = [], []
    for i in range(n):
        kind = int(rng.choice(3, p=[0.7, 0.2, 0.1]))
        words = list(rng.choice(vocab[0], 30)) + list(rng.choice(vocab[kind], 30))
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def kind_of(text):
    return 2 if "vile" in text else 1 if "junk" in text else 0


CLEANER = {"clean": 0.9, "low_quality": 0.05, "toxic": 0.05}


def test_bad_rows_go_and_clean_rows_stay(spark):
    docs, labels, rows = corpus(spark)
    kept = {}
    for r in mixing.mix(docs, labels, CLEANER).collect():
        kept[r.doc_id] = kept.get(r.doc_id, 0) + 1
    clean = [r[0] for r in rows if kind_of(r[1]) == 0]
    bad = [r[0] for r in rows if kind_of(r[1])]
    assert all(kept.get(i, 0) >= 1 for i in clean)
    assert sum(kept.get(i, 0) for i in bad) <= 0.55 * len(bad)


@pytest.mark.parametrize("targets", [mixing.TARGETS, {"clean": 0.5, "low_quality": 0.4, "toxic": 0.1}, {"clean": 1.2, "low_quality": 0.1, "toxic": 0.3}])
def test_expected_totals_meet_targets(spark, targets):
    docs, labels, _ = corpus(spark)
    rows = mixing.rates(docs, labels, targets).collect()
    n = np.array([r.n_tokens for r in rows], float)
    p = np.array([[r[f"p_{k}"] for k in mixing.DOMAINS] for r in rows])
    rate = np.array([r.rate for r in rows])
    assert (rate >= 0).all()
    assert (n * rate) @ p / n.sum() == pytest.approx([targets[k] for k in mixing.DOMAINS], abs=0.002)
    assert all(abs(rows[0][f"residual_{k}"]) < 1e-4 for k in mixing.DOMAINS)
    assert len({tuple(r[f"residual_{k}"] for k in mixing.DOMAINS) for r in rows}) == 1


def test_targets_that_cannot_be_met_show_as_residual():
    p, n = np.array([[0.8, 0.1, 0.1], [0.7, 0.2, 0.1]]), np.array([10.0, 30.0])
    rate, residual = mixing.descend(p, n, np.array([1.0, 0, 0]))
    assert residual == pytest.approx((n * rate) @ p / n.sum() - [1, 0, 0]) and np.abs(residual).max() > 0.05


def test_relative_targets_are_multiples_of_what_is_there(spark):
    docs, labels, rows = corpus(spark)
    model = mixing.train(docs, labels)
    scored = written(mixing.score(docs, model), "test")
    fit = mixing.fit(scored, model, {"toxic": 0.5}, relative=True)
    got = scored.collect()
    p, n = np.array([r.posterior for r in got]), np.array([r.n_tokens for r in got], float)
    there, now = n @ p / n.sum(), (n * fit.rates(p)) @ p / n.sum()
    assert now[2] == pytest.approx(there[2] / 2, abs=0.002) and now.sum() == pytest.approx(1, abs=0.002)
    assert now[1] / there[1] == pytest.approx(now[0] / there[0], abs=0.01)
    kept = {r.doc_id for r in mixing.mix(docs, labels, {"toxic": 0.5}, relative=True).collect()}
    assert all(r[0] in kept for r in rows if kind_of(r[1]) == 0)


def dense(p, n, goal, ridge, steps=200_000):
    """Projected gradient with one rate a document, without acceleration."""
    total = n.sum()
    share = np.maximum((n[:, None] * p).sum(axis=0) / total, 1e-6)
    r = np.ones(len(n))
    for _ in range(steps):
        new = np.maximum(0, r - (p @ (((n * r) @ p / total - goal) / share) + ridge * (r - 1)) / (1 + ridge))
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return r


@pytest.mark.parametrize("goal", [[0.9, 0.05, 0.05], [1.0, 0, 0], [0.3, 0.3, 0.4]])
def test_fit_is_the_dense_optimum(spark, goal):
    docs, labels, _ = corpus(spark, 60)
    model = mixing.train(docs, labels)
    scored = written(mixing.score(docs, model), "test")
    fit = mixing.fit(scored, model, dict(zip(mixing.DOMAINS, goal)), ridge=1e-3, tolerance=1e-10)
    rows = scored.collect()
    p, n = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows], float)
    rounded = mixing.units_of(mixing.cell_of(p), 3) / mixing.GRID
    assert np.abs(rounded - p).max() <= 1 / mixing.GRID + 1e-12 and np.allclose(rounded.sum(axis=1), 1)
    want = dense(rounded, n, np.array(goal), 1e-3)
    assert fit.rates(p) == pytest.approx(want, abs=1e-4)
    assert fit.residual == pytest.approx((n * want) @ rounded / n.sum() - goal, abs=1e-6)


def test_cells_in_spark_are_those_in_numpy(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "i long, p array<double>").select("i", mixing.cell_column(F.col("p"), 3).alias("c"))
    assert [r.c for r in frame.orderBy("i").collect()] == mixing.cell_of(p).tolist()


def test_posteriors_rounded_into_a_cell_not_seen_take_the_nearest():
    fit = mixing.Fit(None, np.sort(mixing.cell_of(np.array([[0.2, 0.3, 0.5], [0.6, 0.3, 0.1]]))), np.array([0.5, 2.0]), np.zeros(3))
    assert fit.rates(np.array([[0.2, 0.301, 0.499], [0.59, 0.3, 0.11], [0.6, 0.3, 0.1]])).tolist() == [0.5, 2.0, 2.0]


def test_features_found_by_spark_are_those_fit_keeps(spark):
    docs, labels, _ = corpus(spark, 200)
    rng = np.random.default_rng(4)
    rows = [(int(t), [int(x) for x in np.unique(rng.integers(0, 30, 10) + 20 * t)]) for t in rng.integers(0, 3, 120)]
    sample = spark.createDataFrame(rows, "target int, features array<long>")
    kept = linear.fit([np.array(f, np.uint64) for _, f in rows], np.array([t for t, _ in rows]), ["a", "b", "c"], 3, 2.0, steps=1).keys
    assert linear.strong_features(sample, 3, 3, 2.0).tolist() == kept.tolist()


def test_rates_and_mix_agree(spark):
    docs, labels, _ = corpus(spark, 120)
    copies = {r.doc_id: r.copies for r in mixing.rates(docs, labels).collect() if r.copies}
    mixed = {}
    for r in mixing.mix(docs, labels).collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    assert copies == mixed


def test_odd_rows(spark):
    docs, labels, _ = corpus(spark, 60)
    odd = spark.createDataFrame([(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "calm1 calm2", "en", "s", 0), (1002, "calm1 " * 30_000, "en", "s", 0), (5, "calm3", "en", "s", 0)], docs.schema)
    both = docs.union(odd).selectExpr("*", "1 AS rate", "2 AS posterior", "3 AS domain", "4 AS target")
    more = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, 1), (5, 1, None), (777, 0, 0)], labels.schema)).selectExpr("*", "'x' AS text")
    assert mixing.rates(both, more).count() == 65
    got = mixing.mix(both, more)
    assert got.columns == both.columns and got.count() > 0
    assert mixing.mix(docs.limit(0), labels).count() == 0 and mixing.rates(docs.limit(0), labels).count() == 0
    none = mixing.rates(docs, labels.limit(0)).collect()  # every posterior is the same
    assert len(none) == 60 and len({r.rate for r in none}) == 1
    assert mixing.mix(docs, labels.limit(0)).count() == sum(r.copies for r in none)
    twice = mixing.rates(docs.union(docs.limit(5)), labels).groupBy("doc_id").agg(F.countDistinct("rate", "copies").alias("n"), F.count("*").alias("rows"))
    assert twice.where("n > 1").count() == 0 and twice.where("rows = 2").count() == 5
    with pytest.raises(ValueError):
        mixing.rates(docs, labels, {"other": 1.0})
