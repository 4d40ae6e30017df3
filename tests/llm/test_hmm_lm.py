"""Hidden Markov language model: exact likelihoods, Baum-Welch, odd rows."""

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annolith.llm import hmm_lm
from annolith.llm.shared import hash_strings, written


def small_model(symbols=5, states=3, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm_lm.Model(np.zeros(0, np.uint64), norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def brute(m, seq):
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[s, b]
        total += p
    return total


def packed(seqs, chunk, block):
    lens = np.array([len(s) for s in seqs], np.int64)
    flat = np.concatenate([np.asarray(s, np.int32) for s in seqs])
    return flat[hmm_lm.Layout(lens, chunk, block).tokens()], lens


CUTS = [(1, 1), (1, 5), (2, 3), (2, 100), (3, 4), (100, 1), (100, 100)]


@pytest.mark.parametrize("chunk,block", CUTS)
def test_forward_is_the_sum_over_all_paths(chunk, block):
    m = small_model()
    seqs = [[4], [0, 3, 4, 1, 1, 2, 0], [2, 2, 0], [], [1], [3, 3, 1, 0]]
    symbols, lens = packed(seqs, chunk, block)
    got = hmm_lm.log_likelihoods(m, symbols, lens, chunk, block)
    assert got == pytest.approx([math.log(brute(m, s)) if s else 0 for s in seqs], abs=1e-12)


@pytest.mark.parametrize("chunk,block", CUTS)
def test_expected_counts_are_brute_force_posteriors(chunk, block):
    m, seqs = small_model(), [[2, 0], [0, 3, 4, 1, 2], [], [1], [4, 4, 0]]
    symbols, lens = packed(seqs, chunk, block)
    start, move, emit, ll = hmm_lm.expected_counts(m, symbols, lens, chunk, block)
    s2, m2, e2 = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for seq in filter(None, seqs):
        z = brute(m, seq)
        for path in itertools.product(range(3), repeat=len(seq)):
            p = m.start[path[0]] * m.emit[seq[0], path[0]]
            for a, b, s in zip(path, path[1:], seq[1:]):
                p *= m.move[a, b] * m.emit[s, b]
            s2[path[0]] += p / z
            for a, b in zip(path, path[1:]):
                m2[a, b] += p / z
            for s, a in zip(seq, path):
                e2[s, a] += p / z
    assert np.allclose(start, s2) and np.allclose(move, m2) and np.allclose(emit, e2)
    assert ll == pytest.approx(sum(math.log(brute(m, s)) for s in seqs if s))


def test_single_precision_over_chunks_is_double_precision_over_whole_documents():
    rng = np.random.default_rng(2)
    m = small_model(200, 8)
    m.emit *= np.exp(6 * rng.normal(size=m.emit.shape))
    m.emit /= m.emit.sum(axis=0)
    seqs = [rng.integers(0, 200, int(n)) for n in rng.integers(0, 5000, 20)]
    lens = np.array([len(s) for s in seqs])
    whole, _ = packed(seqs, 10**6, 10**7)
    parts, _ = packed(seqs, 512, 3000)
    want = hmm_lm.expected_counts(m, whole, lens, 10**6, 10**7)
    got = hmm_lm.expected_counts(m.single(), parts, lens, 512, 3000)
    assert all(np.allclose(a, b, rtol=2e-3, atol=0.05) for a, b in zip(got, want))
    assert np.allclose(hmm_lm.log_likelihoods(m, parts, lens, 512, 3000), hmm_lm.log_likelihoods(m, whole, lens, 10**6, 10**7), rtol=1e-10)


def made(spark, rows, min_share=1e-3, held=1 << 22):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    coded = written(hmm_lm.code(docs, held_tokens=held), "coded")
    counted = hmm_lm.count(coded)
    return coded, counted, *hmm_lm.vocabulary(counted, min_share)


def test_training_finds_structure_and_never_loses_likelihood(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        topic = ["red blue green", "one two three"][i % 2].split()
        rows.append((i, " ".join(rng.choice(topic, 30))))
    coded, counted, keys, counts = made(spark, rows, held=200)
    assert len(keys) == 6 and counts.sum() == 9000 and coded.count() >= 4
    model, seen = hmm_lm.train(coded, keys, counts, 2, 1e-5)
    assert all(b >= a - 1e-4 * abs(a) for a, b in zip(seen, seen[1:])) and len(seen) > 3
    assert seen[-1] - seen[-2] < 1e-5 * abs(seen[-1]) <= seen[-2] - seen[-3]  # it ends by what it gains
    assert len(hmm_lm.train(coded, keys, counts, 2, 1e-2)[1]) < len(seen)
    got = [r.perplexity for r in hmm_lm.score_coded(coded, model, counted, counts).collect()]
    assert len(got) == 300 and np.mean(got) < 3.3  # six words by themselves would give six


def test_iteration_is_that_of_double_precision_over_whole_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(list("abcdefg"), int(rng.integers(0, 40)), p=np.array([7, 6, 5, 4, 3, 2, 1]) / 28))) for i in range(80)]
    coded, _, keys, counts = made(spark, rows, 0.01, 100)
    model, share = hmm_lm.initial(keys, counts, 3), (counts + 0.5) / (counts + 0.5).sum()
    new, ll, n = hmm_lm.step(coded, model, share)
    total = [0.0, 0.0, 0.0, 0.0]
    for _, t in rows:
        words = pa.array(t.split(), pa.string())
        if len(words):
            symbols = hmm_lm.symbols_of(keys, hash_strings(words), hmm_lm.rare_class(words))
            total = [a + b for a, b in zip(total, hmm_lm.expected_counts(model, symbols, np.array([len(symbols)])))]
    assert n == sum(len(t.split()) for _, t in rows) and ll == pytest.approx(total[3], rel=1e-6)
    emit = total[2] + share[:, None]
    assert np.allclose(new.emit, emit / emit.sum(axis=0), rtol=1e-4, atol=1e-9)
    assert np.allclose(new.move, (total[1] + 1) / (total[1] + 1).sum(axis=1, keepdims=True), rtol=1e-4)


@pytest.mark.parametrize("min_share", [0.08, 0.5, 1e-5])
def test_scores_are_brute_force_likelihoods_of_words(spark, min_share):
    rng = np.random.default_rng(6)
    vocab = [a + b for a in "abc" for b in "xy"] + ["rare" + c for c in "pqrs"]
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(1, 7))))) for i in range(40)]
    coded, counted, keys, counts = made(spark, rows, min_share, 20)
    model, _ = hmm_lm.train(coded, keys, counts, 2, 1e-2)
    n = Counter(w for _, t in rows for w in t.split())
    klass = {w: int(hmm_lm.rare_class(pa.array([w]))[0]) for w in n}
    rare = {w for w in n if n[w] < min_share * sum(n.values())}
    total = Counter()
    for w in rare:
        total[klass[w]] += n[w]
    got = {r.doc_id: r.log_likelihood for r in hmm_lm.score_coded(coded, model, counted, counts).collect()}
    for i, t in rows:
        words = pa.array(t.split())
        symbols = hmm_lm.symbols_of(keys, hash_strings(words), hmm_lm.rare_class(words))
        want = math.log(brute(model, symbols.tolist())) + sum(math.log(n[w] / (total[klass[w]] + 1)) for w in t.split() if w in rare)
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert len(rare) + len(keys) == len(n)
    # with other documents: words never seen share one part of their class
    other = written(hmm_lm.code(spark.createDataFrame([(1, "unseen")], "doc_id long, text string")), "other")
    word = pa.array(["unseen"])
    symbol = hmm_lm.symbols_of(keys, hash_strings(word), hmm_lm.rare_class(word))[0]
    assert hmm_lm.score_coded(other, model, counted, counts).first().log_likelihood == pytest.approx(math.log(model.start @ model.emit[symbol]) - math.log(total[int(hmm_lm.rare_class(word)[0])] + 1))


def test_rare_words_become_classes(spark):
    _, counted, keys, counts = made(spark, [(1, "a a a a b"), (2, "a a a a c")], 0.5)
    assert len(keys) == 1 and counts[0] == 8 and counts[1:].sum() == 2 and counted.count() == 3


def test_odd_rows(spark):
    long = "word " * 50_000
    rows = [(1, None, 7), (2, "", 7), (3, " \n ", 7), (None, "same text here", 7), (5, "same text here", 7), (5, "same text here", 7), (6, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slice int").withColumn("word", F.lit("x"))
    got = hmm_lm.score(docs, 3, 1e-2).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert [by[i].n_tokens for i in (1, 2, 3, None, 5, 6)] == [0, 0, 0, 3, 3, 50_000]
    assert by[1].log_likelihood == 0 and by[1].perplexity is None
    assert by[None].log_likelihood == pytest.approx(by[5].log_likelihood) and by[5].log_likelihood < 0
    assert hmm_lm.score(docs.limit(0), 3).count() == 0
    assert [r.n_tokens for r in hmm_lm.score(docs.where("doc_id < 3"), 3).collect()] == [0, 0]
    with pytest.raises(ValueError):
        hmm_lm.score(docs, 1)
