"""Substring dedup and SimHash near-dedup against brute force; odd rows."""

import itertools
import re

import numpy as np
import pytest

from annolith.llm import simhash_dedup as sd
from annolith.llm import substring_dedup as sub
from annolith.llm.shared import written

SCHEMA = "doc_id long, text string, bucket int, fingerprint int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)


def brute_spans(rows, window):
    seen, tokens = {}, [(i, (t or "").split()) for i, t in rows]
    for n, (_, w) in enumerate(tokens):
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), []).append((n, k))
    covered = {}
    for places in seen.values():
        if len(places) > 1:
            for n, k in places:
                covered.setdefault(n, set()).add(k)
    out = []
    for n, starts in covered.items():
        run = None
        for k in sorted(starts):
            if run and k <= run[1]:
                run[1] = k + window
            else:
                run = [k, k + window]
                out.append((tokens[n][0], run))
    return sorted(((i, a, b) for i, (a, b) in out), key=str)


@pytest.mark.parametrize("bucket_bytes", [sub.BUCKET_BYTES, 2, 100])
def test_repeated_spans_are_brute_force(spark, bucket_bytes):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(list("abcd"), int(rng.integers(0, 60))))) for i in range(60)]
    rows += [(100, rows[0][1]), (101, "x y z " * 30), (None, rows[1][1])]
    got = sorted(((r.doc_id, r.start_token, r.end_token) for r in sub.repeated_spans(frame(spark, rows), 6, bucket_bytes=bucket_bytes).collect()), key=str)
    assert got == brute_spans(rows, 6) and got


def test_places_come_back():
    rng = np.random.default_rng(2)
    for n, most in ((0, 1), (1, 10), (1, 10**6), (50, 60), (50, 10**7), (5000, 10**5)):
        x = np.sort(rng.choice(most, min(n, most), replace=False))
        assert sub.unpack_places(sub.pack_places(x)).tolist() == x.tolist() and len(sub.pack_places(x)) <= 4 * len(x) + 2


def test_windows_that_share_64_bits_only_are_not_the_same():
    hashes, more = np.array([7, 7, 7, 3, 3], np.uint64), np.array([1, 2, 1, 5, 5], np.uint32)
    order = sub.in_order(hashes, more)
    same = sub.same_as_before(hashes, more, order)
    repeated = set(order[1:][same].tolist()) | set(order[:-1][same].tolist())
    assert repeated == {0, 2, 3, 4}


def test_substring_odd_rows(spark):
    long = " ".join(map(str, range(120_000)))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, long), (5, long), (6, "q " * 51)]
    got = sorted((r.doc_id, r.start_token, r.end_token) for r in sub.repeated_spans(frame(spark, rows)).collect())
    assert got == [(5, 0, 120_000), (5, 0, 120_000), (6, 0, 51)]
    assert sub.repeated_spans(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 5, 8, 9])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks, halves = sd.covering_masks(radius), sd.half_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and len(halves) == 2 * (2 ** (radius // 2 + 1) - 1)
    assert min(int(m).bit_count() for m in masks) >= 28 and min(int(m).bit_count() for m in halves) >= 16
    rng = np.random.default_rng(radius)
    for _ in range(300):
        bits = rng.choice(64, radius, replace=False)
        diff = np.uint64(sum(1 << int(b) for b in bits))
        assert ((masks & diff) == 0).any() and ((halves & diff) == 0).any()


def some_fingerprints(seed, n):
    rng = np.random.default_rng(seed)
    flip = lambda k: np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    near = [np.array([x ^ flip(int(rng.integers(1, 12))) for x in base]) for _ in range(3)]
    crowd = np.array([base[0] ^ flip(int(rng.integers(0, 5))) for _ in range(60)])
    return np.unique(np.concatenate([base, *near, crowd]))


def brute_pairs(fps, radius):
    return sorted((min(a, b), max(a, b)) for a, b in itertools.combinations(fps.view(np.int64).tolist(), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius)


@pytest.mark.parametrize(("short_keys", "sub_table"), [(1 << 22, 150_000), (0, 150_000), (1 << 22, 40), (1 << 22, 5)])
def test_candidates_are_all_pairs_within_the_radius(spark, short_keys, sub_table):
    fps = some_fingerprints(1, 40)
    frame_ = written(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fingerprint bigint"), "fps")
    got = sd.candidates(frame_, 9, short_keys, sub_table).collect()
    want = brute_pairs(fps, 9)
    assert sorted((r.a, r.b) for r in got) == want and len(want) > 1000  # each pair once


def test_near_pairs_of_sides_are_those_between_them():
    fps = some_fingerprints(2, 30)
    side = np.arange(len(fps)) % 2
    i, j = sd.near_pairs(fps, np.uint64(0), 9, side)
    got = sorted((min(a, b), max(a, b)) for a, b in zip(fps[i].view(np.int64).tolist(), fps[j].view(np.int64).tolist()))
    of = dict(zip(fps.view(np.int64).tolist(), side.tolist()))
    assert got == [(a, b) for a, b in brute_pairs(fps, 9) if of[a] != of[b]]


def brute_classes(rows, radius=sd.RADIUS, share=sd.MIN_JACCARD):
    """Class and links of each id by comparing all sets of words."""
    sets = {i: frozenset(w for w in (re.sub(r"\W+", "", x) for x in (t or "").lower().split()) if w) for i, t in rows if i is not None}
    def print_of(ws):
        n = [sum(sd.word_hash(w) >> b & 1 for w in ws) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * n[b] > len(ws))
    prints = {ws: print_of(ws) for ws in set(sets.values()) if ws}
    near = {ws: [v for v in prints if v != ws and (prints[v] ^ prints[ws]).bit_count() <= radius and len(v & ws) >= share * len(v | ws)] for ws in prints}
    out = {}
    for i, ws in sets.items():
        if not ws:
            out[i] = (i, 0)
            continue
        reached, todo = {ws}, [ws]
        for x in todo:
            todo += [v for v in near[x] if v not in reached]
            reached |= set(near[x])
        out[i] = (min(k for k, v in sets.items() if v in reached), len(near[ws]))
    return out


def found_classes(spark, rows):
    return {r.doc_id: (r.class_id, r.links) for r in sd.classes(frame(spark, rows)).collect()}


def test_classes_are_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocab, int(rng.integers(3, 200)))) for _ in range(40)]
    rows = list(enumerate(texts))
    for k in range(4):  # chains of copies, each with some words changed
        texts = [" ".join(w if rng.random() > 0.04 else str(rng.choice(vocab)) for w in t.split()) for t in texts]
        rows += [(100 * (k + 1) + i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    got = found_classes(spark, rows)
    assert got == brute_classes(rows) and any(n > 2 for _, n in got.values())
    kept = sorted(r.doc_id for r in sd.keep_one(frame(spark, rows)).collect())
    assert kept == sorted(i for i, (c, _) in got.items() if i == c)


def test_texts_without_common_words_are_never_copies(spark):
    pairs = ["integration internet commerce gardening flowering", "integer interest commitment gardeners flowerers"]
    rows = [(1, " ".join(f"{w}{i}" for w in pairs[0].split() for i in range(3))), (2, " ".join(f"{w}x{i}" for w in pairs[1].split() for i in range(3)))]
    rows += [(3, "one two three four five six seven eight"), (4, "one two three four five six seven eight nine"), (5, "天地玄黃宇宙洪荒日月盈昃"), (6, "天地玄黃宇寒來暑往秋收冬藏")]
    got = found_classes(spark, rows)
    assert got == brute_classes(rows) and [got[i][0] for i in (1, 2, 5, 6)] == [1, 2, 5, 6]


@pytest.mark.parametrize("n", [200, 800])
def test_unrelated_documents_stay_at_growing_sizes(spark, sf_dir, n):
    rng = np.random.default_rng(n)  # the same common words in all, rare ones of their own
    rows = [(i, " ".join([*rng.choice(["the", "of", "and", "to", "in", "is", "it", "for"], 30), *(f"w{i}x{k}" for k in range(40))])) for i in range(n)]
    assert all(c == i and k == 0 for i, (c, k) in found_classes(spark, rows).items())


def test_simhash_odd_rows(spark):
    text = " ".join(f"word{i}x" for i in range(100))
    rows = [(1, None), (2, None), (3, ""), (4, ""), (None, text), (5, text), (6, text), (6, text), (7, "a b"), (8, "a b"), (9, "... !!!"), (10, "w " * 100_000), (11, "b, A"), (12, " ".join(f"long{i}" for i in range(30_000)))]
    docs = frame(spark, rows)
    assert found_classes(spark, rows) == brute_classes(rows) == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (5, 0), 7: (7, 0), 8: (7, 0), 9: (9, 0), 10: (10, 0), 11: (7, 0), 12: (12, 0)}
    assert sorted((r.doc_id or 0) for r in sd.keep_one(docs).collect()) == [0, 1, 2, 3, 4, 5, 7, 9, 10, 12]
    assert sd.keep_one(docs).columns == docs.columns
    assert sd.keep_one(docs.limit(0)).count() == 0 and sd.classes(docs.limit(0)).count() == 0
