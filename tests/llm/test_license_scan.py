"""Licence scans: families found in held-out wordings, lookalikes left alone, spans, odd rows."""

import math

import pyarrow as pa
import pytest

from annolith.llm import license_scan as ls
from annolith.llm.shared import hash_strings, mix64

SCHEMA = "doc_id long, text string, family string"
PROSE = [f"On day {i} the river rose again and people of the village moved to the hills with their animals." for i in range(60)]


@pytest.fixture(scope="module")
def trained(spark):
    return ls.train(spark.createDataFrame([(i, "\n".join(PROSE[i:] + ["Released under the MIT License."])) for i in range(60)], "doc_id long, text string"))


@pytest.mark.parametrize(
    "line,family",
    [
        ("Released under the MIT License.", "mit"),
        ("MyTool is licensed under the terms of the MIT license, see below", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("as published by the Free Software Foundation; you can redistribute it under the terms of the GNU Lesser General Public License", "lgpl"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Copyright 2021 Jane Roe. All rights reserved.", "all-rights-reserved"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ],
)
def test_families(trained, line, family):
    kind, prob = ls.classify(trained, pa.array([line]))
    assert trained.model.classes[kind[0]] == family and prob[0] >= 0.5
    assert trained.similarity(family, line)[1] >= ls.MIN_SIMILARITY


def test_lookalikes_and_prose_are_unknown(trained):
    lines = [*PROSE, "My driving license expired in May and nobody told me.", "The public library is free of charge for students.", "He said that all rights come with duties.", ""]
    kind, _ = ls.classify(trained, pa.array(lines))
    assert [x for x, k in zip(lines, kind) if k and trained.similarity(trained.model.classes[k], x)[1] >= ls.MIN_SIMILARITY] == []


def test_spans_and_merging(spark, trained):
    text = "Ünïted prose here.\nLicensed under the Apache License, Version 2.0.\n\nReleased under the MIT License.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nend"
    got = sorted(ls.findings(spark.createDataFrame([(1, text, "x")], SCHEMA), trained).collect(), key=lambda r: r.start)
    assert [(r.family, r.confirmed) for r in got] == [("apache", True), ("mit", True)]
    assert text[got[0].start : got[0].end] == "Licensed under the Apache License, Version 2.0."
    assert text[got[1].start : got[1].end].startswith("Released under") and text[got[1].start : got[1].end].endswith("Software.")


def test_odd_rows(spark, trained):
    line = "Released under the MIT License."
    rows = [(1, None, "a"), (2, "", None), (3, " \n\n ", "a"), (None, line, "a"), (5, line, "a"), (5, line, "a"), (6, "words and words " * 40_000 + "\r\n" + line, "a")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS start", "2 AS confirmed")
    got = ls.findings(docs, trained).collect()
    assert sorted((r.doc_id or 0, r.family) for r in got) == [(0, "mit"), (5, "mit"), (5, "mit"), (6, "mit")]
    assert ls.findings(docs.limit(0), trained).count() == 0
    alone = ls.train(docs.limit(0))
    assert alone.model.classes[ls.classify(alone, pa.array([line]))[0][0]] == "mit"


def test_every_licence_line_of_the_corpus_is_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = set()
    for r in docs.collect():
        for line in r.text.split("\n"):
            for part, family in (("MIT License", "mit"), ("Apache License", "apache"), ("GNU General", "gpl"), ("CC BY-NC", "cc-by-nc"), ("All rights reserved", "all-rights-reserved")):
                if part in line:
                    want.add((r.doc_id, family))
    got = {(r.doc_id, r.family) for r in ls.findings(docs, ls.train(docs)).where("confirmed").collect()}
    assert got == want and want


def test_ties_go_to_the_first_by_name(trained):
    # two families with the same weights and templates: the first is predicted, and its first template confirms
    import copy

    c = copy.deepcopy(trained)
    a, b = (c.model.classes.index(x) for x in ("apache", "mit"))
    c.model.weights[:, b] = c.model.weights[:, a]
    c.model.bias[b] = c.model.bias[a]
    c.templates["mit"] = c.templates["apache"]
    c.least = 0.0
    kind, prob = ls.classify(c, pa.array(["Licensed under the Apache License, Version 2.0."]))
    assert prob[0] <= 0.5 + 1e-9 and (kind[0] == 0 or c.model.classes[kind[0]] == "apache")
    name, like = trained.similarity("mit", "no such words at all")
    assert (name, like) == ("", 0.0)


def brute_findings(c, text):
    """Family, span, probability, template and confirmation of a text's findings: n-grams in nested loops, line by line."""
    import numpy as np

    weights = {int(k): c.model.weights[i].astype(float) for i, k in enumerate(c.model.keys)}

    def gram_hashes(line):
        words = [w.strip(".,;:!?()[]\"'`*#<>") for w in line.lower().split()]
        hashes = [int(h) for h in hash_strings(pa.array(words, pa.string()))]
        sets = [set(), set(), set()]
        for i in range(len(words)):
            h = hashes[i]
            for n in range(3):
                if i + n >= len(words):
                    break
                if n:
                    h = int(mix64(np.array([(h * 0x9E3779B97F4A7C15 + hashes[i + n]) % 2**64], np.uint64))[0])
                sets[n].add(h)
        return sets

    def like(family, part):
        own, best = gram_hashes(part), (None, 0.0)
        for name, n, theirs in c.templates[family]:
            share = len(own[n] & theirs) / max(1, min(len(own[n]), len(theirs)))
            if share > best[1]:
                best = (name, share)
        return best

    out, at, run = [], 0, None
    for line in [*text.split("\n"), None]:
        kind = None
        if line is not None:
            known = [h for s in gram_hashes(line) for h in s if h in weights]
            if known:
                z = [(b + sum(weights[h][k] for h in known)) / c.model.temperature for k, b in enumerate(c.model.bias)]
                e = [math.exp(x - max(z)) for x in z]
                p = [x / sum(e) for x in e]
                best = max(range(1, len(p)), key=lambda k: (p[k], -k))
                if 1 - p[0] >= c.least and p[best] >= 0.5:
                    kind = (c.model.classes[best], p[best])
        if run and (kind is None or kind[0] != run[0]):
            name, share = like(run[0], " ".join(run[4]))
            out.append((run[0], run[1], run[2], round(run[3], 9), name, round(share, 9), share >= ls.MIN_SIMILARITY))
            run = None
        if kind:
            run = (kind[0], run[1] if run else at, at + len(line), max(kind[1], run[3] if run else 0), [*(run[4] if run else []), line])
        at += len(line or "") + 1
    return out


def test_findings_of_the_corpus_are_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = ls.train(docs)
    got = {}
    for r in ls.findings(docs, c).collect():
        got.setdefault(r.doc_id, []).append((r.family, r.start, r.end, round(r.probability, 9), r.template, round(r.similarity, 9), r.confirmed))
    want = {r.doc_id: f for r in docs.collect() if (f := brute_findings(c, r.text))}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and want


def test_threshold_keeps_its_promise(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    strict, loose = ls.train(docs, false_share=0.0), ls.train(docs, false_share=0.2)
    assert strict.least >= loose.least >= 0.5
