"""The pipeline: stages' columns and effects, and run() against the stages one by one."""

import os

import pytest

import corpus_pipeline as cp
from annolith.llm import mixing, secret_scan, simhash_dedup
from annolith.llm.shared import written


def test_stages_in_order_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns, now, counts = docs.columns, docs, []
    for name, stage in cp.STAGES[:-1]:
        now = written(stage(spark, now, sf_dir), name)
        assert now.columns == columns
        counts.append(now.count())
        if name == "simhash_near_dedup":
            assert simhash_dedup.classes(now).where("doc_id <> class_id").count() == 0
        if name == "secret_scans":
            assert secret_scan.secrets(now).count() == 0
    assert len(cp.STAGES) == 5 and counts[0] < docs.count() and counts[1] < counts[0] and counts[2] == counts[1]
    last = cp.STAGES[-1][1](spark, now, sf_dir)
    got = sorted((r.doc_id, r.n_pieces) for r in last.collect())
    assert [i for i, _ in got] == sorted(r.doc_id for r in now.collect())
    kept = {i for i, _ in got}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.8 * len(clean)  # the rest are copies
    assert sorted((r.doc_id, r.n_pieces) for r in cp.run(spark, sf_dir).collect()) == got


def test_empty_documents(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


LONG = " ".join(f"the day{i % 977} of a week in which it is said{i % 31}" for i in range(4_000))
SECRET = "AKIA" + "ABCDEFGHIJKLMNOP"


def test_odd_rows_in_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = docs.schema
    odd = [(None, None, None, None, None), (None, "the word of a day and of the night is in it", "en", "s", 43), (9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, " \n ", None, None, 3), (9004, LONG, "en", "s", len(LONG)), (9005, f"the key of the house is {SECRET} and it is for the day", None, "s", 1)]
    every = docs.limit(60).union(spark.createDataFrame(odd, schema)).union(spark.createDataFrame([odd[5], odd[6]], schema))
    every = written(every, "odd")
    clash = every.selectExpr("*", "'x' AS rate", "1 AS score", "2 AS node", "'y' AS rule", "3 AS `__id`")
    out = {}
    for name, stage in cp.STAGES:
        rows = stage(spark, every, sf_dir).collect()
        out[name] = rows
        wide = stage(spark, clash, sf_dir)
        assert wide.count() == len(rows)
        if name != "sentencepiece":
            assert wide.columns == clash.columns and all(r.asDict() for r in rows)
    ids = lambda name: [r.doc_id for r in out[name]]
    # quality rules: blank texts go, repeated rows are judged alike
    assert not {9001, 9002, 9003} & set(ids("quality_rules")) and ids("quality_rules").count(9004) in (0, 2)
    # near duplicates: rows of one id stay or go together; rows without an id or without words stay
    kept = ids("simhash_near_dedup")
    assert kept.count(9004) == 2 and kept.count(None) == 2 and {9001, 9002, 9003} <= set(kept)
    # secrets: every row stays, lengths follow
    red = out["secret_scans"]
    assert len(red) == every.count() and not any(SECRET in (r.text or "") for r in red)
    assert all(r.n_chars == len(r.text) for r in red if r.doc_id == 9005) and sum(r.text is None for r in red) == 2
    # mixing: repeated rows equally often
    mixed = ids("target_weight_mixing")
    assert mixed.count(9004) % 2 == 0 and mixed.count(9005) % 2 == 0
    # pieces: a row a row
    pieces = out["sentencepiece"]
    assert len(pieces) == every.count() and sum(r.piece_ids is None for r in pieces) == 2 and len({tuple(r.piece_ids) for r in pieces if r.doc_id == 9004}) == 1


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("the test tables are not here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
    copies = {r.doc_id for r in simhash_dedup.classes(docs).where("doc_id <> class_id").collect()}
    kept = {r.doc_id for r in cp.run(spark, sf).collect()}
    assert len(clean - copies - kept) <= 0.02 * len(clean - copies) and not kept & copies


def test_targets_of_the_mixture_are_met(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.train(docs, labels)
    scored = written(mixing.score(docs, model), "scored")
    assert abs(mixing.fit(scored, model, cp.TARGETS, relative=True).residual).max() < 1e-3
