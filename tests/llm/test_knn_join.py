"""Voronoi kNN join against brute force; bounds; odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from annolith.llm import knn_join

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k):
    out = {}
    for i, a in zip(ids, x):
        d = np.sqrt(((x - a) ** 2).sum(axis=1))
        best = sorted((float(v), int(j)) for v, j in zip(d, ids) if j != i)[:k]
        out[int(i)] = [j for _, j in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r.vec_id, []).append(r.neighbor_id)
    return out


@pytest.mark.parametrize("block,data_block,per_root,some", [(4096, 4096, 0.5, False), (16, 50, 0.5, False), (64, 1000, 2.0, False), (5, 30, 2.0, True), (4096, 4096, 0.5, True)])
def test_same_as_brute_force(spark, block, data_block, per_root, some, monkeypatch):
    monkeypatch.setattr(knn_join, "PIVOTS_PER_ROOT", per_root)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5))
    x = np.float32(centres[rng.integers(6, size=400)] + 0.05 * rng.normal(size=(400, 5))).astype(np.float64)
    x[50:60] = x[40]  # ties
    ids = rng.permutation(400) * 3
    docs = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    queries = docs.where("vec_id % 5 = 0") if some else None
    want = {i: n for i, n in brute(ids, x, 7).items() if not some or i % 5 == 0}
    assert found(knn_join.knn_join(docs, queries, 7, block, data_block)) == want


def test_groups_are_near_cells_and_far_data_are_not_replicated(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 2)) + c for c in ([0, 0], [100, 0], [0, 100], [100, 100])])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1)
    plan = knn_join.make_plan(docs, docs, 3, 500)
    there = plan.queries > 0
    assert (plan.bound[there] < 10).all() and (plan.group[there] >= 0).all() and plan.queries.sum() == 2000
    corner = (plan.pivots > 50) @ [1, 2]
    assert all(len(set(corner[plan.group == g])) == 1 for g in range(len(plan.data_parts)) if (plan.group == g).sum() > 3)

    class Held:
        value = plan

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(x.tolist())], names=["id", "v"])
    sent = sum(len(v) // 8 for b in knn_join._send_data(Held, "<f8")(iter([batch])) for v in b.column(4).to_pylist())
    assert 2000 <= sent < 4 * 2000


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [], 1), (5, [float("nan"), 0.0], 1), (6, [None, 1.0], 1), (None, [0.0, 1.0], 1), (7, [0.0, 0.0], 1)]
    data = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS cell")
    assert found(knn_join.knn_join(data, k=3)) == {1: [7, 2], 2: [1, 7], 7: [1, 2]}
    assert knn_join.knn_join(data.limit(0), k=3).count() == 0
    assert knn_join.knn_join(data.where("vec_id = 2"), k=3).count() == 0
    assert knn_join.knn_join(data, data.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        knn_join.knn_join(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SCHEMA), k=3)
