"""Exact top-k search: Voronoi kNN join of queries with data.

Pivots split vectors into Voronoi cells (every vector belongs to its nearest pivot). All that the planning needs of a cell
are summaries: the data's number and k + 1 least distances to the pivot, the queries' number and radius.

1. Assign every vector to its cell; add up the summaries.
2. Bound, from summaries alone: a data vector s of cell j is no farther from a query of cell i than
   radius(i) + |p_i - p_j| + |p_j - s|. The k + 1 least of these over all cells bound the distance that any query of cell i
   has to its k-th neighbour (one more, as a query is no neighbour of itself).
3. Group: cells with queries join their nearest ones until a group has about ``query_block`` queries.
4. Replicate a data vector s to a group, once, if for any of its cells i the triangle inequality lets it be near enough,
   |p_i - s| - radius(i) <= bound(i), and the hyperplane between s's cell and i isn't farther than that either.
5. Solve locally. A crowded cell's queries are cut into parts of ``query_block`` rows, and the data of a group into parts, so that
   every problem is small; each sends its k best for each query, and these are merged.

Vectors travel packed, many to a row, as wide as they are stored. Distances are Euclidean; for vectors of unit length the
order is that of cosine similarity. Candidates come from a matrix product, and the distances of those near the k-th are then
computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mix64, written

K = 10
#: Queries of a local problem, and of a group of cells.
QUERY_BLOCK = 8192
#: Data vectors of a local problem, by what the summaries let it have.
DATA_BLOCK = 32_768
#: The number of pivots is this times the square root of the number of vectors.
PIVOTS_PER_ROOT = 0.5

RESULT = "vec_id bigint, rank int, neighbor_id bigint, distance double"
_RESULT = pa.schema([("vec_id", pa.int64()), ("rank", pa.int32()), ("neighbor_id", pa.int64()), ("distance", pa.float64())])


def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float64 vectors of the usable rows of (id, list of numbers)."""
    lists = batch.column(1)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
    n = len(lists)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.reshape(n, -1) if n else np.zeros((0, 1))


def usable(data: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` of rows that have an id and a vector of finite numbers only."""
    kind = data.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(f"`{vector_col}`").cast("array<float>" if single else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return data.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & fine)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and ``b`` by a matrix product; off by rounding."""
    return np.sqrt(np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T))


def chunks(x: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """By stretches of rows: distances to all pivots, nearest pivot, and the exact distance to it."""
    for lo in range(0, len(x), 1024):
        own = slice(lo, lo + 1024)
        d = distances(x[own], pivots)
        cell = np.argmin(d, axis=1)
        yield own, d, cell, np.sqrt(((x[own] - pivots[cell]) ** 2).sum(axis=1))


def assign(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, and the distance to it."""
    got = [(cell, far) for _, _, cell, far in chunks(x, pivots)]
    return np.concatenate([np.zeros(0, np.int64), *[c for c, _ in got]]), np.concatenate([np.zeros(0), *[f for _, f in got]])


@dataclass
class Plan:
    """Pivots, and by cell: number of queries, their radius, the bound on their distance to a k-th neighbour, and the group
    (-1 without queries); by group: parts of its queries and of its data. Grows with the square root of the rows."""

    pivots: np.ndarray
    queries: np.ndarray
    radius: np.ndarray
    bound: np.ndarray
    group: np.ndarray
    query_parts: np.ndarray
    data_parts: np.ndarray

    def slack(self) -> float:
        """More than rounding can take off a distance to a pivot."""
        return 1e-6 * (1 + float(np.abs(self.pivots).max(initial=0)) * self.pivots.shape[1] ** 0.5)


def bounds(pivots: np.ndarray, radius: np.ndarray, nearest: list[np.ndarray], k: int) -> np.ndarray:
    """For each cell, the k + 1-th least of radius(i) + |p_i - p_j| + |p_j - s| over all cells' summaries."""
    owner = np.repeat(np.arange(len(pivots)), [len(x) for x in nearest])
    near = np.concatenate([np.zeros(0), *nearest])
    out = np.full(len(pivots), np.inf)
    if len(near) <= k:
        return out  # every vector is a neighbour
    for lo in range(0, len(pivots), 64):
        gap = distances(pivots[lo : lo + 64], pivots)
        out[lo : lo + 64] = radius[lo : lo + 64] + np.partition(gap[:, owner] + near, k, axis=1)[:, k]
    return out


def grouped(pivots: np.ndarray, queries: np.ndarray, query_block: int) -> np.ndarray:
    """The group of each cell: the first cell left and its nearest ones, until the group has ``query_block`` queries."""
    group, g = np.full(len(pivots), -1), 0
    left = np.nonzero(queries)[0]
    while len(left):
        near = left[np.argsort(distances(pivots[left[:1]], pivots[left])[0], kind="stable")]
        n = max(1, int(np.searchsorted(np.cumsum(queries[near]), query_block, side="right")))
        group[near[:n]] = g
        left, g = np.setdiff1d(near[n:], near[:0]), g + 1
    return group


def _summaries(data: DataFrame, held, k: int) -> dict[int, tuple[int, float, np.ndarray]]:
    """By cell: number, radius and k least distances to the pivot (none for k = 0)."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, radius, nearest = np.zeros(len(held.value), np.int64), np.zeros(len(held.value)), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            _, x = vectors(batch)
            cell, far = assign(x, held.value)
            count += np.bincount(cell, minlength=len(count))
            np.maximum.at(radius, cell, far)
            order = np.lexsort((far, cell))
            first = np.searchsorted(cell[order], np.arange(len(count) + 1))
            for c in np.unique(cell) if k else ():
                own = far[order[first[c] : min(first[c] + k, first[c + 1])]]
                nearest[c] = np.sort(np.concatenate([nearest.get(c, own[:0]), own]))[:k]
        there = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(count[there]), pa.array(radius[there]), pa.array([nearest.get(c, np.zeros(0)) for c in there], pa.list_(pa.float64()))], names=["cell", "count", "radius", "nearest"])

    sent = data.mapInArrow(summarize, "cell bigint, count bigint, radius double, nearest array<double>")
    got = sent.groupBy("cell").agg(F.sum("count").alias("count"), F.max("radius").alias("radius"), F.slice(F.sort_array(F.flatten(F.collect_list("nearest"))), 1, max(1, k)).alias("nearest"))
    return {r.cell: (r["count"], r.radius, np.array(r.nearest)) for r in got.collect()}  # a row a pivot


def make_plan(data: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> Plan | None:
    """``data`` and ``queries``: usable rows in tables that can be read again. Pivots are the data of the least id hashes.
    None without data or queries."""
    n, dims, least = data.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    m, q_dims, q_least = queries.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
    if not n or not m:
        return None
    if len({dims, least, q_dims, q_least}) > 1:
        raise ValueError("vectors differ in their number of dimensions")
    wanted = max(1, round(PIVOTS_PER_ROOT * n**0.5))
    rows = data.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id", "v").limit(wanted).toArrow()  # grows with the root of the rows
    pivots = np.unique(np.asarray(pc.list_flatten(rows.column("v").combine_chunks()), np.float64).reshape(-1, dims), axis=0)
    held = data.sparkSession.sparkContext.broadcast(pivots)
    count, far, asked, radius, nearest = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), [np.zeros(0)] * len(pivots)
    for c, (a, b, x) in _summaries(data, held, k + 1).items():
        count[c], far[c], nearest[c] = a, b, x
    for c, (a, b, _) in _summaries(queries, held, 0).items():
        asked[c], radius[c] = a, b
    bound = bounds(pivots, radius, nearest, k)
    group = grouped(pivots, asked, query_block)
    groups = int(group.max()) + 1
    plan = Plan(pivots, asked, radius, bound, group, np.ones(groups, np.int64), np.ones(groups, np.int64))
    for g in range(groups):  # at most the data of all cells that may hold what the group's queries reach
        own = np.nonzero(group == g)[0]
        plan.query_parts[g] = -(-int(asked[own].sum()) // query_block) if len(own) == 1 else 1
        reached = np.zeros(len(pivots), bool)
        for lo in range(0, len(own), 64):
            some = own[lo : lo + 64]
            reached |= (distances(pivots[some], pivots) - far <= (radius + bound)[some, None] + plan.slack()).any(axis=0)
        plan.data_parts[g] = max(1, -(-int(count[reached].sum()) // data_block))
    return plan


_PACK = pa.schema([("group", pa.int64()), ("query_part", pa.int32()), ("data_part", pa.int32()), ("queries", pa.bool_()), ("ids", pa.binary()), ("vectors", pa.binary())])


def _packs(rows: list[tuple[int, int, int, bool, np.ndarray, np.ndarray]], kind: str) -> Iterator[pa.RecordBatch]:
    if rows:
        packed = [(*r[:4], r[4].tobytes(), r[5].astype(kind).tobytes()) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*packed), _PACK)], schema=_PACK)


def _send_queries(held, kind: str):
    """Packs of queries: to their group, by part, once for each part of the group's data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = vectors(batch)
            group = plan.group[assign(x, plan.pivots)[0]]
            part = (mix64(ids.view(np.uint64)) % plan.query_parts[group].astype(np.uint64)).astype(np.int64)
            for g in np.unique(group).tolist():
                rows = []
                for q in np.unique(part[group == g]).tolist():
                    own = (group == g) & (part == q)
                    rows += [(g, q, d, True, ids[own], x[own]) for d in range(plan.data_parts[g])]
                yield from _packs(rows, kind)

    return run


def _send_data(held, kind: str):
    """Packs of data: to every group that may need them, by part, once for each part of the group's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        asked = np.nonzero(plan.queries)[0]
        asked = asked[np.argsort(plan.group[asked], kind="stable")]
        first = np.searchsorted(plan.group[asked], np.arange(len(plan.data_parts)))
        reach, bound, slack = (plan.radius + plan.bound)[asked] + plan.slack(), np.minimum(plan.bound[asked], 1e150), plan.slack()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = vectors(batch)
            needed = np.zeros((len(ids), len(first)), bool)
            for own, d, cell, far in chunks(x, plan.pivots):
                near = d[:, asked] <= reach
                kinds, at = np.unique(cell, return_inverse=True)
                gap = distances(plan.pivots[kinds], plan.pivots[asked])[at]
                near &= d[:, asked] ** 2 - far[:, None] ** 2 <= 2 * gap * (bound + slack) + slack
                needed[own] = np.logical_or.reduceat(near, first, axis=1)
            spread = mix64(ids.view(np.uint64)) >> np.uint64(32)
            for g in np.nonzero(needed.any(axis=0))[0].tolist():
                own = np.nonzero(needed[:, g])[0]
                part = (spread[own] % np.uint64(plan.data_parts[g])).astype(np.int64)
                rows = []
                for d in np.unique(part).tolist():
                    some = own[part == d]
                    rows += [(g, q, d, False, ids[some], x[some]) for q in range(plan.query_parts[g])]
                yield from _packs(rows, kind)

    return run


def local_top(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, id and exact distance of each query's k nearest of ``d`` other than itself, in order; ties by id."""
    rows, ids, dists = [], [], []
    order = np.argsort(d_ids, kind="stable")
    d_ids, d = d_ids[order], d[order]
    scale = 1e-9 * (1 + float((q**2).sum(axis=1).max(initial=0)) + float((d**2).sum(axis=1).max(initial=0)))
    for lo in range(0, len(q), 512):
        part = q[lo : lo + 512]
        square = np.maximum(0, (part**2).sum(axis=1)[:, None] + (d**2).sum(axis=1) - 2 * part @ d.T)
        square[q_ids[lo : lo + 512, None] == d_ids] = np.inf
        if square.shape[1] > k:
            limit = np.partition(square, k - 1, axis=1)[:, k - 1] + scale
            r, c = np.nonzero(square <= limit[:, None])
        else:
            r, c = np.nonzero(np.isfinite(square))
        exact = ((part[r] - d[c]) ** 2).sum(axis=1)
        by = np.lexsort((d_ids[c], exact, r))
        r, c, exact = r[by], c[by], exact[by]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (d_ids[c[1:]] != d_ids[c[:-1]])  # repeated rows of one id are one neighbour
        r, c, exact = r[new], c[new], exact[new]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < k
        rows.append(r[top] + lo)
        ids.append(d_ids[c[top]])
        dists.append(np.sqrt(exact[top]))
    cat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return cat(rows, np.int64), cat(ids, np.int64), cat(dists, np.float64)


def _solve(k: int, dims: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("queries").to_numpy()
        ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        xs = [np.frombuffer(x, kind).reshape(-1, dims) for x in table.column("vectors").to_pylist()]
        side = lambda s: (np.concatenate([np.zeros(0, np.int64), *[i for i, m in zip(ids, is_query) if m == s]]), np.concatenate([np.zeros((0, dims)), *[x for x, m in zip(xs, is_query) if m == s]]).astype(np.float64))
        (q_ids, q), (d_ids, d) = side(True), side(False)
        if not len(q) or not len(d):
            return _RESULT.empty_table()
        r, n, dist = local_top(q_ids, q, d_ids, d, k)
        return pa.table([pa.array(q_ids[r]), pa.array((np.arange(len(r)) - np.searchsorted(r, r) + 1).astype(np.int32)), pa.array(n), pa.array(dist)], schema=_RESULT)

    return run


def knn_join(data: DataFrame, queries: DataFrame | None = None, k: int = K, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors of every query: ``vec_id``, ``rank`` from 1, ``neighbor_id``, Euclidean ``distance``.

    Exact. ``queries`` has the columns of ``data``; without it every row of ``data`` is a query too. A query is no neighbour of
    the data vector of its own id. Ties go to the lesser id. Rows without an id, and vectors that are null, empty or
    hold a null, NaN or infinity, have no part in it. Rows that share an id are one vector (the first in the order of
    numbers). With k or fewer vectors to choose from all are returned. Vectors of different
    lengths are an error. Other columns are ignored; empty data or no queries give an empty result.
    """
    if k < 1 or query_block < 1 or data_block < 1:
        raise ValueError("k and blocks must be positive")
    spark = data.sparkSession
    fine = lambda x, name: written(usable(x, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), name)
    own = fine(data, "vectors")
    asked = own if queries is None else fine(queries, "queries")
    plan = make_plan(own, asked, k, query_block, data_block)
    if plan is None:
        return spark.createDataFrame([], RESULT)
    kind = "<f4" if all(x.schema["v"].dataType.elementType == T.FloatType() for x in (own, asked)) else "<f8"
    held = spark.sparkContext.broadcast(plan)
    schema = "group bigint, query_part int, data_part int, queries boolean, ids binary, vectors binary"
    packs = asked.mapInArrow(_send_queries(held, kind), schema).union(own.mapInArrow(_send_data(held, kind), schema))
    found = packs.groupBy("group", "query_part", "data_part").applyInArrow(_solve(k, plan.pivots.shape[1], kind), RESULT)
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbor_id")).alias("rank")
    return found.select("vec_id", place, "neighbor_id", "distance").where(F.col("rank") <= k)
