"""Soft-membership mixing: document rates whose expected domain token totals match targets.

1. A classifier trained on the labelled table predicts each document's domain posteriors p (softmax regression on words).
2. Spark adds up tokens by cells of the posteriors, rounded to 1 / ``GRID``: documents of a cell have the same gradient at every
   step, so that sums over cells are sums over all documents. There are at most C(GRID + 2, 2), half a million, at any size.
3. With n tokens in a document, the rates r >= 0 are fitted by projected gradient descent (accelerated) from r = 1 on
   1/2 sum_k (sum_d n_d p_dk r_d - t_k)**2 / (s_k N) + ridge/2 sum_d (n_d / N) (r_d - 1)**2,
   s_k N being domain k's expected tokens as they are and t_k its target. In this scaling the step 1 / (1 + ridge) is safe. The
   ridge is so small that it only chooses among the rates that meet the targets: those nearest one. It ends when no step moves
   a rate by more than ``TOLERANCE``. What targets that can't be met leave open is returned as the residual.
4. A document is taken floor(rate + u) times, u in [0, 1) from a hash of its id: as many times as its rate, on average.

Domains come from ``labels``: clean, low_quality (quality 0, not toxic) and toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .shared import hash_strings, id_and_text, slices, split_words, texts, written

DOMAINS = ["clean", "low_quality", "toxic"]
#: Share of all tokens that each domain is to have.
TARGETS = {"clean": 0.90, "low_quality": 0.05, "toxic": 0.05}
TRAIN_ROWS = 8_000
GRID = 1_000
RIDGE = 1e-6
TOLERANCE = 1e-7
MIN_ROWS = 3
LEAST_Z = 4.0
PENALTY = 0.01
TRAIN_STEPS = 150


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token (lower case, without a closing comma or full stop), and the number of tokens of each text."""
    codes, words, lens = split_words(pc.utf8_lower(text))
    return hash_strings(pc.utf8_rtrim(words, ".,"))[codes], lens


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        h, lens = words_of(texts(batch))
        lists = [np.unique(x).view(np.int64) for x in np.split(h, np.cumsum(lens)[:-1])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "features"])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> linear.Model:
    """The domain classifier, from at most ``train_rows`` labelled rows (those of the least id hashes).

    ``labels`` has ``doc_id``, ``quality`` and ``toxic``; rows with a null in any are no labels, of several labels for an id
    the worst counts. Labels of documents that ``docs`` lacks are not used. Without labels every posterior is the same.
    """
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).dropna()
    own = own.groupBy("doc_id").agg(F.max(F.when(F.col("t") != 0, 2).when(F.col("q") == 0, 1).otherwise(0)).alias("domain"))
    there = docs.select(F.col(id_col).cast("bigint").alias("doc_id"))
    own = own.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = id_and_text(docs, id_col, text_col).join(F.broadcast(own), "doc_id")  # bounded by the parameter
    sample = written(chosen.select("doc_id", "text").mapInArrow(_features, "doc_id bigint, features array<bigint>").join(F.broadcast(own.withColumnRenamed("domain", "target")), "doc_id"), "sample")
    keys = linear.strong_features(sample, len(DOMAINS), MIN_ROWS, LEAST_Z)
    held = docs.sparkSession.sparkContext.broadcast(keys)

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.intersect1d(x.values.to_numpy().view(np.uint64), held.value, assume_unique=True).view(np.int64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "target", "features"])

    rows = sample.select("doc_id", "target", "features").mapInArrow(strong, "doc_id bigint, target int, features array<bigint>").orderBy("doc_id", "target", F.xxhash64("features")).toArrow()
    feats = [x.values.to_numpy().view(np.uint64) for x in rows.column("features")]
    return linear.fit(feats, rows.column("target").to_numpy().astype(np.int64), DOMAINS, min_rows=MIN_ROWS, least_z=LEAST_Z, l2=PENALTY, steps=TRAIN_STEPS)


def posteriors(model: linear.Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Domain probabilities and token count of each text."""
    h, lens = words_of(text)
    return model.posteriors(h, np.repeat(np.arange(len(lens)), lens), len(lens)), lens


@dataclass
class Fit:
    """The classifier; the cells of posteriors in units of 1 / ``GRID`` (sorted keys) and their rates; fitted minus target shares."""

    model: linear.Model
    keys: np.ndarray
    rate: np.ndarray
    residual: np.ndarray

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Rates of posteriors; where rounding puts one into a cell that was not seen, of the nearest cell seen. 1 without cells."""
        if not len(self.keys):
            return np.ones(len(p))
        key = cell_of(p)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        for i in np.nonzero(self.keys[at] != key)[0]:
            at[i] = np.abs(units_of(self.keys, p.shape[1]) / GRID - p[i]).sum(axis=1).argmin()
        return self.rate[at]


def cell_of(p: np.ndarray) -> np.ndarray:
    """A number for each row's cell: the rounded cumulative posteriors, without the last."""
    up = np.floor(np.cumsum(p[:, :-1], axis=1) * GRID + 0.5).astype(np.int64)
    key = np.zeros(len(p), np.int64)
    for k in range(up.shape[1]):
        key = key * (GRID + 1) + up[:, k]
    return key


def units_of(keys: np.ndarray, domains: int) -> np.ndarray:
    """Posteriors of cells, in units of 1 / ``GRID``; they add up to it."""
    up = [np.full(len(keys), GRID, np.int64)]
    for _ in range(domains - 1):
        up.append(keys % (GRID + 1))
        keys = keys // (GRID + 1)
    up.append(np.zeros(len(keys), np.int64))
    return np.diff(np.stack(up[::-1], axis=1), axis=1)


def cell_column(p: Column, domains: int) -> Column:
    """:func:`cell_of` in Spark."""
    key, up = F.lit(0).cast("bigint"), F.lit(0.0)
    for k in range(domains - 1):
        up = F.element_at(p, k + 1) if not k else up + F.element_at(p, k + 1)
        key = key * (GRID + 1) + F.floor(up * GRID + 0.5)
    return key


def descend(p: np.ndarray, n: np.ndarray, goal: np.ndarray, ridge: float = RIDGE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Rates of rows with posteriors ``p`` and ``n`` tokens, and what shares they miss the goal by (see the module)."""
    weight = n / n.sum()
    share = np.maximum(weight @ p, 1e-6)
    r = ahead = np.ones(len(n))
    pace = 1.0
    while True:
        g = ((weight * ahead) @ p - goal) / share
        new = np.maximum(0, ahead - (p @ g + ridge * (ahead - 1)) / (1 + ridge))
        move = new - r
        if np.abs(new - ahead).max() <= tolerance:
            return new, (weight * new) @ p - goal
        if ((ahead - new) * weight) @ move > 0:  # it goes back: start the acceleration anew
            pace, ahead = 1.0, new
        else:
            faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
            ahead = np.maximum(0, new + (pace - 1) / faster * move)
            pace = faster
        r = new


def score(docs: DataFrame, model: linear.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``posterior`` (an array in the order of the model's classes), one row a row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p, lens = posteriors(held.value, texts(batch))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lens), lists], names=["doc_id", "n_tokens", "posterior"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, posterior array<double>")


def fit(scored: DataFrame, model: linear.Model, targets: dict[str, float] = TARGETS, ridge: float = RIDGE, tolerance: float = TOLERANCE, relative: bool = False) -> Fit:
    """Fit rates to ``targets`` (shares of all tokens, by class; they may add up to more or less than one; a class not named
    is to have none). ``relative``: targets are multiples of the tokens that a class is expected to have as it is, and the classes
    not named share in proportion what is left of all tokens. ``scored``: :func:`score`'s result, read once. Documents without tokens have no part in it; without any,
    rates are 1 and residuals 0."""
    names = model.classes
    if unknown := set(targets) - set(names):
        raise ValueError(f"no such domain: {sorted(unknown)}")
    if any(not 0 <= x < float("inf") for x in targets.values()):
        raise ValueError("targets must be numbers that are not negative")
    cell = cell_column(F.col("posterior"), len(names)).alias("cell")
    got = scored.where("n_tokens > 0").groupBy(cell).agg(F.sum(F.col("n_tokens").cast("double")).alias("n")).toArrow()  # bounded by GRID
    keys, n = got.column("cell").to_numpy().astype(np.int64), got.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    if not len(keys):
        return Fit(model, keys, n, np.zeros(len(names)))
    p = units_of(keys, len(names)) / GRID
    goal = np.array([targets.get(k, 0.0) for k in names])
    if relative:
        there = n @ p / n.sum()
        named = np.array([k in targets for k in names])
        goal = np.where(named, goal * there, 0)
        goal = np.where(named, goal, there * max(0.0, 1 - goal.sum()) / max(there[~named].sum(), 1e-12))
    rate, residual = descend(p, n, goal, ridge, tolerance)
    return Fit(model, keys, rate, residual)


def _draw(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(0))), F.lit(1 << 20)) / (1 << 20)


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: its tokens, posteriors, fitted ``rate``, ``copies`` to take, and for each domain the
    ``residual_...``: the share of all tokens that the fitted rates miss its target by, the same in every row.

    Null and empty texts have no tokens and the rate of the classifier's bias alone. Rows that share an id and text (repeated
    rows, ties) get the same rate and copies; a null id draws as id 0 does. Other columns are ignored; an empty table gives an
    empty result.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = written(score(docs, model, id_col, text_col), "scored")
    found = docs.sparkSession.sparkContext.broadcast(fit(scored, model, targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = pc.list_flatten(batch.column(2)).to_numpy().reshape(batch.num_rows, -1)
                rate = found.value.rates(p)
                times = np.floor(rate + batch.column(3).to_numpy()).astype(np.int32)
                left = [np.full(len(p), x) for x in found.value.residual]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(c)) for c in p.T], pa.array(rate), pa.array(times), *map(pa.array, left)], names=names)

    names = ["doc_id", "n_tokens", *[f"p_{k}" for k in DOMAINS], "rate", "copies", *[f"residual_{k}" for k in DOMAINS]]
    kinds = ["bigint", "bigint", *["double"] * len(DOMAINS), "double", "int", *["double"] * len(DOMAINS)]
    return scored.select("doc_id", "n_tokens", "posterior", _draw("doc_id")).mapInArrow(run, ", ".join(f"{a} {b}" for a, b in zip(names, kinds)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, relative: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as :func:`rates` says (0 to several times), columns unchanged; texts aren't shuffled.
    ``relative``: see :func:`fit`."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    found = docs.sparkSession.sparkContext.broadcast(fit(score(docs, model, id_col, text_col), model, targets, relative=relative))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            p, _ = posteriors(found.value.model, texts(batch, text_col))
            times = np.floor(found.value.rates(p) + batch.column(batch.num_columns - 1).to_numpy()).astype(np.int64)
            take = np.repeat(np.arange(batch.num_rows), times)
            for lo in range(0, len(take), 10_000):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(take[lo : lo + 10_000])) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

    return docs.select("*", _draw(id_col).alias("__draw")).mapInArrow(run, docs.schema)
