"""Quality rules: an isolation forest on rule statistics.

Each rule is a statistic of a text's own characters and words. Trees split a random rule at a random value between the
least and the greatest in their subsample; documents that few splits isolate are anomalous. The score is the usual one,
2 ** (-mean path length / expected path length), and documents that score above a threshold are rejected. The threshold
comes from labelled rows: the one that rejects most bad rows while it rejects at most ``clean_loss`` of the good ones.

Training takes all labelled rows: each tree's subsample, of a fixed size as isolation forests have it, is drawn from all of them
(the trees don't use the labels), and the threshold is exact over all of them. From all of them, too, come the words that prose
can't do without: those in at least ``COMMON_SHARE`` of the rows, in whatever languages they are written.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_strings, id_and_text, mix64, remove, segment_sums, slices, split_words, texts, written, written_at

RULES = ["symbol_share", "shout_share", "bar_share", "mark_share", "word_length", "common_share", "repeated_lines", "repeated_words"]
TREES = 200
SUBSAMPLE = 256
CLEAN_LOSS = 0.003
#: Labels that are looked up in memory at most, 9 bytes each; more are joined by a shuffle.
LABELS_HELD = 20_000_000
#: Parts of the scores' range that are counted at once in search of the threshold.
BINS = 4096
#: What every text is taken to hold besides its own words and lines, so that shares in a short text mean little.
PRIOR_WORDS, PRIOR_LENGTH, PRIOR_COMMON, PRIOR_LINES = 20, 5, 0.25, 3

#: Share of labelled documents that hold a common word: those of a language that as many documents are in.
COMMON_SHARE = 0.03

_KINDS = np.zeros(256, np.uint8)
for _c in b"#$%&*<>[\\]^`{}~":
    _KINDS[_c] = 1
for _c in range(65, 91):
    _KINDS[_c] = 2
_KINDS[ord("|")] = 3
for _c in b"!?":
    _KINDS[_c] = 4


_MARKS = ".,;:!?\"'()"


def statistics(text: pa.Array, common_words: list[str]) -> np.ndarray:
    """The rules' values, a row a text in the order of ``RULES``. A text without words has zeros everywhere."""
    n = len(text)
    large = text.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + n + 1]
    data = np.frombuffer(large.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if large.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kind = _KINDS[data]
    special = np.nonzero(kind)[0]
    counts = np.bincount(doc[special] * 5 + kind[special], minlength=5 * n).reshape(n, 5).astype(np.float64)
    space = np.bincount(doc[(data == 32) | (data == 10)], minlength=n)
    solid = size - space + PRIOR_WORDS * PRIOR_LENGTH
    codes, words, lens = split_words(pc.utf8_lower(text))
    n_words = lens + PRIOR_WORDS
    plain = pc.utf8_trim(words, _MARKS)
    common = pc.is_in(plain, pa.array(common_words, plain.type)).to_numpy(zero_copy_only=False)
    common_share = (segment_sums(common[codes].astype(np.int64), lens) + PRIOR_WORDS * PRIOR_COMMON) / n_words
    word_doc = np.repeat(np.arange(n), lens)
    same = np.zeros(len(codes), np.int64)
    if len(codes) > 2:  # trigrams seen before in the text
        h = hash_strings(words)[codes]
        tri = h[2:] + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + word_doc[2:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        inside = np.nonzero(word_doc[2:] == word_doc[:-2])[0]  # those that go from one text into the next are no trigrams
        tri = tri[inside]
        order = np.argsort(tri, kind="stable")
        again = np.zeros(len(tri), np.int64)
        again[order[1:]] = tri[order[1:]] == tri[order[:-1]]
        same[inside + 2] = again
    repeated_words = segment_sums(same, lens) / n_words
    lines = pc.split_pattern(text, "\n")
    flat, per = lines.flatten(), pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_doc = np.repeat(np.arange(n), per)
    distinct = np.bincount(np.unique(line_doc * (int(line.max(initial=0)) + 1) + line) // (int(line.max(initial=0)) + 1), minlength=n)
    out = np.stack([counts[:, 1] / solid, counts[:, 2] / solid, counts[:, 3] / n_words, counts[:, 4] / n_words, np.log(solid / n_words), common_share, (per - distinct) / (per + PRIOR_LINES), repeated_words], axis=1)
    out[lens == 0] = 0
    return out


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n in a binary search tree."""
    n = np.asarray(n, np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees in arrays: node i has children 2i + 1 and 2i + 2; a leaf sends everything left."""

    rule: np.ndarray
    at: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = math.inf
    common: list[str] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        depth = int(math.log2(self.rule.shape[1] + 1)) - 1
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for rule, at, path in zip(self.rule, self.at, self.path):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, rule[node]] >= at[node])
            total += path[node]
        return 2 ** (-total / max(1, len(self.rule)) / self.norm)


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> Forest:
    """A forest from random subsamples of ``x``; with fewer than two rows there is nothing to split."""
    rng = np.random.default_rng(seed)
    return grow_from((x[rng.permutation(len(x))[:subsample]] for _ in range(trees)), trees, min(subsample, len(x)), rng)


def grow_from(subsamples: Iterable[np.ndarray], trees: int, size: int, rng: np.random.Generator) -> Forest:
    """A tree from each of the subsamples, which have ``size`` rows."""
    depth = max(1, math.ceil(math.log2(max(2, size))))
    nodes = (1 << (depth + 1)) - 1
    rule, at, path = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    for t, drawn in enumerate(subsamples):
        todo = [(0, 0, drawn)]
        for node, level, own in todo:
            low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(1), np.zeros(1))
            open_rules = np.nonzero(high > low)[0]
            if level < depth and len(own) > 1 and len(open_rules):
                rule[t, node] = r = open_rules[rng.integers(len(open_rules))]
                at[t, node] = cut = low[r] + (high[r] - low[r]) * (1 - rng.random())
                right = own[:, r] >= cut
                todo += [(2 * node + 1, level + 1, own[~right]), (2 * node + 2, level + 1, own[right])]
            else:
                while True:  # a leaf above the last level hands its path length down on the left
                    path[t, node] = level + expected_path(len(own))
                    if 2 * node + 1 >= nodes:
                        break
                    node = 2 * node + 1
    return Forest(rule, at, path, float(max(1.0, expected_path(size))))


def calibrate(score: np.ndarray, good: np.ndarray, clean_loss: float = CLEAN_LOSS) -> float:
    """The least threshold that at most ``clean_loss`` of good rows exceed, if a bad one does; else infinity."""
    kept = np.sort(score[good])
    if not len(kept) or good.all():
        return math.inf
    at = float(kept[len(kept) - 1 - int(clean_loss * len(kept))])
    return at if (score[~good] > at).any() else math.inf


def calibrate_table(scored: DataFrame, clean_loss: float = CLEAN_LOSS) -> float:
    """:func:`calibrate` over a table of ``score`` and ``good`` of any size: the same value, found by counting ever finer bins."""
    good = scored.where("good")
    n, low, high = good.agg(F.count("*"), F.min("score"), F.max("score")).first()
    above = int(clean_loss * n)
    while n and low < high:  # the bin that holds the score that ``above`` good ones exceed
        each = good.where(F.col("score").between(low, high)).groupBy(F.floor((F.col("score") - low) / (high - low) * BINS).alias("bin"))
        for _, inside, low, high in each.agg(F.count("*"), F.min("score"), F.max("score")).orderBy(F.desc("bin")).collect():
            if above < inside:
                break
            above -= inside
    return low if n and scored.where(~F.col("good") & (F.col("score") > low)).count() else math.inf


def labelled(docs: DataFrame, labels: DataFrame, held: int = LABELS_HELD) -> DataFrame:
    """``doc_id``, ``text`` and ``good`` of every row that has a label. Up to ``held`` labels no text is shuffled."""
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    own = written(own.agg((F.min("quality").cast("double") != 0).alias("good")), "labels")
    if own.count() > held:
        return docs.select("doc_id", "text").join(own, "doc_id")
    got = own.toArrow().sort_by("doc_id")
    look = docs.sparkSession.sparkContext.broadcast((got["doc_id"].to_numpy(), got["good"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, good = look.value
        for batch in slices(batches):
            key = pc.fill_null(batch.column(0), 0).to_numpy()
            at = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
            hit = np.nonzero(batch.column(0).is_valid().to_numpy(zero_copy_only=False) & (ids[at] == key))[0] if len(ids) else at[:0]
            kept = batch.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(good[at[hit]], pa.bool_())], names=["doc_id", "text", "good"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string, good boolean")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(r).to_numpy() for r in RULES], axis=1)


def known_rows(rows: DataFrame, common: list[str]) -> DataFrame:
    """The rules' values of labelled rows; ``copy`` numbers rows that are the same in all else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(texts(batch), common)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in x.T], batch.column(2)], names=["doc_id", *RULES, "good"])

    each = rows.select("doc_id", "text", "good").mapInArrow(run, ", ".join(["doc_id bigint", *[f"{r} double" for r in RULES], "good boolean"]))
    return each.groupBy(*each.columns).agg(F.count("*").cast("int").alias("n")).select(*each.columns, F.explode(F.sequence(F.lit(1), "n")).alias("copy"))


def draw(known: DataFrame, trees: int, subsample: int) -> list[np.ndarray]:
    """Each tree's subsample, from all rows: those of the least hashes, which are others for each tree.

    Only rows whose hash is below a limit come to the driver, at the first limit some twice as many as are drawn, whatever the
    number of rows. It is raised until every tree has its rows.
    """
    n = known.count()
    size, most = min(subsample, n), (1 << 63) - 1
    limit = min(most, (2 * subsample + 64) * most // max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, key = _matrix(batch), batch.column("copy").to_numpy().astype(np.uint64)
            for c in [batch.column("doc_id").to_numpy(), *x.T]:
                key = mix64(key ^ np.ascontiguousarray(c).view(np.uint64))
            found = []
            for t in range(trees):
                h = (mix64(key + np.uint64(t * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(1)).astype(np.int64)
                at = np.nonzero(h <= limit)[0]
                found.append((np.full(len(at), t), h[at], at))
            tree, h, at = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(h), *[pa.array(c) for c in x[at].T]], names=["tree", "hash", *RULES])

    while True:
        got = known.mapInArrow(run, ", ".join(["tree bigint", "hash bigint", *[f"{r} double" for r in RULES]])).toArrow()
        tree, h = got["tree"].to_numpy(), got["hash"].to_numpy()
        x = np.stack([got[r].to_numpy() for r in RULES], axis=1)
        order = np.lexsort((*x.T, h, tree))
        ends = np.searchsorted(tree[order], np.arange(trees + 1))
        if limit == most or np.diff(ends).min(initial=size) >= size:
            return [x[order[i : i + size]] for i in ends[:-1]]
        limit = min(most, 2 * limit)


def scored_rows(known: DataFrame, forest: Forest) -> DataFrame:
    held = known.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(held.value.scores(_matrix(batch))), batch.column("good")], names=["score", "good"])

    return known.mapInArrow(run, "score double, good boolean")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with the number of a slice's documents that hold it."""
    for batch in slices(batches):
        codes, words, lens = split_words(pc.utf8_lower(texts(batch)))
        plain = pc.utf8_trim(words, _MARKS).dictionary_encode()
        n = max(1, len(plain.dictionary))
        pairs = np.unique(np.repeat(np.arange(len(lens)), lens) * n + plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes])
        count = np.bincount(pairs % n, minlength=len(plain.dictionary))
        yield pa.RecordBatch.from_arrays([plain.dictionary, pa.array(count.astype(np.int64))], names=["word", "n"])


def common_words(rows: DataFrame, share: float = COMMON_SHARE) -> list[str]:
    """Words in at least ``share`` of the rows, sorted: at most a text's mean number of distinct words / ``share``."""
    each = rows.select("doc_id", "text").mapInArrow(_words, "word string, n bigint").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(r.word for r in each.where(F.col("n") >= F.lit(share * rows.count())).collect())


def train(docs: DataFrame, labels: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, clean_loss: float = CLEAN_LOSS, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> Forest:
    """Grow and calibrate a forest from all labelled rows.

    ``labels`` has ``doc_id`` and ``quality`` (0 bad, else good; null is no label). Without labels on both sides nothing
    is rejected: the threshold is infinite. The result doesn't depend on how the rows are partitioned.
    """
    rows, path = written_at(labelled(id_and_text(docs, id_col, text_col), labels), "labelled")
    common = common_words(rows)
    known = written(known_rows(rows, common), "statistics")
    remove(docs.sparkSession, path)
    own = draw(known, trees, subsample)
    forest = grow_from(own, trees, len(own[0]) if own else 0, np.random.default_rng(seed))
    forest.common = common
    forest.threshold = calibrate_table(written(scored_rows(known, forest), "scores"), clean_loss)
    return forest


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's rule statistics, anomaly ``score`` and whether to ``keep`` it.

    A null or empty text, or one of white space only, has zero statistics and score 1, and isn't kept. Repeated rows are
    judged alike; a null id is returned as null. A score that ties with the threshold is kept. Texts of any length count whole.
    Other columns are ignored; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, score, keep = verdicts(texts(batch), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in x.T], pa.array(score), pa.array(keep)], names=["doc_id", *RULES, "score", "keep"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ", ".join(["doc_id bigint", *[f"{r} double" for r in RULES], "score double", "keep boolean"]))


def verdicts(text: pa.Array, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = statistics(text, forest.common)
    blank = pc.equal(pc.utf8_trim_whitespace(text), "").to_numpy(zero_copy_only=False)
    score = np.where(blank, 1.0, forest.scores(x))
    return x, score, ~blank & (score <= forest.threshold)


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """``docs`` without rejected rows, columns unchanged; one pass, no shuffle. See :func:`judge` for odd rows."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(verdicts(texts(batch, text_col), held.value)[2]))

    return docs.mapInArrow(run, docs.schema)
