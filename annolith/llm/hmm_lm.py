"""LM scoring with a hidden Markov language model over words.

1. Code. Each task codes its documents once, some ``HELD_TOKENS`` at a time (a slice): a dictionary of word hashes, the most
   frequent first, and the words as numbers in it, stored by bytes of the same weight, which compress well. Documents are cut into
   chunks of ``CHUNK`` tokens, and blocks of chunks are laid out time-major: all first tokens, then all second tokens, and so on.
   In this layout a step of the recursion is one contiguous stretch of many chunks.
2. Count. Every slice sends its words with their counts; Spark adds them up. This table, as large as the corpus's vocabulary,
   stays distributed. Words whose share of all tokens is ``min_share`` or more are symbols of their own, at most 1 / ``min_share``
   at any size; every other word belongs to a spelling class, one of ``RARE_CLASSES`` by its last two characters and its length.
3. Recursions. What a chunk does to any state is a matrix, the product of its steps; those of a document's chunks give the
   forward variables before each chunk and the backward variables after it. So all chunks advance together, a text of any length
   is ``CHUNK`` steps long, and the result is that of the recursion over the whole document.
4. Train. Baum-Welch: each task runs scaled forward and backward over its slices and sends expected counts, which Spark
   adds up by blocks of symbols; until an iteration gains less than ``TOLERANCE`` of the log-likelihood. The model has
   1 / ``min_share`` + ``RARE_CLASSES`` rows at most, so that the driver holds it and broadcasts it.
5. Score. A state emits a rare word with P(class | state) * P(word | class). The latter is the word's share of its class in
   the table of all words, to which the slices' rare words are joined. The scaled forward recursion, in double precision, gives
   the exact likelihood of each document's words: the sum over all state paths.

A word is its 64-bit hash with its spelling class. Loops run over time steps and states, never over words or documents;
memory is bounded by blocks of ``BLOCK`` tokens, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hash_strings, id_and_text, mix64, slices, split_words, texts, written

STATES = 8
#: Training ends when an iteration gains less than this share of the log-likelihood.
TOLERANCE = 1e-3
MIN_SHARE = 1e-5
RARE_CLASSES = 256
#: Tokens that a task codes in one slice, about.
HELD_TOKENS = 1 << 20
#: Tokens of a block of chunks.
BLOCK = 1 << 19
CHUNK = 1 << 13
#: Steps after which a product of matrices is scaled.
_SCALE_STEPS = 4
_PRIOR = 1.0
_SEND = 512


@dataclass
class Model:
    """``start[k]``, ``move[j, k]`` and ``emit[symbol, k]``; ``keys`` are the sorted hashes of words that are symbols."""

    keys: np.ndarray
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def single(self) -> Model:
        return Model(self.keys, *(np.ascontiguousarray(x, np.float32) for x in (self.start, self.move, self.emit)))


def rare_class(words: pa.Array) -> np.ndarray:
    """The spelling class of each word."""
    tail = hash_strings(pc.utf8_slice_codeunits(words, -2, None))
    size = np.minimum(pc.utf8_length(words).to_numpy(zero_copy_only=False), 12).astype(np.uint64)
    return (mix64(tail + size * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(RARE_CLASSES)).astype(np.int64)


def _active(lens: np.ndarray) -> np.ndarray:
    """For lengths in descending order the number of those longer than t, for each t."""
    return np.searchsorted(-lens, -np.arange(int(lens.max(initial=0))), side="left")


def time_major(lens: np.ndarray) -> np.ndarray:
    """For lengths in descending order: the position, in the order of sequences, of each token in time-major order."""
    active = _active(lens)
    t = np.repeat(np.arange(len(active)), active)
    rank = np.arange(len(t)) - np.repeat(np.cumsum(active) - active, active)
    return (np.cumsum(lens) - lens)[rank] + t


class Layout:
    """How the documents of a slice are cut into chunks, longest first, and chunks into blocks; it follows from the lengths."""

    def __init__(self, lens: np.ndarray, chunk: int = CHUNK, block: int = BLOCK):
        n = -(-lens // chunk)
        doc = np.repeat(np.arange(len(lens)), n)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(chunk, lens[doc] - number * chunk)
        order = np.argsort(-size, kind="stable")
        self.doc, self.number, self.size = doc[order], number[order], size[order]
        self.begin = (np.cumsum(lens) - lens)[self.doc] + self.number * chunk  # of each chunk in the order of documents
        self.chunks = n
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self._place, self._first = place, np.cumsum(n) - n
        self.blocks: list[tuple[int, int, int]] = []  # (first chunk, last + 1, first token)
        total, lo = np.cumsum(self.size), 0
        while lo < len(self.size):
            at = int(total[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, at + block, side="right")))
            self.blocks.append((lo, hi, at))
            lo = hi

    def places(self, docs: np.ndarray, number: int) -> np.ndarray:
        """Where the chunks of this number of some documents are."""
        return self._place[self._first[docs] + number]

    def tokens(self) -> np.ndarray:
        """For each token in this layout its position in the order of documents."""
        parts = [np.zeros(0, np.int64)]
        for lo, hi, _ in self.blocks:
            own = self.size[lo:hi]
            flat = np.repeat(self.begin[lo:hi] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            parts.append(flat[time_major(own)])
        return np.concatenate(parts)


_CODED = "slice bigint, ids binary, valid binary, lens binary, codes binary, words binary, classes binary, counts binary"
_CODED_FIELDS = pa.schema([("slice", pa.int64()), *[(c, pa.binary()) for c in ("ids", "valid", "lens", "codes", "words", "classes", "counts")]])


def code(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_tokens: int = HELD_TOKENS) -> DataFrame:
    """One row a slice of documents: ids, whether they are valid, token counts, words as numbers (in the order of
    :class:`Layout`), and hashes, classes and counts of the slice's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []
        for batch in slices(batches):
            codes, words, lens = split_words(pc.utf8_lower(texts(batch)))
            ids = batch.column(0)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False), lens, codes.astype(np.int32), hash_strings(words), rare_class(words)))
            if sum(len(h[3]) for h in held) >= held_tokens:
                row = _coded_row(number, held)
                held, number = [], number + 1
                pa.default_memory_pool().release_unused()
                yield row
        if held:
            yield _coded_row(number, held)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _CODED)


def _coded_row(number: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ids, valid, lens = (np.concatenate([h[i] for h in held]) for i in range(3))
    words, place, at = np.unique(np.concatenate([h[4] for h in held]), return_index=True, return_inverse=True)
    classes = np.concatenate([h[5] for h in held])[place]
    shift = np.cumsum([0, *[len(h[4]) for h in held]])
    codes = np.concatenate([at[s : s + len(h[4])].astype(np.int32)[h[3]] for h, s in zip(held, shift)])
    n = np.bincount(codes, minlength=len(words))
    there = np.argsort(-n, kind="stable")[: int((n > 0).sum())]
    rank = np.zeros(len(words), np.int32)
    rank[there] = np.arange(len(there), dtype=np.int32)
    planes = np.ascontiguousarray(rank[codes[Layout(lens).tokens()]].view(np.uint8).reshape(-1, 4).T)
    row = [ids, valid, lens.astype(np.int64), planes, words[there], classes[there].astype(np.int16), n[there].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in row]], schema=_CODED_FIELDS)


_KINDS = {"ids": np.int64, "valid": bool, "lens": np.int64, "codes": np.uint8, "words": np.uint64, "classes": np.int16, "counts": np.int64}


def _rows(table: pa.RecordBatch | pa.Table, *names: str) -> Iterator[list[np.ndarray]]:
    for i in range(table.num_rows):
        yield [np.frombuffer(table.column(c)[i].as_buffer(), _KINDS[c]) for c in names]


def _codes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()


def count(coded: DataFrame) -> DataFrame:
    """``word``, ``class`` and ``n`` of every word of a written :func:`code` table; distributed, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, classes, n in _rows(batch, "words", "classes", "counts"):
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(classes), pa.array(n)], names=["word", "class", "n"])

    each = coded.select("words", "classes", "counts").mapInArrow(run, "word bigint, class smallint, n bigint")
    return written(each.groupBy("word", "class").agg(F.sum("n").alias("n")), "words")


def vocabulary(counted: DataFrame, min_share: float = MIN_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that are symbols, and the counts of all symbols: those words', then the classes'."""
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1")
    total = counted.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") >= F.lit(min_share * total)
    got = counted.groupBy(F.when(common, F.col("word")).alias("word"), F.when(~common, F.col("class")).alias("class")).agg(F.sum("n").alias("n")).toArrow()  # at most 1 / min_share + RARE_CLASSES rows
    n = got.column("n").to_numpy().astype(np.float64)
    word = got.column("word").is_valid().to_numpy()
    keys = got.column("word").fill_null(0).to_numpy().view(np.uint64)
    order = np.argsort(keys[word])
    rare = np.zeros(RARE_CLASSES)
    rare[got.column("class").fill_null(0).to_numpy()[~word]] = n[~word]
    return keys[word][order], np.concatenate([n[word][order], rare])


def symbols_of(keys: np.ndarray, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol of each word, by its hash and class."""
    at = np.minimum(np.searchsorted(keys, words), max(0, len(keys) - 1))
    known = keys[at] == words if len(keys) else np.zeros(len(words), bool)
    return np.where(known, at, len(keys) + classes).astype(np.int32)


def transfers(m: Model, symbols: np.ndarray, at: Layout) -> np.ndarray:
    """Of each chunk of a document of several: the product of its steps up to a factor, as a matrix over states before and after
    it. A document's first chunk has no move before its first token."""
    k = len(m.start)
    out = np.zeros((len(at.size), k, k), m.move.dtype)
    several = at.chunks[at.doc] > 1
    for lo, hi, first in at.blocks:
        own = np.nonzero(several[lo:hi])[0]
        if not len(own):
            continue
        active = _active(at.size[lo:hi])
        starts = first + np.cumsum(active) - active
        left = np.searchsorted(own, active)  # of the chunks in question those that go on
        e = m.emit[symbols[starts[0] + own]]
        s = np.where((at.number[lo + own] == 0)[:, None, None], np.eye(k, dtype=out.dtype), m.move) * e[:, None, :]
        for t in range(1, int((left > 0).sum())):
            n = int(left[t])
            e = m.emit[symbols[starts[t] + own[:n]]]
            x = (s[:n].reshape(-1, k) @ m.move).reshape(n, k, k)
            x *= e[:, None, :]
            if t % _SCALE_STEPS == 0:
                x /= x.sum(axis=(1, 2))[:, None, None]
            s[:n] = x
        s /= s.sum(axis=(1, 2))[:, None, None]
        out[lo + own] = s
    return out


def borders(m: Model, symbols: np.ndarray, at: Layout, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables before each chunk but a document's first, and backward variables after each, scaled to go with
    the forward variables there."""
    k = len(m.start)
    before, after = np.zeros((len(at.size), k), m.move.dtype), np.ones((len(at.size), k), m.move.dtype)
    most = int(at.chunks.max(initial=0))
    if most > 1:
        product = transfers(m, symbols, at)
        for j in range(1, most):
            docs = np.nonzero(at.chunks > j)[0]
            last, here = at.places(docs, j - 1), at.places(docs, j)
            a = np.matmul((before[last] if j > 1 else np.broadcast_to(m.start, (len(docs), k)))[:, None, :], product[last])[:, 0]
            before[here] = a / a.sum(axis=1, keepdims=True)
        for j in range(most - 1, 0, -1) if both else ():
            docs = np.nonzero(at.chunks > j)[0]
            last, here = at.places(docs, j - 1), at.places(docs, j)
            b = np.matmul(product[here], after[here][:, :, None])[:, :, 0]
            after[last] = b / (before[here] * b).sum(axis=1, keepdims=True)
    return before, after


def _forward(m: Model, emit: np.ndarray, active: list[int], before: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables and scales of a block of chunks; ``begins``: which are a document's first."""
    alpha, scale, one = np.empty_like(emit), np.empty(len(emit), emit.dtype), np.ones(emit.shape[1], emit.dtype)
    at, last = 0, None
    for n in active:
        a = alpha[at : at + n]
        if last is None:
            np.multiply(np.where(begins[:, None], m.start, before @ m.move), emit[:n], out=a)
        else:
            np.matmul(last[:n], m.move, out=a)
            a *= emit[at : at + n]
        c = a @ one
        scale[at : at + n] = c
        a /= c[:, None]
        last = a
        at += n
    return alpha, scale


def log_likelihoods(m: Model, symbols: np.ndarray, lens: np.ndarray, chunk: int = CHUNK, block: int = BLOCK) -> np.ndarray:
    """Of each document's symbols (in the order of :class:`Layout`): the log of the sum over all state paths. Only scales are kept."""
    at, out, one = Layout(lens, chunk, block), np.zeros(len(lens)), np.ones(len(m.start))
    before, _ = borders(m, symbols, at, both=False)
    for lo, hi, first in at.blocks:
        total, a = np.zeros(hi - lo), None
        for n in _active(at.size[lo:hi]).tolist():
            a = np.where((at.number[lo:hi] == 0)[:, None], m.start, before[lo:hi] @ m.move) if a is None else a[:n] @ m.move
            a *= m.emit[symbols[first : first + n]]
            c = a @ one
            total[:n] += np.log(c)
            a /= c[:, None]
            first += n
        out += np.bincount(at.doc[lo:hi], weights=total, minlength=len(lens))
    return out


def expected_counts(m: Model, symbols: np.ndarray, lens: np.ndarray, chunk: int = CHUNK, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected counts (start, move, emit) over all documents of a slice, and their log-likelihood."""
    at, k = Layout(lens, chunk, block), len(m.start)
    start, move, counts, ll = np.zeros(k), np.zeros((k, k)), np.zeros((len(m.emit), k)), 0.0
    before, after = borders(m, symbols, at)
    back = np.ascontiguousarray(m.move.T)
    for lo, hi, first in at.blocks:
        active = _active(at.size[lo:hi])
        own = symbols[first : first + int(active.sum())]
        begins = at.number[lo:hi] == 0
        emit = m.emit[own]
        alpha, scale = _forward(m, emit, active.tolist(), before[lo:hi], begins)
        ll += float(np.log(scale).sum(dtype=np.float64))
        ahead, place = None, len(own)
        for n in reversed(active.tolist()):
            place -= n
            a, x, more = alpha[place : place + n], emit[place : place + n], 0 if ahead is None else len(ahead)
            if more:
                move += a[:more].T @ ahead
                beta = ahead @ back
                a[:more] *= beta  # gamma, in place
                x[:more] *= beta
            if more < n:  # those that end here
                a[more:] *= after[lo + more : lo + n]
                x[more:] *= after[lo + more : lo + n]
            x /= scale[place : place + n, None]
            ahead = x
        move += before[lo:hi][~begins].T @ ahead[~begins]  # from the chunk before
        for s in range(k):
            counts[:, s] += np.bincount(own, weights=alpha[:, s], minlength=len(counts))
        start += alpha[: hi - lo][begins].sum(axis=0, dtype=np.float64)
    return start, move * m.move, counts, ll


def initial(keys: np.ndarray, counts: np.ndarray, states: int = STATES) -> Model:
    """Every state emits words as often as the corpus has them, up to a factor from a hash of word and state, and mostly stays:
    from there training takes fewer iterations than from states that change often."""
    share = (counts + 0.5) / (counts + 0.5).sum()
    seeds = np.concatenate([keys, np.arange(RARE_CLASSES, dtype=np.uint64)])
    noise = np.stack([(mix64(seeds + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) / 2.0**53 for s in range(states)], axis=1)
    emit = share[:, None] * np.exp(4 * noise)
    return Model(keys, np.full(states, 1 / states), 0.8 * np.eye(states) + 0.2 / states, emit / emit.sum(axis=0))


_SENT = "part bigint, data binary"  # sent as single precision, added up as double
_SENT_FIELDS = pa.schema([("part", pa.int64()), ("data", pa.binary())])


def _added(table: pa.Table) -> pa.Table:
    kind = np.float64 if table.column("part")[0].as_py() < 0 else np.float32
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column("data")]
    return pa.table([table.column("part").slice(0, 1), pa.array([np.sum(parts, axis=0, dtype=np.float64).tobytes()], pa.binary())], schema=_SENT_FIELDS)


def step(coded: DataFrame, model: Model, share: np.ndarray) -> tuple[Model, float, int]:
    """One Baum-Welch iteration: the new model, and the log-likelihood and number of tokens under the old one."""
    k, size = len(model.start), len(model.emit)
    held = coded.sparkSession.sparkContext.broadcast(model.single())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        head, emit = np.zeros(2 + k + k * k), np.zeros((size, k))
        for batch in batches:
            for lens, planes, words, classes in _rows(batch, "lens", "codes", "words", "classes"):
                if len(planes):
                    a, b, c, ll = expected_counts(m, symbols_of(m.keys, words, classes)[_codes(planes)], lens)
                    head += np.concatenate([[ll, len(planes) // 4], a, b.ravel()])
                    emit += c
            pa.default_memory_pool().release_unused()
        if head[1]:
            data = [head.tobytes(), *[emit[lo : lo + _SEND].astype(np.float32).tobytes() for lo in range(0, size, _SEND)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(data) - 1)), pa.array(data, pa.binary())], schema=_SENT_FIELDS)

    sent = coded.select("lens", "codes", "words", "classes").mapInArrow(run, _SENT)
    got = sent.groupBy("part").applyInArrow(_added, _SENT).collect()  # the size of the model
    held.unpersist()
    if not got:
        return model, 0.0, 0
    by = {r.part: np.frombuffer(r.data, np.float64) for r in got}
    head, emit = by.pop(-1), np.concatenate([by[i] for i in sorted(by)]).reshape(size, k) + _PRIOR * share[:, None]
    start, move = head[2 : 2 + k] + _PRIOR, head[2 + k :].reshape(k, k) + _PRIOR
    return Model(model.keys, start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)), float(head[0]), int(head[1])


def train(coded: DataFrame, keys: np.ndarray, counts: np.ndarray, states: int = STATES, tolerance: float = TOLERANCE) -> tuple[Model, list[float]]:
    """Baum-Welch over all of ``coded`` (a table that can be read again): the model, and the log-likelihood before each
    iteration. It ends when one gains less than ``tolerance`` of it. Without tokens the initial model is returned."""
    if states < 2:
        raise ValueError("there must be at least two states")
    if tolerance <= 0:
        raise ValueError("tolerance must be above 0")
    model, seen = initial(keys, counts, states), []
    share = (counts + 0.5) / (counts + 0.5).sum()
    while True:
        new, ll, n = step(coded, model, share)
        seen.append(ll)
        if not n:
            return model, seen
        if len(seen) > 1 and ll - seen[-2] < tolerance * abs(ll):
            return new, seen
        model = new


_SCORES = "doc_id bigint, n_tokens bigint, log_likelihood double, perplexity double"


def score_coded(coded: DataFrame, model: Model, counted: DataFrame, counts: np.ndarray) -> DataFrame:
    """Scores of all documents of a written :func:`code` table. ``counted`` and ``counts``: :func:`count`'s table of the corpus that
    the model was trained on, and :func:`vocabulary`'s counts. Rare words: see :func:`score`."""
    held = coded.sparkSession.sparkContext.broadcast((model, counts[len(model.keys) :]))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value[0].keys
        for batch in batches:
            for i, (words, classes) in enumerate(_rows(batch, "words", "classes")):
                at = np.nonzero(symbols_of(keys, words, classes) >= len(keys))[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column(0)[i].as_py(), np.int64)), pa.array(at.astype(np.int32)), pa.array(words[at].view(np.int64)), pa.array(classes[at])], names=["slice", "at", "word", "class"])

    asked = coded.select("slice", "words", "classes").mapInArrow(rare, "slice bigint, at int, word bigint, class smallint")
    known = asked.join(counted, ["word", "class"]).select("slice", "at", "n")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m, totals = held.value
        pa.default_memory_pool().release_unused()
        out = []
        for ids, valid, lens, planes, words, classes in _rows(left, "ids", "valid", "lens", "codes", "words", "classes"):
            symbols = symbols_of(m.keys, words, classes)
            n = np.ones(len(words))
            n[right.column("at").to_numpy()] = right.column("n").to_numpy()
            share = np.where(symbols >= len(m.keys), np.log(n) - np.log(totals[classes] + 1), 0.0)
            codes, at = _codes(planes), Layout(lens)
            ll = log_likelihoods(m, symbols[codes], lens) if at.blocks else np.zeros(len(lens))
            for lo, hi, first in at.blocks:
                active = _active(at.size[lo:hi])
                rank = np.arange(int(active.sum())) - np.repeat(np.cumsum(active) - active, active)
                own = np.bincount(rank, weights=share[codes[first : first + len(rank)]], minlength=hi - lo)
                ll += np.bincount(at.doc[lo:hi], weights=own, minlength=len(lens))
            none = lens == 0
            out.append(pa.table([pa.array(ids, mask=~valid), pa.array(lens), pa.array(ll), pa.array(np.exp(-ll / np.maximum(lens, 1)), mask=none)], names=["doc_id", "n_tokens", "log_likelihood", "perplexity"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], names=["doc_id", "n_tokens", "log_likelihood", "perplexity"])

    whole = coded.drop("counts")
    return whole.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(run, _SCORES)


def score(docs: DataFrame, states: int = STATES, tolerance: float = TOLERANCE, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all of ``docs`` and score all of it: one row a row of ``docs``, with the exact log-likelihood of its words.

    Tokens are the white-space separated words in lower case. A rare word w of class c has the probability n(w) / (N(c) + 1) in its
    class, n and N being counts over all of ``docs``; all words of the class that were never seen share 1 / (N(c) + 1).
    A null or empty text has no tokens, log-likelihood 0 and a null perplexity. Repeated rows are counted and scored each
    (so ties are scored alike); a null id is returned as null; a text may be of any length; other columns are ignored.
    An empty table gives an empty result.
    """
    coded = written(code(docs, id_col, text_col), "coded")
    counted = count(coded)
    keys, counts = vocabulary(counted, min_share)
    return score_coded(coded, train(coded, keys, counts, states, tolerance)[0], counted, counts)
