"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary comes from a SentencePiece model file, whose path is a parameter; it is read on the driver, and nothing is
trained. The trie is a double
array over UTF-8 bytes (``base``, ``check``), shipped to executors as a broadcast of numpy arrays.

A slice of texts is cut into segments at the whitespace marker and at line ends. No piece goes across such a cut (this is
checked as the model is read), so the best path of a text is the best paths of its segments, joined. Only a slice's
distinct segments are solved: all trie walks advance together, a byte a step, and the Viterbi recursion advances over
all segments together, an offset a step.

Log scores: a unigram model's pieces have them. A BPE model's scores are ranks of merges, so that its pieces get the log
of a Zipf probability of their rank, -log(rank + 1) - log(sum of 1 / (rank + 1)); pieces ranked nowhere come last.
A character in no piece costs 10 more than the rarest piece and becomes its UTF-8 bytes' pieces (byte fallback).

The marker stands for the space character. A text's own U+2581 is no marker: it is encoded as bytes, so that decoding
gives every text back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, starts_of, texts

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
_SLICE = 4 << 20
_BLOCK = 1 << 19


class Pieces:
    """A vocabulary ready for use: its double-array trie, log scores, and the bytes that each id decodes to."""

    def __init__(self, pieces: list[tuple[str, float, str]], ranked: bool = False):
        """pieces: (piece, score, kind) by id, kind one of normal, byte, other; ranked: scores are negated merge ranks."""
        normal = {i: p.replace(MARKER, " ").encode() for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        if any(b" " in p.lstrip(b" ") for p in normal.values()):
            raise ValueError("a piece holds a marker after another character; segments would not be independent")
        raw = np.array([s for _, s, _ in pieces], np.float64)
        if ranked:
            worst = max(-s for i, (_, s, _) in enumerate(pieces) if i in normal and s > -1e8)
            rank = np.where(raw > -1e8, -raw, worst + 1)
            own = np.array(sorted(normal))
            raw = -np.log(rank + 1) - np.log((1 / (rank[own] + 1)).sum())
        self.score = raw.astype(np.float32)
        self.unknown = np.float32(min(raw[i] for i in normal) - UNKNOWN_PENALTY)
        self.lines_split = not any(b"\n" in p for p in normal.values())
        self.byte_id = np.full(256, -1, np.int32)
        self.text: list[bytes] = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_id[int(p[3:5], 16)] = i
            self.text.append(bytes([int(p[3:5], 16)]) if kind == "byte" else normal.get(i, b""))
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        self.is_byte = np.array([kind == "byte" for *_, kind in pieces])
        self.longest = max(map(len, normal.values()))
        self.base, self.check, self.value = double_array({p: i for i, p in normal.items()})
        self.text_start = starts_of(np.array([len(x) for x in self.text], np.int64))
        self.text_bytes = np.frombuffer(b"".join(self.text), np.uint8)


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: the child of state s by byte c is t = base[s] + c if check[t] == s; value[t] is -1 or a key's."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, v in keys.items():
        at = 0
        for c in key:
            nxt = children[at].get(c)
            if nxt is None:
                nxt = children[at][c] = len(children)
                children.append({})
                values.append(-1)
            at = nxt
        values[at] = v
    size = 4 * len(children) + 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    used = bytearray(size)
    used[0] = 1
    place, low = {0: 0}, 1
    todo = [0]
    for node in todo:
        kids = children[node]
        if not kids:
            continue
        labels = sorted(kids)
        while used[low]:
            low += 1
        at, tried = max(low, labels[0]), 0
        while True:
            at = used.find(0, at)
            b = at - labels[0]
            if b + 512 >= len(used):
                more = len(used)
                used.extend(bytes(more))
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
            if not any(used[b + c] for c in labels):
                break
            at += 1
            tried += 1
            if tried > 64:  # crowded: later nodes needn't look here
                low = at
        s = place[node]
        base[s] = b
        for c in labels:
            used[b + c] = 1
            check[b + c] = s
            place[kids[c]] = b + c
            value[b + c] = values[kids[c]]
            todo.append(kids[c])
    end = max(place.values()) + 257
    grow = lambda x, fill: np.array((x + [fill] * 512)[:end], np.int32)
    return grow(base, 0), grow(check, -1), grow(value, -1)


@cache
def read_pieces(model: str) -> Pieces:
    """The vocabulary of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    kinds = {1: "normal", 4: "normal", 6: "byte"}
    return Pieces([(p.piece, p.score, kinds.get(p.type, "other")) for p in proto.pieces], ranked=proto.trainer_spec.model_type == 2)


def solve(p: Pieces, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best piece ids of each segment data[bounds[i]:bounds[i + 1]], one after the other, and the number of each."""
    n = len(data)
    seg_len = np.diff(bounds)
    segment = np.repeat(np.arange(len(seg_len)), seg_len)
    end = bounds[1:][segment]
    head = np.nonzero((data & 0xC0) != 0x80)[0]
    lead = data[head]
    width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    at, state = head, np.zeros(len(head), np.int32)
    starts, lens, ids = [], [], []
    for depth in range(p.longest):
        inside = at + depth < end[at]
        at, state = at[inside], state[inside]
        if not len(at):
            break
        t = p.base[state] + data[at + depth]
        ok = p.check[t] == state
        at, state = at[ok], t[ok]
        hit = p.value[state] >= 0
        starts.append(at[hit])
        lens.append(np.full(int(hit.sum()), depth + 1, np.int64))
        ids.append(p.value[state[hit]])
    start, length, piece = np.concatenate(starts), np.concatenate(lens), np.concatenate(ids)
    whole = np.zeros(n, np.int64)
    whole[head] = width
    single = np.zeros(n, bool)
    single[start[length == whole[start]]] = True
    lost = head[~single[head]]
    start = np.concatenate([start, lost])
    length = np.concatenate([length, np.minimum(whole[lost], end[lost] - lost)])
    piece = np.concatenate([piece, np.full(len(lost), -1, np.int32)])
    gain = np.where(piece >= 0, p.score[piece], p.unknown)
    # a node for each boundary: byte position plus its segment's number, so that segments share none
    origin = start + segment[start]
    goal = origin + length
    offset = start - bounds[segment[start]]
    order = np.argsort(offset, kind="stable")
    origin, goal, gain = origin[order], goal[order], gain[order]
    cuts = np.searchsorted(offset[order], np.arange(int(seg_len.max(initial=0)) + 1))
    best = np.full(n + len(seg_len), -np.inf, np.float64)
    best[bounds[:-1] + np.arange(len(seg_len))] = 0
    back = np.full(n + len(seg_len), -1, np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if lo == hi:
            continue
        score = best[origin[lo:hi]] + gain[lo:hi]
        better = np.nonzero(score > best[goal[lo:hi]])[0]
        at = goal[lo:hi][better]
        best[at] = score[better]
        back[at] = lo + better
    piece, length = piece[order], length[order]
    byte_at = start[order]
    node = bounds[1:] + np.arange(len(seg_len))
    first = bounds[:-1] + np.arange(len(seg_len))
    chains = []
    live = np.nonzero(node > first)[0]
    while len(live):
        edge = back[node[live]]
        chains.append((live, edge))
        node[live] = origin[edge]
        live = live[node[live] > first[live]]
    if not chains:
        return np.zeros(0, np.int32), np.zeros(len(seg_len), np.int64)
    who = np.concatenate([c[0] for c in chains])
    edge = np.concatenate([c[1] for c in chains])
    edge = edge[np.lexsort((origin[edge], who))] if len(chains) > 1 else edge[np.argsort(who, kind="stable")]
    who = segment[byte_at[edge]]
    out_n = np.where(piece[edge] >= 0, 1, length[edge])
    place = np.repeat(np.arange(len(edge)), out_n)
    inner = np.arange(int(out_n.sum())) - np.repeat(starts_of(out_n)[:-1], out_n)
    got = piece[edge][place]
    got = np.where(got >= 0, got, p.byte_id[data[byte_at[edge][place] + inner]])
    return got.astype(np.int32), np.bincount(who, weights=out_n, minlength=len(seg_len)).astype(np.int64)


def gather(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + lens[i] - 1 of all i, one after the other."""
    return np.repeat(start - starts_of(lens)[:-1], lens) + np.arange(int(lens.sum()), dtype=np.int64)


def encode_texts(p: Pieces, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and the number of each."""
    joined = pc.binary_join_element_wise(pa.scalar(" "), text, pa.scalar("")).cast(pa.large_binary())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    cut = np.zeros(len(data) + 1, bool)
    space = data == 32
    cut[1:-1] = space[1:] & ~space[:-1]
    if p.lines_split:
        line = data == 10
        cut[:-1] |= line
        cut[1:] |= line
    cut[offsets] = True
    bounds = np.nonzero(cut)[0]
    segments = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    codes = segments.indices.to_numpy(zero_copy_only=False)
    words = segments.dictionary
    w_off = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    w_data = np.frombuffer(words.buffers()[2], np.uint8)[: w_off[-1]]
    parts, counts, lo = [], [], 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(w_off, w_off[lo] + _BLOCK, side="right")) - 1)
        ids, n = solve(p, w_data[w_off[lo] : w_off[hi]], w_off[lo : hi + 1] - w_off[lo])
        parts.append(ids)
        counts.append(n)
        lo = hi
    table, size = np.concatenate(parts), np.concatenate(counts)
    lens = size[codes]
    ids = table[gather(starts_of(size)[:-1][codes], lens)]
    per_segment = starts_of(lens)
    per_text = per_segment[np.searchsorted(bounds, offsets)]
    counts = np.diff(per_text)
    blank = np.diff(offsets) == 1  # the marker alone: an empty text has no pieces
    if blank.any():
        ids, counts = ids[~np.repeat(blank, counts)], np.where(blank, 0, counts)
    return ids, counts


def decode_ids(p: Pieces, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The texts of consecutive id lists. Bytes that are no UTF-8 become U+FFFD."""
    size = np.diff(p.text_start)[ids]
    data = p.text_bytes[gather(p.text_start[:-1][ids], size)]
    per_id = starts_of(size)
    offsets = per_id[starts_of(counts)]
    first = offsets[:-1][(np.diff(offsets) > 0)]
    lead = first[data[first] == 32]
    keep = np.ones(len(data), bool)
    keep[lead] = False  # the marker that encoding put in front
    offsets = starts_of(keep.astype(np.int64))[offsets]
    data = np.ascontiguousarray(data[keep])
    raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _list_of(ids: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = pa.array(starts_of(counts).astype(np.int32), mask=np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "piece_ids", count_col: str = "n_pieces", exact_col: str | None = None, keep_cols: list[str] | None = None) -> DataFrame:
    """``docs`` (``keep_cols``, all by default) with the ids of each text's best pieces and their number.

    A null text has null ids and 0 pieces, an empty one no ids. Repeated rows are encoded alike; of segmentations that tie, the
    same one always counts (that whose last piece is the longest, and so on backwards). Texts of any length are encoded whole; an
    empty table gives an empty result. A name that ``docs`` has already among the kept columns is
    replaced. ``exact_col``: also decode the ids and tell whether the very text comes back (null for a null text).
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(model))
    added = [ids_col, count_col, *([exact_col] if exact_col else [])]
    kept = [c for c in (docs.columns if keep_cols is None else keep_cols) if c not in added]
    out = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(count_col, T.LongType()), *([T.StructField(exact_col, T.BooleanType())] if exact_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces.value
        for batch in slices(batches, "__text", _SLICE):
            text = texts(batch, "__text")
            null = batch.column(batch.schema.get_field_index("__text")).is_null().to_numpy(zero_copy_only=False)
            ids, counts = encode_texts(p, text)
            cols = [*batch.columns[:-1], _list_of(ids, counts, null), pa.array(counts)]
            if exact_col:
                same = pc.equal(decode_ids(p, ids, counts), text).to_numpy(zero_copy_only=False)
                cols.append(pa.array(same, mask=null))
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], *added])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, out)


def decode(encoded: DataFrame, model: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each row's ids; null ids give null. An id outside the vocabulary is an error."""
    pieces = encoded.sparkSession.sparkContext.broadcast(read_pieces(model))
    kept = [c for c in encoded.columns if c != text_col]
    out = T.StructType([*encoded.select(*[F.col(f"`{c}`") for c in kept]).schema, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(p.text)):
                raise ValueError("an id is outside the vocabulary")
            null = lists.is_null().to_numpy(zero_copy_only=False)
            got = decode_ids(p, ids, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.if_else(pa.array(null), pa.scalar(None, pa.string()), got)], names=[*kept, text_col])

    return encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias("__ids")).mapInArrow(run, out)
