"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted by Spark's shuffle.

1. Scan. Each slice of documents (a *chunk*) gets one 64-bit token hash a word and, from prefix sums of two polynomials
   modulo 2**64, 96 hash bits of every window of ``window`` tokens in a few vector operations: of 10**13 windows no two different
   ones are expected to share them. A chunk sends each distinct window hash once, packed by hash bucket: 12 bytes for the hash
   and about one for its place. Hashes that repeat within the chunk are known as repeated at once, so that a passage in
   millions of documents sends one hash a chunk.
2. Count. All packs of a bucket meet; hashes seen in two or more packs are repeated, and their places go back. There are as many
   buckets as keep one at ``BUCKET_BYTES``, and chunks grow with them, so that packs don't become single windows.
3. Merge. A chunk's repeated windows merge into maximal intervals of each document.

So what is shuffled is thirteen bytes a window, not a row, and texts are never shuffled.

The input must be a table scan or a checkpointed frame (its rows in the same order if a task is run again): chunks
are named by partition and position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_array, hash_strings, id_and_text, mix64, pack_ascending, powers, shuffle_width, slices, split_words, starts_of, texts, unpack_ascending

WINDOW = 50
#: Hashes and places of a bucket, about.
BUCKET_BYTES = 256 << 20
#: Text of a chunk; larger ones send a passage that many documents share fewer times.
CHUNK_BYTES, MOST_CHUNK_BYTES = 8 << 20, 64 << 20
#: Bytes of text that a window stands for, at least, and that it is sent with.
_TEXT, _SENT = 6, 13

_PACK = "chunk bigint, bucket int, hashes binary, places binary, ids binary, counts binary"
_FIELDS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SECOND = np.uint64(0xA3EC647659359ACD)


def pack_places(index: np.ndarray) -> bytes:
    """Ascending places as gaps of a byte, or as they are where gaps are large."""
    plain = b"\x01" + index.astype(np.uint32).tobytes()
    if len(index) and int(index[-1]) // 255 + len(index) >= len(plain):
        return plain
    return b"\x00" + pack_ascending(index)


def unpack_places(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32, offset=1).astype(np.int64) if data[:1] == b"\x01" else unpack_ascending(data[1:])


def window_hashes(token_hash: np.ndarray, lens: np.ndarray, window: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window inside a document, in order, and the number of windows of each document."""
    n = len(token_hash)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(token_hash * powers(n, np.uint64(pow(int(base), -1, 1 << 64))), out=prefix[1:]) if n else None
    counts = np.maximum(lens - window + 1, 0)
    first = np.repeat(starts_of(lens)[:-1] - starts_of(counts)[:-1], counts) + np.arange(int(counts.sum()), dtype=np.int64)
    return mix64((prefix[first + window] - prefix[first]) * powers(n + 1, base)[first]), counts


def _scan(window: int, buckets: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=chunk_bytes):
            codes, words, lens = split_words(texts(batch))
            tokens = hash_strings(words)[codes]
            hashes, counts = window_hashes(tokens, lens, window)
            if not len(hashes):
                continue
            more = (window_hashes(mix64(tokens), lens, window, _SECOND)[0] >> np.uint64(32)).astype(np.uint32)
            order = in_order(hashes, more)
            new = np.concatenate([[True], ~same_as_before(hashes, more, order)])
            group = np.cumsum(new) - 1
            known = np.sort(order[np.bincount(group)[group] > 1])
            places = np.sort(order[new])  # where each distinct hash comes first
            sent, more = hashes[places], more[places]
            bucket = ((sent >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            rows = [(chunk, b, sent[own].tobytes() + more[own].tobytes(), pack_places(places[own]), None, None) for b in range(buckets) if len(own := by[cuts[b] : cuts[b + 1]])]
            ids = batch.column(0)
            kept = counts > 0
            mask = kept & ids.is_valid().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)[kept].astype(np.int64)
            rows.append((chunk, int(mix64(np.array([chunk], np.uint64))[0] % np.uint64(buckets)), mask[kept].tobytes(), pack_places(known), numbers.tobytes(), counts[kept].astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)
            chunk += 1

    return run


def in_order(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Places by hash, and where 64 bits are the same but not all by the other bits."""
    order = np.argsort(hashes, kind="stable")
    a, b = hashes[order], more[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((more, hashes))
    return order


def same_as_before(hashes: np.ndarray, more: np.ndarray, order: np.ndarray) -> np.ndarray:
    a, b = hashes[order], more[order]
    return (a[1:] == a[:-1]) & (b[1:] == b[:-1])


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: the places of hashes that several packs hold. Rows with ids describe a chunk and pass."""
    chunks, hashes, places = (table.column(c).to_pylist() for c in ("chunk", "hashes", "places"))
    about = table.column("ids").is_valid().to_pylist()
    packs = [i for i, x in enumerate(about) if not x]
    out = [table.slice(i, 1) for i, x in enumerate(about) if x]
    if packs:
        parts = [np.frombuffer(hashes[i], np.uint64, len(hashes[i]) // 12) for i in packs]
        every = np.concatenate(parts)
        more = np.concatenate([np.frombuffer(hashes[i], np.uint32, offset=len(hashes[i]) // 12 * 8) for i in packs])
        order = in_order(every, more)
        same = same_as_before(every, more, order)
        repeated = np.zeros(len(every), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        at, rows = 0, []
        for i, part in zip(packs, parts):
            own = repeated[at : at + len(part)]
            at += len(part)
            if own.any():
                rows.append((chunks[i], pack_places(unpack_places(places[i])[own])))
        if rows:
            none = pa.nulls(len(rows), pa.binary())
            out.append(pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), none, binary_array([r[1] for r in rows]), none, none], schema=_FIELDS))
    return pa.concat_tables(out) if out else _FIELDS.empty_table()


_OUT = pa.schema([("doc_id", pa.int64()), ("start_token", pa.int64()), ("end_token", pa.int64())])


def _merge(window: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("ids").to_pylist()
        places = table.column("places").to_pylist()
        about = next(i for i, x in enumerate(ids) if x is not None)
        valid = np.frombuffer(table.column("hashes")[about].as_py(), bool)
        numbers = np.frombuffer(ids[about], np.int64)
        first = starts_of(np.frombuffer(table.column("counts")[about].as_py(), np.int64))
        found = np.unique(np.concatenate([unpack_places(x) for x in places]))
        if not len(found):
            return _OUT.empty_table()
        doc = np.searchsorted(first, found, side="right") - 1
        start = found - first[doc]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window)])
        last = np.concatenate([np.nonzero(new)[0][1:] - 1, [len(found) - 1]])
        own = doc[new]
        return pa.table([pa.array(numbers[own], mask=~valid[own]), pa.array(start[new]), pa.array(start[last] + window)], schema=_OUT)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Maximal token intervals ``[start_token, end_token)`` covered by windows that occur twice or more in the corpus.

    Tokens are the white-space separated words of a text, compared as they are. Every occurrence of a repeated window
    counts, within one document too; windows that overlap or touch merge. Null and empty texts, and texts under
    ``window`` tokens, have no window and no row. Repeated rows are repeated text: their spans are returned for each
    row. A null id is returned as null. Other columns are ignored.
    """
    if window < 1:
        raise ValueError("window must be positive")
    both = id_and_text(docs, id_col, text_col)
    size = both.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * shuffle_width(docs.sparkSession), -(-size * _SENT // (_TEXT * bucket_bytes)))
    chunk_bytes = min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, 16 * _TEXT * buckets))
    packs = both.mapInArrow(_scan(window, buckets, chunk_bytes), _PACK)
    repeated = packs.groupBy("bucket").applyInArrow(_count, _PACK)
    return repeated.groupBy("chunk").applyInArrow(_merge(window), "doc_id bigint, start_token bigint, end_token bigint")
