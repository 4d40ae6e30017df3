"""What the operators of this subpackage share: lineage cuts in the shared folder, and columnar text helpers.

The text-heavy operators run in ``mapInArrow`` on whole Arrow columns: a slice of documents is split into words once,
the words are dictionary-encoded, and everything that follows is numpy on integer codes. Python loops run over distinct
words at most (and the language model's over time steps, each of which advances many texts).
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
#: Ids that are broadcast at most, some 16 bytes each.
BROADCAST_IDS = 2_000_000
_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Unset, as in tests in one process: a temporary one.

    Executors on other machines can't read a folder of the driver's, so that an unset folder is an error there.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="annolith-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/annolith-{sc.applicationId}"
    if path not in _folders:
        _folders.add(path)
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that outlives any executor; its path too."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """A written table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def by_ids(df: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Semi or anti join of ``df`` with the written, distinct ``ids`` (a column ``__id``): broadcast if they are few enough."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, df[f"`{id_col}`"].cast("bigint") == F.col("__id"), how)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names; whatever else ``docs`` holds can't clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column``; a longer single text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column with nulls as empty text."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")


def split_words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Whitespace words of each text: codes in order, the dictionary they index, and per-text word counts.

    Texts are trimmed first: where the last one of a buffer ends in white space, the split's result isn't always the same.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(text))
    flat, lens = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = flat.dictionary_encode()
    codes, words = enc.indices.to_numpy(zero_copy_only=False), enc.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py() if len(words) else -1
    if empty >= 0:  # no text at all
        real = codes != empty
        lens = segment_sums(real.astype(np.int64), lens)
        codes = codes[real]
    return codes, words, lens


def starts_of(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def segment_sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over consecutive segments, empty ones included."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    at = starts_of(lens)
    return total[at[1:]] - total[at[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads a 64-bit value over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls for the usual base."""
    global _powers
    if base != _BASE or len(_powers) < n:
        p = np.full(max(n, 1), base, np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        if base != _BASE:
            return p
        _powers = p
    return _powers[:n]


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's UTF-8 bytes: a polynomial modulo 2**64, mixed. The same in every process."""
    strings = strings.cast(pa.large_binary()) if not pa.types.is_large_binary(strings.type) else strings
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + n + 1]
    lens = np.diff(offsets)
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if strings.buffers()[2] else np.zeros(0, np.uint8)
    at = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1] - offsets[0], lens)
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(int(lens.max(initial=0)) + 1)[at]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    ends = offsets - offsets[0]
    return mix64(total[ends[1:]] - total[ends[:-1]] + lens.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def pack_ascending(index: np.ndarray) -> bytes:
    """Ascending indices as one byte a gap; 255 means: add 255 and go on."""
    if not len(index):
        return b""
    gaps = np.diff(index.astype(np.int64), prepend=np.int64(0))
    full = gaps // 255
    out = np.full(int(full.sum()) + len(index), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = gaps % 255
    return out.tobytes()


def unpack_ascending(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.cumsum(b.astype(np.int64))[b != 255]


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
