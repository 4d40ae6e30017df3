"""Language identification by compression: the language whose zstandard dictionary encodes a text smallest.

The dictionary of a language is raw content: texts of labelled rows, in lower case, concatenated. A text, in lower case too,
is compressed with each dictionary; the language of the smallest result is predicted unless the runner-up comes too close.

The whole text is compressed, in blocks of ``BLOCK`` bytes that each start from the dictionary alone, and the sizes are
added up. Compressed in one piece a long text would soon match itself, and what a dictionary gains would be lost in its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_and_text, slices, texts

SAMPLE_DOCS = 200
DICTIONARY_BYTES = 192 << 10
LEVEL = 6
BLOCK = 4 << 10
MIN_MARGIN = 0.02

SCHEMA = "doc_id bigint, language string, nearest string, runner_up string, size int, next_size int, margin double"


def dictionaries(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries by language from at most ``sample_docs`` labelled rows a language, whole texts only.

    The rows are those whose ids have the least hashes (ties by id, then text), the same at every run. A text is taken if it still
    fits in ``dictionary_bytes``; if not one does, the shortest is taken. Rows without a language, text or id are no labels.
    """
    rows = labelled.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ranked = rows.where("lang is not null and length(text) > 0 and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("t"))
    ranked = ranked.select("*", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "size", "t")).alias("n")).where(F.col("n") <= sample_docs)
    chosen: list[tuple[str, int, int, int]] = []
    by: dict[str, list] = {}
    for r in ranked.collect():  # bounded by sample_docs, without texts
        by.setdefault(r.lang, []).append(r)
    for lang, own in by.items():
        room, some = dictionary_bytes, False
        for r in sorted(own, key=lambda r: r.n):
            if r["size"] < room:
                room -= r["size"] + 1
                chosen.append((lang, r.doc_id, r.t, r.n))
                some = True
        if not some:
            r = min(own, key=lambda r: (r["size"], r.n))
            chosen.append((lang, r.doc_id, r.t, r.n))
    wanted = labelled.sparkSession.createDataFrame(chosen, "lang string, doc_id bigint, t bigint, n int")
    got = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(wanted), ["lang", "doc_id", "t"]).select("lang", "n", "text").distinct().collect()  # bounded by dictionary_bytes
    return {lang: b"\n".join(r.text.lower().encode() for r in sorted((r for r in got if r.lang == lang), key=lambda r: r.n)) for lang in sorted(by)}


def compressed_sizes(text: bytes, dictionary: bytes, level: int = LEVEL) -> int:
    """Bytes of ``text`` compressed with a raw-content dictionary (what the operator compares, for one text)."""
    return _size(_compressor(dictionary, level).compress, text)


def _size(compress: Callable[[bytes], bytes], text: bytes) -> int:
    return sum(len(compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK))


def _compressor(dictionary: bytes, level: int):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def identify(docs: DataFrame, by_language: dict[str, bytes], level: int = LEVEL, min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: the predicted ``language``, null if rejected, and what the choice rests on.

    ``margin`` is (next_size - size) / next_size. A prediction is rejected if it is under ``min_margin``, or if sizes tie
    (``nearest`` is then the first by name). A null or empty text has no language, sizes or margin. Repeated rows are identified
    alike; a null id is returned as null. Texts of any length count whole. Other columns of ``docs`` are ignored; an empty table
    gives an empty result.
    """
    if len(by_language) < 2:
        raise ValueError("at least two languages are needed to choose from")
    held = docs.sparkSession.sparkContext.broadcast(sorted(by_language.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [k for k, _ in held.value]
        encoders = [_compressor(v, level).compress for _, v in held.value]
        for batch in slices(batches):
            column = pc.utf8_lower(texts(batch)).cast(pa.binary()).to_pylist()
            sizes = np.array([[_size(e, t) for e in encoders] if t else [0] * len(names) for t in column], np.int32)
            none = np.array([not t for t in column], bool)
            order = np.argsort(sizes, axis=1, kind="stable")
            at = np.arange(len(column))
            least, second = sizes[at, order[:, 0]], sizes[at, order[:, 1]]
            margin = (second - least) / np.maximum(second, 1)
            no = none | (margin < min_margin) | (second == least)
            best = [names[i] for i in order[:, 0]]
            cols = [batch.column(0), pa.array(best, pa.string(), mask=no), pa.array(best, pa.string(), mask=none), pa.array([names[i] for i in order[:, 1]], pa.string(), mask=none), pa.array(least, mask=none), pa.array(second, mask=none), pa.array(margin, mask=none)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "language", "nearest", "runner_up", "size", "next_size", "margin"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
