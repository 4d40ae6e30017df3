"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint: 64 bits, bit i set where more of a text's distinct words have bit i set in their MD5-derived hash than
not. Two texts are near copies if their fingerprints differ in at most ``radius`` bits and at least ``min_jaccard`` of their
distinct words are common: the fingerprints find candidates, the words decide.

Covering: every bit position i gets a vector m(i) of radius + 1 bits. For each nonzero vector v, one table keeps the
positions with <m(i), v> odd. The positions in which two fingerprints within the radius differ span at most ``radius``
dimensions, so some nonzero v is orthogonal to all of them, and in its table both have the same key: no pair within the
radius is missed. There are 2**(radius + 1) - 1 tables, each keeping about half the bits.

Fewer tables do for fewer fingerprints: of two pairs of halves, one differs in at most radius // 2 bits, so that the tables of
both halves, 2 * (2**(radius // 2 + 1) - 1) of them with keys of about 16 bits, miss no pair either. They are used while keys so
short tell fingerprints apart (``SHORT_KEYS``); the pairs found are the same.

Only distinct fingerprints enter the tables, eight bytes each and packed, so that thousands of copies cost one entry. A pair
is sent from the first table in which its ends collide. A part of a table that holds far more than its share (many
texts alike) is cut into blocks, and every pair of blocks is a task's problem. Then words are compared, and connected components
of what is left are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_ids, id_and_text, mix64, remove, segment_sums, slices, split_words, starts_of, texts, written, written_at

RADIUS = 9
MIN_JACCARD = 0.5
#: Distinct fingerprints in a part of a table, on average at most.
SUB_TABLE = 150_000
#: Distinct fingerprints up to which the tables of halves are used.
SHORT_KEYS = 1 << 22


def covering_masks(radius: int = RADIUS, bits: int = 64) -> np.ndarray:
    """The masks of all 2**(radius + 1) - 1 tables over 64 or 32 bits; of 64, each keeps at least 28.

    Row j of the m(i) is a function of the bits of i: the coordinates, the constant one, and (over 64 bits) up to three bent
    functions Tr(b x y) over the field of eight elements, any sum of which is bent too. So every mask is an affine
    function (half the bits or all) or a bent one plus an affine one (28 or 36 of 64).
    """
    most = {64: 9, 32: 5}[bits]
    if not 0 <= radius <= most:
        raise ValueError(f"radius must be from 0 to {most}")

    def times(x: int, y: int) -> int:  # modulo t**3 + t + 1
        z = x * (y & 1) ^ (x << 1) * (y >> 1 & 1) ^ (x << 2) * (y >> 2 & 1)
        return z ^ 0b10110 * (z >> 4 & 1) ^ 0b1011 * ((z ^ 0b10110 * (z >> 4 & 1)) >> 3 & 1)

    def trace(x: int) -> int:
        return (x ^ times(x, x) ^ times(times(x, x), times(x, x))) & 1

    rows = [[i >> j & 1 for i in range(bits)] for j in range(bits.bit_length() - 1)] + [[1] * bits]
    rows += [[trace(times(b, times(i & 7, i >> 3))) for i in range(64)] for b in (1, 2, 4)] * (bits == 64)
    words = np.array([sum(bit << i for i, bit in enumerate(row)) for row in rows[: radius + 1]], np.uint64)
    masks = np.zeros(1, np.uint64)
    for w in words:
        masks = np.concatenate([masks, masks ^ w])
    return masks[1:]


def half_masks(radius: int = RADIUS) -> np.ndarray:
    """The masks of the tables of both halves of the bits."""
    low = covering_masks(radius // 2, 32)
    return np.concatenate([low, low << np.uint64(32)])


def word_hash(word: str) -> int:
    """The first 64 bits of the MD5 of the word."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")


_PRINTS = "doc_id bigint, node bigint, fingerprint bigint, words array<int>"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in slices(batches):
        codes, words, lens = split_words(pc.utf8_lower(texts(batch)))
        plain = pc.replace_substring_regex(words, r"[^\p{L}\p{N}_]+", "").dictionary_encode()
        if len(cache) > 500_000:
            cache.clear()
        values = plain.dictionary.to_pylist()
        hashes = np.zeros(max(1, len(values)), np.uint64)
        for i, w in enumerate(values):
            h = cache.get(w)
            if h is None:
                h = cache[w] = word_hash(w)
            hashes[i] = h
        code = plain.indices.to_numpy(zero_copy_only=False)[codes] if len(codes) else codes
        doc = np.repeat(np.arange(len(lens)), lens)
        some = np.array([w != "" for w in values] or [True])
        doc, code = doc[some[code]], code[some[code]]
        pairs = np.unique(doc.astype(np.int64) * len(hashes) + code)
        doc, code = pairs // len(hashes), pairs % len(hashes)
        count = np.bincount(doc, minlength=len(lens))
        out = np.zeros(len(lens), np.uint64)
        at = starts_of(count)
        big_endian = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        lo = 0
        while lo < len(lens):  # documents whose words together are about 2**18
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 18), side="right")) - 1)
            own = np.arange(lo, hi)[count[lo:hi] > 0]
            if len(own):
                bits = np.unpackbits(big_endian[code[at[lo] : at[hi]]], axis=1)
                ones = np.add.reduceat(bits, at[own] - at[lo], axis=0, dtype=np.int32)
                out[own] = np.packbits(2 * ones > count[own, None], axis=1).view(">u8").ravel()
            lo = hi
        of_set = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mix64(hashes)[code], out=of_set[1:])
        node = mix64(out ^ mix64(of_set[at[1:]] - of_set[at[:-1]] + count.astype(np.uint64)))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)[code]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node.view(np.int64)), pa.array(out.view(np.int64)), lists], names=["doc_id", "node", "fingerprint", "words"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, 64-bit SimHash ``fingerprint`` (as signed), ``node`` (a name of the set of words) and ``words`` (hashes
    of the distinct ones), one row a row of docs.

    Words are lower-cased, split at white space, and stripped of everything but letters, digits and underscores. A text
    without words (null, empty, punctuation only) has fingerprint 0 and no words.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_prints, _PRINTS)


def _part(fps: np.ndarray, mask: np.uint64, parts: int) -> np.ndarray:
    return (mix64(fps & mask) % np.uint64(parts)).astype(np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints in large arrays."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch.column(0).to_numpy().view(np.uint64))
        if sum(map(len, held)) >= SUB_TABLE:
            yield np.concatenate(held)
            held = []
    if sum(map(len, held)):
        yield np.concatenate(held)


def _sizes(masks: np.ndarray, parts: int):
    """How many fingerprints each part of each table gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _held(batches):
            for t, mask in enumerate(masks):
                n = np.bincount(_part(fps, mask, parts))
                own = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays([pa.array(t * parts + own), pa.array(n[own])], names=["bucket", "n"])

    return run


_PACK = pa.schema([("bucket", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("block", pa.int32()), ("fps", pa.binary())])


def _tables(masks: np.ndarray, parts: int, blocks: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _held(batches):
            for t, mask in enumerate(masks):
                part = _part(fps, mask, parts)
                by = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[by], np.arange(parts + 1))
                rows = []
                for p in np.nonzero(np.diff(cuts))[0].tolist():
                    own, n = fps[by[cuts[p] : cuts[p + 1]]], blocks.get(t * parts + p, 1)
                    if n == 1:
                        rows.append((t * parts + p, 0, 0, 0, own.tobytes()))
                        continue
                    block = (mix64(own + np.uint64(t)) % np.uint64(n)).astype(np.int64)
                    for x in range(n):
                        pack = own[block == x].tobytes()
                        rows += [(t * parts + p, min(x, y), max(x, y), x, pack) for y in range(n) if pack]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACK)], schema=_PACK)

    return run


def near_pairs(fps: np.ndarray, mask: np.uint64, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the radius whose masked keys are the same; with ``side``, of pairs of different sides."""
    key = fps & mask
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(fps)))
    a, b = [], []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        i, j = order[i], order[j]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        if side is not None:
            ok &= side[i] != side[j]
        a.append(i[ok])
        b.append(j[ok])

    off, runs = 1, np.nonzero(size > 1)[0]
    while len(runs) > 16:  # an offset at a time, over all runs at once
        n = size[runs] - off
        for lo, hi in _steps(n, 1 << 20):
            i = np.repeat(first[runs[lo:hi]] - starts_of(n[lo:hi])[:-1], n[lo:hi]) + np.arange(int(n[lo:hi].sum()))
            take(i, i + off)
        off += 1
        runs = runs[size[runs] > off]
    for r in runs.tolist():  # the few longest runs, a row at a time
        at, n = int(first[r]), int(size[r])
        own = fps[order[at : at + n]]
        for x in range(n - off):
            hit = np.nonzero(np.bitwise_count(own[x + off :] ^ own[x]) <= radius)[0]
            if len(hit):
                take(np.full(len(hit), at + x), at + x + off + hit)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _steps(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts of ``n`` into consecutive stretches that add up to about ``most``."""
    total, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _edges(masks: np.ndarray, parts: int, radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        t = int(table.column("bucket")[0].as_py()) // parts
        packs = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("fps")]
        fps, side = np.concatenate(packs), None
        if table.column("a")[0].as_py() != table.column("b")[0].as_py():
            side = np.repeat(table.column("block").to_numpy(), [len(x) for x in packs])
        i, j = near_pairs(fps, masks[t], radius, side)
        fresh = np.ones(len(i), bool)
        for lo in range(0, len(i), 100_000):
            d = (fps[i[lo : lo + 100_000]] ^ fps[j[lo : lo + 100_000]])[:, None]
            fresh[lo : lo + 100_000] = ((d & masks[None, :t]) != 0).all(axis=1)
        a, b = fps[i[fresh]].view(np.int64), fps[j[fresh]].view(np.int64)
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return run


def candidates(distinct: DataFrame, radius: int = RADIUS, short_keys: int = SHORT_KEYS, sub_table: int = SUB_TABLE) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of distinct fingerprints (a written bigint column, no repeats) within the radius."""
    n = distinct.count()
    masks = half_masks(radius) if n <= short_keys else covering_masks(radius)
    parts = max(1, -(-n // sub_table))
    heavy = distinct.mapInArrow(_sizes(masks, parts), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 4 * sub_table)
    blocks = {r.bucket: -(-r.n // (2 * sub_table)) for r in heavy.collect()} if parts > 1 else {}  # at most tables * parts / 4
    packs = distinct.mapInArrow(_tables(masks, parts, blocks), "bucket bigint, a int, b int, block int, fps binary")
    return packs.groupBy("bucket", "a", "b").applyInArrow(_edges(masks, parts, radius), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``(node, root)`` with the least node as root, for nodes with an edge to a smaller one.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each one shuffle, with a lineage cut a round.
    """
    spark = edges.sparkSession
    edges, path = written_at(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = F.min(F.least("u", "v")).over(Window.partitionBy("u"))
        large = both.select("u", "v", least.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", least.alias("m")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges, last = written_at(small, "edges")
        remove(spark, path)
        path = last
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def classes(docs: DataFrame, radius: int = RADIUS, min_jaccard: float = MIN_JACCARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``class_id`` (the least id of its class) and ``links``.

    Documents with the same set of words are copies of each other, whatever the order. Different sets are linked if
    fingerprints differ in at most ``radius`` bits and the sets' Jaccard index is ``min_jaccard`` or more; ``links`` counts
    the other sets that a document's own is linked to, however many copies each has. A class is a connected component. The
    same holds for texts of any length, long or of one word.

    A text without words (null, empty, punctuation only) is its own class, without links. Rows that share an id are one
    document: the least class and the most links of its rows. Rows without an id are in no class and not returned. Ties
    don't occur: whatever is within both bounds is linked. Other columns are ignored; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col).where("doc_id is not null"), "fingerprints")
    some = prints.where(F.size("words") > 0)
    keyed = written(some.groupBy("node", "fingerprint").agg(F.min("doc_id").alias("least")), "keyed")
    distinct = written(keyed.select("fingerprint").distinct(), "distinct")
    pairs = candidates(distinct, radius)
    end = lambda c: keyed.select(F.col("fingerprint").alias(f"f{c}"), F.col("node").alias(c), F.col("least").alias(f"least_{c}"))
    apart = pairs.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(end("a"), "fa").join(end("b"), "fb").select("a", "b", "least_a", "least_b")
    together = end("a").join(end("b"), (F.col("fa") == F.col("fb")) & (F.col("a") < F.col("b"))).select("a", "b", "least_a", "least_b")
    found = written(apart.union(together), "candidates")
    # the words of one document of each set that has a candidate
    ids = written(found.select(F.explode(F.array("least_a", "least_b")).alias("__id")).distinct(), "ids")
    sets = by_ids(some, ids, "left_semi").groupBy("node").agg(F.first("words").alias("words"))
    sets = written(sets, "sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("words").alias(f"w{c}"))
    common = F.size(F.array_intersect("wa", "wb"))
    near = found.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(common >= F.lit(min_jaccard) * (F.size("wa") + F.size("wb") - common)).select("a", "b")
    near = written(near, "near")
    links = near.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    labelled = keyed.join(components(near), "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("least").alias("class_id"))
    known = labelled.join(least, "root").select("node", "class_id", "links")
    # a set's copies may be most of all rows: the smaller side goes out by node, and AQE splits what is left too large
    out = prints.select("doc_id", "node").join(known, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))


def keep_one(docs: DataFrame, radius: int = RADIUS, min_jaccard: float = MIN_JACCARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose class (see :func:`classes`) has a lesser id, columns unchanged; rows without an
    id stay, and so do all rows of an id that is kept."""
    gone = classes(docs, radius, min_jaccard, id_col, text_col).where("doc_id <> class_id").select(F.col("doc_id").alias("__id"))
    return by_ids(docs, written(gone, "gone"), "left_anti", id_col)
