"""The query's pieces against a Viterbi search over whole texts, and ties."""

import os

import pyarrow as pa
import pytest

from annolith.llm import queries
from annolith.llm import sentencepiece_codec as sp

pytestmark = pytest.mark.skipif(not os.path.exists(queries.PIECES), reason="no vocabulary here")


def best_total(p, table, data):
    """The best total score of a text's bytes: every piece, and single characters that are none, at every place."""
    best = [0.0] + [float("-inf")] * len(data)
    for start in range(len(data)):
        here = best[start]
        if here == float("-inf"):
            continue
        for end in range(start + 1, min(len(data), start + p.longest) + 1):
            score = table.get(data[start:end])
            if score is not None and here + score > best[end]:
                best[end] = here + score
        width = 1 + (data[start] >= 0xC0) + (data[start] >= 0xE0) + (data[start] >= 0xF0)
        one = data[start : start + width]
        if one not in table and here + float(p.unknown) > best[start + width]:
            best[start + width] = here + float(p.unknown)
    return best[-1]


def total(p, ids, data):
    """What a segmentation adds up to; runs of bytes are characters."""
    score, at, i = 0.0, 0, 0
    while i < len(ids):
        if p.is_byte[ids[i]]:
            width = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
            assert b"".join(p.text[x] for x in ids[i : i + width]) == data[at : at + width]
            score, i, at = score + float(p.unknown), i + width, at + width
        else:
            piece = p.text[ids[i]]
            assert data[at : at + len(piece)] == piece
            score, i, at = score + float(p.score[ids[i]]), i + 1, at + len(piece)
    assert at == len(data)
    return score


def test_the_query_finds_the_best_segmentation_of_every_text(spark, sf_dir):
    p = sp.read_pieces(queries.PIECES)
    table = {}
    for i in range(len(p.text)):
        if p.text[i] and not p.is_byte[i]:
            table[p.text[i]] = float(p.score[i])
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r for r in queries.op2_sentencepiece(spark, sf_dir).collect()}
    assert set(got) == set(texts) and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got.values())
    for i in sorted(texts)[:: max(1, len(texts) // 60)]:
        data = (" " + texts[i]).encode()
        assert total(p, got[i].piece_ids, data) == pytest.approx(best_total(p, table, data), rel=1e-6), i


def test_of_segmentations_that_tie_the_same_one_counts_always():
    pieces = [(w, -1.0, "normal") for w in (sp.MARKER, "a", "b", "ab", "ba", "aba")] + [(f"<0x{i:02X}>", -20.0, "byte") for i in range(256)]
    p = sp.Pieces(pieces)
    first = sp.encode_texts(p, pa.array(["abab"]))[0].tolist()
    assert len(first) == 3
    for other in (["abab"], ["abab", "abab"], ["zz", "abab"], ["abab", "qrst"]):
        ids, counts = sp.encode_texts(p, pa.array(other))
        parts, at = [], 0
        for n in counts:
            parts.append(ids[at : at + n].tolist())
            at += n
        assert all(x == first for x, t in zip(parts, other) if t == "abab")
