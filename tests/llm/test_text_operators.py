"""SentencePiece codec, language identification, secret scans and quality rules: brute force, round trips, odd rows."""

import base64
import bz2
import functools
import gzip
import hashlib
import json
import lzma
import os
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from annolith.llm import language_id, quality_forest, queries, secret_scan
from annolith.llm import sentencepiece_codec as sp

SCHEMA = "doc_id long, text string, piece_ids int, score double"
KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], SCHEMA)


def tiny():
    words = [" a", " ab", "ab", "b", "c", " ", "a", "abc", " é", "é"]
    pieces = [(w.replace(" ", sp.MARKER), -1.0 - 0.3 * i, "normal") for i, w in enumerate(words)] + [(f"<0x{i:02X}>", -20.0, "byte") for i in range(256)]
    return sp.Pieces(pieces)


def best_score(p, data):
    """Viterbi over all pieces, byte by byte."""
    table = {p.text[i]: p.score[i] for i in range(len(p.text)) if not p.is_byte[i]}
    best = [0.0] + [-1e30] * len(data)
    for end in range(1, len(data) + 1):
        for start in range(end):
            piece = data[start:end]
            if piece in table:
                best[end] = max(best[end], best[start] + table[piece])
        for start in range(max(0, end - 4), end):  # one character that is no piece
            try:
                one = len(data[start:end].decode()) == 1
            except UnicodeDecodeError:
                one = False
            if one and data[start:end] not in table:
                best[end] = max(best[end], best[start] + p.unknown)
    return best[-1]


def test_viterbi_is_the_best_segmentation():
    p = tiny()
    rng = np.random.default_rng(0)
    for _ in range(200):
        text = "".join(rng.choice(list("abcé x\n"), int(rng.integers(1, 14))))
        ids, counts = sp.encode_texts(p, pa.array([text]))
        score, i = 0.0, 0
        while i < len(ids):
            if p.is_byte[ids[i]]:
                width = 1 + (int(p.text[ids[i]][0]) >= 0xC0)
                score += p.unknown
                i += width
            else:
                score += p.score[ids[i]]
                i += 1
        assert score == pytest.approx(best_score(p, (" " + text).encode()), abs=1e-3), text
        assert sp.decode_ids(p, ids, counts).to_pylist() == [text]


@pytest.mark.skipif(not os.path.exists(queries.PIECES), reason="no vocabulary here")
def test_round_trip_and_odd_rows(spark):
    texts = [None, "", " ", "  two  spaces ", "línea\n\nñ 漢字 🍕 ▁ x", "same", "same", "long " * 60_000]
    docs = frame(spark, list(enumerate(texts))).union(frame(spark, [(None, "no id")]))
    enc = sp.encode(docs, queries.PIECES, exact_col="exact")
    got = sp.decode(enc, queries.PIECES).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and [by[i].decoded for i in range(8)] == texts
    assert by[0].piece_ids is None and by[0].n_pieces == 0 and by[0].exact is None and by[1].piece_ids == []
    assert all(r.exact for r in got if r.doc_id != 0)
    assert sp.encode(docs.limit(0), queries.PIECES).count() == 0


def test_identify_is_brute_force_and_holds_on_rows_it_has_not_seen(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = language_id.dictionaries(docs.where("doc_id % 2 = 0"))
    texts = {r.doc_id: r for r in docs.collect()}
    own = {}
    for lang, content in d.items():  # dictionaries hold whole texts of that language's rows
        parts = {r.text.lower().encode() for r in texts.values() if r.lang == lang and r.doc_id % 2 == 0}
        assert len(content) <= language_id.DICTIONARY_BYTES and max(parts, key=len) and any(p in content for p in parts)
        own[lang] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def size(lang, text):
        whole = 0
        for i in range(0, len(text), language_id.BLOCK):
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=own[lang], write_content_size=False, write_checksum=False, write_dict_id=False)
            whole += len(c.compress(text[i : i + language_id.BLOCK]))
        return whole

    got = language_id.identify(docs.where("doc_id % 2 = 1"), d).collect()
    accepted = [r for r in got if r.language]
    assert sum(r.language == texts[r.doc_id].lang for r in accepted) >= 0.98 * len(accepted) and len(accepted) >= 0.95 * len(got)
    own = {lang: zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for lang, content in d.items()}
    for x in own.values():
        x.precompute_compress(level=language_id.LEVEL)
    for r in got[:60]:
        sizes = sorted((size(lang, texts[r.doc_id].text.lower().encode()), lang) for lang in d)
        assert (r.size, r.next_size, r.nearest) == (sizes[0][0], sizes[1][0], sizes[0][1])
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert r.margin == pytest.approx(margin) and r.language == (sizes[0][1] if margin >= language_id.MIN_MARGIN else None)


def test_languages_of_repeated_rows_and_other_columns(spark):
    d = {"aa": b"abc abd abe " * 40, "bb": b"xyz xyw xyv " * 40}
    rows = [(1, "abc abd abe"), (1, "abc abd abe"), (2, "abc"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS language", "1 AS size", "2 AS margin", "3 AS nearest")
    got = language_id.identify(docs, d).collect()
    assert len(got) == 4 and len({tuple(r) for r in got if r.doc_id == 1}) == 1 and got[0].language == "aa"
    same = language_id.identify(docs, {"aa": d["aa"], "ab": d["aa"]}).collect()  # sizes tie
    assert all(r.language is None for r in same) and same[0].nearest == "aa"
    assert language_id.identify(docs.limit(0), d).count() == 0
    with pytest.raises(ValueError):
        language_id.identify(docs, {"aa": b"x"})


def test_dictionaries_of_whole_texts(spark):
    rows = [(i, f"text {i} " * 40, "aa") for i in range(5)] + [(9, "x" * 5000, "bb"), (9, "x" * 4000, "bb"), (10, None, "aa"), (11, "t", None), (None, "no id", "aa"), (0, "text 0 " * 40, "aa")]
    d = language_id.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("t", F.lit(1)), 10, 700)
    assert d["bb"] == b"x" * 4000  # none fits: the shortest
    assert len(d["aa"]) <= 700 and set(d["aa"].decode().split("\n")) <= {t for _, t, k in rows if k == "aa" and t}
    assert language_id.dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_languages_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    vocab = {k: ["".join(rng.choice(list(s), 6)) for _ in range(60)] for k, s in {"aa": "abcdef", "bb": "mnopqr", "cc": "uvwxyz"}.items()}
    rows = [(i, " ".join(rng.choice(vocab[k], 80)), k) for i, k in enumerate(list(vocab) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = language_id.dictionaries(docs.where("doc_id < 60"))
    got = {r.doc_id: r for r in language_id.identify(docs, d).collect()}
    assert sum(got[i].language == k for i, _, k in rows[60:]) >= 0.95 * len(rows[60:])
    for i, text, _ in rows[:5]:
        sizes = sorted(language_id.compressed_sizes(text.encode(), x) for x in d.values())
        assert (got[i].size, got[i].next_size) == (sizes[0], sizes[1])
    odd = {r.doc_id: r for r in language_id.identify(frame(spark, [(1, None), (2, ""), (None, "abcdef fedcba"), (3, "12345"), (4, rows[0][1] * 500)]), d).collect()}
    assert odd[1].language is None and odd[2].size is None and odd[3].language is None and odd[4].language == "aa" and None in odd
    assert language_id.identify(docs.limit(0), d).count() == 0
    with pytest.raises(ValueError):
        language_id.identify(docs, {"aa": b"x"})


def test_clean_long_texts_keep_their_language(spark):
    rng = np.random.default_rng(4)
    ends = {"aa": ["en", "er", "ung", "st"], "bb": ["os", "as", "ar", "ado"]}  # languages that share stems, not endings
    stems = ["".join(rng.choice(list("abcdefghijklmnoprstu"), 5)) for _ in range(3000)]
    write = lambda k, n: " ".join(a + b for a, b in zip(rng.choice(stems, n), rng.choice(ends[k], n)))
    labelled = spark.createDataFrame([(i, write(k, 300), k) for i, k in enumerate(["aa", "bb"] * 60)], "doc_id long, text string, lang string")
    d = language_id.dictionaries(labelled)
    long = [(n, k, write(k, n // 8)[:n]) for n in (3_000, 100_000, 1_000_000, 10_000_000) for k in ends]
    got = language_id.identify(frame(spark, [(i, t) for i, (_, _, t) in enumerate(long)]), d).collect()
    assert {r.doc_id: r.language for r in got} == {i: k for i, (_, k, _) in enumerate(long)}
    margins = [r.margin for r in got]
    assert max(margins) < 2 * min(margins)  # the same at all lengths


@pytest.mark.parametrize(
    "wrap,path",
    [
        (lambda s: s, ""),
        (lambda s: urllib.parse.quote(s, safe="").replace("A", "%41"), "url"),
        (lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "unicode"),
        (lambda s: base64.b64encode(s.encode()).decode(), "base64"),
        (lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(), "base64>base64"),
        (lambda s: base64.b64encode(gzip.compress(s.encode() * 2)).decode(), "base64>gzip"),
        (lambda s: "".join(f"%{b:02x}" for b in base64.b64encode(s.encode())), "url>base64"),
    ],
)
def test_secrets_at_any_depth(wrap, path):
    inner = f"key {KEY} end"
    hidden = wrap(inner)
    text = f"before {hidden} after"
    hits = [h for h in secret_scan.scan(text) if h[0] == "aws_access_key"]
    assert hits and all(h[3] == path for h in hits)
    assert all(7 <= h[1] < h[2] <= 7 + len(hidden) for h in hits)
    if path in ("", "url", "unicode"):
        start, end = hits[0][1:3]
        shown = urllib.parse.unquote(text[start:end]) if path == "url" else text[start:end].encode().decode("unicode_escape") if path else text[start:end]
        assert shown == KEY
    assert [h for h in secret_scan.scan(secret_scan.redacted(text)) if h[0] == "aws_access_key"] == []


@pytest.mark.parametrize("wrap", [lambda s: base64.b64encode(s.encode()).decode(), lambda s: s.replace("A", "%41"), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: base64.b64encode(gzip.compress(s.encode() * 2)).decode()])
def test_every_copy_of_an_encoded_secret_is_found(wrap):
    line = f"{wrap(f'key {KEY} end')}\n"
    text = f"{line}between\n{line}{line}"
    hits = [h for h in secret_scan.scan(text) if h[0] == "aws_access_key"]
    starts = [m.start() for m in re.finditer(re.escape(line), text)]
    assert {max(s for s in starts if s <= h[1]) for h in hits} == set(starts) and len(starts) == 3
    assert [h for h in secret_scan.scan(secret_scan.redacted(text)) if h[0] == "aws_access_key"] == []


def test_aligned_assignments_are_found():
    names = ["db_password", "x" * 60 + "_api_key", "token" + "_y" * 40, "secret"]
    text = "".join(f"{name:<120}{sign}{' ' * 30}{'hunter2hunter2' + str(i)}\n" for i, name in enumerate(names) for sign in "=:")
    assert [text[h[1] : h[2]] for h in sorted(secret_scan.scan(text), key=lambda h: h[1])] == [f"hunter2hunter2{i}" for i in range(4) for _ in "=:"]
    assert secret_scan.scan("token" * 100_000 + " " * 100_000 + "x") == []  # in linear time


def test_scan_ends_on_cycles():
    same = secret_scan.Layer("x" * 40, np.arange(40), np.arange(40) + 1)
    calls = []

    def to_itself(layer):
        calls.append(layer.text)
        yield secret_scan.Layer("y" * 40 if layer.text[0] == "x" else "x" * 40, same.first, same.last, (*layer.path, "swap"))

    assert secret_scan.scan("x" * 40, to_itself) == [] and len(calls) == 2


def mime(data):
    return base64.encodebytes(data).decode().strip()


LATIN = "contraseña ünd "
CASES = {
    "latin-1": lambda s: base64.b64encode((LATIN + s).encode("latin-1")).decode(),
    "utf-16-le": lambda s: base64.b64encode(s.encode("utf-16-le")).decode(),
    "utf-16": lambda s: base64.b64encode((LATIN + s).encode("utf-16")).decode(),
    "utf-16-be": lambda s: base64.b64encode(b"\x07" + (s + "é").encode("utf-16-be")).decode(),
    "wrapped gzip": lambda s: mime(gzip.compress((s + "".join(map(str, range(400)))).encode())),
    "wrapped": lambda s: mime(("x" * 40 + s + "y" * 80).encode()),
    "wrapped by blanks": lambda s: mime(("x" * 40 + s + "y" * 80).encode()).replace("\n", " "),
    "narrow lines": lambda s: "\n".join(re.findall(".{1,10}", base64.b64encode(s.encode()).decode())),
    "quoted in JSON": lambda s: json.dumps(mime(("x" * 40 + s + "y" * 80).encode())).replace("/", "\\/"),
    "glued name": lambda s: "v1_" + base64.b64encode(s.encode()).decode(),
    "glued path": lambda s: "https://x.com/callback/" + base64.b64encode(s.encode()).decode() + "/more",
    "glued gzip": lambda s: "path/to/" + base64.b64encode(gzip.compress(s.encode())).decode(),
    "second member": lambda s: base64.b64encode(gzip.compress(b"nothing here") + gzip.compress(s.encode())).decode(),
    "across members": lambda s: base64.b64encode(gzip.compress(s[:15].encode()) + gzip.compress(s[15:].encode())).decode(),
    "after other bytes": lambda s: base64.b64encode(b"\x00\x01\x02head" + bz2.compress(s.encode()) + b"tail").decode(),
    "cut off": lambda s: base64.b64encode(zlib.compress((s + "".join(map(str, range(3000)))).encode())[:1500]).decode(),
    "70 times zlib": lambda s: base64.b64encode(functools.reduce(lambda d, _: zlib.compress(d), range(70), s.encode())).decode(),
    "unprintable": lambda s: base64.b64encode(bytes(range(256)) + s.encode() + bytes(range(255, 0, -1))).decode(),
    "percent gzip": lambda s: "".join(f"%{b:02X}" for b in gzip.compress(s.encode())),
    "value on the next line": lambda s: "password:\n" + "".join(f"%{ord(c):02x}" for c in "hunter2hunter2") + " " + base64.b64encode(s.encode()).decode(),
    "xz in zstd": lambda s: base64.b64encode(zstandard.compress(lzma.compress(s.encode()))).decode(),
}


@pytest.mark.parametrize("name", CASES)
def test_secrets_however_wrapped(name):
    hidden = CASES[name](f"key {KEY} end")
    text = f"before {hidden}\nbetween\n{hidden}\nafter"
    hits = [h for h in secret_scan.scan(text) if h[0] == "aws_access_key"]
    starts = [m.start() for m in re.finditer(re.escape(hidden), text)]
    assert {max(s for s in starts if s <= h[1]) for h in hits} == set(starts) and len(starts) == 2  # each copy
    assert {h[5] for h in hits} == {hashlib.sha256(KEY.encode()).hexdigest()}
    clean = secret_scan.redacted(text)
    assert secret_scan.scan(clean) == [] and clean.startswith("before ") and (name == "cut off" or clean.endswith("after") and "between" in clean)  # where damaged data end isn't known


ENCODERS = [
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    lambda s: mime(s.encode()),
    lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    lambda s: base64.b64encode(lzma.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zstandard.compress(s.encode())).decode(),
    lambda s: base64.b64encode(s.encode("utf-16")).decode(),
    lambda s: json.dumps(s),
]


@pytest.mark.parametrize("seed", range(40))
def test_secrets_encoded_over_and_over_at_random_places(spark, seed):
    rng = np.random.default_rng(seed)
    plain = "".join(rng.choice(list("abc def. "), 300))
    text, keys = plain, []
    for _ in range(int(rng.integers(1, 4))):
        key = "AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))
        part = f"{''.join(rng.choice(list('pq ñé'), int(rng.integers(0, 30))))} {key} {''.join(rng.choice(list('rs t'), int(rng.integers(0, 30))))}"
        for _ in range(int(rng.integers(0, 5))):
            part = f"{''.join(rng.choice(list('uv w/-_'), int(rng.integers(0, 12))))} " * int(rng.integers(2)) + ENCODERS[int(rng.integers(len(ENCODERS)))](part)
        at = int(rng.integers(len(text)))
        at = text.find(" ", at) + 1 or len(text)
        text = f"{text[:at]}\n<{part}>\n{text[at:]}" if not keys else f"{text}\n<{part}>\n"
        keys.append(key)
    digests = {h[5] for h in secret_scan.scan(text)}
    assert all(hashlib.sha256(k.encode()).hexdigest() in digests for k in keys)
    clean = secret_scan.redacted(text)
    assert secret_scan.scan(clean) == [] and not any(k in clean for k in keys)
    assert secret_scan._gated(pa.array([text])) == [0]


def test_what_inflates_to_much_is_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 1 << 16)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 10)
    inner = b"x " * 500_000 + KEY.encode() + b" y" * 500_000
    sizes = [len(w) for w, *_ in secret_scan.inflated(gzip.compress(inner), 0, "gzip")]
    assert max(sizes) <= 1 << 16 and sum(sizes) >= len(inner)
    text = "a " + base64.b64encode(gzip.compress(inner)).decode()
    assert [h[0] for h in secret_scan.scan(text)] == ["aws_access_key"]


def test_no_rule_matches_fewer_than_16_characters():
    short = ["AKIA" + "A" * 16, "ghp_" + "a" * 36, "xoxb-" + "a" * 12, "AIza" + "a" * 35, "sk_live_" + "a" * 16, "eyJ" + "a" * 8 + ".eyJ" + "a" * 8 + "." + "a" * 8, "-----BEGIN PRIVATE KEY-----", "pwd=" + "a" * 12, "x://u:123456@abc"]
    for text, name in zip(short, secret_scan.RULES):
        assert len(text) >= 16 and [h[0] for h in secret_scan.scan(text)] == [name], text
        assert secret_scan.scan(text[:-1]) == [] or name == "private_key"


def test_secret_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, f"a {KEY}"), (3, f"b {KEY}"), (3, f"b {KEY}"), (4, "word " * 60_000 + KEY)]
    docs = frame(spark, rows)
    assert sorted((r.doc_id or 0) for r in secret_scan.secrets(docs).collect()) == [0, 3, 3, 4]
    red = secret_scan.redact(docs).collect()
    assert len(red) == 6 and not any(KEY in (r.text or "") for r in red) and any(r.text is None for r in red)
    odd = frame(spark, rows).selectExpr("doc_id", "text", "length(text) AS n_chars", "1 AS rule", "2 AS start", "3 AS path", "4 AS `end`", "null AS lang")
    assert secret_scan.secrets(odd).count() == 4
    back = secret_scan.redact(odd).collect()
    assert secret_scan.redact(odd).columns == odd.columns and all(r.n_chars == (None if r.text is None else len(r.text)) and (r.rule, r.start, r.path, r.lang) == (1, 2, 3, None) for r in back)
    assert secret_scan.secrets(docs.limit(0)).count() == 0 and secret_scan.redact(docs.limit(0)).columns == docs.columns


def test_forest_paths_are_those_of_its_trees():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 3)), [[9.0, 9, 9]]])
    f = quality_forest.grow(x, trees=30, subsample=64)

    def walk(t, row):
        node = 0
        while 2 * node + 1 < f.rule.shape[1]:
            node = 2 * node + 1 + int(row[f.rule[t, node]] >= f.at[t, node])
        return f.path[t, node]

    want = [2 ** (-np.mean([walk(t, row) for t in range(30)]) / f.norm) for row in x[-20:]]
    assert np.allclose(f.scores(x)[-20:], want) and f.scores(x).argmax() == 300


def test_rejected_rows_are_the_labelled_bad_ones(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality_forest.train(docs, labels)
    rows = quality_forest.judge(docs, forest).join(labels, "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.3
    kept = {r.doc_id for r in quality_forest.keep_good(docs, forest).collect()}
    assert kept == {r.doc_id for r in quality_forest.judge(docs, forest).where("keep").collect()}


def test_quality_odd_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality_forest.train(docs, labels)
    odd = {r.doc_id: r for r in quality_forest.judge(frame(spark, [(1, None), (2, ""), (3, " \n "), (None, "the word of the day"), (4, "the and of " * 50_000)]), forest).collect()}
    assert len(odd) == 5 and not (odd[1].keep or odd[2].keep or odd[3].keep) and odd[1].score == 1
    assert quality_forest.judge(docs.limit(0), forest).count() == 0
    none = quality_forest.train(docs, labels.limit(0))
    assert quality_forest.keep_good(docs, none).count() == docs.where("trim(text) <> ''").count()
