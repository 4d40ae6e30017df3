"""Secret scans with a recursive decoding worklist.

A document starts as one layer. Each layer is scanned by every rule, then unwrapped: percent escapes; Unicode, JSON and HTML
escapes; base64; and gzip, zlib, bzip2, xz or zstandard data. What comes of it are new layers on the worklist, and so on until
nothing decodes: a fixpoint, at whatever depth. A layer that shows the same text (or bytes) from the same characters of the
document again is not taken up, so data that decode to themselves end, while each copy of an encoded passage is scanned.
Every character of a layer knows the span of the document it comes from, so a secret found at any depth is mapped to the text
that hides it.

- Escapes are decoded in the whole layer at once, so that what they encode stays beside what it belongs to.
- Base64 runs (both alphabets) go on over line breaks, and over blanks after 40 characters; all four alignments are
  decoded, so that neither wrapping nor what is glued to a run hides it. Bytes are read as UTF-8, byte by byte where they are
  none (Latin-1 for instance), and as UTF-16 of both orders where it looks like that.
- Compressed data are looked for at every place of such bytes, and all members of a stream are inflated, in windows of
  ``WINDOW`` bytes, each with the last ``OVERLAP`` bytes of the one before: memory stays bounded whatever they inflate to.
  Of data that are damaged or cut off, what inflates is scanned.

Only documents that could matter reach the worklist: one linear-time expression over the Arrow column is implied by every
rule and every decoder.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import id_and_text, slices, texts

#: name: (expression, group of the secret). None matches fewer than 16 characters.
RULES: dict[str, tuple[str, int]] = {
    "aws_access_key": (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0),
    "github_token": (r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0),
    "slack_token": (r"\bxox[abprs]-[0-9A-Za-z-]{12,}", 0),
    "google_api_key": (r"\bAIza[0-9A-Za-z_-]{35}", 0),
    "stripe_key": (r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", 0),
    "json_web_token": (r"\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}", 0),
    "private_key": (r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0),
    "assigned_secret": (r"""(?i)(?<![\w-])(?=[\w-]*?(?:secret|token|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key))[\w-]++["']?[ \t]*+\s{0,4}(?::=|=>|[:=])[ \t]*+\s{0,4}["']?([A-Za-z0-9+/_.~=-]{12,})""", 1),
    "url_credentials": (r"(?<=[A-Za-z0-9])://[^\s/:@]+:(?!\[\w+\]@)([^\s/@]{6,})@[\w.-]{3,}", 1),
}

#: Implied by every rule and decoder. 22 characters of base64 are the fewest that hold 16 bytes.
GATE = r"""%[0-9A-Fa-f]{2}|\\[uUxnrt/"'\\]|&#?\w+;|[A-Za-z0-9+/_-]{22,}|[A-Za-z0-9+/_-][ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]|AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|[sr]k_(?:live|test)|PRIVATE KEY|(?i:secret|token|passw|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key)|://[^\s/:@]+:"""

WINDOW = 8 << 20
OVERLAP = 1 << 20
_COMPILED = {name: (re.compile(x), g) for name, (x, g) in RULES.items()}
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"""\\u\{0*([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|(&#?\w+;)|\\([nrt/"'\\])""")
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t"}
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+(?:(?:(?<=[A-Za-z0-9+/_-]{40})[ \t]+|[ \t]*\r?\n[ \t]*)[A-Za-z0-9+/_-]+)*")
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{22}|[A-Za-z0-9+/_-][ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]")
_GAP = re.compile(r"\s+")
_TO_STANDARD = str.maketrans("-_", "+/")
#: Bytes that could hold a secret or an encoded one as text: a rule has 16 ASCII characters in a row, or a scheme's sign.
_SOME_TEXT = re.compile(rb"[\t\n\r\x20-\x7e]{16}|://")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e\xa0-\xff]\x00){16,}|(?:\x00[\t\n\r\x20-\x7e\xa0-\xff]){16,}")
_MAGIC = re.compile(rb"(?P<gzip>\x1f\x8b\x08)|(?P<bzip2>BZh[1-9])|(?P<xz>\xfd7zXZ\x00)|(?P<zstd>\x28\xb5\x2f\xfd)|(?P<zlib>x[\x01\x5e\x9c\xda])")


def _zstd() -> object:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


_DECODERS: dict[str, Callable[[], object]] = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor, "zstd": _zstd}


class Layer:
    """A text whose character i comes from document characters first[i] .. last[i] - 1, by the decoders in ``path``."""

    __slots__ = ("first", "last", "path", "text")

    def __init__(self, text: str, first: np.ndarray, last: np.ndarray, path: tuple[str, ...] = ()):
        self.text, self.first, self.last, self.path = text, first, last, path

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start:end].min()), int(self.last[start:end].max())

    def key(self) -> tuple:
        """The text and where its characters come from; spans only narrow from layer to layer, so keys run out."""
        where = (int(self.first[0]), int(self.last[0])) if self.first.strides == (0,) and len(self.first) else hashlib.sha256(self.first.tobytes() + self.last.tobytes()).digest()
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), where


class Data:
    """Bytes in stretches: those up to cuts[i] come from the document's characters first[i] .. last[i] - 1."""

    __slots__ = ("cuts", "data", "first", "last", "path")

    def __init__(self, data: bytes, cuts: list[int], spans: list[tuple[int, int]], path: tuple[str, ...]):
        self.data, self.cuts, self.path = data, np.array(cuts), path
        self.first, self.last = (np.array(x, np.int64) for x in zip(*spans))

    def span(self, start: int, end: int) -> tuple[int, int]:
        own = slice(int(np.searchsorted(self.cuts, start, side="right")), int(np.searchsorted(self.cuts, max(start, end - 1), side="right")) + 1)
        return int(self.first[own].min()), int(self.last[own].max())

    def read(self, text: str, at: np.ndarray | int = 0) -> Layer:
        """A layer of text whose characters are from the bytes at these places (``at``: from there on, a byte each)."""
        if len(self.cuts) == 1:
            return Layer(text, np.broadcast_to(self.first[0], len(text)), np.broadcast_to(self.last[0], len(text)), self.path)
        own = np.minimum(np.searchsorted(self.cuts, at if isinstance(at, np.ndarray) else at + np.arange(len(text)), side="right"), len(self.cuts) - 1)
        return Layer(text, self.first[own], self.last[own], self.path)

    def key(self) -> tuple:
        return hashlib.sha256(self.data).digest(), hashlib.sha256(b"".join(x.tobytes() for x in (self.cuts, self.first, self.last))).digest(), bytes


def root(text: str) -> Layer:
    at = np.arange(len(text), dtype=np.int64)
    return Layer(text, at, at + 1)


def _rewritten(layer: Layer, found: re.Pattern, kind: str, decode: Callable[[re.Match], list[tuple[str, int, int]] | None]) -> Iterator[Layer]:
    """The layer with everything decoded that decodes; of equal length, parts map character by character."""
    text, first, last, at = [], [], [], 0

    def take(piece: str, start: int, end: int) -> None:
        if len(piece) == end - start:
            first.append(layer.first[start:end])
            last.append(layer.last[start:end])
        else:
            lo, hi = layer.span(start, end)
            first.append(np.full(len(piece), lo))
            last.append(np.full(len(piece), hi))
        text.append(piece)

    for m in found.finditer(layer.text):
        got = decode(m)
        if got is not None:
            if at < m.start():
                take(layer.text[at : m.start()], at, m.start())
            for part in got:
                take(*part)
            at = m.end()
    if at:
        if at < len(layer.text):
            take(layer.text[at:], at, len(layer.text))
        yield Layer("".join(text), np.concatenate(first), np.concatenate(last), (*layer.path, kind))


def _percent(m: re.Match) -> list[tuple[str, int, int]] | None:
    raw = bytes.fromhex(m.group().replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    at, out = m.start(), []
    for c in text:
        width = 3 * (len(c.encode()) if len(text) != len(raw) else 1)
        out.append((c, at, at + width))
        at += width
    return out


def _escape(m: re.Match) -> list[tuple[str, int, int]] | None:
    simple = m.group(6)
    if simple:
        return [(_SIMPLE.get(simple, simple), m.start(), m.end())]
    code = next((x for x in m.groups()[:4] if x), None)
    if code is None:
        text = html.unescape(m.group())
        return None if text == m.group() else [(text, m.start(), m.end())]
    n = int(code, 16)
    return None if n > 0x10FFFF or 0xD800 <= n < 0xE000 else [(chr(n), m.start(), m.end())]


def _percent_bytes(layer: Layer) -> Iterator[Data]:
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m.group().replace("%", ""))
        if _MAGIC.search(raw):
            yield Data(raw, [len(raw)], [layer.span(m.start(), m.end())], (*layer.path, "url"))


def inflated(data: bytes, at: int, name: str) -> Iterator[tuple[bytes, list[int], list[tuple[int, int]], bool]]:
    """What the stream at ``at`` and further members right after it inflate to, in windows: the bytes, where each member's
    end, from where to where in ``data`` each is, and whether the stream ends there. A member of several windows counts as
    going on to the end of the data, until it ends."""
    held, place = bytearray(), at
    cuts: list[int] = []
    spans: list[tuple[int, int]] = []
    fresh = False  # whether there is more than the last window's end
    while True:
        done, fed = False, place
        for got, fed, done in _member(data, place, name):
            held += got
            fresh |= bool(got)
            while len(held) > WINDOW:
                yield bytes(held[:WINDOW]), [*[min(c, WINDOW) for c in cuts], WINDOW], [*spans, (place, len(data))], False
                del held[: WINDOW - OVERLAP]
                gone = sum(c <= WINDOW - OVERLAP for c in cuts)
                cuts, spans = [c - WINDOW + OVERLAP for c in cuts[gone:]], spans[gone:]
        cuts.append(len(held))
        spans.append((place, fed))
        if not done:
            break
        place = fed
        if not (m := _MAGIC.match(data, place)) or m.lastgroup != name:
            break
    if fresh and held:
        yield bytes(held), cuts, spans, done


def _member(data: bytes, at: int, name: str) -> Iterator[tuple[bytes, int, bool]]:
    """What one member inflates to, bit by bit: (bytes, up to where it was read, whether it ended)."""
    decoder, fed = _DECODERS[name](), at
    step = 1 << 14
    while fed < len(data):
        try:
            got = decoder.decompress(data[fed : fed + step])
        except Exception as e:  # the decoders raise errors of five kinds on data that only look compressed or are damaged
            if isinstance(e, MemoryError):
                raise
            if step == 1:
                return
            decoder, step = _DECODERS[name](), 1  # once more, to get what comes before the damage
            for lo in range(at, fed, 1 << 14):
                decoder.decompress(data[lo : min(fed, lo + (1 << 14))])
            continue
        fed = min(len(data), fed + step)
        if decoder.eof:
            yield got, fed - len(decoder.unused_data), True
            return
        yield got, fed, False


def _widths(text: str, size: int) -> np.ndarray:
    """How many of its ``size`` bytes each character takes."""
    return np.ones(len(text), np.int64) if len(text) == size else np.array([len(c.encode("utf-8", "surrogateescape")) for c in text], np.int64)


def _wide(data: bytes) -> Iterator[tuple[str, int]]:
    for m in _WIDE.finditer(data):
        yield m.group().decode("utf-16-be" if m.group()[0] == 0 else "utf-16-le"), m.start()


def _unpacked(layer: Data) -> Iterator[Layer | Data]:
    """All layers one step below bytes: their readings as text, and what is compressed in them."""
    data = layer.data
    if _SOME_TEXT.search(data):
        text = data.decode("utf-8", "surrogateescape")
        yield layer.read(text, 0 if len(text) == len(data) or len(layer.cuts) == 1 else np.cumsum(_widths(text, len(data))) - 1)
    for text, at in _wide(data):
        yield layer.read(text, at + 2 * np.arange(len(text)))
    yield from _streams(data, layer.span, layer.path)


def _streams(data: bytes, span: Callable[[int, int], tuple[int, int]], path: tuple[str, ...]) -> Iterator[Data]:
    after = 0
    for m in _MAGIC.finditer(data):
        if m.start() >= after:
            for out, cuts, spans, done in inflated(data, m.start(), m.lastgroup):
                yield Data(out, cuts, [span(*x) for x in spans], (*path, m.lastgroup))
                after = spans[-1][1] if done else after  # inside a whole stream there is no other


def _base64(layer: Layer) -> Iterator[Layer | Data]:
    if not _LONG_RUN.search(layer.text):
        return
    for m in _BASE64.finditer(layer.text):
        if m.end() - m.start() < 22:
            continue
        run = m.group().translate(_TO_STANDARD)
        where = np.arange(m.start(), m.end())
        if _GAP.search(run):
            where = where[[not c.isspace() for c in run]]
            run = _GAP.sub("", run)
        for shift in range(4):
            body = run[shift:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            if len(body) < 22:
                break
            data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
            path = (*layer.path, "base64")
            at = where[shift:]
            readings = [(w, i + 2 * np.arange(len(w)), 2) for w, i in _wide(data)]
            if _SOME_TEXT.search(data):
                text = data.decode("utf-8", "surrogateescape")
                width = _widths(text, len(data))
                readings.append((text, np.cumsum(width) - width, width))
            for text, begin, width in readings:
                end = np.minimum(-(-(begin + width) * 4 // 3), len(at)) - 1
                yield Layer(text, layer.first[at[begin * 4 // 3]], layer.last[at[end]], path)
            yield from _streams(data, lambda i, j: layer.span(int(at[i * 4 // 3]), int(at[min(-(-j * 4 // 3), len(at)) - 1]) + 1), path)  # noqa: B023


def decode_layers(layer: Layer | Data) -> Iterator[Layer | Data]:
    """All layers one step below."""
    if isinstance(layer, Data):
        yield from _unpacked(layer)
        return
    yield from _rewritten(layer, _PERCENT, "url", _percent)
    yield from _percent_bytes(layer)
    yield from _rewritten(layer, _ESCAPE, "unicode", _escape)
    yield from _base64(layer)


def scan(text: str, decoders: Callable[[Layer | Data], Iterator[Layer | Data]] = decode_layers) -> list[tuple[str, int, int, str, int, str]]:
    """(rule, start, end, path, depth, SHA-256 of the secret) of all secrets of a text, spans in its own characters.

    Sorted, without repeats; a secret that several layers show at one place is reported for the least deep (of equally deep
    ones for the first path by name).
    """
    work: list[Iterator[Layer | Data]] = [iter([root(text)])]  # depth first, so that few windows are held at a time
    seen: set[tuple] = set()
    found: dict[tuple[str, int, int, str], tuple[int, str]] = {}
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        shown = layer.key()
        if shown in seen:
            continue
        seen.add(shown)
        if isinstance(layer, Layer):
            about = (len(layer.path), ">".join(layer.path))
            for name, (rule, group) in _COMPILED.items():
                for m in rule.finditer(layer.text):
                    start, end = layer.span(*m.span(group))
                    key = (name, start, end, hashlib.sha256(m.group(group).encode("utf-8", "surrogateescape" if layer.path else "surrogatepass")).hexdigest())
                    found[key] = min(about, found.get(key, about))
        work.append(decoders(layer))
    return sorted((name, start, end, path, depth, digest) for (name, start, end, digest), (depth, path) in found.items())


SCHEMA = "doc_id bigint, rule string, start int, end int, path string, depth int, secret_sha256 string"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("path", pa.string()), ("depth", pa.int32()), ("secret_sha256", pa.string())])


def _gated(text: pa.Array) -> list[int]:
    return np.nonzero(pc.match_substring_regex(text, GATE).to_numpy(zero_copy_only=False))[0].tolist()


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a secret: rule, span ``[start, end)`` in the document's characters, decoders passed, digest of the secret.

    Every row of ``docs`` is scanned, repeated ones and ones without an id too; null and empty texts have no secrets. Ties (a
    secret shown at one place by several layers) go to the least deep layer. The secret itself is not returned. Other columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = texts(batch)
            rows = [(batch.column(0)[i].as_py(), *hit) for i in _gated(text) for hit in scan(text[i].as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def _cut(text: str, hits: list[tuple[str, int, int, str, int, str]]) -> str:
    out, at = [], 0
    spans: list[list] = []
    for name, start, end, *_ in sorted(hits, key=lambda x: (x[1], -x[2], x[0])):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end, name])
    for start, end, name in spans:
        out += [text[at:start], f"[{name}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(text: str) -> str:
    """The text with each secret's span replaced by the name of the rule; spans that meet are one (its first rule's).

    What is left is scanned again, until it has no secrets.
    """
    while hits := scan(text):
        new = _cut(text, hits)
        if new == text:
            break
        text = new
    return text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets redacted and, if ``length_col`` is a column, the length of changed texts brought up to date.

    All rows and columns stay, repeated rows too. Null texts stay null, empty ones empty; where nothing is redacted the length
    stays what it was, null included. Columns of any other name are passed on as they are.
    """
    cols = docs.columns
    length = length_col if length_col in cols else None
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in cols]).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            k = batch.schema.get_field_index(text_col)
            text = texts(batch, text_col)
            new = {i: r for i in _gated(text) if (r := redacted(t := text[i].as_py())) != t}
            if new:
                mask = np.zeros(len(text), bool)
                mask[list(new)] = True
                kind = batch.schema.field(k).type
                batch = batch.set_column(k, batch.schema.field(k), pc.replace_with_mask(batch.column(k), pa.array(mask), pa.array(list(new.values()), kind)))
                if length:
                    n = batch.schema.get_field_index(length)
                    kind = batch.schema.field(n).type
                    batch = batch.set_column(n, batch.schema.field(n), pc.replace_with_mask(batch.column(n), pa.array(mask), pa.array([len(x) for x in new.values()], kind)))
            yield batch

    return docs.mapInArrow(run, schema)
