"""License scans: a paragraph classifier, confirmed by comparison with templates.

Every paragraph (a line of text) is classified by softmax regression on its distinct words and word pairs and triples, with
one class for each licence family and one for what is no licence. It is trained from the families' templates: whole,
shortened, and with names, years and other words put in. Paragraphs of a bounded sample of documents that resemble no
template, and sentences that merely share words with licences, are the unknown class. Probabilities are calibrated on
held-out rows twice: by a temperature, and by the least probability at which no more than ``false_share`` of held-out
unknown rows are taken for a family; whatever stays below is unknown.

A predicted paragraph is confirmed if most of its word triples are those of a template of the family, or it has most of a
template's. Neighbouring paragraphs of one family are one finding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .license_templates import LOOKALIKES, TEMPLATES
from .shared import hash_strings, id_and_text, mix64, slices, split_words, starts_of, texts

UNKNOWN = "unknown"
SAMPLE_DOCS = 400
SAMPLE_LINES = 4_000
VARIANTS = 60
FALSE_SHARE = 0.001
MIN_SIMILARITY = 0.5
_SLICE = 4 << 20

SCHEMA = "doc_id bigint, family string, start int, end int, probability double, template string, similarity double, confirmed boolean"
_FIELDS = pa.schema([("doc_id", pa.int64()), ("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("template", pa.string()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])


def grams(lines: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of words, pairs and triples of each line; the line of each; the number of words of each line."""
    codes, words, lens = split_words(pc.utf8_lower(lines))
    h = hash_strings(pc.utf8_trim(words, ".,;:!?()[]\"'`*#<>"))[codes]
    line = np.repeat(np.arange(len(lens)), lens)
    hashes, owner, full = [h], [line], h
    for n in (1, 2):
        full = mix64(full[: max(0, len(h) - n)] * np.uint64(0x9E3779B97F4A7C15) + h[n:])  # one word longer, at the same place
        inside = line[n:] == line[: max(0, len(line) - n)]
        hashes.append(full[inside])
        owner.append(line[n:][inside])
    return hashes, owner, lens


def by_line(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same in one array, ordered by line."""
    hashes, owner, _ = grams(lines)
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return h[order], o[order]


def grams_of(text: str) -> list[set[int]]:
    """Hashes of the words, pairs and triples of one text."""
    return [set(x.tolist()) for x in grams(pa.array([text]))[0]]


def longest(sets: list[set[int]]) -> int:
    """Triples if there are any, else pairs, else words."""
    return max((n for n in range(3) if sets[n]), default=0)


@dataclass
class Classifier:
    model: linear.Model
    least: float
    templates: dict[str, list[tuple[str, int, set[int]]]]

    def similarity(self, family: str, text: str) -> tuple[str, float]:
        """The template of the family that a text is most like, and how much it is: of the one that has fewer word triples
        (pairs for a template of two words), the share that the other has too."""
        own, best = grams_of(text), ("", 0.0)
        for name, n, theirs in self.templates[family]:
            share = len(own[n] & theirs) / max(1, min(len(own[n]), len(theirs)))
            if share > best[1]:
                best = (name, share)
        return best


def variants(text: str, n: int, rng: np.random.Generator, filler: list[str]) -> list[str]:
    """The text itself and n texts made from it: cut to windows, some words dropped, others put in or around."""
    words, out = text.split(), [text]
    for _ in range(n):
        own = list(words)
        if len(own) > 12 and rng.random() < 0.7:
            size = int(rng.integers(8, len(own) + 1))
            at = int(rng.integers(0, len(own) - size + 1))
            own = own[at : at + size]
        elif len(own) > 6 and rng.random() < 0.3:
            del own[int(rng.integers(len(own)))]
        for side in (0, len(own)):
            if rng.random() < 0.3:
                own[side:side] = [str(w) for w in rng.choice(filler, int(rng.integers(1, 6)))]
        out.append(" ".join(own))
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, n_variants: int = VARIANTS, false_share: float = FALSE_SHARE, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> Classifier:
    """The classifier, from the templates and at most ``sample_lines`` paragraphs of ``sample_docs`` documents of ``docs``
    (those of the least id hashes). Without documents the unknown class has only sentences like licences."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    sets = {f: [grams_of(t) for t in TEMPLATES[f]] for f in families}
    held = {f: [(f"{f}-{i}", longest(x), x[longest(x)]) for i, x in enumerate(sets[f])] for f in families}
    every = set().union(*(x[2] for f in families for x in sets[f]))
    some = id_and_text(docs, id_col, text_col).where("doc_id is not null and text is not null")
    ids = some.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)  # ids alone are gathered, then their texts are found
    chosen = some.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    lines = chosen.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''").orderBy(F.xxhash64("doc_id", "line"), "line").limit(sample_lines).toArrow().column("line").to_pylist()
    unknown = [x for x in lines if not (t := grams_of(x)[2]) or len(t & every) < 0.2 * len(t)]
    filler = sorted({w for x in unknown[:200] for w in x.split()[:20]} | {"2019", "2024", "John", "Smith", "Inc.", "Copyright", "(c)", "the", "Contributors", "project", "file"})
    rows, target = [], []
    for c, f in enumerate(families, 1):
        made = [v for t in TEMPLATES[f] for v in variants(t, n_variants, rng, filler)]
        rows += made
        target += [c] * len(made)
    made = unknown + [v for t in LOOKALIKES for v in variants(t, n_variants, rng, filler)]
    rows, target = rows + made, np.array(target + [0] * len(made))
    h, o = by_line(pa.array(rows))
    feats = np.split(h, np.cumsum(np.bincount(o, minlength=len(rows)))[:-1])
    model = linear.fit(feats, target, [UNKNOWN, *families], min_rows=5, least_z=5.0, l2=0.01, steps=150, held_out=0.2)
    test = np.random.default_rng(7).random(len(rows)) < 0.2  # the rows that fit held out for its temperature
    p = model.posteriors(h, o, len(rows))[test & (target == 0)]
    wrong = np.sort(1 - p[:, 0])
    least = float(max(0.5, wrong[min(len(wrong) - 1, int(np.ceil((1 - false_share) * len(wrong))))] if len(wrong) else 0.5))
    return Classifier(model, least, held)


def classify(c: Classifier, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class (0: unknown) and probability of each line."""
    hashes, owner, lens = grams(lines)
    where, row = [], []
    for h, o in zip(hashes, owner):
        at, r = c.model.rows_of(h)
        where.append(o[at])
        row.append(r)
    where, row = np.concatenate(where), np.concatenate(row)
    pair = np.unique(where.astype(np.int64) * max(1, len(c.model.keys)) + row)
    where, row = pair // max(1, len(c.model.keys)), pair % max(1, len(c.model.keys))
    lit, first = np.unique(where, return_index=True)
    kind, prob = np.zeros(len(lines), np.int64), np.ones(len(lines))
    if len(lit):
        logits = np.add.reduceat(c.model.weights[row].astype(np.float64), first, axis=0) + c.model.bias
        p = linear.softmax(logits / c.model.temperature)
        best = p[:, 1:].argmax(axis=1) + 1
        family = 1 - p[:, 0]
        yes = (family >= c.least) & (p[np.arange(len(p)), best] >= 0.5)
        kind[lit] = np.where(yes, best, 0)
        prob[lit] = np.where(yes, p[np.arange(len(p)), best], p[:, 0])
    return kind, prob


def findings(docs: DataFrame, classifier: Classifier, min_similarity: float = MIN_SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a finding: family, span ``[start, end)`` in the document's characters, probability, the most similar
    template of the family, how similar it is, and whether that confirms it.

    Every row and every line is classified, whole. Null and empty texts have no findings; repeated rows have the same ones each;
    a null id is returned as null. Ties: of families that are equally likely, and of templates equally similar, the first by
    name counts. Other columns are ignored; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        cache: dict[tuple[str, str], tuple[str, float]] = {}
        for batch in slices(batches, limit=_SLICE):
            lists = pc.split_pattern(texts(batch), "\n")
            lines, per = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            kind, prob = classify(c, lines)
            hit = np.nonzero(kind)[0]
            if not len(hit):
                continue
            first = starts_of(per)
            doc = np.searchsorted(first, hit, side="right") - 1
            size = starts_of(pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (doc[1:] != doc[:-1]) | (kind[hit[1:]] != kind[hit[:-1]])
            begin = np.nonzero(new)[0]
            rows = []
            for lo, hi in zip(begin, [*begin[1:], len(hit)]):
                a, b, d = hit[lo], hit[hi - 1], doc[lo]
                family = c.model.classes[kind[a]]
                text = " ".join(lines[int(i)].as_py() for i in range(a, b + 1))
                if (family, text) not in cache:
                    if len(cache) > 50_000:
                        cache.clear()
                    cache[family, text] = c.similarity(family, text)
                name, like = cache[family, text]
                rows.append((batch.column(0)[int(d)].as_py(), family, size[a] - size[first[d]], size[b + 1] - 1 - size[first[d]], prob[a : b + 1].max(), name or None, like, like >= min_similarity))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
