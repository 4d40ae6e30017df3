"""Spans of many terms in one pass over each text, and overlaps resolved in the same pass: Arrow batches, no shuffle.

Phrases go into one automaton, which finds all of them at once, however many there are; expressions are compiled once a task.
Only the text column goes to Python, and finished annotations come back. The functions are called nondeterministic so that no
optimizer copies a call into several places: each text is searched once however often its annotations are used. For one sparse expression
:func:`annolith.functions.spans.spans` stays inside the JVM.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ANNOTATIONS
from .spans import SPAN, _cases, bounded, once

_STRINGS = ("label", "layer", "source", "type", "subtype", "metadata")
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: Where lower case depends on what is around, or takes two characters.
_ODD_ALWAYS = "İΣς"
#: Bytes of a batch that are taken apart at once. A batch of Spark's holds thousands of rows, whose spans as Python objects take many
#: times its size; by pieces, what a worker holds besides the batch is the same for any input.
PIECE = 1 << 18


@dataclass(frozen=True)
class Term:
    """A phrase or a regular expression, what its annotations say, and phrases that no match may overlap."""

    pattern: str
    label: str | None = None
    layer: str | None = None
    source: str | None = None
    type: str | None = None
    subtype: str | None = None
    metadata: str | None = None
    phrase: bool = True
    ignore_case: bool = True
    bounded: bool = True
    barred: tuple[str, ...] = ()
    priority: int = 0


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Matcher:
    """Finds terms as ``re.finditer`` would, each by itself."""

    def __init__(self, terms: list[Term]):
        import ahocorasick

        self.terms = list(terms)
        hidden: dict[tuple[str, bool], int] = {}
        every = list(terms)
        self.barred: list[list[int]] = []
        for t in terms:
            own = []
            for phrase in t.barred:
                if (phrase, t.ignore_case) not in hidden:
                    hidden[phrase, t.ignore_case] = len(every)
                    every.append(Term(phrase, ignore_case=t.ignore_case))
                own.append(hidden[phrase, t.ignore_case])
            self.barred.append(own)
        self.every = every
        self.expressions = [(i, re.compile(bounded(t.pattern) if t.bounded else t.pattern, re.I if t.ignore_case else 0)) for i, t in enumerate(every) if not t.phrase]
        phrases = [(i, t) for i, t in enumerate(every) if t.phrase and t.pattern]
        self.size = [len(t.pattern) for t in every]
        self.automata, self.odd = {}, None
        for fold in (True, False):
            keys: dict[str, list[int]] = {}
            for i, t in phrases:
                if t.ignore_case is fold:
                    keys.setdefault(t.pattern.lower() if fold else t.pattern, []).append(i)
            if fold and keys:
                # characters that match a letter of a phrase though their lower case isn't that of the letter
                letters = {c for k in keys for c in k if c.isalpha()}
                odd = {x for c in letters if c <= "￿" for x in _cases(c)[1:-1] if x.lower() != c} | set(_ODD_ALWAYS)
                self.odd = re.compile("[" + "".join(sorted(odd)) + "]")
            if keys:
                machine = self.automata[fold] = ahocorasick.Automaton()
                for k, v in keys.items():
                    machine.add_word(k, v)
                machine.make_automaton()
        self.slow = [(i, re.compile(rf"(?<!\w){re.escape(t.pattern)}(?!\w)" if t.bounded else re.escape(t.pattern), re.I)) for i, t in phrases if t.ignore_case]

    def spans(self, text: str) -> list[list[tuple[int, int]]]:
        """The spans of each term, hidden ones last."""
        found: list[list[tuple[int, int]]] = [[] for _ in self.every]
        for i, expression in self.expressions:
            found[i] = [m.span() for m in expression.finditer(text)]
        for fold, machine in self.automata.items():
            if fold and self.odd.search(text):
                for i, expression in self.slow:
                    found[i] = [m.span() for m in expression.finditer(text)]
                continue
            n = len(text)
            for last, which in machine.iter(text.lower() if fold else text):
                end = last + 1
                for i in which:
                    start, own = end - self.size[i], found[i]
                    if own and start < own[-1][1]:
                        continue
                    if self.every[i].bounded and ((start and _is_word(text[start - 1])) or (end < n and _is_word(text[end]))):
                        continue
                    own.append((start, end))
        return found

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, term) in the order of terms, then of places, without those that overlap a barred phrase."""
        found = self.spans(text)
        out = []
        for i, own in enumerate(found[: len(self.terms)]):
            if own and self.barred[i]:
                taken = [s for b in self.barred[i] for s in found[b]]
                own = [s for s in own if not any(s[0] < e and b < s[1] for b, e in taken)]
            out += [(s, e, i) for s, e in own]
        return out


# ---------------------------------------------------------------- overlaps


class Kept:
    """Spans that don't overlap each other, in text order; spans that merely touch don't overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Take a span in unless it overlaps one."""
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        at = bisect_left(self.starts, start)
        while at < len(self.starts) and self.starts[at] == start and self.ends[at] < end:
            at += 1
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def greedy(spans: list[tuple[int, int]], order: list[int]) -> list[int]:
    """Of the spans, taken in this order, the numbers of those that overlap none taken before, in that order."""
    kept = Kept()
    return [i for i in order if kept.add(*spans[i])]


STRATEGIES = ("all", "longest", "priority", "longest_priority")


def conflict_order(hits: list[tuple[int, int, int]], priorities: list[int], strategy: str) -> list[int]:
    """What pattern rules found, by strategy, in text order. Ties go by place in ``hits``."""
    if strategy == "all":
        return sorted(range(len(hits)), key=lambda i: hits[i][:2])
    key = {
        "longest": lambda i: (hits[i][0] - hits[i][1], hits[i][0]),
        "priority": lambda i: (-priorities[hits[i][2]], hits[i][0] - hits[i][1], hits[i][0]),
        "longest_priority": lambda i: (hits[i][0] - hits[i][1], -priorities[hits[i][2]], hits[i][0]),
    }[strategy]
    kept = greedy([h[:2] for h in hits], sorted(range(len(hits)), key=key))
    return sorted(kept, key=lambda i: hits[i][:2])


# ---------------------------------------------------------------- columns


def sizes(array: pa.Array) -> np.ndarray:
    """About how many bytes each row of strings, lists of numbers and strings, or structs of these takes."""
    if pa.types.is_struct(array.type):
        return sum((sizes(x) for x in array.flatten()), np.zeros(len(array), np.int64))
    if pa.types.is_list(array.type):
        each = pc.list_value_length(array).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(each)
        inner = np.concatenate([[0], np.cumsum(sizes(array.flatten()))])
        return inner[ends] - inner[ends - each] + 8
    if pa.types.is_string(array.type) or pa.types.is_large_string(array.type):
        return pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 8
    return np.full(len(array), 8, np.int64)


def pieces(batch: pa.Array, most: int = PIECE) -> Iterator[pa.Array]:
    """The batch's rows in order, in slices of at most so many bytes, or of one row."""
    total, at = np.cumsum(sizes(batch)), 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(total, most + (total[at - 1] if at else 0), "right")))
        yield batch.slice(at, end - at)
        at = end


def by_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield from pieces(batch)


def annotations(text: Column, terms: list[Term], strategy: str | None = None) -> Column:
    """Annotations of all terms in the order of terms, or what a conflict strategy leaves in text order; empty for a null text."""
    if strategy is not None and strategy not in STRATEGIES:
        raise ValueError(f"Unsupported conflict strategy: {strategy}")
    constants = {f: pa.array([getattr(t, f) for t in terms], pa.string()) for f in _STRINGS}
    priorities = [t.priority for t in terms]

    @F.arrow_udf(ANNOTATIONS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(terms)
        for batch in by_pieces(batches):
            offsets, start, end, which, words = [0], [], [], [], []
            for t in batch.to_pylist():
                hits = matcher.hits(t) if t else []
                if strategy is not None and len(hits) > 1:
                    hits = [hits[i] for i in conflict_order(hits, priorities, strategy)]
                for s, e, i in hits:
                    start.append(s)
                    end.append(e)
                    which.append(i)
                    words.append(t[s:e])
                offsets.append(len(start))
            index = pa.array(which, pa.int32())
            fields = {f: c.take(index) for f, c in constants.items()} | {"start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "text": pa.array(words, pa.string()), "score": pa.nulls(len(start), pa.float64())}
            struct = pa.StructArray.from_arrays([fields[f.name] for f in ANNOTATIONS.elementType.fields], names=[f.name for f in ANNOTATIONS.elementType.fields])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)

    return run.asNondeterministic()(text)


def spans(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """All matches of an expression as an array of (start, end): for expressions with many matches. Null for a null text."""

    @F.arrow_udf(SPAN)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        expression = re.compile(pattern, re.I if ignore_case else 0)
        for batch in by_pieces(batches):
            offsets, start, end, texts = [0], [], [], batch.to_pylist()
            for t in texts:
                for m in expression.finditer(t) if t is not None else ():
                    start.append(m.start())
                    end.append(m.end())
                offsets.append(len(start))
            struct = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], fields=list(_SPAN.value_type))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.array([*(t is None for t in texts), False])), struct)

    return run.asNondeterministic()(text)


# ---------------------------------------------------------------- annotations made before


def _priority(metadata: str | None, known: dict[str | None, int]) -> int:
    got = known.get(metadata)
    if got is None:
        try:
            got = int((json.loads(metadata) or {}).get("priority") or 0)
        except (TypeError, ValueError, AttributeError):
            got = 0
        known[metadata] = got
    return got


def _text_key(x: str | None) -> tuple[bool, str]:
    return (x is not None, x or "")


@dataclass(frozen=True)
class Choice:
    """How annotations are chosen: keys of preference, the order of the result, and the one layer concerned (else all)."""

    prefer: tuple[str, ...]
    result: str = "place"
    layer: str | None = None
    one_layer: bool = False
    ranks: tuple[tuple[str, int], ...] = ()

    @property
    def columns(self) -> list[str]:
        wanted = {"priority": "metadata", "rank": "layer", "label": "label"}
        more = {wanted[k] for k in self.prefer if k in wanted} | ({"layer"} if self.one_layer else set()) | ({"layer", "label"} if self.result == "label" else set())
        return ["start", "end", *sorted(more)]

    def pick(self, row: dict[str, list], known: dict[str | None, int]) -> list[int]:
        """The numbers of the annotations that stay, in the order of the result."""
        start, end = ([x or 0 for x in row[c]] for c in ("start", "end"))  # without offsets: nothing, at the beginning
        every = range(len(start))
        own = [i for i in every if row["layer"][i] == self.layer] if self.one_layer else list(every)
        if self.result == "paint":
            at, out = 0, []
            for i in sorted(own, key=lambda i: (start[i], start[i] - end[i])):
                if start[i] >= at:
                    out.append(i)
                    at = end[i]
            return out
        ranks = dict(self.ranks)
        keys = {
            "length": lambda i: start[i] - end[i],
            "start": lambda i: start[i],
            "priority": lambda i: -_priority(row["metadata"][i], known),
            "rank": lambda i: -ranks.get(row["layer"][i] or "", 0),
            "label": lambda i: _text_key(row["label"][i]),
        }
        kept = greedy(list(zip(start, end)), sorted(own, key=lambda i: tuple(keys[k](i) for k in self.prefer))) if self.prefer else own
        if self.one_layer:
            mine = set(own)
            kept = [i for i in every if i not in mine] + (kept if self.result == "label" else sorted(kept))
        if self.result == "label":
            return sorted(kept, key=lambda i: (start[i], end[i], _text_key(row["layer"][i]), _text_key(row["label"][i])))
        if self.prefer == ("length",) and not self.one_layer:
            kept = sorted(kept)
        return sorted(kept, key=lambda i: (start[i], end[i]))


_PLACES = T.ArrayType(T.IntegerType())


def places_chosen(annotations: Column, choices: tuple[Choice, ...]) -> Column:
    """Where in the array the annotations are that choices, one after the other, leave, in the last one's order; null for null.

    Only what the choices look at goes to Python, and only places come back.
    """
    columns = list(dict.fromkeys(c for choice in choices for c in choice.columns))

    @F.arrow_udf(_PLACES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str | None, int] = {}
        for batch in by_pieces(batches):
            out: list[list[int] | None] = []
            for values in zip(*(c.to_pylist() for c in batch.flatten())):
                if values[0] is None:
                    out.append(None)
                    continue
                row, places = dict(zip(columns, values)), list(range(len(values[0])))
                for choice in choices:
                    if len(places) > 1 or choice.result == "paint":
                        picked = choice.pick(row, known)
                        row, places = {c: [v[i] for i in picked] for c, v in row.items()}, [places[i] for i in picked]
                out.append(places)
            yield pa.array(out, pa.list_(pa.int32()))

    return run.asNondeterministic()(F.struct(*[annotations[c].alias(c) for c in columns]))


def chosen(annotations: Column, *choices: Choice) -> Column:
    """The annotations that a choice leaves, in its order; null for null. A choice of what another one left is made with it."""
    source, before = vars(annotations).get("_chosen", (annotations, ()))
    choices = (*before, *choices)
    both = F.struct(places_chosen(source, choices).alias("p"), source.alias("a"))
    out = once(both, lambda x: F.transform(x["p"], lambda i: F.get(x["a"], i)))
    vars(out)["_chosen"] = (source, choices)
    return out


def holders(start: list[int], end: list[int], outer: list[tuple[int, int]], exact: bool) -> list[int | None]:
    """For each span the first of ``outer`` that is the same, or that holds it."""
    if exact:
        first: dict[tuple[int, int], int] = {}
        for i, x in enumerate(outer):
            first.setdefault(x, i)
        return [first.get(x) for x in zip(start, end)]
    if all(a[1] <= b[0] and a[0] <= a[1] for a, b in zip(outer, outer[1:])):  # apart and in order, as sentences are
        begins = [x[0] for x in outer]
        out: list[int | None] = []
        for s, e in zip(start, end):
            at = bisect_right(begins, s) - 1
            while at > 0 and outer[at - 1][1] >= e and outer[at - 1][0] <= s:
                at -= 1
            out.append(at if at >= 0 and outer[at][0] <= s and e <= outer[at][1] else None)
        return out
    return [next((i for i, (b, f) in enumerate(outer) if b <= s and e <= f), None) for s, e in zip(start, end)]


def places(inner: Column, outer: Column, exact: bool) -> Column:
    """For each span of ``inner`` the place in ``outer`` (both arrays of structs with start and end) of :func:`holders`."""

    @F.arrow_udf(_PLACES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in by_pieces(batches):
            rows = zip(*(c.to_pylist() for c in batch.flatten()))
            yield pa.array([None if a is None else holders(a, b, [(-1, -1) if None in x else x for x in zip(c or [], d or [])], exact) for a, b, c, d in rows], pa.list_(pa.int32()))

    fields = [x[f].alias(f"{n}{f}") for n, x in (("inner_", inner), ("outer_", outer)) for f in ("start", "end")]
    return run.asNondeterministic()(F.struct(*fields))
