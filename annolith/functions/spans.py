"""Spans of regular expressions as built-in expressions, and small scalar functions on spans, texts and names.

``spans`` marks every match with sentinels, splits at the opening one and adds up lengths: a fold inside the JVM, no Python
worker, no shuffle. Offsets are those of Python's ``re.finditer``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_OPEN, _CLOSE = "\x01", "\x02"


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """A Python pattern in Java's dialect: named groups, ``\\Z``, Unicode classes and case."""
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", pattern)
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern)
    return ("(?iuU)" if ignore_case else "(?uU)") + pattern


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is used: a lambda's argument, which no optimizer inlines."""
    return F.transform(F.array(value), use)[0]


@cache
def _cases(letter: str) -> str:
    """A class of all characters that a letter matches when case is ignored; much faster than a flag that folds each place."""
    same = re.compile(letter, re.I)
    every = "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000)
    return "[" + "".join(sorted(set(same.findall(every)) | {letter})) + "]"


def literal_pattern(literal: str, bounded: bool = True, fold: bool = False) -> str:
    """A pattern for a phrase, by default only where no word character is next to it; ``fold``: of whatever case.

    The phrase comes first and what is before it is looked at last, so that most places fail on its first letter.
    """
    quoted = "".join((_cases(c) if fold and c < "\uffff" else c) if c.isalpha() else c if c.isalnum() or c.isspace() or c == "_" else "\\" + c for c in literal)
    return rf"{quoted}(?!\w)(?<!\w{quoted})" if bounded else quoted


def bounded(pattern: str) -> str:
    return rf"(?<!\w)(?:{pattern})(?!\w)"


def spans(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """All matches of ``pattern`` as an array of (start, end), in text order; null for a null text.

    One difference from Python: a pattern that matches nothing at all (``x*``) also does so inside a character beyond
    U+FFFF, which the JVM holds as two units.
    """
    odd = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    clean = F.when(odd, F.translate(text, _OPEN + _CLOSE, "\x03\x03")).otherwise(text)
    marked = F.split(F.regexp_replace(clean, F.lit(java_pattern(pattern, ignore_case)), F.lit(_OPEN + "$0" + _CLOSE)), _OPEN)
    empty = F.array().cast(SPAN)

    def step(acc: Column, part: Column) -> Column:
        size = F.locate(_CLOSE, part) - F.lit(1)
        span = F.struct(acc["at"].alias("start"), (acc["at"] + size).alias("end"))
        return F.struct((acc["at"] + F.length(part) - F.lit(1)).alias("at"), F.array_append(acc["out"], span).alias("out"))

    def fold(parts: Column) -> Column:
        start = F.struct(F.length(parts[0]).alias("at"), empty.alias("out"))
        found = F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), start, step, lambda acc: acc["out"])
        return F.when(F.size(parts) > 1, found).otherwise(empty)

    return F.when(text.isNotNull(), once(marked, fold))


def surface(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + F.lit(1), end - start)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Spans that merely touch don't overlap."""
    return (a_start < b_end) & (b_start < a_end)


def split_camel_case(name: Column) -> Column:
    return F.regexp_replace(name, "(?<!^)(?=[A-Z])", " ")


def short_name(uri: Column) -> Column:
    """What follows the last ``#``, or else the last ``/``."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def meta(metadata: Column, key: str) -> Column:
    """A value of the metadata as text, null if absent or null."""
    return F.get_json_object(metadata, f"$['{key}']")


def canonical(text: Column, metadata: Column) -> Column:
    """What an annotation is about: concept, entity, normalized value (with unit or grain), or its text in lower case."""
    filled = lambda key: F.nullif(meta(metadata, key), F.lit(""))
    normal = meta(metadata, "normalized")
    return F.coalesce(
        F.concat(F.lit("concept_uri:"), filled("concept_uri")),
        F.concat(F.lit("wikidata:"), filled("wikidata")),
        F.concat(F.lit("normalized:"), normal, F.coalesce(F.concat(F.lit("|unit:"), filled("unit")), F.concat(F.lit("|grain:"), filled("grain")), F.lit(""))),
        F.concat(F.lit("text:"), strip(F.lower(F.coalesce(text, F.lit(""))))),
    )


def smoothed_idf(documents: Column, df: Column) -> Column:
    return F.when(documents <= 0, F.lit(0.0)).otherwise(F.ln((documents + 1) / (df + 1)) + 1)


def text_hash(language: Column, processors: Column, text: Column) -> Column:
    """The key under which results for a text are cached."""
    return F.sha1(F.concat_ws("\n", language, processors, text))


def distance_weight(kind: str, distance: Column, decay: float) -> Column:
    if kind == "exponential":
        return F.pow(F.lit(float(decay)), distance)
    if kind == "inverse":
        return F.lit(1.0) / (F.lit(1) + distance)
    if kind == "none":
        return F.lit(1.0)
    raise ValueError(f"Unsupported decay function: {kind}")
