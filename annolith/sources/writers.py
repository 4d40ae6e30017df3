"""Output profiles and writers. The serialized corpus is built by built-in JSON expressions, a document a row."""

from __future__ import annotations

import json
import sys
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import once
from ..model import FIELDS, flatten, no_annotations

_SUFFIXES = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".txt": "text", ".text": "text"}
COMPACT_FIELDS = [f for f in FIELDS if f not in ("score", "metadata")]
COMPACT_METADATA = ["concept_uri", "match_source", "matched_value", "wikidata", "normalized", "grain", "unit", "multiplier", "multiplier_value", "duckling_dim"]


def infer_output_format(path: str, fmt: str | None = None) -> str:
    return fmt or ("jsonl" if path == "-" else _SUFFIXES.get(PurePosixPath(path).suffix.lower(), "json"))


def compact_metadata(a: Column) -> Column:
    """The metadata that the compact profile keeps, as JSON with the values' own types; null if nothing is left. It is parsed once."""

    def kept(v: Column) -> Column:
        value = {k: F.try_variant_get(v, f"$.{k}", "variant") for k in COMPACT_METADATA}
        return F.array_compact(F.array(*[F.when(~F.is_variant_null(x), F.concat(F.lit(json.dumps(k) + ":"), F.to_json(x))) for k, x in value.items()]))

    pairs = once(F.try_parse_json(a["metadata"]), kept)
    return once(pairs, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("{"), F.array_join(x, ","), F.lit("}"))))


def compact_annotations(annotations: Column) -> Column:
    """Annotations without score and with compact metadata."""
    return F.transform(F.coalesce(annotations, no_annotations()), lambda a: F.struct(*[a[c].alias(c) for c in COMPACT_FIELDS], compact_metadata(a).alias("metadata")))


def annotation_json(annotations: Column, profile: str) -> Column:
    """The annotations as one JSON array. Compact leaves nulls out, full writes them."""
    if profile not in ("compact", "full"):
        raise ValueError(f"Unsupported output profile: {profile}")
    made = compact_annotations(annotations) if profile == "compact" else F.coalesce(annotations, no_annotations())
    fields = COMPACT_FIELDS if profile == "compact" else [f for f in FIELDS if f != "metadata"]

    def one(a: Column) -> Column:
        body = F.to_json(F.struct(*[a[c].alias(c) for c in fields]), {"ignoreNullFields": str(profile == "compact").lower()})
        extra = F.coalesce(F.concat(F.lit(',"metadata":'), a["metadata"]), F.lit("" if profile == "compact" else ',"metadata":{}'))
        return F.concat(F.substring(body, F.lit(1), F.length(body) - F.lit(1)), extra, F.lit("}"))

    return F.concat(F.lit("["), F.array_join(F.transform(made, one), ","), F.lit("]"))


def document_json(docs: DataFrame, profile: str = "compact", corpus_metadata: dict | None = None) -> Column:
    """A document as one JSON object: text, annotations, metadata (``doc_id``, and in full what a column ``metadata`` has).

    ``corpus_metadata`` is the metadata of documents that have none of their own.
    """
    own = F.when(F.col("doc_id").isNotNull(), F.to_json(F.struct("doc_id")))
    if profile == "full" and "metadata" in docs.columns:
        own = F.coalesce(F.col("metadata"), own)
    about = F.coalesce(own, F.lit(json.dumps(corpus_metadata, ensure_ascii=False)) if corpus_metadata else F.lit(None))
    text = F.coalesce(F.to_json(F.struct("text")), F.lit("{}"))
    head = F.when(F.col("text").isNull(), F.lit('{"text":null')).otherwise(F.substring(text, F.lit(1), F.length(text) - F.lit(1)))
    return F.concat(head, F.lit(',"annotations":'), annotation_json(F.col("annotations"), profile), F.coalesce(F.concat(F.lit(',"metadata":'), about), F.lit("")), F.lit("}"))


def documents_export(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``annotations`` as JSON; documents without annotations stay."""
    return docs.select("doc_id", "text", annotation_json(F.col("annotations"), "full").alias("annotations"))


def annotations_export(docs: DataFrame) -> DataFrame:
    """One row an annotation, metadata as JSON."""
    return flatten(docs).drop("ord", "doc_key")


def write_corpus(docs: DataFrame, path: str, output_format: str | None = None, profile: str = "compact", corpus_metadata: dict | None = None) -> None:
    """``jsonl`` and ``text`` are written by the executors, a directory of files; ``json`` is a single document of a small
    corpus, made on the driver. To standard output (``-``) rows are streamed, a partition at a time."""
    fmt = infer_output_format(path, output_format)
    if fmt not in ("json", "jsonl", "text"):
        raise ValueError(f"Unsupported output format: {fmt}")
    if profile == "compact" and corpus_metadata:
        corpus_metadata = {k: v for k, v in corpus_metadata.items() if k == "layer_colors"}
    rows = docs.select((F.col("text") if fmt == "text" else document_json(docs, profile, corpus_metadata if fmt == "jsonl" else None)).alias("value"))
    if fmt == "json":
        whole = {"documents": [json.loads(r.value) for r in rows.toLocalIterator()]} | ({"metadata": corpus_metadata} if corpus_metadata else {})
        put(json.dumps(whole, ensure_ascii=False, indent=2), path)
    elif path == "-":
        for r in rows.toLocalIterator():
            sys.stdout.write((r.value or "") + "\n")
    else:
        rows.write.mode("overwrite").text(path)


def put(text: str, path: str | None) -> None:
    """To a file, or to standard output if there is none."""
    if path in (None, "-"):
        sys.stdout.write(text)
    else:
        Path(path).write_text(text, encoding="utf-8")


def write_metrics(value: Any, path: str | None = None) -> None:
    put(json.dumps(value, ensure_ascii=False, indent=2) + "\n", path)
