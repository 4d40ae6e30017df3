"""Rendering: annotated text as HTML or for a terminal, a document at a time on the executors."""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matching import by_pieces
from ..operators.resolve import paint_order, select_visible

COLORS = {"ontology": "#ffd6d6", "temporal": "#d6e4ff", "cantidades": "#d6fff6", "ner": "#e6d6ff", "dbpedia": "#d6ffd9", "dinero": "#fff2cc"}
DEFAULT_COLOR = "#eeeeee"
_STYLE = "body{font-family:sans-serif;margin:2em}article{border:1px solid #ddd;padding:1em;margin:1em 0}.annotation{border-radius:3px;padding:0 2px}table{border-collapse:collapse}td,th{border:1px solid #ddd;padding:2px 8px}"


def layer_colors(config: dict[str, Any]) -> dict[str, str]:
    """The colours that a configuration gives to layers (an annotator without a layer colours the one of its name)."""
    return {a.get("layer", a["name"]): a["color"] for a in config.get("annotators") or [] if isinstance(a, dict) and a.get("color")}


def color_of(layer: str, custom: dict[str, str] | None = None) -> str:
    return (custom or {}).get(layer) or COLORS.get(layer, DEFAULT_COLOR)


def terminal_color(layer: str) -> int:
    """One of six, the same in every process."""
    return 31 + int(hashlib.md5(layer.encode()).hexdigest(), 16) % 6


def annotated_html(text: str, annotations: list[dict[str, Any]], colors: dict[str, str] | None = None) -> str:
    """``annotations`` in paint order; spans that start before the last one's end are left out."""
    chunks, at = [], 0
    for a in annotations:
        if a["start"] < at:
            continue
        layer, label = a.get("layer") or "unknown", a.get("label") or ""
        chunks += [html.escape(text[at : a["start"]]), f'<span class="annotation" style="background:{color_of(layer, colors)}" title="{html.escape(f"{label} · {layer}")}">{html.escape(text[a["start"] : a["end"]])}</span>']
        at = a["end"]
    return "".join([*chunks, html.escape(text[at:])])


def fragments(docs: DataFrame, colors: dict[str, str] | None = None) -> DataFrame:
    """``doc_id`` and ``html``, a fragment for each document with what is visible of its annotations."""

    shown = F.transform(paint_order(select_visible(F.col("annotations"))), lambda a: F.struct(*[a[c].alias(c) for c in ("start", "end", "label", "layer")]))
    rows = docs.select("doc_id", "text", F.to_json(shown).alias("spans"))

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(b.to_struct_array() for b in batches):
            ids, texts, spans = batch.flatten()
            pairs = zip(texts.to_pylist(), spans.to_pylist())
            yield pa.RecordBatch.from_arrays([ids, pa.array([annotated_html(t or "", json.loads(s or "[]"), colors) for t, s in pairs], pa.string())], names=["doc_id", "html"])

    return rows.mapInArrow(paint, T.StructType([rows.schema["doc_id"], T.StructField("html", T.StringType())]))


def render_html(docs: DataFrame, title: str = "Annotation report", colors: dict[str, str] | None = None, extended: DataFrame | None = None) -> str:
    """One page of a small corpus: layers, documents, and propagated scores if there are any."""
    layers = [r.layer for r in docs.select(F.explode("annotations.layer").alias("layer")).where("layer <> ''").distinct().orderBy("layer").collect()]
    legend = " ".join(f'<span class="annotation" style="background:{color_of(x, colors)}">{html.escape(x)}</span>' for x in layers)
    tables: dict[Any, str] = {}
    if extended is not None:
        for r in extended.orderBy("doc_id", F.desc("score"), "concept").toLocalIterator():
            tables[r.doc_id] = tables.get(r.doc_id, "") + f"<tr><td>{html.escape(r.concept)}</td><td>{r.score:.3f}</td></tr>"
    body = "\n".join(f"<article><h2>{html.escape(str(r.doc_id))}</h2><p>{r.html}</p>" + (f"<table>{tables[r.doc_id]}</table>" if r.doc_id in tables else "") + "</article>" for r in fragments(docs, colors).toLocalIterator())
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1><p>{legend}</p>\n{body}\n</body></html>\n'


def annotated_console(text: str, annotations: list[dict[str, Any]]) -> str:
    chunks, at = [], 0
    for a in annotations:
        if a["start"] < at:
            continue
        chunks += [text[at : a["start"]], f"\x1b[{terminal_color(a['layer'] or '')}m{text[a['start'] : a['end']]}\x1b[0m[{a['label']}]"]
        at = a["end"]
    return "".join([*chunks, text[at:]])


def render_console(docs: DataFrame) -> str:
    shown = docs.select("doc_id", "text", paint_order(select_visible(F.col("annotations"))).alias("a"))
    return "\n".join(f"# {r.doc_id}\n{annotated_console(r.text or '', [x.asDict() for x in r.a])}\n" for r in shown.toLocalIterator())


def text_table(df: DataFrame, digits: int = 3) -> str:
    """A small result as a table of text."""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    rows = [df.columns, *[[show(v) for v in r] for r in df.toLocalIterator()]]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in rows) + "\n"
