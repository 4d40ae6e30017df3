"""Readers: corpora as documents, annotated corpora back as documents with annotations, and configurations."""

from __future__ import annotations

import json
import sys
from pathlib import PurePosixPath
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import strip
from ..model import ANNOTATION, documents, no_annotations
from ..operators.ontology import OWL, RDF, TYPE, Triple

_SUFFIXES = {".csv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".txt": "text", ".text": "text"}


def infer_input_format(path: str, fmt: str | None = None) -> str:
    """The named format, or what the name ends in; standard input is text, anything else CSV."""
    return fmt or ("text" if path == "-" else _SUFFIXES.get(PurePosixPath(path).suffix.lower(), "csv"))


def read_documents(spark: SparkSession, path: str, input_format: str | None = None, text_col: str = "text", id_col: str = "id", sep: str = ",") -> DataFrame:
    fmt = infer_input_format(path, input_format)
    if fmt == "csv":
        return read_csv(spark, path, text_col, sep)
    if fmt == "jsonl":
        return read_jsonl(spark, path, text_col, id_col)
    if fmt == "text":
        return read_text(spark, path)
    if fmt == "parquet":
        return documents(spark.read.parquet(path), text_col, id_col)
    raise ValueError(f"Unsupported input format: {fmt}")


def _stdin_or(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    if path == "-":
        data = sys.stdin.read()
        return spark.createDataFrame([(x,) for x in ([data] if whole else data.splitlines())], "value string")
    return spark.read.text(path, wholetext=whole)


def numbered(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Rows numbered from 0 in the order of the scan: one small count a partition, no shuffle of rows, no single partition."""
    tagged = df.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"))
    counts = tagged.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("before"))  # a row a partition
    place = F.col("before") + F.col("__m") - F.shiftleft(F.col("__p").cast("bigint"), 33)
    return tagged.join(F.broadcast(before), "__p").select(place.alias(name), *[F.col(f"`{c}`") for c in df.columns])


def read_csv(spark: SparkSession, path: str, text_col: str = "text", sep: str = ",") -> DataFrame:
    """A row a document; its id is the row's number from 0, and an empty text is the string ``nan``."""
    if path == "-":
        lines = spark.sparkContext.parallelize(sys.stdin.read().splitlines(), 1)
        raw = spark.read.csv(lines, header=True, sep=sep, escape='"')
    else:
        raw = spark.read.csv(path, header=True, sep=sep, escape='"', multiLine=True)
    if text_col not in raw.columns:
        raise ValueError(f"Column not found: {text_col}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("nan"))
    return numbered(raw.select(text.alias("text"))).select("doc_id", "text", no_annotations().alias("annotations"))


def read_jsonl(spark: SparkSession, path: str, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """An object a line; blank lines are skipped but count in the line number that stands in for a missing id.

    The whole object is kept as JSON in ``source``.
    """
    lines = numbered(_stdin_or(spark, path), "line").where(strip(F.col("value")) != "")
    get = lambda c: F.get_json_object("value", f"$['{c}']")
    return lines.select(F.coalesce(get(id_col), F.col("line").cast("string")).alias("doc_id"), get(text_col).alias("text"), no_annotations().alias("annotations"), F.col("value").alias("source"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A file a document, without white space around it, and without an id."""
    return _stdin_or(spark, path, True).select(F.lit(None).cast("string").alias("doc_id"), strip(F.col("value")).alias("text"), no_annotations().alias("annotations"))


# ---------------------------------------------------------------- annotated corpora

_LOOSE = T.ArrayType(T.StructType([f for f in ANNOTATION.fields]))


def _document(value: Column) -> list[Column]:
    get = lambda path: F.get_json_object(value, path)
    return [get("$.metadata.doc_id").alias("doc_id"), get("$.text").alias("text"), F.coalesce(F.from_json(F.coalesce(get("$.annotations"), F.lit("[]")), _LOOSE), no_annotations()).alias("annotations"), get("$.metadata").alias("metadata")]


def read_annotated(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Documents of an annotated corpus (``.json`` with ``documents``, or ``.jsonl`` with one a line); all fields optional.

    A document without an id gets its place. From standard input the format has to be named.
    """
    kind = fmt or {".json": "json", ".jsonl": "jsonl"}.get(PurePosixPath(path).suffix.lower() if path != "-" else "")
    if kind not in ("json", "jsonl"):
        raise ValueError("Input format must be json or jsonl" + (" and named for standard input" if path == "-" else ""))
    if kind == "json":
        docs = _stdin_or(spark, path, True).select(F.posexplode(F.from_json(F.get_json_object("value", "$.documents"), "array<string>")).alias("place", "value"))
    else:
        docs = numbered(_stdin_or(spark, path), "place").where(strip(F.col("value")) != "")
    got = docs.select("place", *_document(F.col("value")))
    return got.select(F.coalesce("doc_id", F.col("place").cast("string")).alias("doc_id"), "text", "annotations", "metadata", "place")


def load_config(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Results of a language model by ``text_hash``; of several for one text the last counts."""
    lines = numbered(_stdin_or(spark, path), "line").where(strip(F.col("value")) != "")
    keyed = lines.select(F.get_json_object("value", "$.text_hash").alias("text_hash"), "line", "value")
    last = keyed.groupBy("text_hash").agg(F.max_by("value", "line").alias("value"))
    from ..operators.annotators import ENTITIES, TOKENS

    return last.select("text_hash", F.from_json(F.get_json_object("value", "$.tokens"), TOKENS).alias("tokens"), F.from_json(F.get_json_object("value", "$.entities"), ENTITIES).alias("entities"))


def with_cached(docs: DataFrame, cache: DataFrame, language: str = "es", processors: str = "tokenize,mwt,pos,lemma,depparse,ner") -> DataFrame:
    """``docs`` with tokens and entities from the cache, null where it has none."""
    from ..functions.spans import text_hash

    keyed = docs.withColumn("text_hash", text_hash(F.lit(language), F.lit(processors), F.col("text")))
    return keyed.join(cache.select("text_hash", "tokens", "entities"), "text_hash", "left")


# ---------------------------------------------------------------- RDF/XML

_XML = "{http://www.w3.org/XML/1998/namespace}"


def read_rdf(path: str) -> list[Triple]:
    """Triples of an RDF/XML file in file order. Names resolve against ``xml:base``; text between elements is ignored."""
    from urllib.parse import urljoin

    root = ElementTree.parse(path).getroot()
    out: list[Triple] = []
    blank = 0

    def uri(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def resolve(base: str, ref: str) -> str:
        if ref.startswith("#"):
            return base.split("#")[0] + ref
        return urljoin(base, ref) if base and "://" not in ref else ref

    def node(el: ElementTree.Element, base: str, lang: str | None) -> str:
        nonlocal blank
        base, lang = el.get(_XML + "base", base), el.get(_XML + "lang", lang)
        r = "{" + RDF + "}"
        if el.get(r + "about") is not None:
            s = resolve(base, el.get(r + "about"))
        elif el.get(r + "ID") is not None:
            s = resolve(base, "#" + el.get(r + "ID"))
        else:
            blank += 1
            s = "_:" + (el.get(r + "nodeID") or f"b{blank}")
        if uri(el.tag) != RDF + "Description":
            out.append(Triple(s, TYPE, uri(el.tag)))
        for key, value in el.attrib.items():
            if key.startswith("{") and not key.startswith((r, _XML)):
                out.append(Triple(s, uri(key), value, True, lang))
        for child in el:
            p, own_lang, own_base = uri(child.tag), child.get(_XML + "lang", lang), child.get(_XML + "base", base)
            if child.get(r + "resource") is not None:
                out.append(Triple(s, p, resolve(own_base, child.get(r + "resource"))))
            elif child.get(r + "nodeID") is not None:
                out.append(Triple(s, p, "_:" + child.get(r + "nodeID")))
            elif len(child):
                for inner in child:
                    out.append(Triple(s, p, node(inner, own_base, own_lang)))
            else:
                out.append(Triple(s, p, child.text or "", True, own_lang, child.get(r + "datatype")))
        return s

    base = root.get(_XML + "base", "")
    for el in root if uri(root.tag) == RDF + "RDF" else [root]:
        node(el, base, root.get(_XML + "lang"))
    return list(dict.fromkeys(out))


def ontology_info(triples: list[Triple]) -> dict[str, int]:
    return {"triples": len(set((t.s, t.p, t.o, t.literal, t.lang) for t in triples)), "concepts": len({t.s for t in triples if t.p == TYPE and t.o in (OWL + "Class", OWL + "NamedIndividual")})}


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
