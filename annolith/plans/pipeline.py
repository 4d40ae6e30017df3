"""From a configuration to one lazy plan: scan, annotators in order, resolver, TF-IDF, propagation."""

from __future__ import annotations

import time
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import documents, flatten, nest
from ..operators import annotators as A
from ..operators import metrics, ontology
from ..operators.resolve import apply_resolver
from ..sources.readers import load_config, read_cache, read_documents, read_rdf, with_cached
from .render import layer_colors


def build_annotator(item: str | dict[str, Any], config: dict[str, Any], base: Path = Path(".")) -> Any:
    """An annotator by name; a dictionary also has its parameters."""
    item = {"name": item} if isinstance(item, str) else dict(item)
    name = item.pop("name", None)
    item.pop("color", None)
    take = lambda *keys: {k: item[k] for k in keys if k in item}
    if name == "ontology":
        about = config.get("ontology") or {}
        path = item.get("path") or about.get("path")
        if not path:
            raise ValueError("The ontology annotator needs an ontology path")
        match = item.get("match") or about.get("match") or {}
        flags = {f"match_{k}": bool(v) for k, v in match.items() if k in ("labels", "aliases", "patterns", "name", "name_camel_case")}
        return A.OntologyAnnotator(ontology.build_index(read_rdf(str(base / path)), about), source=str(path), **take("layer"), **flags)
    if name == "pattern":
        if "source" not in item:
            raise ValueError("The pattern annotator needs a source")
        layer = item.get("layer", "pattern")
        return A.PatternAnnotator(A.pattern_rules(load_config(str(base / item["source"])), layer), source=str(item["source"]), **take("conflict_strategy", "ignore_case", "word_boundaries"))
    shared = take("language", "locale", "timezone", "layer", "ref_time")
    if name == "duckling":
        if "dimensions" not in item:
            raise ValueError("The duckling annotator needs dimensions")
        return A.GrammarAnnotator(dimensions=item["dimensions"], **shared)
    if name == "temporal":
        return A.TemporalAnnotator(**shared)
    if name == "quantity":
        return A.QuantityAnnotator(**shared)
    if name == "stanza-ner":
        return A.EntityAnnotator(**take("language", "layer"))
    if name == "dbpedia":
        return A.LinkAnnotator(**take("layer"))
    raise ValueError(f"Unknown annotator: {name}")


def build_annotators(items: Iterable[str | dict[str, Any]], config: dict[str, Any] | None = None, base: Path = Path(".")) -> list[Any]:
    return [build_annotator(i, config or {}, base) for i in items]


def build_preprocessors(items: Iterable[str | dict[str, Any]], spark: SparkSession, base: Path = Path(".")) -> list[Any]:
    """Only ``stanza`` is known: tokens and entities from a cache file of that model's results."""
    out = []
    for item in items:
        item = {"name": item} if isinstance(item, str) else item
        if item.get("name") != "stanza":
            raise ValueError(f"Unknown preprocessor: {item.get('name')}")
        cache = read_cache(spark, str(base / item["cache"])) if item.get("cache") else None
        args = {k: item[k] for k in ("language", "processors") if k in item}
        out.append(lambda docs, cache=cache, args=args: docs if cache is None else with_cached(docs, cache, **args))
    return out


@dataclass
class AnnotationPipeline:
    """Annotators in order over any documents; everything stays lazy. ``timings`` has how long building each took."""

    annotators: list[Any]
    preprocessors: list[Any] = field(default_factory=list)
    timings: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        yield
        self.timings[name] = self.timings.get(name, 0.0) + time.perf_counter() - began

    def run(self, docs: DataFrame) -> DataFrame:
        for p in self.preprocessors:
            docs = p(docs)
        for a in self.annotators:
            with self.timed(type(a).__name__):
                docs = a.annotate(docs)
        return docs

    def run_texts(self, spark: SparkSession, texts: Iterable[str]) -> DataFrame:
        return self.run(documents(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", "id"))

    def run_text(self, spark: SparkSession, text: str) -> DataFrame:
        return self.run_texts(spark, [text])


@dataclass
class Result:
    """Annotated ``documents``; with metrics enabled, scores are in annotations and ``extended`` has the propagated ones."""

    documents: DataFrame
    metadata: dict[str, Any]
    extended: DataFrame | None = None


def score_documents(docs: DataFrame, layer: str) -> DataFrame:
    """TF-IDF written into the annotations of a layer."""
    scored = metrics.with_scores_in_metadata(metrics.tfidf(docs, layer))
    return nest(docs, scored)


def run_config(spark: SparkSession, config: dict[str, Any] | str, input_path: str | None = None, docs: DataFrame | None = None, base: str = ".", **reader: Any) -> Result:
    """The whole run that a configuration (a dictionary or a YAML file) describes, over a file or a DataFrame."""
    config = load_config(config) if isinstance(config, str) else config
    root = Path(base)
    pipeline = AnnotationPipeline(build_annotators(config.get("annotators") or [], config, root), build_preprocessors(config.get("preprocessors") or [], spark, root))
    source = docs if docs is not None else read_documents(spark, input_path, **reader)
    out = apply_resolver(pipeline.run(source), config.get("resolver"))
    about = config.get("metrics") or {}
    plain, extended = about.get("tfidf") or {}, about.get("extended_tfidf") or {}
    if plain.get("enabled"):
        out = score_documents(out, plain.get("layer", "ontology"))
    propagated = None
    if extended.get("enabled"):
        path = (config.get("ontology") or {}).get("path")
        if not path:
            raise ValueError("Extended TF-IDF needs an ontology path")
        decay = extended.get("decay") or {}
        kind, value = (decay.get("type", "exponential"), decay.get("value", 0.5)) if isinstance(decay, dict) else ("exponential", decay)
        graph = ontology.build_graph(read_rdf(str(root / path)), config)
        far = extended.get("max_distance", 3)
        near = distance_frame(spark, graph, far)
        propagated = metrics.extended_tfidf(flatten(out), near, value, extended.get("layer", "ontology"), kind, extended.get("aggregation", "sum"))
    colors = layer_colors(config)
    return Result(out, {"layer_colors": colors, "annotator_timings": dict(pipeline.timings), "preprocessors": len(pipeline.preprocessors)}, propagated)


def distance_frame(spark: SparkSession, graph: ontology.Graph, max_distance: float) -> DataFrame:
    """All distances of a small graph, itself at 0, as ``src``, ``dst``, ``distance``."""
    rows = [(a, b, float(d)) for a in graph.nodes for b, d in graph.distances_from(a, max_distance).items()]
    return spark.createDataFrame(rows, "src string, dst string, distance double")


def expansion_distances(spark: SparkSession, triples: list[ontology.Triple], max_distance: int = 2, direction: str = "outgoing") -> DataFrame:
    """Unit-hop distances of an ontology's hierarchy, without a node's to itself."""
    _, edges = ontology.expansion_edges(triples)
    return ontology.distances(spark.createDataFrame(edges, "src string, dst string"), max_distance, direction)


def annotation_count(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.size("annotations")), F.lit(0))).first()[0]
