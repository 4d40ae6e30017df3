"""Annotating a stream: the same annotators and resolver, which keep no state; metrics are kept by event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import flatten
from ..operators.resolve import apply_resolver
from ..plans.pipeline import AnnotationPipeline


def annotate_stream(docs: DataFrame, pipeline: AnnotationPipeline, resolver: dict | None = None) -> DataFrame:
    """``docs`` (documents from ``readStream``) with annotations, overlaps resolved if the configuration says so."""
    return apply_resolver(pipeline.run(docs), resolver)


def label_counts(docs: DataFrame, time_col: str, window: str, watermark: str) -> DataFrame:
    """Annotations by window, layer and label; rows later than the watermark are left out."""
    flat = docs.withWatermark(time_col, watermark).select("doc_id", time_col, F.explode("annotations").alias("a"))
    return flat.groupBy(F.window(time_col, window), F.col("a.layer").alias("layer"), F.col("a.label").alias("label")).agg(F.count("*").alias("count"))


def flat_stream(docs: DataFrame) -> DataFrame:
    return flatten(docs)
