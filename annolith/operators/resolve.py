"""Greedy overlap resolution within a document's array of annotations: no shuffle.

Every variant takes annotations in an order of preference and keeps those that overlap none kept before. Sorting and sweeping
are a few lines over plain numbers (:mod:`annolith.functions.matching`), in Arrow batches of the columns that matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import STRATEGIES, Choice, chosen
from ..model import no_annotations

#: How much a layer matters when only some annotations can be shown.
LAYER_PRIORITY = {"contact": 100, "social": 90, "entity": 80, "temporal": 70, "cantidades": 70, "quantity": 70, "pattern": 60, "ontology": 10}


def by_place(annotations: Column) -> Column:
    return chosen(annotations, Choice(()))


def select_non_overlapping(annotations: Column) -> Column:
    """The longest first (ties by place in the array); the result in text order."""
    return chosen(annotations, Choice(("length",)))


def resolve_layer(annotations: Column, layer: str) -> Column:
    """One layer resolved, others as they are; all in text order, the others first where places are the same."""
    return chosen(annotations, Choice(("length",), layer=layer, one_layer=True))


def resolve_conflicts(candidates: Column, strategy: str) -> Column:
    """What pattern rules found, by strategy: all, longest, priority or longest_priority. Ties go by place."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unsupported conflict strategy: {strategy}")
    prefer = {"all": (), "longest": ("length", "start"), "priority": ("priority", "length", "start"), "longest_priority": ("length", "priority", "start")}
    return chosen(candidates, Choice(prefer[strategy]))


def select_visible(annotations: Column) -> Column:
    """For display: by the layer's priority, the annotation's own, then length."""
    return chosen(annotations, Choice(("rank", "priority", "length"), ranks=tuple(LAYER_PRIORITY.items())))


def resolve_by_label(annotations: Column, layer: str | None = None) -> Column:
    """The older resolver: longest, then first, then by label, within a layer if one is named; by (start, end, layer, label)."""
    return chosen(annotations, Choice(("length", "start", "label"), "label", layer, layer is not None))


def paint_order(annotations: Column) -> Column:
    """Spans a renderer paints going left to right: each that starts at or after the end of the last one painted."""
    return chosen(annotations, Choice((), "paint"))


def apply_resolver(docs: DataFrame, config: dict | None) -> DataFrame:
    """Across all layers if the configuration enables it; the only strategy is ``longest_non_overlapping``."""
    config = config or {}
    if not config.get("enabled", False):
        return docs
    strategy = config.get("strategy", "longest_non_overlapping")
    if strategy != "longest_non_overlapping":
        raise ValueError(f"Unsupported resolver strategy: {strategy}")
    return docs.withColumn("annotations", select_non_overlapping(F.coalesce("annotations", no_annotations())))
