"""Corpus metrics over flat annotations (``doc_id``, ``doc_key``, ``ord`` and the fields): summaries, salience, TF-IDF, propagation.

The number of documents comes from the documents table, as documents without annotations count too. Documents are counted as
they are, told apart by ``doc_key``: ids may be null or repeated. Where values tie, the order of first appearance decides: by
``doc_id``, then ``doc_key``, then ``ord``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matching import by_pieces
from ..functions.spans import canonical, distance_weight, meta, smoothed_idf
from ..model import FIELDS, no_annotations, with_key


def _first() -> Column:
    return F.min(F.struct("doc_id", "doc_key", "ord"))


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def total(docs: DataFrame) -> Column:
    """The number of documents, as a scalar subquery."""
    return docs.agg(F.count("*").alias("n")).scalar()


# ---------------------------------------------------------------- summary


def summary_totals(docs: DataFrame) -> DataFrame:
    """Documents with and without annotations, and annotations; one pass, no shuffle of rows."""
    size = F.size(F.coalesce("annotations", no_annotations()))
    n = docs.agg(F.count("*").alias("documents"), F.count_if(size > 0).alias("documents_with_annotations"), F.coalesce(F.sum(size), F.lit(0)).alias("annotations"))
    return n.select(
        "documents",
        "documents_with_annotations",
        (F.col("documents") - F.col("documents_with_annotations")).alias("documents_without_annotations"),
        "annotations",
        F.when(F.col("documents") > 0, F.col("annotations") / F.col("documents")).otherwise(0.0).alias("annotations_per_document"),
    )


def summary_counts(flat: DataFrame) -> DataFrame:
    """All four counts in one pass: ``grouping`` says of what, the other columns are null where they don't apply."""
    keyed = flat.select(_empty("text").alias("text"), _empty("layer").alias("layer"), _empty("label").alias("label"), "doc_id", "doc_key", "ord")
    layer, label, text = F.col("layer"), F.col("label"), F.col("text")
    got = keyed.groupingSets([[layer], [label], [layer, label], [text, layer, label]], text, layer, label).agg(F.count("*").alias("count"), _first().alias("first"), F.grouping_id().alias("g"))
    names = F.create_map(*[F.lit(x) for x in (5, "layer", 6, "label", 4, "layer_label", 0, "annotation")])
    return got.select(names[F.col("g").cast("int")].alias("grouping"), "text", "layer", "label", "count", "first")


def top_counts(flat: DataFrame, grouping: str, top: int) -> DataFrame:
    """The most frequent of one grouping; ties by first appearance."""
    keys = {"layer": ["layer"], "label": ["label"], "layer_label": ["layer", "label"], "annotation": ["text", "layer", "label"]}[grouping]
    got = flat.groupBy(*[_empty(k).alias(k) for k in keys]).agg(F.count("*").alias("count"), _first().alias("first"))
    return got.orderBy(F.desc("count"), "first").limit(top).drop("first")


def layers(flat: DataFrame) -> DataFrame:
    return flat.where("layer <> ''").select("layer").distinct().orderBy("layer")


# ---------------------------------------------------------------- salience


def salience_scores(docs: DataFrame, flat: DataFrame, layer: str | None = None, label: str | None = None) -> DataFrame:
    """TF, DF, smoothed IDF and score of every (layer, label, canonical); the filters do not change the document count."""
    keyed = flat.select("doc_id", "doc_key", "ord", _empty("layer").alias("layer"), _empty("label").alias("label"), canonical(F.col("text"), F.col("metadata")).alias("canonical"), _empty("text").alias("text"))
    if layer is not None:
        keyed = keyed.where(F.col("layer") == layer)
    if label is not None:
        keyed = keyed.where(F.col("label") == label)
    keys = ["layer", "label", "canonical"]
    # one shuffle by key and document does for terms, documents and displays
    each = keyed.groupBy(*keys, "doc_id", "doc_key", "text").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    shown = each.groupBy(*keys, "text").agg(F.sum("n").alias("n"), _first().alias("first"))
    shown = shown.groupBy(*keys).agg(F.min_by("text", F.struct(-F.col("n"), "first")).alias("display"), F.sum("n").alias("tf"), F.min("first").alias("first"))
    df = each.groupBy(*keys).agg(F.countDistinct("doc_key").alias("df"))
    n = total(docs)
    scored = shown.join(df, keys).withColumn("idf", smoothed_idf(n, F.col("df")))
    return scored.withColumn("score", F.col("tf") * F.col("idf"))


def salience(docs: DataFrame, flat: DataFrame, top: int = 20, layer: str | None = None, label: str | None = None) -> DataFrame:
    got = salience_scores(docs, flat, layer, label).orderBy(F.desc("score"), F.desc("tf"), F.desc("df"), F.desc("display"), "first").limit(top)
    return got.select("layer", "label", "canonical", "display", "tf", "df", "idf", "score")


# ---------------------------------------------------------------- TF-IDF


_TF = T.ArrayType(T.StructType([T.StructField("tf", T.IntegerType()), T.StructField("first", T.BooleanType())]))


def term_frequencies(annotations: Column, layer: str) -> Column:
    """For each annotation of the layer how often its label is the document's, and whether it is the label's first; null for others."""

    @F.arrow_udf(_TF)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in by_pieces(batches):
            offsets, tf, first, none = [0], [], [], []
            for labels, layers in zip(*(c.to_pylist() for c in batch.flatten())):
                none.append(labels is None)
                count = Counter(x for x, y in zip(labels or [], layers or []) if y == layer)
                seen: set[str | None] = set()
                for x, y in zip(labels or [], layers or []):
                    tf.append(count[x] if y == layer else None)
                    first.append(x not in seen if y == layer else None)
                    if y == layer:
                        seen.add(x)
                offsets.append(len(tf))
            each = pa.array(tf, pa.int32())
            struct = pa.StructArray.from_arrays([each, pa.array(first, pa.bool_())], names=["tf", "first"], mask=each.is_null())
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.array([*none, False])), struct)

    return run.asNondeterministic()(F.struct(annotations["label"].alias("label"), annotations["layer"].alias("layer")))


def tfidf(docs: DataFrame, layer: str = "ontology") -> DataFrame:
    """Flat annotations, each of the layer scored by its label: tf in the document times ln(N / df), 1 where df is 1.

    tf is counted within a document's array; only labels are shuffled, and annotations meet them in one join, which Spark
    makes a broadcast where the labels are few.
    """
    docs = with_key(docs)
    tf = term_frequencies(F.col("annotations"), layer)
    each = docs.select("doc_id", "doc_key", F.posexplode(F.arrays_zip("annotations", tf.alias("t"))).alias("ord", "x"))
    flat = each.select("doc_id", "doc_key", "ord", *[F.col(f"x.annotations.{c}").alias(c) for c in FIELDS], F.col("x.t.tf").cast("bigint").alias("tf"), F.col("x.t.first").alias("__first"))
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("__l")
    df = flat.where("__first").groupBy(key).agg(F.count("*").alias("df"))
    n = total(docs)
    joined = flat.withColumn("__l", F.when(F.col("tf").isNotNull(), key)).join(df, "__l", "left")
    idf = F.when(F.col("df") > 1, F.ln(n / F.col("df"))).when(F.col("df") == 1, F.lit(1.0))
    scored = joined.withColumn("idf", idf).withColumn("tfidf", F.col("tf") * F.col("idf"))
    return scored.withColumn("score", F.coalesce("tfidf", "score")).drop("__l", "__first")


def with_scores_in_metadata(scored: DataFrame) -> DataFrame:
    """tf, df, idf and tfidf of :func:`tfidf` written into the metadata."""
    own = F.to_json(F.struct("tf", "df", "idf", "tfidf"))
    body = F.regexp_replace(F.coalesce("metadata", F.lit("{}")), r"\}\s*$", "")
    merged = F.concat(body, F.when(body.rlike(r"\{\s*$"), F.lit("")).otherwise(F.lit(", ")), F.substring(own, F.lit(2), F.length(own)))
    return scored.withColumn("metadata", F.when(F.col("tfidf").isNotNull(), merged).otherwise(F.col("metadata"))).drop("tf", "df", "idf", "tfidf")


def extended_tfidf(scored: DataFrame, distances: DataFrame, decay: float = 0.5, layer: str = "ontology", decay_function: str = "exponential", aggregation: str = "sum") -> DataFrame:
    """``doc_id``, ``concept``, ``score``: each scored annotation spreads to the concepts its own reaches, itself included.

    ``distances`` has ``src``, ``dst`` and ``distance`` and holds a node's distance to itself. An annotation's concept is
    ``concept_id`` of its metadata, or else its label.
    """
    if aggregation not in ("sum", "max"):
        raise ValueError(f"Unsupported aggregation: {aggregation}")
    concept = F.coalesce(F.nullif(meta(F.col("metadata"), "concept_id"), F.lit("")), F.col("label"))
    own = scored.where((F.col("layer") == layer) & F.col("score").isNotNull()).select("doc_id", "doc_key", concept.alias("src"), "score")
    # a concept's annotations in a document spread alike, so that they are combined before the join
    own = own.groupBy("doc_id", "doc_key", "src").agg((F.sum if aggregation == "sum" else F.max)("score").alias("score"))
    spread = own.join(distances, "src").select("doc_id", "doc_key", F.col("dst").alias("concept"), (F.col("score") * distance_weight(decay_function, F.col("distance"), decay)).alias("c"))
    combined = F.sum("c") if aggregation == "sum" else F.greatest(F.lit(0.0), F.max("c"))
    return spread.groupBy("doc_id", "doc_key", "concept").agg(combined.alias("score")).drop("doc_key")


# ---------------------------------------------------------------- extended salience


def observed_concepts(docs: DataFrame, flat: DataFrame, layer: str) -> DataFrame:
    """TF, DF, IDF and score of every concept that annotations of the layer name."""
    uri = F.nullif(meta(F.col("metadata"), "concept_uri"), F.lit(""))
    own = flat.where(F.col("layer") == layer).select("doc_id", "doc_key", "ord", uri.alias("concept_uri"), _empty("text").alias("text"), _empty("label").alias("label")).where("concept_uri is not null")
    # one branch, so that texts are searched once: a document's annotations of a concept meet, and its first one counts the document
    met = own.groupBy("concept_uri", "doc_id", "doc_key").agg(F.collect_list(F.struct("ord", "text", "label")).alias("a"))
    each = met.select("concept_uri", "doc_id", "doc_key", F.posexplode("a").alias("place", "x")).select("concept_uri", "doc_id", "doc_key", "x.*", (F.col("place") == 0).cast("bigint").alias("document"))
    uri, text, label = F.col("concept_uri"), F.col("text"), F.col("label")
    sets = each.groupingSets([[uri, text], [uri, label]], uri, text, label).agg(F.count("*").alias("n"), F.sum("document").alias("df"), _first().alias("first"), F.grouping_id().alias("g"))
    texts, order = F.col("g") == 1, F.struct(-F.col("n"), "first")
    most = lambda c, own: F.min_by(c, F.when(own, order)).alias(c)
    got = sets.groupBy("concept_uri").agg(most("text", texts).alias("display"), most("label", ~texts), F.sum(F.when(texts, F.col("n"))).alias("tf"), F.sum(F.when(texts, F.col("df"))).alias("df"))
    got = got.withColumn("idf", smoothed_idf(total(docs), F.col("df")))
    return got.withColumn("observed_score", F.col("tf") * F.col("idf"))


def extended_salience(docs: DataFrame, flat: DataFrame, distances: DataFrame, top: int = 20, layer: str = "ontology", max_distance: int = 2, decay: float = 0.5) -> DataFrame:
    """Concepts by their own score plus what related concepts pass on: observed score times decay ** distance.

    ``expanded_from`` lists the sources by distance, then contribution, then name. Ties end with the URI.
    """
    seen = observed_concepts(docs, flat, layer)
    near = distances.where((F.col("distance") > 0) & (F.col("distance") <= max_distance))
    passed = near.join(seen.select(F.col("concept_uri").alias("src"), "observed_score"), "src").select("src", "dst", "distance", (F.col("observed_score") * F.pow(F.lit(float(decay)), "distance")).alias("contribution"))
    order = F.array_sort(F.collect_list(F.struct("distance", (-F.col("contribution")).alias("minus"), F.col("src").alias("source"), "contribution")))
    grown = passed.groupBy(F.col("dst").alias("concept_uri")).agg(F.sum("contribution").alias("expanded_score"), order.alias("e"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    rows = seen.join(grown, "concept_uri", "full_outer").select(
        F.concat(F.lit("concept_uri:"), "concept_uri").alias("canonical"),
        "concept_uri",
        F.lit(layer).alias("layer"),
        zero("label", ""),
        zero("display", ""),
        zero("tf", 0),
        zero("df", 0),
        zero("idf", 0.0),
        zero("observed_score", 0.0),
        zero("expanded_score", 0.0),
        (F.coalesce("observed_score", F.lit(0.0)) + F.coalesce("expanded_score", F.lit(0.0))).alias("score"),
        F.transform(F.coalesce("e", F.array().cast("array<struct<distance:int,minus:double,source:string,contribution:double>>")), lambda x: F.struct(x["source"].alias("source"), x["distance"].alias("distance"), x["contribution"].alias("contribution"))).alias("expanded_from"),
    )
    return rows.orderBy(F.desc("score"), F.desc("observed_score"), F.desc("expanded_score"), F.desc("tf"), F.desc("display"), "concept_uri").limit(top)


def explain(items: DataFrame, wanted: str) -> DataFrame:
    """The contributions of one item: by its URI, canonical form or short name."""
    short = F.when(F.contains("concept_uri", F.lit("#")), F.substring_index("concept_uri", "#", -1)).otherwise(F.substring_index("concept_uri", "/", -1))
    own = items.where((F.col("concept_uri") == wanted) | (F.col("canonical") == wanted) | (short == wanted))
    return own.select("concept_uri", "observed_score", "expanded_score", "score", F.posexplode_outer("expanded_from").alias("place", "x")).select("concept_uri", "observed_score", "expanded_score", "score", "place", "x.source", "x.distance", "x.contribution")
