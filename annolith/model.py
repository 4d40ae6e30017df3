"""The data model: documents with an array of annotations each, and the same flat.

A document's annotations travel in one array column until overlaps are resolved, so that annotating and resolving never
shuffle. Their order in the array is the order in which they were made, which is what ties fall back to. Offsets are code
points, half-open. ``metadata`` is a JSON object: its values keep their types, and ``normalized`` may be of any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANNOTATION = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("subtype", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("metadata", T.StringType()),
    ]
)
ANNOTATIONS = T.ArrayType(ANNOTATION)
FIELDS = [f.name for f in ANNOTATION.fields]


def documents(df: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """``df`` as documents: ``doc_id``, ``text`` (cast to string) and no annotations yet; other columns stay.

    Without ``id_col``, ids are unique and ascend with the rows of the scan, but have gaps between partitions.
    """
    ident = F.col(f"`{id_col}`") if id_col else F.monotonically_increasing_id()
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text_col, id_col, "doc_id", "text", "annotations")]
    return df.select(ident.alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *rest, no_annotations().alias("annotations"))


def no_annotations() -> Column:
    return F.array().cast(ANNOTATIONS)


def annotation(**fields: Column) -> Column:
    """One annotation; fields left out are null."""
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ANNOTATION.fields])


def settled(value: Column) -> Column:
    """The value, as an expression that no optimizer copies or moves into another one: it is computed once a row, and a Python
    function over it gets a plain column (one over expressions with lambdas isn't always planned)."""
    return F.when(F.spark_partition_id() >= 0, value)


def append(docs: DataFrame, annotations: Column) -> DataFrame:
    return docs.withColumn("annotations", settled(F.concat(F.coalesce("annotations", no_annotations()), F.coalesce(annotations, no_annotations()))))


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_key``, which tells documents apart whatever their ids are, null or repeated. Keys follow the rows
    of the scan, so that two uses of one plan agree; streams have none."""
    return docs if "doc_key" in docs.columns or docs.isStreaming else docs.withColumn("doc_key", F.monotonically_increasing_id())


def flatten(docs: DataFrame) -> DataFrame:
    """One row an annotation: ``doc_id``, ``doc_key`` (see :func:`with_key`), ``ord`` (its place in the document) and the fields."""
    docs = with_key(docs)
    own = [c for c in ("doc_id", "doc_key") if c in docs.columns]
    return docs.select(*own, F.posexplode("annotations").alias("ord", "a")).select(*own, "ord", *[F.col(f"a.{c}").alias(c) for c in FIELDS])


def nest(docs: DataFrame, flat: DataFrame) -> DataFrame:
    """The reverse of :func:`flatten` of the same ``docs``; documents without annotations stay, with none."""
    made = F.array_sort(F.collect_list(F.struct("ord", F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ANNOTATION.fields]).alias("a"))))
    arrays = flat.groupBy("doc_key").agg(F.transform(made, lambda x: x["a"]).alias("annotations"))
    joined = with_key(docs).drop("annotations").join(arrays, "doc_key", "left").withColumn("annotations", F.coalesce("annotations", no_annotations()))
    return joined.select(*docs.columns)
