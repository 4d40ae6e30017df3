"""Queries for readers, writers, ontologies, rendering, document identity, grammar and streams, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import spans as S
from .functions.language import temporal_rules
from .model import documents, flatten
from .operators import annotators as A
from .operators import metrics as M
from .operators import ontology as O
from .plans.pipeline import AnnotationPipeline, distance_frame, run_config, score_documents
from .plans.render import fragments
from .queries import BASE, annotated, annotator, corpus, table
from .sources import readers
from .sources.scratch import scratch_path
from .sources.writers import documents_export, write_corpus
from .streaming.annotate import annotate_stream, label_counts

# ---------------------------------------------------------------- readers and writers, through files


def csv_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one CSV file, read back as documents numbered by line."""
    path = scratch_path(spark, "nations") + ".csv"
    table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("text"), "n_nationkey").coalesce(1).write.csv(path, header=True)
    return readers.read_documents(spark, path).select("doc_id", "text")


def jsonl_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as JSON lines, read back with ids, texts and the objects they came from."""
    path = scratch_path(spark, "documents") + ".jsonl"
    table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text", "lang")).alias("value")).write.text(path)
    got = readers.read_documents(spark, path)
    return got.select("doc_id", "text", F.get_json_object("source", "$.lang").alias("lang"))


def text_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file, a document without white space around it and without an id."""
    path = scratch_path(spark, "regions") + ".txt"
    table(spark, sf_dir, "region").orderBy("r_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).getField("r_name"), "\n").alias("v")).select(F.concat(F.lit("  "), "v", F.lit("\n\n"))).coalesce(1).write.text(path)
    return readers.read_documents(spark, path).select("doc_id", "text")


def corpus_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated corpus written as JSON lines in the full profile, read back and taken apart."""
    path = scratch_path(spark, "annotated") + ".jsonl"
    write_corpus(annotated(spark, sf_dir), path, None, "full")
    back = readers.read_annotated(spark, path)
    return flatten(back).select(F.col("doc_id").cast("bigint").alias("doc_id"), "start", "end", "text", "label", "layer", "source", "type", "ord")


def documents_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_export(annotated(spark, sf_dir))


def html_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(annotated(spark, sf_dir))


def cached_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a model's cache file, found again by the hash of each text."""
    path = scratch_path(spark, "cache") + ".jsonl"
    docs = corpus(spark, sf_dir)
    keyed = docs.select(S.text_hash(F.lit("es"), F.lit("tokenize,mwt,pos,lemma,depparse,ner"), F.col("text")).alias("text_hash"), F.substring_index("text", " ", 1).alias("first"))
    token = F.struct(F.col("first").alias("text"), F.lit(0).alias("start"), F.length("first").alias("end"), F.lit("X").alias("upos"))
    keyed.select(F.to_json(F.struct("text_hash", F.array(token).alias("tokens"))).alias("value")).write.text(path)
    got = readers.with_cached(docs, readers.read_cache(spark, path))
    return got.select("doc_id", F.col("tokens")[0]["text"].alias("token"), F.col("tokens")[0]["end"].alias("end"), F.col("tokens")[0]["upos"].alias("upos"))


# ---------------------------------------------------------------- ontologies

GEO = "http://example.org/geo#"
_RELATIONS = {"relations": [{"property": "rdfs:subClassOf", "distance": 2}, {"property": "rdf:type", "direction": "instance_to_class", "distance": 0.5}]}


def geo_triples(spark: SparkSession, sf_dir: str) -> list[O.Triple]:
    """Regions as classes, nations as their subclasses and individuals of a class Country: a few dozen triples."""
    out = [O.Triple(GEO + "Country", O.TYPE, O.OWL + "Class")]
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        out += [O.Triple(f"{GEO}R{r.r_regionkey}", O.TYPE, O.OWL + "Class"), O.Triple(f"{GEO}R{r.r_regionkey}", O.LABEL, r.r_name, True)]
    for n in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        uri = f"{GEO}N{n.n_nationkey}"
        out += [O.Triple(uri, O.TYPE, O.OWL + "Class"), O.Triple(uri, O.TYPE, GEO + "Country"), O.Triple(uri, O.LABEL, n.n_name, True), O.Triple(uri, O.SUBCLASS, f"{GEO}R{n.n_regionkey}"), O.Triple(uri, O.SEE_ALSO, n.n_name.lower(), True)]
    return out


def concept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c.uri, c.name, "|".join(c.labels), "|".join(c.aliases), "|".join(c.parents), c.entity_type) for c in O.build_index(geo_triples(spark, sf_dir))]
    return spark.createDataFrame(rows, "uri string, name string, labels string, aliases string, parents string, entity_type string")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.build_graph(geo_triples(spark, sf_dir), _RELATIONS).frame(spark)


def graph_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance_frame(spark, O.build_graph(geo_triples(spark, sf_dir), _RELATIONS), 2.5)


def expansion_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(O.expansion_edges(geo_triples(spark, sf_dir))[1], "src string, dst string")


def table_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances along suppliers and customers, nations and regions: a graph of the tables' size, followed outgoing."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "customer").select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"), F.lit(1).alias("weight"))
    edges = edges.union(table(spark, sf_dir, "supplier").select(node("s", "s_suppkey"), node("n", "s_nationkey"), F.lit(2)))
    edges = edges.union(table(spark, sf_dir, "nation").select(node("n", "n_nationkey"), node("r", "n_regionkey"), F.lit(2)))
    return O.distances(edges, 3)


def configured_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run from a configuration over an annotated frame: resolver, and TF-IDF written into the annotations."""
    config = {"resolver": {"enabled": True, "strategy": "longest_non_overlapping"}, "metrics": {"tfidf": {"enabled": True, "layer": "function"}}}
    got = run_config(spark, config, docs=annotated(spark, sf_dir))
    flat = flatten(got.documents)
    return flat.select("doc_id", "start", "end", "label", "layer", F.round("score", 9).alias("score"), S.meta(F.col("metadata"), "tf").cast("bigint").alias("tf"))


# ---------------------------------------------------------------- identity of documents


def unnamed(spark: SparkSession, sf_dir: str, null: bool) -> DataFrame:
    """All documents with null ids, or with ids that many share."""
    made = F.lit(None).cast("bigint") if null else F.col("doc_id") % 7
    docs = table(spark, sf_dir, "documents").select(made.alias("doc_id"), F.col("doc_id").alias("own"), "text")
    return annotator().annotate(documents(docs, "text", "doc_id"))


def summary_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary_totals(unnamed(spark, sf_dir, False)).withColumn("annotations_per_document", F.round("annotations_per_document", 9))


def salience_null_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = unnamed(spark, sf_dir, True)
    got = M.salience_scores(docs, flatten(docs))
    return got.select("layer", "label", "canonical", "tf", "df", F.round("score", 9).alias("score"))


def _tfidf_ids(null: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = M.tfidf(unnamed(spark, sf_dir, null), "function").where("layer = 'function'")
        return got.groupBy("label", "tf", "df", F.round("score", 9).alias("score")).agg(F.count("*").alias("n"))

    return query


def nest_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written back: every document keeps its own annotations."""
    docs = score_documents(unnamed(spark, sf_dir, False), "function")
    size = F.size(F.filter("annotations", lambda a: a["layer"] == "function"))
    return docs.select("own", F.size("annotations").cast("bigint").alias("annotations"), F.size(F.filter("annotations", lambda a: a["score"].isNotNull())).cast("bigint").alias("scored"), size.cast("bigint").alias("function"))


# ---------------------------------------------------------------- times and quantities


def temporal_surfaces_by_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word surfaces and their dimension and grain by length: every rule of the lists, the prefixes by grain too."""
    words = table(spark, sf_dir, "documents").where("text is not null").select(F.split("text", " ").alias("w"))
    zipped = F.slice(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b")), F.lit(1), F.greatest(F.lit(1), F.size("w") - 1))
    pairs = F.transform(zipped, lambda x: F.concat(x["a"], F.lit(" "), F.coalesce(x["b"], F.lit(""))))
    fixed = F.array(*[F.lit(x) for x in ("un 30", "a cuatro", "SEP", "mil", "1000")])
    both = words.select(F.explode(F.concat("w", pairs, fixed)).alias("surface")).distinct()
    grain = F.element_at(F.array(F.lit("minute"), F.lit("year"), F.lit("day")), F.length("surface") % 3 + 1)
    dim = F.when(F.length("surface") % 2 == 0, "duration").otherwise("time")
    return both.select("surface", grain.alias("grain"), dim.alias("dim"), A.is_bad_temporal_surface(F.col("surface"), dim, grain, temporal_rules("es")).alias("bad"))


def quantity_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in made-up Spanish phrases, multiplied: spans, surfaces and normalized values."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("son "), key.cast("string"), F.element_at(F.array(F.lit(" mil"), F.lit(" millones"), F.lit(" gatos")), (key % 3 + 1).cast("int")), F.lit(" aquí"))
    docs = documents(table(spark, sf_dir, "orders").select(key.alias("id"), text.alias("text")), "text", "id")
    flat = flatten(A.QuantityAnnotator(language="es", dimensions=["number"], ref_time="2026-07-01T12:00:00").annotate(docs))
    about = lambda k: S.meta(F.col("metadata"), k)
    return flat.select("doc_id", "start", "end", "text", "label", "subtype", about("normalized").cast("double").alias("normalized"), about("multiplier").alias("multiplier"), S.canonical(F.col("text"), F.col("metadata")).startswith("normalized:").alias("by_value"))


_REF = "2026-07-01T12:00:00"


def temporal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates and a relative day in made-up Spanish phrases: spans, labels, grain and the day itself."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    docs = documents(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("pedido "), day, F.lit(" visto ayer")).alias("text")), "text", "id")
    flat = flatten(A.TemporalAnnotator(language="es", dimensions=["time"], ref_time=_REF).annotate(docs))
    about = lambda k: S.meta(F.col("metadata"), k)
    return flat.select("doc_id", "start", "end", "text", "label", "layer", about("grain").alias("grain"), F.substring(about("normalized"), 1, 10).alias("day"), about("locale").alias("locale"))


_UNITS = [("euros", "MONEY", "EUR"), ("kilómetros", "DISTANCE", "kilometre"), ("litros", "VOLUME", "litre"), ("grados", "TEMPERATURE", "degree")]


def quantity_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with units in made-up Spanish phrases, and the key that counts them by value and unit."""
    n = F.col("o_orderkey") % 997 + 2
    unit = F.element_at(F.array(*[F.lit(u) for u, _, _ in _UNITS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    docs = documents(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("hay "), n.cast("string"), F.lit(" "), unit).alias("text")), "text", "id")
    flat = flatten(A.QuantityAnnotator(language="es", dimensions=["amount-of-money", "distance", "volume", "temperature"], ref_time=_REF).annotate(docs))
    about = lambda k: S.meta(F.col("metadata"), k)
    return flat.select("doc_id", "start", "end", "text", "label", about("normalized").cast("double").alias("normalized"), about("unit").alias("unit"), S.canonical(F.col("text"), F.col("metadata")).alias("canonical"))


def filtered_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that are persons' names and numbers that are determiners, by what entities and tokens say."""
    key = F.col("o_orderkey")
    docs = documents(table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 2 == 0, "en julio").otherwise("una cosa").alias("text")), "text", "id")
    entity = F.struct(F.lit("julio").alias("text"), F.lit(3).alias("start"), F.lit(8).alias("end"), F.when(F.col("doc_id") % 4 == 0, "PER").otherwise("LOC").alias("type"))
    token = F.struct(F.lit("una").alias("text"), F.lit(0).alias("start"), F.lit(3).alias("end"), *[F.lit("x").alias(c) for c in ("lemma",)], F.when(F.col("doc_id") % 3 == 0, "DET").otherwise("PRON").alias("upos"), *[F.lit(None).cast("string").alias(c) for c in ("xpos", "feats", "deprel", "head")])
    docs = docs.withColumn("entities", F.array(entity)).withColumn("tokens", F.array(token))
    docs = A.TemporalAnnotator(language="es", dimensions=["time"], ref_time=_REF).annotate(docs)
    docs = A.QuantityAnnotator(language="es", dimensions=["number"], ref_time=_REF).annotate(docs)
    return flatten(docs).select("doc_id", "start", "end", "text", "layer", F.get_json_object("metadata", "$.stanza.upos").alias("upos"))


def entities_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and links that a model and a service found before, from columns; ones without a place are left out."""
    key = F.col("c_custkey")
    docs = documents(table(spark, sf_dir, "customer").select(key.alias("id"), F.concat(F.lit("de "), "c_name").alias("text"), "c_name"), "text", "id")
    entity = F.struct(F.col("c_name").alias("text"), F.when(F.col("doc_id") % 3 != 0, 3).alias("start"), (F.length("c_name") + 3).alias("end"), F.lit("ORG").alias("type"))
    link = F.to_json(F.struct(F.array(F.struct(F.lit("http://x/y").alias("@URI"), F.when(F.col("doc_id") % 2 == 0, "3").otherwise("-1").alias("@offset"), F.col("c_name").alias("@surfaceForm"), F.lit("T").alias("@types"))).alias("Resources")))
    docs = docs.withColumn("entities", F.array(entity)).withColumn("link_response", link)
    docs = A.LinkAnnotator().annotate(A.EntityAnnotator().annotate(docs))
    return flatten(docs).select("doc_id", "start", "end", "text", "label", "layer", "source", "type", S.meta(F.col("metadata"), "uri").alias("uri"))


def distance_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances of :func:`table_distances` as a map for each node, its entries in order."""
    got = O.distance_maps(table_distances(spark, sf_dir))
    entries = F.array_sort(F.map_entries("distances"))
    return got.select("src", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias("reached"))


# ---------------------------------------------------------------- streams


def stream_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types annotated on a stream, counted by hour, layer and label."""
    import uuid

    name = "counts_" + uuid.uuid4().hex
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    docs = documents(events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), "event_type", "event_id")
    rules = [{"label": "BUY", "pattern": "purchase", "layer": "money"}, {"label": "SEE", "patterns": ["view", "click"], "layer": "web"}]
    pipeline = AnnotationPipeline([A.PatternAnnotator(A.pattern_rules({"patterns": rules}))])
    counts = label_counts(annotate_stream(docs, pipeline, {"enabled": True}), "ts", "1 hour", "1 hour")
    out, at = scratch_path(spark, "counts"), scratch_path(spark, "state")
    query = counts.writeStream.queryName(name).option("checkpointLocation", at).outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "layer", "label", "count")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (csv_input, jsonl_input, text_input, corpus_file_roundtrip, cached_hashes, html_fragments, concept_index, graph_edges, graph_distances, expansion_edges, table_distances, configured_run, summary_repeated_ids, salience_null_ids, nest_repeated_ids, temporal_surfaces_by_grain, quantity_products, temporal_dates, quantity_units, filtered_by_model, entities_and_links, distance_maps, stream_label_counts)
} | {"documents_export": documents_exported, "tfidf_null_ids": _tfidf_ids(True), "tfidf_repeated_ids": _tfidf_ids(False)}


# ---------------------------------------------------------------- the same in SQL

_W, _G = Q._words(), GEO
_ESC = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_ES = Q._ES
_IN = Q._IN
_TFIDF_COUNTS = f"{_W}, {Q._TFIDF} SELECT label, tf, df, round(tf * idf, 9) AS score, sum(tf)::BIGINT AS n FROM sc GROUP BY label, tf, df, idf"
_GEO_EDGES = f"geo(src, dst, weight) AS (SELECT '{_G}N' || n_nationkey, '{_G}R' || n_regionkey, 2.0::DOUBLE FROM nation UNION ALL SELECT '{_G}N' || n_nationkey, '{_G}Country', 0.5::DOUBLE FROM nation)"

_TABLE_DISTANCES = "WITH e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 1 AS w FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 2 FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2 FROM nation), dist AS (SELECT src, dst, w AS distance FROM e UNION ALL SELECT a.src, b.dst, a.w + b.w FROM e a JOIN e b ON a.dst = b.src WHERE a.w + b.w <= 3)"

ORACLES: dict[str, str] = {
    "distance_maps": f"{_TABLE_DISTANCES} SELECT src, string_agg(dst || '=' || distance, ' ' ORDER BY dst) AS reached FROM dist GROUP BY src",
    "csv_input": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS doc_id, n_name AS text FROM nation",
    "jsonl_input": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents",
    "text_input": "SELECT NULL::VARCHAR AS doc_id, string_agg(r_name, chr(10) ORDER BY r_regionkey) AS text FROM region",
    "corpus_file_roundtrip": f"{_W} SELECT {Q._COLS}, 'pattern' AS source, 'phrase' AS type, ord FROM ann",
    "documents_export": f"""{_W} SELECT d.doc_id, any_value(d.text) AS text, '[' || coalesce(string_agg('{{"start":' || a."start" || ',"end":' || a."end" || ',"text":"' || a.text || '","label":"' || a.label || '","layer":"' || a.layer || '","source":"pattern","type":"phrase","subtype":null,"score":null,"metadata":' || a.metadata || '}}', ',' ORDER BY a.ord), '') || ']' AS annotations FROM documents d LEFT JOIN ann a ON a.doc_id = d.doc_id GROUP BY d.doc_id""",
    "cached_hashes": "SELECT doc_id, string_split(text, ' ')[1] AS token, length(string_split(text, ' ')[1])::INT AS \"end\", 'X' AS upos FROM documents",
    "html_fragments": f"""{_W}, {Q._greedy(f'k0: -({Q._LAYER_RANK}), k1: -prio, k2: -("end" - "start")', order="ord")},
gaps AS (SELECT *, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY "start", "end") AS prev FROM kept),
body AS (SELECT g.doc_id, string_agg({_ESC('substr(d.text, g.prev + 1, g."start" - g.prev)')} || '<span class="annotation" style="background:#eeeeee" title="' || g.label || ' · ' || g.layer || '">' || {_ESC('substr(d.text, g."start" + 1, g."end" - g."start")')} || '</span>', '' ORDER BY g."start", g."end") AS html, max(g."end") AS last FROM gaps g JOIN documents d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, coalesce(b.html, '') || {_ESC('substr(d.text, coalesce(b.last, 0) + 1)')} AS html FROM documents d LEFT JOIN body b ON b.doc_id = d.doc_id""",
    "concept_index": f"""SELECT '{_G}Country' AS uri, 'Country' AS name, '' AS labels, '' AS aliases, '' AS parents, 'owl:Class' AS entity_type
UNION ALL SELECT '{_G}R' || r_regionkey, 'R' || r_regionkey, r_name, '', '', 'owl:Class' FROM region
UNION ALL SELECT '{_G}N' || n_nationkey, 'N' || n_nationkey, n_name, lower(n_name), 'R' || n_regionkey, 'owl:Class' FROM nation""",
    "graph_edges": f"WITH {_GEO_EDGES} SELECT src, dst, weight, CASE weight WHEN 2 THEN 'rdfs:subClassOf' ELSE 'rdf:type' END AS property, CASE weight WHEN 2 THEN 'child_to_parent' ELSE 'instance_to_class' END AS direction FROM geo",
    "graph_distances": f"WITH {_GEO_EDGES} SELECT src, dst, weight AS distance FROM geo UNION ALL SELECT x, x, 0.0::DOUBLE FROM (SELECT src AS x FROM geo UNION SELECT dst FROM geo)",
    "expansion_edges": f"SELECT '{_G}N' || n_nationkey AS src, '{_G}R' || n_regionkey AS dst FROM nation UNION ALL SELECT '{_G}N' || n_nationkey, '{_G}Country' FROM nation",
    "table_distances": f"{_TABLE_DISTANCES} SELECT * FROM dist",
    "configured_run": f"""{_W}, {Q._greedy(Q._LEN, order="ord")}, fin AS (SELECT * FROM kept),
per AS (SELECT doc_id, label, count(*) AS tf FROM fin WHERE layer = 'function' GROUP BY ALL), dfs AS (SELECT label, count(*) AS df FROM per GROUP BY label),
sc AS (SELECT doc_id, label, tf, CASE WHEN df > 1 THEN ln((SELECT count(*) FROM documents) / df) ELSE 1.0 END AS idf FROM per JOIN dfs USING (label))
SELECT f.doc_id, f."start", f."end", f.label, f.layer, round(sc.tf * sc.idf, 9) AS score, sc.tf FROM fin f LEFT JOIN sc ON f.layer = 'function' AND sc.doc_id = f.doc_id AND sc.label = f.label""",
    "summary_repeated_ids": Q.ORACLES["summary_totals"],
    "salience_null_ids": f"{_W}, keyed AS (SELECT doc_id, layer, label, {Q._CANON} AS canonical FROM ann), agg AS (SELECT layer, label, canonical, count(*) AS tf, count(DISTINCT doc_id) AS df FROM keyed GROUP BY ALL) SELECT layer, label, canonical, tf, df, round(tf * ({Q._IDF}), 9) AS score FROM agg",
    "tfidf_null_ids": _TFIDF_COUNTS,
    "tfidf_repeated_ids": _TFIDF_COUNTS,
    "nest_repeated_ids": f"{_W} SELECT d.doc_id AS own, count(a.doc_id) AS annotations, count(*) FILTER (a.layer = 'function') AS scored, count(*) FILTER (a.layer = 'function') AS function FROM documents d LEFT JOIN ann a ON a.doc_id = d.doc_id GROUP BY d.doc_id",
    "temporal_surfaces_by_grain": f"""WITH w AS (SELECT string_split(text, ' ') AS t FROM documents),
raw AS (SELECT unnest(t) AS surface FROM w UNION SELECT unnest(list_transform(range(1, greatest(2, len(t))), lambda i: t[i] || ' ' || coalesce(t[i + 1], ''))) FROM w UNION SELECT unnest(['un 30', 'a cuatro', 'SEP', 'mil', '1000'])),
s AS (SELECT DISTINCT surface, CASE length(surface) % 3 WHEN 0 THEN 'minute' WHEN 1 THEN 'year' ELSE 'day' END AS grain, CASE WHEN length(surface) % 2 = 0 THEN 'duration' ELSE 'time' END AS dim, regexp_replace(surface, '^\\s+|\\s+$', '', 'g') AS trimmed FROM raw),
l AS (SELECT *, lower(trimmed) AS low, string_split_regex(lower(trimmed), '\\s+') AS p FROM s)
SELECT surface, grain, dim, trimmed IN ({_IN(_ES.exact)}) OR low = '' OR low IN ({_IN(_ES.single)}) OR (low IN ({_IN(_ES.years)}) AND grain = 'year') OR (len(p) = 2 AND p[1] IN ({_IN(_ES.starts)}) AND p[2] IN ({_IN(_ES.single)})) OR (len(p) = 2 AND p[1] IN ({_IN(_ES.hour_starts)}) AND p[2] IN ({_IN(_ES.hours)})) OR (grain = 'minute' AND ({" OR ".join(f"starts_with(low, {Q._text(x)})" for x in _ES.prefixes["minute"])})) OR (dim = 'duration' AND regexp_full_match(low, '[0-9]+')) AS bad FROM l""",
    "quantity_products": """WITH q AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS n, CASE o_orderkey % 3 WHEN 0 THEN 'mil' WHEN 1 THEN 'millones' END AS m FROM orders)
SELECT k AS doc_id, 4 AS "start", 4 + length(n) + coalesce(1 + length(m), 0) AS "end", n || coalesce(' ' || m, '') AS text, CASE WHEN m IS NULL THEN 'NUMBER' ELSE 'QUANTITY' END AS label, CASE WHEN m IS NULL THEN 'number' ELSE 'multiplier' END AS subtype, nullif(k * CASE m WHEN 'mil' THEN 1000.0 WHEN 'millones' THEN 1000000.0 ELSE 1.0 END::DOUBLE, 0) AS normalized, m AS multiplier, k <> 0 AS by_value FROM q""",
    "temporal_dates": """WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT k AS doc_id, 7 AS "start", 17 AS "end", d AS text, 'DATE' AS label, 'temporal' AS layer, 'day' AS grain, d AS day, 'ES_ES' AS locale FROM o
UNION ALL SELECT k, 24, 28, 'ayer', 'DATE', 'temporal', 'day', '2026-06-30', 'ES_ES' FROM o""",
    "quantity_units": "WITH u(i, u, label, unit) AS (VALUES " + ", ".join(f"({i}, '{u}', '{a}', '{b}')" for i, (u, a, b) in enumerate(_UNITS)) + """), o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 997 + 2 AS VARCHAR) AS n, u.* FROM orders JOIN u ON u.i = o_orderkey % 4)
SELECT k AS doc_id, 4 AS "start", CAST(5 + length(n) + length(u) AS INTEGER) AS "end", n || ' ' || u AS text, label, CAST(n AS DOUBLE) AS normalized, unit, 'normalized:' || n || '|unit:' || unit AS canonical FROM o""",
    "filtered_by_model": """SELECT o_orderkey AS doc_id, 3 AS "start", 8 AS "end", 'julio' AS text, 'temporal' AS layer, NULL::VARCHAR AS upos FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0
UNION ALL SELECT o_orderkey, 0, 3, 'una', 'cantidades', 'PRON' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0""",
    "entities_and_links": """SELECT c_custkey AS doc_id, 3 AS "start", CAST(3 + length(c_name) AS INTEGER) AS "end", c_name AS text, 'ORG' AS label, 'ner' AS layer, 'stanza' AS source, 'ner' AS type, NULL::VARCHAR AS uri FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 3, CAST(3 + length(c_name) AS INTEGER), c_name, 'T', 'dbpedia', 'dbpedia-spotlight', 'entity-linking', 'http://x/y' FROM customer WHERE c_custkey % 2 = 0""",
    "stream_label_counts": "SELECT date_trunc('hour', ts) AS hour, CASE event_type WHEN 'purchase' THEN 'money' ELSE 'web' END AS layer, CASE event_type WHEN 'purchase' THEN 'BUY' ELSE 'SEE' END AS label, count(*) AS count FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY ALL",
}
