"""Queries over the test tables, one for each operator, and the SQL that says what they must return.

A few pattern rules over function words stand in for an annotation configuration; both sides are made from ``RULES``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import matching as Mt
from .functions import spans as S
from .functions.language import quantity_rules, temporal_rules
from .model import append, documents, flatten
from .operators import annotators as A
from .operators import metrics as M
from .operators import ontology as O
from .operators import resolve as R
from .sources.writers import annotation_json, annotations_export, document_json

BASE = "http://example.org/words#"


def _rule(rid: str, label: str, phrase: str, layer: str, priority: int, **metadata: Any) -> dict[str, Any]:
    return {"id": rid, "label": label, "pattern": phrase, "layer": layer, "priority": priority, "metadata": metadata}


RULES = [
    _rule("the", "DET", "the", "function", 1, concept_id=BASE + "The", concept_uri=BASE + "The"),
    _rule("of", "PREP", "of", "function", 1, concept_id=BASE + "Of", concept_uri=BASE + "Of"),
    _rule("of_the", "PHRASE", "of the", "phrase", 5, concept_uri=BASE + "OfThe"),
    _rule("the_of", "PHRASE", "the of", "phrase", 3),
    _rule("de", "PREP", "de", "function", 2, concept_id=BASE + "De", concept_uri=BASE + "De"),
    _rule("de_la", "PHRASE", "de la", "phrase", 5),
    _rule("und", "CONJ", "und", "function", 1, concept_id=BASE + "Und", concept_uri=BASE + "Und"),
    _rule("license", "TERM", "license", "entity", 9, wikidata="Q79719"),
    _rule("and_the", "CONJ", "and the", "social", 4),
]
EDGES = [(BASE + a, BASE + b, w) for a, b, w in [("The", "Article", 1), ("Of", "Preposition", 1), ("De", "Preposition", 1), ("Und", "Conjunction", 1), ("Article", "FunctionWord", 1), ("Preposition", "FunctionWord", 2), ("Conjunction", "FunctionWord", 1), ("FunctionWord", "Word", 1), ("OfThe", "Of", 1), ("OfThe", "The", 2), ("Word", "OfThe", 4)]]
REGEXES = {"EMAIL": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "NUMBER": r"[0-9]+", "CAPS": r"[A-Z][A-Z]+"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


def annotator(strategy: str = "all", rules: list[dict] = RULES) -> A.PatternAnnotator:
    return A.PatternAnnotator(A.pattern_rules({"patterns": rules}), strategy)


def annotated(spark: SparkSession, sf_dir: str, strategy: str = "all") -> DataFrame:
    return annotator(strategy).annotate(corpus(spark, sf_dir))


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "src string, dst string, weight int")


SPAN = ["doc_id", "start", "end", "text", "label", "layer"]


def _resolved(make: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = annotated(spark, sf_dir)
        return flatten(docs.withColumn("annotations", make(F.col("annotations")))).select(*SPAN)

    return query


def _conflict(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: flatten(annotated(spark, sf_dir, strategy)).select(*SPAN, "ord")


def regex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    got = Mt.annotations(F.col("text"), [Mt.Term(p, k, phrase=False, ignore_case=False, bounded=False) for k, p in REGEXES.items()])
    return flatten(append(docs, got)).select("doc_id", "start", "end", "text", "label")


def pattern_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [RULES[0] | {"exceptions": ["of the", "and the"]}]
    return flatten(annotator("all", rules).annotate(corpus(spark, sf_dir))).select(*SPAN)


def ontology_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = [O.Concept(BASE + "The", "The", labels=["the"], aliases=["der"], patterns=["die|das"], entity_type="owl:Class"), O.Concept(BASE + "OfThe", "OfThe", labels=["de"], entity_type="owl:Class")]
    docs = A.OntologyAnnotator(concepts, match_name=True).annotate(corpus(spark, sf_dir))
    return flatten(docs).select("doc_id", "start", "end", "text", "label", S.meta(F.col("metadata"), "match_source").alias("match_source"), S.meta(F.col("metadata"), "matched_value").alias("matched_value"))


def _flat(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = annotated(spark, sf_dir)
    return docs, flatten(docs)


def _rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; large ones are compared with fewer decimals."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.summary_totals(annotated(spark, sf_dir)), "annotations_per_document")


def summary_groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary_counts(_flat(spark, sf_dir)[1]).drop("first")


def _top(grouping: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: M.top_counts(_flat(spark, sf_dir)[1], grouping, 20)


def layers_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.layers(_flat(spark, sf_dir)[1])


def _salience(**args: Any) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(M.salience(*_flat(spark, sf_dir), **args), "idf", "score")


def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)[1]
    return flat.groupBy("layer", "label", S.canonical(F.col("text"), F.col("metadata")).alias("canonical")).agg(F.count("*").alias("tf"), F.countDistinct("doc_key").alias("df"))


def tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.tfidf(annotated(spark, sf_dir), "function")
    return _rounded(got.select("doc_id", "start", "end", "label", "layer", "tf", "df", "idf", "score"), "idf", "score")


def _near(spark: SparkSession, include_self: bool) -> DataFrame:
    return O.distances(edges(spark), 4, include_self=include_self)


def _extended_tfidf(kind: str, aggregation: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = M.tfidf(annotated(spark, sf_dir), "function")
        return _rounded(M.extended_tfidf(scored, _near(spark, True), 0.5, "function", kind, aggregation), "score", digits=6)

    return query


def _extended_salience(direction: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        near = O.distances(edges(spark).drop("weight"), 2, direction)
        got = M.extended_salience(*_flat(spark, sf_dir), near, 50, "function", 2, 0.5)
        sources = F.array_join(F.transform("expanded_from", lambda x: F.concat(x["source"], F.lit("@"), x["distance"].cast("string"))), " ")
        return _rounded(got.withColumn("sources", sources).drop("expanded_from"), "idf", "observed_score", "expanded_score", "score")

    return query


def extended_salience_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = O.distances(edges(spark).drop("weight"), 2)
    items = M.extended_salience(*_flat(spark, sf_dir), near, 50, "function", 2, 0.5)
    return _rounded(M.explain(items, "Preposition").select("concept_uri", "place", "source", "distance", "contribution"), "contribution")


def dijkstra_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, True)


def bfs_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.distances(edges(spark).drop("weight"), 3, "both")


def temporal_bad_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("surface")).distinct()
    bad = A.is_bad_temporal_surface(F.col("surface"), F.lit("duration"), F.lit("year"), temporal_rules("es"))
    return words.select("surface", bad.alias("bad"))


def quantity_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(x) for x in (" mil", " millones de euros", " euros", " millonesx")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    number = F.col("o_orderkey").cast("string")
    word, times, size = A.multiplier(F.concat(number, unit), F.length(number), quantity_rules("es"))
    return table(spark, sf_dir, "orders").select("o_orderkey", word.alias("word"), times.alias("times"), F.when(word.isNotNull(), size).alias("size"))


def token_exact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    upos = lambda t: F.when(F.lower(t).isin("the", "der", "la"), "DET").otherwise("X")
    docs = annotated(spark, sf_dir).withColumn("tokens", Mt.spans(F.col("text"), r"[A-Za-z]+", False))
    docs = docs.withColumn("p", Mt.places(F.col("annotations"), F.col("tokens"), True))
    zipped = F.arrays_zip(F.col("annotations").alias("a"), F.col("p").alias("p"))
    # a token of the same span has the annotation's text, so that tokens are no more than spans
    with_token = F.transform(zipped, lambda x: F.struct(x["a"]["start"].alias("start"), x["a"]["end"].alias("end"), x["a"]["label"].alias("label"), F.when(x["p"].isNotNull(), upos(x["a"]["text"])).alias("upos")))
    return docs.select("doc_id", F.inline(with_token))


def entity_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Mt.spans(F.col("text"), r"[^.\n]+", False)
    docs = annotated(spark, sf_dir).withColumn("entities", lines)
    docs = docs.withColumn("p", Mt.places(F.col("annotations"), F.col("entities"), False))
    zipped = F.arrays_zip(F.col("annotations").alias("a"), F.col("p").alias("p"))
    around = F.transform(zipped, lambda x: F.struct(x["a"]["start"].alias("start"), x["a"]["end"].alias("end"), F.col("entities")[x["p"]].alias("e")))
    return docs.select("doc_id", F.inline(around)).select("doc_id", "start", "end", F.col("e.start").alias("entity_start"), F.col("e.end").alias("entity_end"))


def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.text_hash(F.lit("es"), F.lit("tokenize"), F.col("text")).alias("text_hash"))


def camel_case_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.split_camel_case(F.regexp_replace("p_name", " ", "")).alias("term"), S.short_name(F.concat(F.lit("http://example.org/x#"), "p_name")).alias("name"))


def compact_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir, "longest_priority").select("doc_id", annotation_json(F.col("annotations"), "compact").alias("annotations"))


def annotations_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations_export(annotated(spark, sf_dir))


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = annotated(spark, sf_dir)
    line = document_json(docs, "full")
    return docs.select(line.alias("v")).select(F.get_json_object("v", "$.metadata.doc_id").cast("bigint").alias("doc_id"), F.get_json_object("v", "$.text").alias("text"), F.size(F.from_json(F.get_json_object("v", "$.annotations"), "array<struct<start:int>>")).cast("bigint").alias("annotations"))


def grammar_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and quantities in all documents of the languages that the grammar knows (it has no SQL)."""
    every = table(spark, sf_dir, "documents")
    out = []
    for lang in ("en", "es"):
        docs = documents(every.where(F.col("lang") == lang).select("doc_id", "text"), "text", "doc_id")
        for a in (A.TemporalAnnotator(language=lang, ref_time="2026-07-01T12:00:00"), A.QuantityAnnotator(language=lang, ref_time="2026-07-01T12:00:00")):
            docs = a.annotate(docs)
        out.append(flatten(docs).drop("ord", "score", "doc_key"))
    return out[0].union(out[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "regex_spans": regex_spans,
    "conflict_all": _conflict("all"),
    "conflict_longest": _conflict("longest"),
    "conflict_priority": _conflict("priority"),
    "conflict_longest_priority": _conflict("longest_priority"),
    "pattern_exceptions": pattern_exceptions,
    "ontology_spans": ontology_spans,
    "resolve_longest": _resolved(R.select_non_overlapping),
    "resolve_layer": _resolved(lambda a: R.resolve_layer(a, "phrase")),
    "resolve_visible": _resolved(R.select_visible),
    "resolve_by_label": _resolved(R.resolve_by_label),
    "paint_order": _resolved(R.paint_order),
    "summary_totals": summary_totals,
    "summary_groupings": summary_groupings,
    "summary_by_layer": _top("layer"),
    "summary_by_label": _top("label"),
    "summary_by_layer_label": _top("layer_label"),
    "summary_top_annotations": _top("annotation"),
    "layers_distinct": layers_distinct,
    "salience_top": _salience(top=20),
    "salience_layer": _salience(top=5, layer="phrase"),
    "salience_label": _salience(top=5, label="PREP"),
    "canonical_keys": canonical_keys,
    "tfidf_scores": tfidf_scores,
    "ext_tfidf_sum": _extended_tfidf("exponential", "sum"),
    "ext_tfidf_max": _extended_tfidf("exponential", "max"),
    "ext_tfidf_inverse": _extended_tfidf("inverse", "sum"),
    "ext_tfidf_none": _extended_tfidf("none", "sum"),
    "ext_salience_out": _extended_salience("outgoing"),
    "ext_salience_in": _extended_salience("incoming"),
    "ext_salience_both": _extended_salience("both"),
    "ext_salience_explain": extended_salience_explain,
    "dijkstra_distances": dijkstra_distances,
    "bfs_distances": bfs_distances,
    "temporal_bad_surface": temporal_bad_surface,
    "quantity_multiplier": quantity_multiplier,
    "token_exact_join": token_exact_join,
    "entity_containment_join": entity_containment_join,
    "text_hash": text_hash,
    "camel_case_terms": camel_case_terms,
    "compact_profile": compact_profile,
    "annotations_export": annotations_exported,
    "jsonl_roundtrip": jsonl_roundtrip,
    "grammar_spans": grammar_spans,
}


# ---------------------------------------------------------------- the same in SQL


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def matches(pattern: str, name: str) -> str:
    """CTE ``name``: doc_id, place, start, end, text of the pattern's matches, and the text between it and the one before."""
    return f"""{name} AS (SELECT doc_id, i, CAST(sum(length(gap) + length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) - length(t) AS "start", CAST(sum(length(gap) + length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS "end", t, gap
  FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS t, unnest(s[1:len(m)]) AS gap FROM (SELECT doc_id, regexp_extract_all(text, {_text(pattern)}) AS m, string_split_regex(text, {_text(pattern)}) AS s FROM documents)))"""


def _words(rules: list[dict] = RULES) -> str:
    values = []
    for r, rule in enumerate(rules):
        first, _, second = rule["pattern"].partition(" ")
        about = rule["metadata"] | {"rule_id": rule["id"], "matched_value": rule["pattern"], "match_type": "phrase", "priority": rule["priority"]}
        values.append(f"({r}, {_text(first)}, {_text(second)}, {_text(rule['label'])}, {_text(rule['layer'])}, {rule['priority']}, {_text(json.dumps(about, ensure_ascii=False))}, {_text(rule['metadata'].get('concept_uri'))}, {_text(rule['metadata'].get('wikidata'))})")
    return f"""WITH RECURSIVE {matches(r"[\p{L}\p{M}\p{N}_]+", "tok")},
rules(r, w1, w2, label, layer, prio, metadata, concept_uri, wikidata) AS (VALUES {", ".join(values)}),
pair AS (SELECT doc_id, "start", "end", t, lead(t) OVER w AS t2, lead("end") OVER w AS end2, lead(gap) OVER w AS gap2 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT doc_id, "start", CASE WHEN w2 = '' THEN "end" ELSE end2 END AS "end", CASE WHEN w2 = '' THEN t ELSE t || ' ' || t2 END AS text, rules.* FROM pair JOIN rules ON lower(t) = w1 AND (w2 = '' OR (lower(t2) = w2 AND gap2 = ' '))),
ann AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", r) - 1 AS INTEGER) AS ord FROM hit)"""


def _greedy(keys: str, name: str = "kept", source: str = "ann", order: str = "i") -> str:
    fold = "lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s < x.e AND x.s < k.e)) = 0 THEN list_append(acc, x) ELSE acc END"
    return f"""{name}_l AS (SELECT doc_id, list_sort(list({{{keys}, i: {order}, s: "start", e: "end", t: text, l: label, y: layer}})) AS l FROM {source} GROUP BY doc_id),
{name} AS (SELECT doc_id, x.s AS "start", x.e AS "end", x.t AS text, x.l AS label, x.y AS layer, x.i AS i FROM (SELECT doc_id, unnest(list_reduce(l, {fold}, l[1:0])) AS x FROM {name}_l))"""


_COLS = 'doc_id, "start", "end", text, label, layer'
_LEN = 'k1: -("end" - "start")'
_FLAT = "SELECT * FROM ann"


def _conflict_sql(keys: str | None) -> str:
    # ties go by the order of generation: rules first, then place
    if keys is None:
        return f"{_words()} SELECT {_COLS}, ord FROM ann"
    gen = "gen AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r, \"start\") AS g FROM ann)"
    return f'{_words()}, {gen}, {_greedy(keys, source="gen", order="g")} SELECT {_COLS}, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end") - 1 AS INTEGER) AS ord FROM kept'


_IDF = "ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1"
_CANON = "CASE WHEN concept_uri IS NOT NULL THEN 'concept_uri:' || concept_uri WHEN wikidata IS NOT NULL THEN 'wikidata:' || wikidata ELSE 'text:' || lower(text) END"


def _salience_sql(where: str, top: int) -> str:
    return f"""{_words()},
keyed AS (SELECT doc_id, ord, layer, label, {_CANON} AS canonical, text FROM ann WHERE {where}),
agg AS (SELECT layer, label, canonical, count(*) AS tf, count(DISTINCT doc_id) AS df, min((doc_id, ord)) AS first FROM keyed GROUP BY ALL),
shown AS (SELECT layer, label, canonical, text, row_number() OVER (PARTITION BY layer, label, canonical ORDER BY count(*) DESC, min((doc_id, ord))) AS n FROM keyed GROUP BY layer, label, canonical, text)
SELECT layer, label, canonical, text AS display, tf, df, round({_IDF}, 9) AS idf, round(tf * ({_IDF}), 9) AS score FROM agg JOIN shown USING (layer, label, canonical) WHERE n = 1
ORDER BY tf * ({_IDF}) DESC, tf DESC, df DESC, display DESC, first LIMIT {top}"""


def _top_sql(keys: str) -> str:
    return f"{_words()} SELECT {keys}, count(*) AS count FROM ann GROUP BY {keys} ORDER BY count(*) DESC, min((doc_id, ord)) LIMIT 20"


_EDGES = "edges(src, dst, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', {w})" for a, b, w in EDGES) + ")"


def _dist(most: int, weighted: bool, direction: str = "outgoing") -> str:
    w = "weight" if weighted else "1"
    out, back = f"SELECT src, dst, {w} AS weight FROM edges", f"SELECT dst AS src, src AS dst, {w} AS weight FROM edges"
    step = {"outgoing": out, "incoming": back, "both": f"{out} UNION ALL {back}"}[direction]
    return f"""{_EDGES}, step AS ({step}), walk(src, dst, distance) AS (SELECT src, src, 0 FROM (SELECT src FROM step UNION SELECT dst FROM step) UNION SELECT w.src, s.dst, w.distance + s.weight FROM walk w JOIN step s ON s.src = w.dst WHERE w.distance + s.weight <= {most}),
dist AS (SELECT src, dst, min(distance) AS distance FROM walk GROUP BY src, dst)"""


_TFIDF = """per AS (SELECT doc_id, label, count(*) AS tf FROM ann WHERE layer = 'function' GROUP BY ALL),
dfs AS (SELECT label, count(*) AS df FROM per GROUP BY label),
sc AS (SELECT doc_id, label, tf, df, CASE WHEN df > 1 THEN ln((SELECT count(*) FROM documents) / df) ELSE 1.0 END AS idf FROM per JOIN dfs USING (label))"""


def _ext_tfidf_sql(weight: str, agg: str) -> str:
    return f"""{_words()}, {_dist(4, True)}, {_TFIDF},
own AS (SELECT a.doc_id, a.concept_uri AS src, sc.tf * sc.idf AS score FROM ann a JOIN sc ON sc.doc_id = a.doc_id AND sc.label = a.label WHERE a.layer = 'function')
SELECT doc_id, dst AS concept, round({agg}(score * {weight}), 6) AS score FROM own JOIN dist USING (src) GROUP BY doc_id, dst"""


def _ext_salience_ctes(direction: str) -> str:
    return f"""{_words()}, {_dist(2, False, direction)},
own AS (SELECT * FROM ann WHERE layer = 'function' AND concept_uri IS NOT NULL),
seen AS (SELECT concept_uri, min(label) AS label, count(*) AS tf, count(DISTINCT doc_id) AS df FROM own GROUP BY 1),
shown AS (SELECT concept_uri, text AS display, row_number() OVER (PARTITION BY concept_uri ORDER BY count(*) DESC, min((doc_id, ord))) AS n FROM own GROUP BY 1, 2),
obs AS (SELECT concept_uri, label, display, tf, df, {_IDF} AS idf, tf * ({_IDF}) AS observed_score FROM seen JOIN shown USING (concept_uri) WHERE n = 1),
passed AS (SELECT d.src, d.dst, d.distance, o.observed_score * power(0.5, d.distance) AS contribution FROM dist d JOIN obs o ON o.concept_uri = d.src WHERE d.distance > 0)"""


def _ext_salience_sql(direction: str) -> str:
    return f"""{_ext_salience_ctes(direction)},
grown AS (SELECT dst AS concept_uri, sum(contribution) AS expanded_score, string_agg(src || '@' || distance, ' ' ORDER BY distance, -contribution, src) AS sources FROM passed GROUP BY 1)
SELECT 'concept_uri:' || concept_uri AS canonical, concept_uri, 'function' AS layer, coalesce(label, '') AS label, coalesce(sources, '') AS sources, coalesce(display, '') AS display, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df, round(coalesce(idf, 0), 9) AS idf, round(coalesce(observed_score, 0), 9) AS observed_score, round(coalesce(expanded_score, 0), 9) AS expanded_score, round(coalesce(observed_score, 0) + coalesce(expanded_score, 0), 9) AS score
FROM obs FULL JOIN grown USING (concept_uri)"""


_LAYER_RANK = "CASE layer " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.LAYER_PRIORITY.items()) + " ELSE 0 END"
_ES = temporal_rules("es")
_IN = lambda values: ", ".join(_text(v) for v in sorted(values))

ORACLES: dict[str, str] = {
    "regex_spans": "WITH " + ", ".join(matches(p, f"m{n}") for n, p in enumerate(REGEXES.values())) + " " + " UNION ALL ".join(f"SELECT doc_id, \"start\", \"end\", t AS text, '{k}' AS label FROM m{n}" for n, k in enumerate(REGEXES)),
    "conflict_all": _conflict_sql(None),
    "conflict_longest": _conflict_sql(f'{_LEN}, k2: "start"'),
    "conflict_priority": _conflict_sql('k0: -prio, k1: -("end" - "start"), k2: "start"'),
    "conflict_longest_priority": _conflict_sql(f'{_LEN}, k2: -prio, k3: "start"'),
    "pattern_exceptions": f"{_words()} SELECT {_COLS} FROM ann a WHERE r = 0 AND NOT EXISTS (SELECT 1 FROM ann b WHERE b.doc_id = a.doc_id AND b.r IN (2, 8) AND a.\"start\" < b.\"end\" AND b.\"start\" < a.\"end\")",
    "ontology_spans": f"""WITH {matches(r"[\p{L}\p{M}\p{N}_]+", "tok")},
terms(n, w, label, match_source, matched_value) AS (VALUES (0, 'the', 'The', 'label', 'the'), (1, 'der', 'The', 'alias', 'der'), (2, 'the', 'The', 'name', 'The'), (3, 'die', 'The', 'regex', 'die|das'), (3, 'das', 'The', 'regex', 'die|das'), (4, 'de', 'OfThe', 'label', 'de'), (5, 'ofthe', 'OfThe', 'name', 'OfThe')),
pair AS (SELECT doc_id, "start", t, lead(t) OVER w AS t2, lead("end") OVER w AS end2, lead(gap) OVER w AS gap2 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, "start", "end", t AS text, label, match_source, matched_value FROM tok JOIN terms ON lower(t) = w
UNION ALL SELECT doc_id, "start", end2, t || ' ' || t2, 'OfThe', 'name_camel_case', 'Of The' FROM pair WHERE lower(t) = 'of' AND lower(t2) = 'the' AND gap2 = ' '""",
    "resolve_longest": f'{_words()}, {_greedy(_LEN, order="ord")} SELECT {_COLS} FROM kept',
    "resolve_layer": f"{_words()}, phrase AS (SELECT * FROM ann WHERE layer = 'phrase'), {_greedy(_LEN, source='phrase', order='ord')} SELECT {_COLS} FROM kept UNION ALL SELECT {_COLS} FROM ann WHERE layer <> 'phrase'",
    "resolve_visible": f'{_words()}, {_greedy(f"""k0: -({_LAYER_RANK}), k1: -prio, k2: -("end" - "start")""", order="ord")} SELECT {_COLS} FROM kept',
    "resolve_by_label": f'{_words()}, {_greedy(_LEN + """, k2: "start", k3: label""", order="ord")} SELECT {_COLS} FROM kept',
    "paint_order": f"""{_words()}, l AS (SELECT doc_id, list_sort(list({{s: "start", n: -("end" - "start"), i: ord, e: "end", t: text, l: label, y: layer}})) AS l FROM ann GROUP BY doc_id),
x AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(acc) = 0 OR acc[-1].e <= x.s THEN list_append(acc, x) ELSE acc END, l[1:0])) AS x FROM l)
SELECT doc_id, x.s AS "start", x.e AS "end", x.t AS text, x.l AS label, x.y AS layer FROM x""",
    "summary_totals": f"{_words()} SELECT d AS documents, w AS documents_with_annotations, d - w AS documents_without_annotations, a AS annotations, round(a / d, 9) AS annotations_per_document FROM (SELECT (SELECT count(*) FROM documents) AS d, count(DISTINCT doc_id) AS w, count(*) AS a FROM ann)",
    "summary_groupings": f"{_words()} SELECT CASE WHEN grouping(text) = 0 THEN 'annotation' WHEN grouping(layer) = 0 AND grouping(label) = 0 THEN 'layer_label' WHEN grouping(layer) = 0 THEN 'layer' ELSE 'label' END AS grouping, text, layer, label, count(*) AS count FROM ann GROUP BY GROUPING SETS ((layer), (label), (layer, label), (text, layer, label))",
    "summary_by_layer": _top_sql("layer"),
    "summary_by_label": _top_sql("label"),
    "summary_by_layer_label": _top_sql("layer, label"),
    "summary_top_annotations": _top_sql("text, layer, label"),
    "layers_distinct": f"{_words()} SELECT DISTINCT layer FROM ann",
    "salience_top": _salience_sql("true", 20),
    "salience_layer": _salience_sql("layer = 'phrase'", 5),
    "salience_label": _salience_sql("label = 'PREP'", 5),
    "canonical_keys": f"{_words()} SELECT layer, label, {_CANON} AS canonical, count(*) AS tf, count(DISTINCT doc_id) AS df FROM ann GROUP BY ALL",
    "tfidf_scores": f"""{_words()}, {_TFIDF} SELECT a.doc_id, a."start", a."end", a.label, a.layer, sc.tf, sc.df, round(sc.idf, 9) AS idf, round(sc.tf * sc.idf, 9) AS score FROM ann a LEFT JOIN sc ON a.layer = 'function' AND sc.doc_id = a.doc_id AND sc.label = a.label""",
    "ext_tfidf_sum": _ext_tfidf_sql("power(0.5, distance)", "sum"),
    "ext_tfidf_max": _ext_tfidf_sql("power(0.5, distance)", "max"),
    "ext_tfidf_inverse": _ext_tfidf_sql("(1.0 / (1 + distance)::DOUBLE)", "sum"),
    "ext_tfidf_none": _ext_tfidf_sql("1.0::DOUBLE", "sum"),
    "ext_salience_out": _ext_salience_sql("outgoing"),
    "ext_salience_in": _ext_salience_sql("incoming"),
    "ext_salience_both": _ext_salience_sql("both"),
    "ext_salience_explain": f"{_ext_salience_ctes('outgoing')} SELECT dst AS concept_uri, CAST(row_number() OVER (ORDER BY distance, -contribution, src) - 1 AS INTEGER) AS place, src AS source, distance, round(contribution, 9) AS contribution FROM passed WHERE dst = '{BASE}Preposition'",
    "dijkstra_distances": f"WITH RECURSIVE {_dist(4, True)} SELECT * FROM dist",
    "bfs_distances": f"WITH RECURSIVE {_dist(3, False, 'both')} SELECT * FROM dist WHERE src <> dst",
    "temporal_bad_surface": f"""SELECT surface, trim(surface, E' \\n\\t\\r') IN ({_IN(_ES.exact)}) OR low = '' OR low IN ({_IN(_ES.single)}) OR low IN ({_IN(_ES.years)}) OR (len(w) = 2 AND w[1] IN ({_IN(_ES.starts)}) AND w[2] IN ({_IN(_ES.single)})) OR (len(w) = 2 AND w[1] IN ({_IN(_ES.hour_starts)}) AND w[2] IN ({_IN(_ES.hours)})) OR regexp_full_match(low, '[0-9]+') AS bad
FROM (SELECT surface, lower(trim(surface, E' \\n\\t\\r')) AS low, string_split_regex(lower(trim(surface, E' \\n\\t\\r')), '\\s+') AS w FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS surface FROM documents))""",
    "quantity_multiplier": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'mil' WHEN 1 THEN 'millones' END AS word, CASE o_orderkey % 4 WHEN 0 THEN 1000::BIGINT WHEN 1 THEN 1000000::BIGINT END AS times, CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 9 END AS size FROM orders",
    "token_exact_join": f"""{_words()}, {matches("[A-Za-z]+", "plain")} SELECT a.doc_id, a."start", a."end", a.label, CASE WHEN p.t IS NULL THEN NULL WHEN lower(p.t) IN ('the', 'der', 'la') THEN 'DET' ELSE 'X' END AS upos FROM ann a LEFT JOIN plain p ON p.doc_id = a.doc_id AND p."start" = a."start" AND p."end" = a."end\"""",
    "entity_containment_join": f"""{_words()}, {matches("[^.\n]+", "line")}, ent AS (SELECT * FROM line) SELECT a.doc_id, a."start", a."end", e."start" AS entity_start, e."end" AS entity_end FROM ann a LEFT JOIN ent e ON e.doc_id = a.doc_id AND e."start" <= a."start" AND a."end" <= e."end\"""",
    "text_hash": "SELECT doc_id, sha1('es' || chr(10) || 'tokenize' || chr(10) || text) AS text_hash FROM documents",
    "camel_case_terms": "SELECT p_partkey, ltrim(regexp_replace(replace(p_name, ' ', ''), '([A-Z])', ' \\1', 'g')) AS term, p_name AS name FROM part",
    "compact_profile": _conflict_sql(f'{_LEN}, k2: -prio, k3: "start"').rsplit(" SELECT ", 1)[0]
    + """ SELECT d.doc_id, '[' || coalesce(string_agg('{"start":' || k."start" || ',"end":' || k."end" || ',"text":"' || k.text || '","label":"' || k.label || '","layer":"' || k.layer || '","source":"pattern","type":"phrase","metadata":{' || CASE WHEN g.concept_uri IS NOT NULL THEN '"concept_uri":"' || g.concept_uri || '",' ELSE '' END || '"matched_value":"' || g.w1 || CASE WHEN g.w2 = '' THEN '' ELSE ' ' || g.w2 END || '"' || CASE WHEN g.wikidata IS NOT NULL THEN ',"wikidata":"' || g.wikidata || '"' ELSE '' END || '}}', ',' ORDER BY k."start", k."end"), '') || ']' AS annotations FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN gen g ON g.doc_id = k.doc_id AND g.g = k.i GROUP BY d.doc_id""",
    "annotations_export": f"{_words()} SELECT {_COLS}, 'pattern' AS source, 'phrase' AS type, NULL::VARCHAR AS subtype, NULL::DOUBLE AS score, metadata FROM ann",
    "jsonl_roundtrip": f"{_words()} SELECT d.doc_id, any_value(d.text) AS text, count(a.doc_id) AS annotations FROM documents d LEFT JOIN ann a ON a.doc_id = d.doc_id GROUP BY d.doc_id",
}
