"""Spans, resolvers, annotators, metrics, ontologies, readers and writers, pipeline, streaming and the command line."""

import json
import random
import re
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from annolith.functions import grammar, language, matching
from annolith.functions import spans as S
from annolith.model import ANNOTATIONS, documents, flatten, nest
from annolith.operators import annotators as A
from annolith.operators import metrics as M
from annolith.operators import ontology as O
from annolith.operators import resolve as R
from annolith.plans import cli, render
from annolith.plans.pipeline import AnnotationPipeline, build_annotators, distance_frame, run_config
from annolith.sources import readers, writers
from annolith.streaming.annotate import annotate_stream, label_counts

REF = "2026-07-01T12:00:00"
OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns="http://ex.org/t#" xml:base="http://ex.org/t">
stray text
<owl:ObjectProperty rdf:about="#eats"/>
<owl:Class rdf:about="#Animal"><rdfs:label xml:lang="en">animal</rdfs:label></owl:Class>
<owl:Class rdf:about="#Cat"><rdfs:label>cat</rdfs:label><rdfs:seeAlso>kitty</rdfs:seeAlso><rdfs:subClassOf rdf:resource="#Animal"/><regex>cats?|felines?</regex><eats rdf:resource="#Fish"/></owl:Class>
<owl:Class rdf:about="#Fish"><rdfs:subClassOf rdf:resource="#Animal"/></owl:Class>
<owl:NamedIndividual rdf:about="#Tom"><rdf:type rdf:resource="#Cat"/><rdfs:label>Tom</rdfs:label></owl:NamedIndividual>
</rdf:RDF>"""
URI = "http://ex.org/t#"


def docs_of(spark, *texts):
    return documents(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", "id")


def ann(start, end, label="L", layer="a", metadata="{}", text="x"):
    return (start, end, text, label, layer, None, None, None, None, metadata)


def with_annotations(spark, *lists, texts=None):
    rows = [(i, (texts or ["x" * 60] * len(lists))[i], list(x)) for i, x in enumerate(lists)]
    return spark.createDataFrame(rows, f"doc_id long, text string, annotations {ANNOTATIONS.simpleString()}")


@pytest.fixture(scope="module")
def owl(tmp_path_factory):
    path = tmp_path_factory.mktemp("owl") / "t.owl"
    path.write_text(OWL)
    return str(path)


@pytest.mark.parametrize("pattern", [r"\w+", r"\b\d+\b", "x*", r"(\w)\1", S.literal_pattern("año"), S.literal_pattern("a.b"), r"(?P<n>é)t", S.bounded("a|b")])
def test_spans_are_those_of_finditer(spark, pattern):
    texts = ["", "aa bb 12 🍕 été ÉTÉ año a.b A.B axb", "xxx  x1x 22", "control \x01 \x02 año", "b"]
    texts = [t.replace("🍕", "-") for t in texts] if pattern == "x*" else texts  # see the docstring of spans
    got = docs_of(spark, *texts).select("doc_id", S.spans(F.col("text"), pattern).alias("s")).orderBy("doc_id").collect()
    want = [[m.span() for m in re.finditer(pattern.replace(r"(?<!\w" + re.escape("año") + ")", ""), t, re.I)] if "año" not in pattern else [m.span() for m in re.finditer(r"(?<!\w)año(?!\w)", t, re.I)] for t in texts]
    assert [[tuple(x) for x in r.s] for r in got] == want
    assert docs_of(spark, None).select(S.spans(F.col("text"), pattern).alias("s")).first().s is None


def model_greedy(items, key):
    kept = []
    for a in sorted(items, key=key):
        if not any(a[0] < k[1] and k[0] < a[1] for k in kept):
            kept.append(a)
    return kept


def test_resolvers_are_a_simple_model(spark):
    rng = random.Random(4)
    lists = []
    for _ in range(60):
        one = []
        for _ in range(rng.randint(0, 14)):
            s = rng.randint(0, 25)
            one.append(ann(s, s + rng.randint(0, 8), rng.choice("AB"), rng.choice(["a", "b", "social"]), json.dumps({"priority": rng.randint(0, 3)})))
        lists.append(one)
    docs = with_annotations(spark, *lists)
    prio = lambda a: json.loads(a[9])["priority"]
    rank = lambda a: R.LAYER_PRIORITY.get(a[4], 0)
    size = lambda a: a[1] - a[0]
    place = lambda kept: sorted(kept, key=lambda a: (a[0], a[1]))

    def longest(x):
        i = {id(a): n for n, a in enumerate(x)}
        return sorted(model_greedy(x, lambda a: -size(a)), key=lambda a: (a[0], a[1], i[id(a)]))

    cases = {
        "longest": (R.select_non_overlapping, longest),
        "all": (lambda c: R.resolve_conflicts(c, "all"), place),
        "c_longest": (lambda c: R.resolve_conflicts(c, "longest"), lambda x: place(model_greedy(x, lambda a: (-size(a), a[0])))),
        "priority": (lambda c: R.resolve_conflicts(c, "priority"), lambda x: place(model_greedy(x, lambda a: (-prio(a), -size(a), a[0])))),
        "longest_priority": (lambda c: R.resolve_conflicts(c, "longest_priority"), lambda x: place(model_greedy(x, lambda a: (-size(a), -prio(a), a[0])))),
        "visible": (R.select_visible, lambda x: place(model_greedy(x, lambda a: (-rank(a), -prio(a), -size(a))))),
        "layer": (lambda c: R.resolve_layer(c, "a"), lambda x: place([a for a in x if a[4] != "a"] + longest([a for a in x if a[4] == "a"]))),
        "label": (R.resolve_by_label, lambda x: sorted(model_greedy(x, lambda a: (-size(a), a[0], a[3])), key=lambda a: (a[0], a[1], a[4], a[3]))),
    }
    for name, (make, model) in cases.items():
        got = docs.select("doc_id", make(F.col("annotations")).alias("a")).orderBy("doc_id").collect()
        for r, x in zip(got, lists):
            assert [tuple(a) for a in r.a] == model(x), (name, x)
    with pytest.raises(ValueError):
        R.resolve_conflicts(F.col("annotations"), "other")
    with pytest.raises(ValueError):
        R.apply_resolver(docs, {"enabled": True, "strategy": "longest_match"})
    assert R.apply_resolver(docs, None) is docs


def test_patterns_exceptions_and_conflicts(spark):
    config = {"defaults": {"layer": "m", "match": "phrase"}, "patterns": [{"id": "n", "label": "NY", "patterns": ["new york", "york"], "exceptions": ["new york times"]}, {"label": "W", "match": "regex", "pattern": r"\bn\w+", "case_sensitive": True, "priority": 2, "metadata": {"wikidata": "Q1"}}]}
    docs = A.PatternAnnotator(A.pattern_rules(config)).annotate(docs_of(spark, "In New York and the New York Times news", None, ""))
    got = flatten(docs).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.text, r.label) for r in got] == [(0, "New York", "NY"), (0, "news", "W")]
    assert json.loads(got[1].metadata) == {"wikidata": "Q1", "rule_id": "rule_1", "matched_value": r"\bn\w+", "match_type": "regex", "priority": 2}
    for bad in ({"label": "x"}, {"label": "x", "pattern": "y", "match": "glob"}):
        with pytest.raises(ValueError):
            A.pattern_rules({"patterns": [bad]})


def test_ontology_index_graph_and_annotator(spark, owl):
    triples = readers.read_rdf(owl)
    index = O.build_index(triples, {"entity_types": {"include": ["owl:Class", "owl:NamedIndividual"]}})
    assert [(c.name, c.labels, c.aliases, c.patterns, c.parents) for c in index] == [("Animal", ["animal"], [], [], []), ("Cat", ["cat"], ["kitty"], ["cats?|felines?"], ["Animal"]), ("Fish", [], [], [], ["Animal"]), ("Tom", ["Tom"], [], [], [])]
    got = flatten(A.OntologyAnnotator(index).annotate(docs_of(spark, "Tom the Cat; cats, concat, kitty"))).collect()
    assert [(r.text, r.label, S and json.loads(r.metadata)["match_source"]) for r in got] == [("Cat", "Cat", "label"), ("kitty", "Cat", "alias"), ("Cat", "Cat", "regex"), ("cats", "Cat", "regex"), ("Tom", "Tom", "label")]
    graph = O.build_graph(triples, {"relations": [{"property": "rdfs:subClassOf"}, {"property": "rdf:type", "direction": "instance_to_class"}, {"property": "eats", "distance": 2, "direction": "both"}]})
    assert graph.distances_from(URI + "Tom", 3) == {URI + "Tom": 0, URI + "Cat": 1, URI + "Animal": 2, URI + "Fish": 3}
    assert graph.distances_from("nowhere", 3) == {}
    frame = {(r.src, r.dst): r.distance for r in O.distances(graph.frame(spark), 3, include_self=True).collect()}
    assert frame == {(r.src, r.dst): r.distance for r in distance_frame(spark, graph, 3).collect()}
    with pytest.raises(ValueError):
        O.build_graph(triples, {"relations": [{"property": "nothing"}]})
    with pytest.raises(ValueError):
        O.find_concept(graph.nodes, "Dog")
    assert O.adjacency({"a": ["b"], "b": {"c": 1}}, "both") == [("a", "b"), ("b", "c"), ("b", "a"), ("c", "b")]
    with pytest.raises(TypeError):
        O.adjacency(7)


def test_graphs_hold_what_is_configured(spark, owl):
    triples = readers.read_rdf(owl)
    assert O.build_graph(triples).edges == {} and O.build_graph(triples, {"ontology": {"relations": []}}).nodes == {}
    half = O.build_graph(triples, {"relations": [{"property": "rdfs:subClassOf", "distance": 0.5}]})
    assert half.distances_from(URI + "Cat", 1) == {URI + "Cat": 0, URI + "Animal": 0.5}
    assert {(r.src, r.dst): r.distance for r in O.distances(half.frame(spark), 1).collect()} == {(URI + "Cat", URI + "Animal"): 0.5, (URI + "Fish", URI + "Animal"): 0.5}
    literal = O.build_graph(triples, {"relations": [{"property": "regex"}]})
    assert (URI + "Cat", "cats?|felines?") in literal.edges
    assert [O.short_name(x) for x in ("a#b", "http://x/y", "http://x/y/", "concept_uri:z", "plain")] == ["b", "y", "y", "z", "plain"]


def test_documents_are_told_apart_whatever_their_ids(spark):
    rows = [(None, "a dog"), (None, "a cat and a dog"), (1, "a cat"), (1, "nothing")]
    docs = documents(spark.createDataFrame(rows, "id long, text string"), "text", "id")
    docs = A.PatternAnnotator(A.pattern_rules({"patterns": [{"label": x, "pattern": x, "layer": "ontology"} for x in ("dog", "cat")]})).annotate(docs)
    totals = M.summary_totals(docs).first()
    assert (totals.documents, totals.documents_with_annotations, totals.annotations) == (4, 3, 4)
    assert {(r.label, r.tf, r.df) for r in M.salience_scores(docs, flatten(docs)).collect()} == {("dog", 2, 2), ("cat", 2, 2)}
    assert {(r.label, r.tf, r.df) for r in M.tfidf(docs).collect()} == {("dog", 1, 2), ("cat", 1, 2)}
    back = nest(docs, M.with_scores_in_metadata(M.tfidf(docs))).collect()
    assert sorted((r.text, [a.text for a in r.annotations]) for r in back) == [("a cat", ["cat"]), ("a cat and a dog", ["cat", "dog"]), ("a dog", ["dog"]), ("nothing", [])]
    assert back[0].__fields__ == docs.columns


def test_phrases_of_all_rules_are_found_as_each_by_itself(spark):
    rng = random.Random(8)
    phrases = ["aa", "a a", "A", "ß", "kelvin", "sis", "istanbul", "σας", "a-b", "b", "ab a"]
    alphabet = ["a", "A", "b", "-", " ", " ", "ß", "K", "elvin", "k", "ſi", "sis", "İstanbul", "istanbul", "ΣΑΣ", "σας", "_", "1", "\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for ignore in (True, False):
        for edges in (True, False):
            m = matching.Matcher([matching.Term(p, ignore_case=ignore, bounded=edges) for p in phrases])
            for t in texts:
                want = [[x.span() for x in re.finditer(rf"(?<!\w){re.escape(p)}(?!\w)" if edges else re.escape(p), t, re.I if ignore else 0)] for p in phrases]
                assert m.spans(t) == want, (t, ignore, edges)


def test_holders_are_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        spans = [(s, s + rng.randint(0, 4)) for s in (rng.randint(0, 20) for _ in range(rng.randint(0, 8)))]
        outer = [(s, s + rng.randint(0, 9)) for s in (rng.randint(0, 20) for _ in range(rng.randint(0, 6)))]
        if rng.random() < 0.5:
            cuts = sorted(rng.randint(0, 25) for _ in range(rng.randint(0, 7)))
            outer = list(zip(cuts, cuts[1:]))
        start, end = [s for s, _ in spans], [e for _, e in spans]
        assert matching.holders(start, end, outer, True) == [next((i for i, x in enumerate(outer) if x == s), None) for s in spans]
        assert matching.holders(start, end, outer, False) == [next((i for i, x in enumerate(outer) if x[0] <= s[0] and s[1] <= x[1]), None) for s in spans]


def test_languages(tmp_path):
    assert [grammar.locale_of(x) for x in ("es", "en", "fr")] == ["ES_ES", "EN_US", "FR"]
    with pytest.raises(ValueError):
        grammar.language_of("fr")
    with pytest.raises(ValueError):
        A.parsed(["time"], "xx", "UTC", REF)
    (tmp_path / "es").mkdir()
    (tmp_path / "es" / "temporal.yml").write_text("single: [una]\n")
    assert language.language_resource(str(tmp_path), "ES-mx", "temporal") == {"single": ["una"]} and language.language_resource(str(tmp_path), "en", "temporal") == {}


def test_grammar():
    ref = grammar.reference_time(REF, "Europe/Madrid")
    assert ref == datetime(2026, 7, 1, 12, tzinfo=ZoneInfo("Europe/Madrid"))
    every = {"time", "duration", "time-grain", "number", "amount-of-money", "quantity", "distance", "volume", "temperature", "ordinal"}

    def found(text, lang="es", dims=every):
        return [(r["body"], r["dim"], r["value"]["value"]) for r in grammar.parse(text, dims, lang, ref)]

    assert found("Ayer llovió") == [("Ayer", "time", "2026-06-30T00:00:00.000+02:00")]
    assert found("el próximo lunes") == [("el próximo lunes", "time", "2026-07-06T00:00:00.000+02:00")]
    assert found("en dos semanas", dims={"time", "duration"}) == [("en dos semanas", "time", "2026-07-13T00:00:00.000+02:00")]
    assert found("12 euros y 200 gramos de queso") == [("12 euros", "amount-of-money", 12), ("200 gramos de queso", "quantity", 200)]
    assert found("12 meters tomorrow", "en") == [("12 meters", "distance", 12), ("tomorrow", "time", "2026-07-02T00:00:00.000+02:00")]
    assert found("", "en") == []


def test_temporal_and_quantity_annotators(spark):
    docs = docs_of(spark, "Mañana pediremos 3 pizzas", "unos 22.000 millones de euros", "el SEP y la mar", None)
    got = flatten(A.QuantityAnnotator(ref_time=REF).annotate(A.TemporalAnnotator(ref_time=REF).annotate(docs))).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.text, r.label, r.layer) for r in got] == [(0, "Mañana", "DATE", "temporal"), (0, "3", "NUMBER", "cantidades"), (1, "22.000 millones", "QUANTITY", "cantidades")]
    about = json.loads(got[2].metadata)
    assert about["normalized"] == 22e9 and about["multiplier"] == "millones" and got[2].subtype == "multiplier"
    assert json.loads(got[1].metadata)["normalized"] == 3
    rules = A.temporal_rules("es")
    cases = [("una", None, None, True), ("a cuatro", None, None, True), ("un 30", None, "minute", True), ("3", "duration", None, True), ("SEP", None, None, True), ("sep", None, None, False), ("mil", None, "year", True), ("mañana", "time", "day", False), ("", None, None, True)]
    frame = spark.createDataFrame(cases, "s string, d string, g string, want boolean")
    assert all(r.bad == r.want for r in frame.select("want", A.is_bad_temporal_surface(F.col("s"), F.col("d"), F.col("g"), rules).alias("bad")).collect())


def test_tokens_and_entities_decide(spark):
    docs = docs_of(spark, "una pizza", "en julio").withColumn("tokens", F.when(F.col("doc_id") == 0, F.from_json(F.lit('[{"text":"una","start":0,"end":3,"upos":"DET"}]'), A.TOKENS))).withColumn("entities", F.when(F.col("doc_id") == 1, F.from_json(F.lit('[{"text":"x","type":"LOC"},{"text":"julio","start":3,"end":8,"type":"PER"}]'), A.ENTITIES)))
    got = flatten(A.EntityAnnotator().annotate(A.TemporalAnnotator(ref_time=REF).annotate(A.QuantityAnnotator(ref_time=REF).annotate(docs)))).collect()
    assert [(r.doc_id, r.text, r.layer) for r in got] == [(1, "julio", "ner")]
    linked = docs.withColumn("link_response", F.lit('{"Resources":[{"@URI":"u","@offset":"3","@surfaceForm":"pizza","@similarityScore":"0.9"},{"@offset":"-1","@surfaceForm":"y"}]}'))
    assert [(r.start, r.end, r.label) for r in flatten(A.LinkAnnotator().annotate(linked)).collect()] == [(3, 8, "DBPEDIA")] * 2
    own = A.FunctionAnnotator(lambda t: [{"start": 0, "end": 1, "label": "F"}]).annotate(docs)
    assert flatten(own).count() == 2


def test_metrics(spark):
    uri = lambda x: json.dumps({"concept_uri": x})
    docs = with_annotations(spark, [ann(0, 1, "Gov", "news", text="Government"), ann(2, 3, "Gov", "news", text="Health")], [ann(0, 1, "Gov", "news", text="government ")], [])
    flat = flatten(docs)
    top = M.salience(docs, flat).collect()
    assert (top[0].canonical, top[0].display, top[0].tf, top[0].df, round(top[0].idf, 3), round(top[0].score, 3)) == ("text:government", "Government", 2, 2, 1.288, 2.575)
    assert round(top[1].score, 3) == 1.693
    totals = M.summary_totals(docs).first()
    assert (totals.documents, totals.documents_with_annotations, totals.documents_without_annotations, totals.annotations) == (3, 2, 1, 3)
    assert {r.grouping for r in M.summary_counts(flat).collect()} == {"layer", "label", "layer_label", "annotation"}
    two = with_annotations(spark, [ann(0, 1, "P", "ontology", uri("h")), ann(2, 3, "Q", "ontology", uri("q"))], [ann(0, 1, "P", "ontology", uri("h"))])
    scored = M.tfidf(two)
    assert sorted((r.label, r.tf, r.df, r.idf, r.score) for r in scored.collect()) == [("P", 1, 2, 0.0, 0.0)] * 2 + [("Q", 1, 1, 1.0, 1.0)]
    near = spark.createDataFrame([("q", "q", 0), ("q", "z", 1)], "src string, dst string, distance int")
    ext = M.extended_tfidf(scored.withColumn("metadata", F.regexp_replace("metadata", "concept_uri", "concept_id")), near)
    assert {(r.doc_id, r.concept): r.score for r in ext.collect()} == {(0, "q"): 1.0, (0, "z"): 0.5}
    items = M.extended_salience(two, flatten(two), near, max_distance=2)
    got = {r.concept_uri: r for r in items.collect()}
    assert got["z"].score == pytest.approx(got["q"].observed_score / 2) and got["z"].tf == 0 and got["h"].expanded_score == 0
    assert [(r.source, r.distance) for r in M.explain(items, "z").collect()] == [("q", 1)]
    back = nest(two, M.with_scores_in_metadata(scored)).orderBy("doc_id").first()
    assert json.loads(back.annotations[1].metadata)["tfidf"] == 1.0
    with pytest.raises(ValueError):
        M.extended_tfidf(scored, near, decay_function="other")
    empty = docs.limit(0)
    assert M.salience(empty, flatten(empty)).count() == 0 and M.summary_totals(empty).first().annotations_per_document == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n7,"one, ""two""\nlines"\n8,\n9,three\n')
    assert [(r.doc_id, r.text) for r in readers.read_documents(spark, str(tmp_path / "a.csv")).orderBy("doc_id").collect()] == [(0, 'one, "two"\nlines'), (1, "nan"), (2, "three")]
    (tmp_path / "a.jsonl").write_text('{"id": "x", "text": "A", "more": 1}\n\n{"text": "B"}\n')
    got = readers.read_documents(spark, str(tmp_path / "a.jsonl")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == [("2", "B"), ("x", "A")] and json.loads(got[1].source)["more"] == 1
    (tmp_path / "a.txt").write_text("  whole\nfile \n")
    assert readers.read_documents(spark, str(tmp_path / "a.txt")).first().text == "whole\nfile"
    assert [readers.infer_input_format(p) for p in ("-", "a.CSV", "b.ndjson", "c.text", "d.bin")] == ["text", "csv", "jsonl", "text", "csv"]
    assert [writers.infer_output_format(p) for p in ("-", "a.json", "b.ndjson", "c.txt", "d.bin")] == ["jsonl", "json", "jsonl", "text", "json"]
    for call in (lambda: readers.read_documents(spark, "x", "xml"), lambda: readers.read_annotated(spark, "-"), lambda: readers.read_annotated(spark, "x.csv")):
        with pytest.raises(ValueError):
            call()
    (tmp_path / "c.jsonl").write_text('{"text_hash": "h", "tokens": []}\n{"text_hash": "h", "tokens": [{"text": "t", "start": 0, "end": 1}]}\n')
    assert [len(r.tokens) for r in readers.read_cache(spark, str(tmp_path / "c.jsonl")).collect()] == [1]


def test_profiles_and_writers(spark, tmp_path):
    docs = with_annotations(spark, [(0, 1, "x", "L", "a", None, None, None, 2.0, '{"normalized":1.5,"junk":2,"unit":null}')], [])
    compact = [json.loads(r.v) for r in docs.orderBy("doc_id").select(writers.document_json(docs).alias("v")).collect()]
    assert compact[0] == {"text": "x" * 60, "annotations": [{"start": 0, "end": 1, "text": "x", "label": "L", "layer": "a", "metadata": {"normalized": 1.5}}], "metadata": {"doc_id": 0}}
    assert compact[1]["annotations"] == []
    full = json.loads(docs.orderBy("doc_id").select(writers.document_json(docs, "full").alias("v")).first().v)["annotations"][0]
    assert full["score"] == 2.0 and full["subtype"] is None and full["metadata"]["junk"] == 2
    with pytest.raises(ValueError):
        writers.document_json(docs, "other")
    for name, fmt in (("o.json", "json"), ("o.jsonl", "jsonl")):
        writers.write_corpus(docs, str(tmp_path / name), None, "full")
        back = readers.read_annotated(spark, str(tmp_path / name), fmt)
        assert back.count() == 2 and flatten(back).first().score == 2.0
    writers.write_corpus(docs, str(tmp_path / "o.txt"))
    assert spark.read.text(str(tmp_path / "o.txt")).count() == 2
    assert writers.documents_export(docs).count() == 2 and writers.annotations_export(docs).count() == 1


def test_run_from_configuration_render_and_command_line(spark, owl, tmp_path, capsys):
    (tmp_path / "r.yml").write_text("patterns:\n  - {label: BIG, pattern: big}\n")
    (tmp_path / "o.yml").write_text("ontology:\n  relations:\n    - {property: 'rdf:type', direction: instance_to_class}\n    - {property: 'rdfs:subClassOf'}\n")
    (tmp_path / "d.csv").write_text("text\nYesterday the big cat ate 3 fish\nA cat & a cat\n")
    config = {"ontology": {"path": owl, "match": {"name": True}, "relations": [{"property": "rdfs:subClassOf"}, {"property": "rdf:type", "direction": "instance_to_class"}]}, "annotators": ["ontology", {"name": "temporal", "language": "en", "ref_time": REF}, {"name": "quantity", "language": "en", "ref_time": REF}, {"name": "pattern", "source": "r.yml", "color": "#123456"}], "resolver": {"enabled": True}, "metrics": {"tfidf": {"enabled": True}, "extended_tfidf": {"enabled": True, "decay": {"value": 0.5}}}}
    got = run_config(spark, config, str(tmp_path / "d.csv"), base=str(tmp_path))
    flat = flatten(got.documents).orderBy("doc_id", "ord").collect()
    assert [(r.text, r.label) for r in flat] == [("Yesterday", "DATE"), ("big", "BIG"), ("cat", "Cat"), ("3", "NUMBER"), ("fish", "Fish"), ("cat", "Cat"), ("cat", "Cat")]
    assert {(r.doc_id, r.concept): r.score for r in got.extended.collect()}[0, URI + "Animal"] == 0.5
    page = render.render_html(got.documents, "T", got.metadata["layer_colors"], got.extended)
    assert "#123456" in page and "&amp; a" in page
    assert "[Cat]" in render.render_console(got.documents)
    for bad in ("other", {"name": "pattern"}, {"name": "duckling"}, "ontology"):
        with pytest.raises(ValueError):
            build_annotators([bad])
    assert AnnotationPipeline(build_annotators([{"name": "temporal", "language": "en"}])).run_text(spark, "tomorrow").first().annotations[0].label == "DATE"
    writers.write_corpus(got.documents, str(tmp_path / "out.json"), None, "full")
    out = str(tmp_path / "out.json")
    for args in (["metrics", "summary", "--input", out], ["metrics", "salience", "--input", out], ["metrics", "salience", "--input", out, "--method", "tfidf-e", "--ontology", owl, "--json"], ["ontology", "info", "--ontology", owl], ["ontology", "concepts", "--ontology", owl], ["ontology", "distances", "--ontology", owl, "--config", str(tmp_path / "o.yml"), "--concept", "Tom"], ["ontology", "relations", "--ontology", owl], ["render", "html", "--input", out], ["preprocess", "hashes", "--input", str(tmp_path / "d.csv"), "--limit", "1"]):
        cli.main(args, spark)
        assert capsys.readouterr().out.strip()
    with pytest.raises(ValueError):
        cli.main(["metrics", "salience", "--input", out, "--explain", "x"], spark)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the cat", "2026-01-01 00:00:01"), (2, "the the", "2026-01-01 00:00:02")], "id long, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = documents(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "text", "id")
    pipeline = AnnotationPipeline([A.PatternAnnotator(A.pattern_rules({"patterns": [{"label": "T", "pattern": "the"}]}))])
    counts = label_counts(annotate_stream(stream, pipeline, {"enabled": True}), "at", "1 minute", "1 minute")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["count"] for r in spark.sql("select * from counts").collect()] == [3]


def test_odd_documents(spark):
    docs = docs_of(spark, None, "", "the " * 4_000, "the").withColumn("label", F.lit("x")).withColumn("start", F.lit(1))
    got = AnnotationPipeline([A.PatternAnnotator(A.pattern_rules({"patterns": [{"label": "T", "pattern": "the"}]})), A.TemporalAnnotator(language="en")]).run(docs)
    assert flatten(got).groupBy("doc_id").count().orderBy("doc_id").collect()[0]["count"] == 4_000


def test_batches_are_taken_by_pieces(spark):
    import pyarrow as pa

    rng = random.Random(7)
    words = [None if rng.random() < 0.2 else "é" * rng.randint(0, 200) for _ in range(300)]
    spans = [None if rng.random() < 0.2 else list(range(rng.randint(0, 60))) for _ in range(300)]
    cases = [pa.array(words, pa.string()), pa.array(spans, pa.list_(pa.int32())), pa.StructArray.from_arrays([pa.array(spans, pa.list_(pa.int32())), pa.array([[w] for w in words], pa.list_(pa.string()))], names=["a", "b"]), pa.array(words).slice(50, 200), pa.array([], pa.string()), pa.nulls(3, pa.string())]
    for batch in cases:
        got = list(matching.pieces(batch, 500))
        assert [x for p in got for x in p.to_pylist()] == batch.to_pylist()
        assert all(len(p) == 1 or matching.sizes(p).sum() <= 500 for p in got) and (len(batch) < 100 or len(got) > 20)
    # more text than one piece, in one batch, with nulls and an expression that matches nothing
    texts = [None if i % 7 == 0 else f"w{i} " * 400 for i in range(900)]
    docs = documents(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1), "text", "id")
    got = docs.select("doc_id", matching.spans(F.col("text"), "w[0-9]+|(?=w)", False).alias("s"), matching.annotations(F.col("text"), [matching.Term(r"w\d+", "W", phrase=False, bounded=False)]).alias("a")).collect()
    for r in got:
        want = None if texts[r.doc_id] is None else [m.span() for m in re.finditer("w[0-9]+|(?=w)", texts[r.doc_id])]
        assert (None if r.s is None else [tuple(x) for x in r.s]) == want and [(x.start, x.end) for x in r.a] == (want or [])


def test_choices_of_choices_and_what_goes_to_python(spark):
    lists = [[ann(0, 9, layer="social"), ann(2, 5), ann(9, 12), ann(3, 14, layer="contact")], [], None, [ann(4, 6)], [ann(0, 4), ann(4, 4), ann(2, 6)]]
    rows = [(i, "x" * 60, x) for i, x in enumerate(lists)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, annotations {ANNOTATIONS.simpleString()}")
    at_once = docs.select("doc_id", R.paint_order(R.select_visible(F.col("annotations"))).alias("a"))
    in_steps = docs.withColumn("annotations", R.select_visible(F.col("annotations"))).select("doc_id", R.paint_order(F.col("annotations")).alias("a"))
    assert at_once.orderBy("doc_id").collect() == in_steps.orderBy("doc_id").collect()
    assert at_once.where("doc_id = 2").first().a is None and [tuple(x) for x in at_once.where("doc_id = 0").first().a] == [lists[0][3]]
    # starts and ends go to Python and places come back: no texts, no metadata
    plan = docs.select(R.paint_order(F.col("annotations")).alias("a"))._jdf.queryExecution().executedPlan().toString()
    node = next(x for x in plan.splitlines() if "ArrowEvalPython" in x)
    assert "start" in node and "metadata" not in node.split("run(")[1].split(")")[0]


@pytest.mark.parametrize("lang", ["es", "en"])
def test_grammar_searches_where_a_match_can_begin(lang):
    g, rng = grammar, random.Random(5)
    dims = frozenset(g._RULES_OF)
    words = [*g._NUMBERS[lang], *g._UNITS[lang], *g._DAYS[lang], *g._MONTHS[lang], *g._RELATIVE[lang], *g._ORDINALS[lang], *g._MONEY, *(u for x in g._MEASURES.values() for u in x), *"el la próximo próxima pasado pasada next last en in dentro de hace ago on of 5 12 2026 1987 3.000 3,5 1,234.5 2026-03-04 4/5/2024 3rd ² x5 5x _5".split()]
    finder, rules = g._Finder(lang, dims), g._rules(lang)
    for _ in range(1500):
        text = "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" "] * 5 + ["", "s ", ".", "-", "/", "€", "\n", "K"]) for w in rng.choices(words, k=8))
        find = finder.matches(text)
        assert {name: [m.span() for m in find(name)] for name in rules} == {name: [m.span() for m in r.finditer(text)] for name, r in rules.items()}, text


def test_grammar_takes_time_in_proportion_to_results():
    import time

    ref = grammar.reference_time(REF, "Europe/Madrid")
    began = time.process_time()
    got = grammar.parse("3 km y 4 euros, " * 8000, {"number", "distance", "amount-of-money"}, "es", ref)
    assert len(got) == 16000 and time.process_time() - began < 10


def test_concepts_are_observed_in_one_pass(spark):
    about = lambda c: json.dumps({"concept_uri": c})
    docs = with_annotations(spark, [ann(0, 1, "B", metadata=about("u"), text="y"), ann(1, 2, "A", metadata=about("u"), text="x"), ann(2, 3, "A", metadata=about("v"), text="z")], [ann(0, 1, "A", metadata=about("u"), text="y")], [])
    got = M.observed_concepts(docs, flatten(docs), "a")
    assert {r.concept_uri: (r.display, r.label, r.tf, r.df) for r in got.collect()} == {"u": ("y", "A", 3, 2), "v": ("z", "A", 1, 1)}
    text = A.PatternAnnotator(A.pattern_rules({"patterns": [{"label": "L", "pattern": "x"}]})).annotate(docs_of(spark, "x"))
    plan = M.observed_concepts(text, flatten(text), "pattern")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_compact_metadata_is_parsed_once(spark):
    rows = ['{"wikidata": "Q1", "normalized": 1.50, "grain": null, "unit": "", "other": 2}', '{"normalized": {"a": [1, null]}, "multiplier_value": true}', "{}", "broken", None, '{"grain": null}']
    docs = with_annotations(spark, [ann(0, 1, metadata=m) for m in rows])
    made = docs.select(F.transform("annotations", lambda a: writers.compact_metadata(a)).alias("m"))
    assert made.first().m == ['{"wikidata":"Q1","normalized":1.5,"unit":""}', '{"normalized":{"a":[1,null]},"multiplier_value":true}', None, None, None, None]
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json") == 1 and "get_json_object" not in plan


def test_what_a_filter_looks_at_is_made_once(spark):
    made = A.TemporalAnnotator(language="es", ref_time=REF).annotate(docs_of(spark, "en julio"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1 and [r.text for r in flatten(made).collect()] == ["julio"]


def test_a_surface_is_taken_apart_once(spark):
    df = spark.createDataFrame([(" A  cuatro\t",), ("un 30",), ("SEP",), ("sep",), (" ",), (None,)], "s string")
    made = df.select(A.is_bad_temporal_surface(F.col("s"), F.lit("time"), F.lit("minute"), language.temporal_rules("es")).alias("bad"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert [r.bad for r in made.collect()] == [True, True, True, False, True, True]
    assert plan.count("regexp_replace") == 1 and plan.count("split(") == 1
