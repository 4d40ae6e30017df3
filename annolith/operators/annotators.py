"""Annotators: each takes documents and returns them with annotations appended to the array. None of them shuffles.

Ontology terms and pattern rules are found in one pass over the text, in Arrow batches, whatever their number. Times and
quantities are parsed by a grammar in an Arrow-batched function; their filters and projections are built-in expressions. Entities and links come from columns that a model or service filled before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grammar
from ..functions.language import QuantityRules, TemporalRules, quantity_rules, temporal_rules
from ..functions.matching import Term
from ..functions.matching import annotations as annotations_of
from ..functions.matching import by_pieces
from ..functions.spans import once, strip, surface
from ..model import annotation, append
from .resolve import resolve_layer

TOKENS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType() if c in ("start", "end") else T.StringType()) for c in ("text", "start", "end", "lemma", "upos", "xpos", "feats", "deprel", "head")]))
ENTITIES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType())]))


def dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


# ---------------------------------------------------------------- patterns


@dataclass
class PatternRule:
    id: str
    label: str
    match: str
    patterns: list[str]
    layer: str
    type: str
    subtype: str | None = None
    priority: int = 0
    metadata: dict[str, Any] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    case_sensitive: bool | None = None
    word_boundaries: bool | None = None


def pattern_rules(config: dict[str, Any], layer: str = "pattern") -> list[PatternRule]:
    """Rules of a configuration; each inherits what ``defaults`` has. ``pattern`` goes before ``patterns``."""
    defaults, rules = config.get("defaults") or {}, []
    for index, raw in enumerate(config.get("patterns") or []):
        get = lambda key, default=None: raw.get(key, defaults.get(key, default))  # noqa: B023, E731
        match = get("match", "phrase")
        if "pattern" in raw:
            patterns = [str(raw["pattern"])]
        elif "patterns" in raw:
            patterns = [raw["patterns"]] if isinstance(raw["patterns"], str) else [str(p) for p in raw["patterns"]]
        else:
            raise ValueError(f"Rule {index} names neither a pattern nor patterns: {raw}")
        if match not in ("regex", "phrase"):
            raise ValueError(f"Unsupported match type: {match}")
        rules.append(
            PatternRule(
                raw.get("id", f"rule_{index}"), raw["label"], match, patterns, get("layer", layer), get("type", match), get("subtype"), int(get("priority", 0)),
                raw.get("metadata") or {}, raw.get("exceptions") or [], get("case_sensitive"), get("word_boundaries"),
            )
        )
    return rules


@dataclass
class PatternAnnotator:
    rules: list[PatternRule]
    conflict_strategy: str = "longest_priority"
    ignore_case: bool = True
    word_boundaries: bool = True
    source: str = "pattern"

    def terms(self) -> list[Term]:
        """A term for each pattern, in the order of rules and patterns."""
        out = []
        for rule in self.rules:
            ignore = self.ignore_case if rule.case_sensitive is None else not rule.case_sensitive
            edges = self.word_boundaries if rule.word_boundaries is None else rule.word_boundaries
            for pattern in rule.patterns:
                about = rule.metadata | {"rule_id": rule.id, "matched_value": pattern, "match_type": rule.match, "priority": rule.priority}
                phrase = rule.match == "phrase"
                out.append(Term(pattern, rule.label, rule.layer, self.source, rule.type, rule.subtype, dump(about), phrase, ignore, phrase and edges, tuple(rule.exceptions), rule.priority))
        return out

    def annotate(self, docs: DataFrame) -> DataFrame:
        """Matches of all rules, without those that overlap a rule's exceptions, as the conflict strategy leaves them."""
        return append(docs, annotations_of(F.col("text"), self.terms(), self.conflict_strategy))


# ---------------------------------------------------------------- ontology


@dataclass
class OntologyAnnotator:
    """``concepts``: those of :func:`annolith.operators.ontology.build_index`, in its order."""

    concepts: list[Any]
    layer: str = "ontology"
    source: str = "ontology"
    match_labels: bool = True
    match_aliases: bool = True
    match_patterns: bool = True
    match_name: bool = False
    match_name_camel_case: bool = True

    def terms(self) -> list[Term]:
        """Labels, aliases, names and expressions of all concepts, in the order of annotations."""
        import re

        out = []
        for c in self.concepts:
            terms = [(x, "label") for x in c.labels if self.match_labels] + [(x, "alias") for x in c.aliases if self.match_aliases]
            if self.match_name:
                terms.append((c.name, "name"))
                split = re.sub(r"(?<!^)(?=[A-Z])", " ", c.name)
                if self.match_name_camel_case and split != c.name:
                    terms.append((split, "name_camel_case"))
            for value, kind in [(t, k) for t, k in terms if t] + [(p, "regex") for p in c.patterns if self.match_patterns]:
                about = {"concept_id": c.uri, "concept_uri": c.uri, "concept_name": c.name, "entity_type": c.entity_type, "match_source": kind, "matched_value": value}
                out.append(Term(value, c.name, self.layer, self.source, "ontology", None, dump(about), kind != "regex"))
        return out

    def annotate(self, docs: DataFrame) -> DataFrame:
        return append(docs, annotations_of(F.col("text"), self.terms()))


# ---------------------------------------------------------------- tokens and entities


def token_at(tokens: Column, start: Column, end: Column) -> Column:
    """The first token with exactly this span, or null."""
    return F.try_element_at(F.filter(tokens, lambda t: (t["start"] == start) & (t["end"] == end)), F.lit(1))


def entity_around(entities: Column, start: Column, end: Column) -> Column:
    """The first entity (with offsets) that holds this span, or null."""
    return F.try_element_at(F.filter(entities, lambda e: (e["start"] <= start) & (end <= e["end"])), F.lit(1))


def tokens_of(docs: DataFrame) -> Column:
    return F.col("tokens") if "tokens" in docs.columns else F.lit(None).cast(TOKENS)


def entities_of(docs: DataFrame) -> Column:
    return F.col("entities") if "entities" in docs.columns else F.lit(None).cast(ENTITIES)


# ---------------------------------------------------------------- times and quantities

_RESULT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("dim", T.StringType()), T.StructField("body", T.StringType()), T.StructField("value", T.StringType())]))
_RESULT_ARROW = pa.list_(pa.struct([(f.name, pa.int32() if f.name in ("start", "end") else pa.string()) for f in _RESULT.elementType.fields]))


def parsed(dims: list[str], language: str, timezone: str, ref_time: str | None) -> Column:
    """What the grammar finds, as an array of (start, end, dim, body, value as JSON); Arrow batches, no shuffle."""
    grammar.language_of(language)  # an unknown one is an error at once
    ref = grammar.reference_time(ref_time, timezone)  # fixed here, so that all tasks and retries have the same

    @F.arrow_udf(_RESULT)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in by_pieces(batches):
            yield pa.array([None if t is None else [r | {"value": dump(r["value"])} for r in grammar.parse(t, set(dims), language, ref)] for t in batch.to_pylist()], _RESULT_ARROW)

    return parse.asNondeterministic()(F.col("text"))  # so that it isn't copied: once a text


@dataclass
class GrammarAnnotator:
    """Results of the grammar as they are: label is the dimension in capitals."""

    dimensions: list[str]
    language: str = "es"
    locale: str | None = None
    timezone: str = "Europe/Madrid"
    layer: str = "duckling"
    source: str = "duckling"
    ref_time: str | None = None

    kind = "duckling"

    def results(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("__r", parsed(self.dimensions, self.language, self.timezone, self.ref_time))

    def base(self, r: Column) -> list[Column]:
        """The metadata that every result has."""
        return [r["dim"].alias("dim"), F.parse_json(r["value"]).alias("value"), r["body"].alias("body"), F.lit(self.locale or grammar.locale_of(self.language)).alias("locale"), F.lit(self.timezone).alias("timezone")]

    def made(self, r: Column, label: Column, extra: list[Column] = [], **fields: Column) -> Column:  # noqa: B006
        fields = {"start": r["start"], "end": r["end"], "subtype": r["dim"]} | fields
        text = surface(F.col("text"), fields["start"], fields["end"])
        about = F.to_json(F.struct(*self.base(r), *extra))
        return annotation(text=text, label=label, layer=F.lit(self.layer), source=F.lit(self.source), type=F.lit(self.kind), metadata=about, **fields)

    def annotate(self, docs: DataFrame) -> DataFrame:
        got = F.transform(F.col("__r"), lambda r: self.made(r, F.translate(F.upper(r["dim"]), "-", "_")))
        return append(self.results(docs), got).drop("__r")


def value_of(r: Column, path: str) -> Column:
    return F.get_json_object(r["value"], "$." + path)


def first_true(*values: Column) -> Column:
    """The first that is neither null, nor empty, nor zero."""
    return F.coalesce(*[once(v, lambda x: F.when(~x.isin("", "0", "0.0", "false", "null"), x)) for v in values])


def is_bad_temporal_surface(text: Column, dim: Column, grain: Column, rules: TemporalRules) -> Column:
    """Surfaces that look like times and are none, by the language's lists."""
    return once(strip(text), lambda plain: once(F.lower(plain), lambda low: _bad_surface(plain, low, dim, grain, rules)))


def _bad_surface(plain: Column, low: Column, dim: Column, grain: Column, rules: TemporalRules) -> Column:
    """Of a surface without white space around it, and the same in lower case; what many lists look at is computed once."""
    return once(F.split(low, r"(?U)\s+"), lambda words: _bad_words(plain, low, words, dim, grain, rules))


def _bad_words(plain: Column, low: Column, words: Column, dim: Column, grain: Column, rules: TemporalRules) -> Column:
    among = lambda c, values: c.isin(*sorted(values)) if values else F.lit(False)
    two = F.size(words) == 2
    second = F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))
    prefixed = reduce(lambda a, b: a | b, [(grain == g) & F.startswith(low, F.lit(p)) for g, ps in rules.prefixes.items() for p in ps], F.lit(False))
    return F.coalesce(
        among(plain, rules.exact)
        | (low == "")
        | among(low, rules.single)
        | (among(low, rules.years) & (F.coalesce(grain, F.lit("")) == "year"))
        | (two & among(words[0], rules.starts) & among(second, rules.single))
        | (two & among(words[0], rules.hour_starts) & among(second, rules.hours))
        | F.coalesce(prefixed, F.lit(False))
        | ((F.coalesce(dim, F.lit("")) == "duration") & low.rlike(r"(?U)^\d+$")),
        F.lit(True),
    )


@dataclass
class TemporalAnnotator(GrammarAnnotator):
    dimensions: list[str] = field(default_factory=lambda: ["time", "time-grain", "duration"])
    layer: str = "temporal"
    source: str = "duckling-temporal"

    kind = "temporal"

    def annotate(self, docs: DataFrame) -> DataFrame:
        rules = temporal_rules(self.language)
        text, entities = F.col("text"), entities_of(docs)
        labels = F.create_map(*[F.lit(x) for x in ("time", "DATE", "duration", "DURATION", "time-grain", "TIME_GRAIN")])

        def fine(r: Column) -> Column:
            def good(plain: Column, low: Column, grain: Column) -> Column:
                bad = _bad_surface(plain, low, r["dim"], grain, rules)
                if rules.person_months:
                    e = entity_around(entities, r["start"], r["end"])
                    bad |= low.isin(*sorted(rules.person_months)) & F.coalesce(F.upper(e["type"]).isin("PER", "PERSON"), F.lit(False))
                return ~bad

            own = F.struct(strip(surface(text, r["start"], r["end"])).alias("plain"), value_of(r, "grain").alias("grain"))
            return once(own, lambda x: once(F.lower(x["plain"]), lambda low: good(x["plain"], low, x["grain"])))

        def make(r: Column) -> Column:
            return once(first_true(value_of(r, "value"), value_of(r, "from.value"), value_of(r, "to.value")), lambda normal: made(r, normal))

        def made(r: Column, normal: Column) -> Column:
            typed = F.when(r["dim"] == "duration", F.parse_json(F.coalesce(normal, F.lit("null")))).otherwise(F.parse_json(F.concat(F.lit('"'), normal, F.lit('"'))))
            extra = [typed.alias("normalized"), value_of(r, "grain").alias("grain"), F.parse_json(r["value"]).alias("raw_value"), r["dim"].alias("duckling_dim"), r["body"].alias("duckling_body")]
            return self.made(r, F.coalesce(labels[r["dim"]], F.lit("TEMPORAL")), extra)

        return append(self.results(docs), F.transform(F.filter(F.col("__r"), fine), make)).drop("__r")


_QUANTITY_LABELS = {"number": "NUMBER", "amount-of-money": "MONEY", "distance": "DISTANCE", "volume": "VOLUME", "temperature": "TEMPERATURE", "ordinal": "ORDINAL", "quantity": "QUANTITY"}


@dataclass
class QuantityAnnotator(GrammarAnnotator):
    """Afterwards the whole document is in text order, with no overlaps in this layer."""

    dimensions: list[str] = field(default_factory=lambda: list(_QUANTITY_LABELS))
    layer: str = "cantidades"
    source: str = "duckling-quantity"

    kind = "quantity"

    def annotate(self, docs: DataFrame) -> DataFrame:
        rules = quantity_rules(self.language)
        text, tokens = F.col("text"), tokens_of(docs)
        labels = F.create_map(*[F.lit(x) for pair in _QUANTITY_LABELS.items() for x in pair])

        def fine(r: Column) -> Column:
            low = F.lower(strip(surface(text, r["start"], r["end"])))
            return ~(F.coalesce(low.isin(*sorted(rules.determiners)) if rules.determiners else F.lit(False), F.lit(False)) & F.coalesce(token_at(tokens, r["start"], r["end"])["upos"] == "DET", F.lit(False)))

        def make(r: Column) -> Column:
            normal = first_true(value_of(r, "value"), value_of(r, "amount"), value_of(r, "normalized.value"))
            word, times, size = multiplier(text, r["end"], rules)
            more = (r["dim"] == "number") & word.isNotNull()
            end = F.when(more, r["end"] + size).otherwise(r["end"])
            label = F.when(more, F.lit("QUANTITY")).otherwise(F.coalesce(labels[r["dim"]], F.lit("QUANTITY")))
            product = F.when(more & times.isNotNull(), F.to_json(F.struct((F.try_to_number(normal, F.lit("S999999999999999999D999999")).cast("double") * times).alias("x"))))
            number = F.coalesce(F.get_json_object(product, "$.x"), normal)
            t = token_at(tokens, r["start"], end)
            extra = [
                F.parse_json(F.coalesce(number, F.lit("null"))).alias("normalized"),
                F.parse_json(r["value"]).alias("raw_value"),
                r["dim"].alias("duckling_dim"),
                r["body"].alias("duckling_body"),
                first_true(value_of(r, "unit"), value_of(r, "normalized.unit")).alias("unit"),
                F.when(more, word).alias("multiplier"),
                F.when(more, times).alias("multiplier_value"),
                F.when(t.isNotNull(), F.struct(*[t[c].alias(c) for c in ("lemma", "upos", "xpos", "feats")])).alias("stanza"),
            ]
            return self.made(r, label, extra, end=end, subtype=F.when(more, F.lit("multiplier")).otherwise(r["dim"]))

        out = append(self.results(docs), F.transform(F.filter(F.col("__r"), fine), make)).drop("__r")
        return out.withColumn("annotations", resolve_layer(F.col("annotations"), self.layer))


def multiplier(text: Column, end: Column, rules: QuantityRules) -> tuple[Column, Column, Column]:
    """The multiplier that follows at once (in lower case), its value, and how many characters it adds; null if none."""
    if rules.multiplier is None:
        return F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("int")
    tail = F.substring(text, end + F.lit(1), F.length(text))
    pattern = "(?U)^" + rules.multiplier
    word = F.nullif(F.regexp_extract(tail, pattern, 1), F.lit(""))
    values = F.create_map(*[F.lit(x) for k, v in rules.multipliers.items() for x in (k, v)])
    return F.lower(word), F.try_element_at(values, F.lower(word)).cast("bigint"), F.length(F.regexp_extract(tail, pattern, 0))


# ---------------------------------------------------------------- entities and links from columns


@dataclass
class EntityAnnotator:
    """Named entities that a model found before, from the column ``entities``; ones without offsets are left out."""

    language: str = "es"
    layer: str = "ner"
    source: str = "stanza"

    def annotate(self, docs: DataFrame) -> DataFrame:
        about = F.lit(dump({"language": self.language}))
        usable = F.filter(entities_of(docs), lambda e: e["start"].isNotNull() & e["end"].isNotNull())
        return append(docs, F.transform(usable, lambda e: annotation(start=e["start"], end=e["end"], text=e["text"], label=e["type"], layer=F.lit(self.layer), source=F.lit(self.source), type=F.lit("ner"), subtype=e["type"], metadata=about)))


@dataclass
class LinkAnnotator:
    """Links to a knowledge base from the column ``link_response``: a service's JSON answer for each text, null if it failed.

    Resources without an offset, or with a negative one, are left out.
    """

    layer: str = "dbpedia"
    source: str = "dbpedia-spotlight"

    def annotate(self, docs: DataFrame) -> DataFrame:
        if "link_response" not in docs.columns:
            return docs
        keys = {"uri": "@URI", "similarity_score": "@similarityScore", "percentage_of_second_rank": "@percentageOfSecondRank", "types": "@types"}
        fields = ["@offset", "@surfaceForm", *keys.values()]
        schema = T.StructType([T.StructField("Resources", T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields])))])
        made = F.filter(F.from_json("link_response", schema)["Resources"], lambda r: r["@offset"].cast("int") >= 0)

        def make(r: Column) -> Column:
            start = r["@offset"].cast("int")
            about = F.to_json(F.struct(*[r[v].alias(k) for k, v in keys.items()]))
            return annotation(start=start, end=start + F.length(r["@surfaceForm"]), text=r["@surfaceForm"], label=F.coalesce(r["@types"], F.lit("DBPEDIA")), layer=F.lit(self.layer), source=F.lit(self.source), type=F.lit("entity-linking"), subtype=F.lit("dbpedia"), metadata=about)

        return append(docs, F.transform(made, make))


@dataclass
class FunctionAnnotator:
    """Any Python function from a text to a list of dictionaries of annotation fields, in Arrow batches."""

    function: Any

    def annotate(self, docs: DataFrame) -> DataFrame:
        from ..model import ANNOTATIONS

        call = self.function

        @F.pandas_udf("string")
        def run(text: pd.Series) -> pd.Series:
            return text.map(lambda t: None if t is None else dump([a | {"metadata": dump(a.get("metadata") or {})} for a in call(t)]))

        return append(docs, F.from_json(run(F.col("text")), ANNOTATIONS))
