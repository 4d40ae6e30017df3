"""Command line: run, metrics summary and salience, ontology info, concepts, distances and relations, cache, render."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import text_hash
from ..model import flatten
from ..operators import metrics, ontology
from ..sources.readers import load_config, ontology_info, read_annotated, read_documents, read_rdf
from ..sources.writers import put, write_corpus, write_metrics
from . import render
from .pipeline import expansion_distances, run_config


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="annolith")
    sub = top.add_subparsers(dest="command", required=True)

    def command(path: str, *args: tuple) -> None:
        p = groups[path.split()[0]].add_parser(path.split()[1]) if " " in path else sub.add_parser(path)
        p.set_defaults(path=path)
        for names, options in args:
            p.add_argument(*names.split(), **options)

    groups = {g: sub.add_parser(g).add_subparsers(dest="what", required=True) for g in ("metrics", "ontology", "preprocess", "render")}
    text = {"default": None}
    io = [("--input", {"required": True}), ("--input-format", text), ("--output", {"default": "-"})]
    command("run", ("--config", {"required": True}), *io, ("--output-format", text), ("--output-profile", {"default": "compact"}), ("--text-column", {"default": "text"}), ("--id-column", {"default": "id"}), ("--sep", {"default": ","}), ("--base", {"default": "."}))
    command("metrics summary", *io, ("--top", {"type": int, "default": 20}), ("--json", {"action": "store_true"}))
    command("metrics salience", *io, ("--top", {"type": int, "default": 20}), ("--layer", text), ("--label", text), ("--method", {"default": "tfidf", "choices": ["tfidf", "tfidf-e"]}), ("--ontology", text), ("--max-distance", {"type": int, "default": 2}), ("--decay", {"type": float, "default": 0.5}), ("--direction", {"default": "outgoing"}), ("--explain", text), ("--json", {"action": "store_true"}))
    for what in ("info", "concepts", "relations", "distances"):
        command(f"ontology {what}", ("--ontology", {"required": True}), ("--config", text), *([("--concept", {"required": True}), ("--max-distance", {"type": float, "default": 3})] if what == "distances" else []))
    command("preprocess hashes", *io, ("--language", {"default": "es"}), ("--processors", {"default": "tokenize,mwt,pos,lemma,depparse,ner"}), ("--limit", {"type": int, "default": None}))
    for what in ("html", "console"):
        command(f"render {what}", *io, ("--title", {"default": "Annotation report"}))
    return top


def _out(df: DataFrame, args: argparse.Namespace) -> None:
    if getattr(args, "json", False) or args.output != "-":
        write_metrics([r.asDict(True) for r in df.collect()], args.output)
    else:
        put(render.text_table(df), None)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("annolith").getOrCreate()
    if args.path == "run":
        got = run_config(spark, args.config, args.input, base=args.base, input_format=args.input_format, text_col=args.text_column, id_col=args.id_column, sep=args.sep)
        write_corpus(got.documents, args.output, args.output_format, args.output_profile, got.metadata)
    elif args.command == "ontology":
        triples = read_rdf(args.ontology)
        config = load_config(args.config) if args.config else {}
        graph = ontology.build_graph(triples, config)
        if args.what == "info":
            rows = ontology_info(triples) | {"relations": len(graph.edges)}
        elif args.what == "concepts":
            rows = [{"uri": c.uri, "name": c.name, "type": c.entity_type, "labels": ", ".join(c.labels), "aliases": ", ".join(c.aliases), "parents": ", ".join(c.parents)} for c in ontology.build_index(triples, config)]
        elif args.what == "relations":
            rows = [{"source": graph.nodes[a], "target": graph.nodes[b], "property": e["property"], "direction": e["direction"], "distance": e["weight"]} for (a, b), e in graph.edges.items()]
        else:
            found = graph.distances_from(ontology.find_concept(graph.nodes, args.concept), args.max_distance)
            rows = [{"concept": graph.nodes[u], "uri": u, "distance": d} for u, d in sorted(found.items(), key=lambda x: (x[1], x[0]))]
        write_metrics(rows)
    elif args.command == "preprocess":
        docs = read_documents(spark, args.input, args.input_format).withColumn("text_hash", text_hash(F.lit(args.language), F.lit(args.processors), F.col("text")))
        rows = docs.orderBy("doc_id").limit(args.limit) if args.limit else docs
        put("".join(json.dumps({"doc_id": r.doc_id, "text": r.text, "text_hash": r.text_hash}, ensure_ascii=False) + "\n" for r in rows.toLocalIterator()), args.output)
    elif args.command == "render":
        docs = read_annotated(spark, args.input, args.input_format)
        put(render.render_html(docs, args.title) if args.what == "html" else render.render_console(docs), args.output)
    else:
        docs = read_annotated(spark, args.input, args.input_format)
        flat = flatten(docs)
        if args.what == "summary":
            tables = {"totals": metrics.summary_totals(docs)} | {k: metrics.top_counts(flat, k, args.top) for k in ("layer", "label", "layer_label", "annotation")}
            if args.json or args.output != "-":
                write_metrics({k: [r.asDict() for r in t.collect()] for k, t in tables.items()}, args.output)
            else:
                put("\n".join(f"{k}\n{render.text_table(t)}" for k, t in tables.items()), None)
        elif args.method == "tfidf":
            if args.explain:
                raise ValueError("--explain needs --method tfidf-e")
            _out(metrics.salience(docs, flat, args.top, args.layer, args.label), args)
        else:
            if not args.ontology or args.label:
                raise ValueError("--method tfidf-e needs --ontology and takes no --label")
            near = expansion_distances(spark, read_rdf(args.ontology), args.max_distance, args.direction)
            items = metrics.extended_salience(docs, flat, near, args.top, args.layer or "ontology", args.max_distance, args.decay)
            _out(metrics.explain(items, args.explain) if args.explain else items.drop("expanded_from") if args.output == "-" and not args.json else items, args)


if __name__ == "__main__":
    main()
