"""Command line: read an image, scan, compare or evaluate a chapter, normalize texts, extract sentences, score results,
run the registered queries. Models are plug-ins, named as module:factory."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import corpus, evaluate, spell
from scriptoria.plans import chapter
from scriptoria.session import reachable, stored
from scriptoria.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptoria")
    sub = p.add_subparsers(dest="command", required=True)
    n = sub.add_parser("normalize", help="lines of text to normalized lines")
    n.add_argument("input")
    n.add_argument("output")
    n.add_argument("--lexicon", help="tab-separated Lemma and Freq(ipm)")
    n.add_argument("--lite", action="store_true")
    e = sub.add_parser("extract", help="distinct sentences of a corpus archive")
    e.add_argument("archive")
    e.add_argument("output")
    e.add_argument("--max-sentences", type=int, default=100_000)
    s = sub.add_parser("score", help="results (JSON lines with engine, page, text, latency_sec, error) against a manifest")
    s.add_argument("results")
    s.add_argument("manifest")
    s.add_argument("output")
    for name, what in (("image", "text of one image"), ("scan", "texts of a folder of images"), ("evaluate", "a scan against manifest.json"), ("compare", "engines over the *.png files of a folder")):
        c = sub.add_parser(name, help=what)
        c.add_argument("input")
        if name != "image":
            c.add_argument("--output", required=True)
        c.add_argument("--detector", required=name != "compare", help="module:factory of image -> boxes")
        c.add_argument("--recognizer", required=name != "compare", help="module:factory of crop -> (text, confidence)")
        c.add_argument("--second", help="module:factory of a second recognizer")
        c.add_argument("--target", type=float, default=0.90, help="confidence from which a result is certain")
        c.add_argument("--passes", type=int, default=4, help="most readings in the vote")
        if name == "image":
            c.add_argument("--json", action="store_true")
        if name == "scan":
            c.add_argument("--top", type=int, default=0, help="rows of pixels to leave out above")
            c.add_argument("--bottom", type=int, default=0, help="end row; 0 keeps all")
        if name == "compare":
            c.add_argument("--engine", action="append", default=[], help="name=module:factory of image -> text")
    q = sub.add_parser("query", help="run a registered query")
    q.add_argument("name")
    q.add_argument("tables")
    return p


def plug(name: str) -> Callable:
    """The factory of `module:factory`, looked up again where it is called, so that only its name is shipped."""
    module, _, factory = name.partition(":")

    def make():
        return getattr(importlib.import_module(module), factory)()

    return make


def _scan(spark: SparkSession, a: argparse.Namespace, pages: DataFrame) -> DataFrame:
    extra = {"make_second": plug(a.second)} if a.second else {}
    return chapter.scan(pages, plug(a.detector), plug(a.recognizer), getattr(a, "top", 0), getattr(a, "bottom", 0), target=a.target, passes=a.passes, **extra)


def _recognition(spark: SparkSession, a: argparse.Namespace) -> None:
    """The commands that read images."""
    compared = a.command == "compare"
    pages = readers.pixels(spark, a.input, natural=not compared, suffixes=(".png",) if compared else readers.IMAGE_SUFFIXES)
    if compared:
        rows = [chapter.engine_rows(pages, {n: plug(f) for n, _, f in (e.partition("=") for e in a.engine)})] if a.engine else []
        if a.detector and a.recognizer:
            rows.append(chapter.own_rows(_scan(spark, a, pages)))
        if not rows:
            raise SystemExit("nothing to compare: name an engine, or a detector and a recognizer")
        kept = stored(rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]))
        scored, report = chapter.compare(kept, readers.manifest(spark, f"{a.input}/manifest.json"))
        writers.report(scored, f"{a.output}/results")
        writers.report(report, f"{a.output}/report")
        for line in report.toJSON().collect():  # one line an engine
            print(line)
        return
    found = _scan(spark, a, pages)
    if a.command == "image":
        rows = found.drop("page", "source").limit(1).collect()
        if not rows:
            raise SystemExit("image could not be loaded")
        one = rows[0].asDict()
        print(json.dumps(one, ensure_ascii=False, indent=2) if a.json else f"{one['text']}\nconfidence={one['confidence']:.3f} certain={one['certain']} passes={one['passes']}")
    elif a.command == "scan":
        if pages.isEmpty():
            raise SystemExit(f"no images in {a.input}")
        chapter.write_chapter(found, a.output)
    else:
        rows, report = chapter.score_chapter(spark, a.input, stored(found))
        writers.report(rows, f"{a.output}/results")
        writers.report(report, f"{a.output}/report")
        print(report.toJSON().first())


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = reachable(spark or SparkSession.builder.appName("scriptoria").getOrCreate())
    if a.command in ("image", "scan", "evaluate", "compare"):
        _recognition(spark, a)
    elif a.command == "normalize":
        lines = spark.read.text(a.input)
        if a.lexicon:
            # a frequency list has no morphology: a listed word counts as known by its frequency
            words = readers.lexicon(spark, a.lexicon).withColumns({"morph": F.lit(0.5), "zipf": F.lit(0.0)})
            out = spell.normalize_with(lines, "value", words)
        else:
            out = lines.select((T.normalize_lite if a.lite else T.normalize)(F.col("value")).alias("normalized"))
        out.select(F.col("normalized").alias("value")).write.mode("overwrite").text(a.output)
    elif a.command == "extract":
        found = readers.tar_sentences(spark, a.archive)
        writers.sentences(corpus.sentences(found, "text", ["archive", "seq"], limit=a.max_sentences), a.output)
    elif a.command == "score":
        schema = "engine string, page int, text string, confidence double, latency_sec double, error string"
        rows = evaluate.scored(spark.read.schema(schema).json(a.results), evaluate.truth_of(readers.manifest(spark, a.manifest)))
        writers.report(rows, f"{a.output}/results")
        report = evaluate.engine_report(rows)
        writers.report(report, f"{a.output}/report")
        for line in report.toJSON().collect():  # one line an engine
            print(line)
    else:
        from scriptoria.plans import catalogue

        catalogue.QUERIES[a.name](spark, a.tables).show(truncate=False)


if __name__ == "__main__":
    main()
