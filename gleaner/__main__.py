"""python -m gleaner index|ask|evaluate|compare|benchmark-models: the engine over a folder of Parquet tables."""

from __future__ import annotations

import argparse
import importlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import text as t
from gleaner.operators import chunk, metrics
from gleaner.plans import generate, output, pipeline
from gleaner.sources import archive, html


def generator(name: str) -> generate.Generator:
    """The generator that a `module:name` names; names without a module are those of plans.generate."""
    module, _, own = name.rpartition(":")
    return getattr(importlib.import_module(module or "gleaner.plans.generate"), own)()


def benchmark(spark: SparkSession, questions: DataFrame, chunks: DataFrame, models: list[generate.Generator], conf: config.Config) -> DataFrame:
    """The same questions and evidence for each model: (model, tokens_per_second, wall_seconds, runs)."""
    rows = []
    for model in models:
        began = time.perf_counter()
        found = pipeline.ask(questions, chunks, config=conf, generator=model).select(F.sum(t.estimate_tokens("answer"))).first()[0] or 0
        took = time.perf_counter() - began
        rows.append((model.name, int(found), took * 1e9, took))
    return metrics.throughput(spark.createDataFrame(rows, "model string, eval_count long, eval_duration double, wall_seconds double"), "model")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gleaner", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    index = verbs.add_parser("index", help="pages to chunks")
    index.add_argument("pages")
    index.add_argument("chunks")
    for verb, what in (("ask", "answer questions from chunks"), ("compare", "answers of several models"), ("benchmark-models", "speed of several models")):
        p = verbs.add_parser(verb, help=what)
        p.add_argument("--model", action="append", help="module:name of a generator; may be given again")
        p.add_argument("chunks")
        p.add_argument("question", nargs="+")
        p.add_argument("--config")
    evaluate = verbs.add_parser("evaluate", help="metrics of vectors against labels")
    for name in ("queries", "query_vectors", "chunks", "chunk_vectors", "qrels"):
        evaluate.add_argument(name)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("gleaner").getOrCreate()
    if given.verb == "index":
        pages = spark.read.parquet(given.pages).select(F.col("path").alias("article_path"), html.blocks("html").alias("blocks"))
        chunk.chunk_articles(pages.filter("blocks is not null")).write.mode("overwrite").parquet(given.chunks)
    elif given.verb in ("ask", "compare", "benchmark-models"):
        questions = spark.createDataFrame([(i, q) for i, q in enumerate(given.question)], "query_id int, question string")
        models, chunks, conf = [generator(m) for m in given.model or ["Extractive"]], spark.read.parquet(given.chunks), config.load(given.config)
        if given.verb == "benchmark-models":
            benchmark(spark, questions, chunks, models, conf).show(truncate=False)
        else:
            for model in models[: 1 if given.verb == "ask" else None]:
                output.show_answers(pipeline.ask(questions, chunks, config=conf, generator=model))
    else:
        tables = [spark.read.parquet(getattr(given, n)) for n in ("queries", "query_vectors", "chunks", "chunk_vectors", "qrels")]
        archive.write_json(pipeline.evaluate(*tables), given.qrels.rstrip("/") + ".metrics")
        spark.read.json(given.qrels.rstrip("/") + ".metrics").show(truncate=False)


if __name__ == "__main__":
    main()
