"""Command line: python -m veriloom COMMAND ...

queries             list the registered queries
run NAME DIR OUT    run one over a folder of tables, written as parquet
chunk PAGES OUT     pages (parquet with the parser's columns) to chunks
embed CHUNKS OUT    chunks with deterministic embeddings
subset CASES IDS OUT   cases by a file of ids, in its order
dataset CHUNKS OUT  evaluation cases from chunks
report ROWS TITLE   a parquet table as markdown
ingest CATALOG PAGES INDEX   one manual's catalog file (JSON) and pages (parquet: url, html) into an index folder
batch CATALOG PAGES INDEX    all manuals of a catalog file, failures kept apart
evaluate CHUNKS CASES OUT    a configuration over cases (parquet: query_id, text, question_type, answerable, gold_chunk_ids)
suite CHUNKS CASES OUT CONFIG...   configurations over the same cases; the first is the baseline
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veriloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in {"queries": (), "run": ("name", "dir", "out"), "chunk": ("pages", "out"), "embed": ("chunks", "out"), "subset": ("cases", "ids", "out"), "dataset": ("chunks", "out"), "report": ("rows", "title"), "ingest": ("catalog", "pages", "index"), "batch": ("catalog", "pages", "index"), "evaluate": ("chunks", "cases", "out"), "suite": ("chunks", "cases", "out")}.items():
        command = commands.add_parser(name)
        for place in places:
            command.add_argument(place)
        if name == "chunk":
            command.add_argument("--target", type=int, default=900)
            command.add_argument("--overlap", type=int, default=120)
            command.add_argument("--lenient", action="store_true")
        if name in ("ingest", "batch"):
            command.add_argument("--host", action="append", required=True)
            command.add_argument("--select")
            command.add_argument("--limit", type=int)
            command.add_argument("--fail-fast", action="store_true")
            command.add_argument("--force-embed", action="store_true")
        if name in ("ingest", "batch", "evaluate"):
            command.add_argument("--config")
        if name == "suite":
            command.add_argument("configs", nargs="+")
            command.add_argument("--free", action="store_true")
        if name == "embed":
            command.add_argument("--dimension", type=int, default=64)
    told = parser.parse_args(args)
    from pyspark.sql import SparkSession

    from . import flows, queries  # noqa: F401  flows register beside the others
    from .functions.vectors import hash_embed
    from .operators import chunking, datasets, reports
    from .sources import html, tables

    if told.command == "queries":
        print("\n".join(sorted(queries.QUERIES)))
        return 0
    spark = SparkSession.builder.appName(f"veriloom {told.command}").getOrCreate()
    read = lambda path: spark.read.parquet(path)
    if told.command == "run":
        if told.name not in queries.QUERIES:
            print(f"unknown query {told.name}", file=sys.stderr)
            return 2
        queries.QUERIES[told.name](spark, told.dir).write.parquet(told.out)
    elif told.command == "chunk":
        documents = html.parse_topics(read(told.pages), strict=not told.lenient)
        chunking.chunk_documents(documents, chunking.Chunking(told.target, told.overlap)).write.parquet(told.out)
    elif told.command == "embed":
        chunks = read(told.chunks)
        made = hash_embed(chunks.select(F.col("chunk_id").alias("id"), "text"), told.dimension).withColumnRenamed("id", "chunk_id")
        chunks.join(made, "chunk_id").write.parquet(told.out)
    elif told.command == "subset":
        reports.subset(read(told.cases), Path(told.ids).read_text(encoding="utf-8").split()).write.parquet(told.out)
    elif told.command == "dataset":
        datasets.build_cases(read(told.chunks)).write.parquet(told.out)
    elif told.command in ("ingest", "batch"):
        return _ingest(spark, told)
    elif told.command in ("evaluate", "suite"):
        return _suite(spark, told)
    else:
        print(tables.markdown(read(told.rows), told.title))
    return 0


def _settings(path: str | None):
    from .plans.settings import load_mapping, settings

    return settings(load_mapping(path) if path else {})


def _ingest(spark, told) -> int:
    from .plans.ingest import ingest
    from .sources import catalog, tables

    config = _settings(told.config)
    entries = catalog.selected(catalog.parsed(catalog.read_catalog(spark, told.catalog), told.host), told.select, told.limit)
    table = tables.VectorTable(spark, f"{told.index}/vectors", config.dimension)
    held = tables.VectorTable(spark, f"{told.index}/cache", config.dimension)
    stored = table.read() if table.generation() else None
    cache = held.read().select("cache_key", "dimension", F.col("embedding").alias("vector")) if held.generation() else None
    out = ingest(entries, spark.read.parquet(told.pages), stored, cache, config, fail_fast=told.fail_fast or told.command == "ingest", force_embed=told.force_embed)
    table.apply(out.changed, out.stale)
    fresh = out.cache.select(F.col("cache_key").alias("chunk_id"), "cache_key", "dimension", F.col("vector").alias("embedding"))
    held.upsert(fresh)
    print(tables.markdown(out.manuals.orderBy("manual_key"), "Manuals"))
    print(tables.markdown(out.report, "Report"))
    return 0 if not out.manuals.filter("status = 'failed'").count() else 1


def _suite(spark, told) -> int:
    from .plans.suite import run_suite
    from .sources import tables

    rows = spark.read.parquet(told.cases)
    questions = rows.select("query_id", "text")
    cases = rows.select(F.col("query_id").alias("case_id"), "question_type", "answerable")
    gold = rows.select(F.col("query_id").alias("case_id"), F.explode("gold_chunk_ids").alias("chunk_id"))
    paths = [told.config] if told.command == "evaluate" else told.configs
    configs = {Path(p).stem if p else "default": _settings(p) for p in paths}
    out = run_suite(spark.read.parquet(told.chunks), configs, next(iter(configs)), questions, cases, gold, one_factor=told.command == "suite" and not told.free)
    out.write.parquet(told.out)
    print(tables.markdown(spark.read.parquet(told.out).orderBy("config_id", "scope"), "Evaluation"))
    return 1 if spark.read.parquet(told.out).filter("status = 'failed'").count() else 0


if __name__ == "__main__":
    sys.exit(main())
