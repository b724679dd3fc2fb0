"""Ingestion of manuals end to end: catalog, navigation, topics, chunks, index, report; as one batch.

Every manual of the batch goes through the same plans at once. A manual whose index page is missing
or unreadable, or that has no chunk in the end, is failed: its error is kept, nothing of it enters
the index or leaves it, and the others go on, unless fail_fast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embedding_text
from ..operators import index, reports
from ..session import written
from ..sources import html
from . import registry
from .registry import Clients, require
from .settings import Settings

CACHE = "cache_key string, dimension int, vector array<float>"
SCOPE = ("manual_id", "snapshot_id")


@dataclass(frozen=True)
class Ingestion:
    """What a run yields: all frames are written or read from written ones.

    chunks: of completed manuals. index: the index after the run. changed, stale: what has to be
    upserted and deleted (chunk_id) to come from the index before to that. cache: vectors to append to
    the cache. manuals: status, error and counts per manual. report: one row of counters.
    """

    chunks: DataFrame
    index: DataFrame
    changed: DataFrame
    stale: DataFrame
    cache: DataFrame
    manuals: DataFrame
    report: DataFrame


def ingest(entries: DataFrame, pages: DataFrame, stored: DataFrame | None = None, cache: DataFrame | None = None, settings: Settings = Settings(), clients: Clients = Clients(), fail_fast: bool = False, force_embed: bool = False) -> Ingestion:
    """entries: of a parsed catalog (url, manual_key, snapshot_id, name, version). pages: (url, html) of
    index and topic pages. stored: the index so far. force_embed: vectors are made anew."""
    spark = entries.sparkSession
    chunk = require(registry.CHUNKERS, settings.chunker, "chunker")(settings, clients)
    embed = require(registry.EMBEDDERS, settings.embedder, "embedder")(settings, clients)
    meta = entries.select(F.col("url").alias("index_url"), "manual_key", "snapshot_id", F.col("name").alias("manual_name"), F.col("version").alias("manual_version"))
    found = entries.select("url").join(pages.select("url", "html"), "url", "left")
    topics = written(html.parse_navigation(found).join(meta, "index_url"), "topics")
    held = topics.filter(F.col("error").isNull()).join(pages.select(F.col("url").alias("source_url"), "html"), "source_url", "left")
    documents = html.parse_topics(held.filter(F.col("html").isNotNull())).drop("manual_version")
    of_manual = topics.filter(F.col("error").isNull()).select("manual_id", "snapshot_id", "manual_key", "manual_name", "manual_version").distinct()
    chunks = written(chunk(documents.join(of_manual, list(SCOPE))), "chunks")

    per_topics = topics.groupBy("manual_key", "snapshot_id").agg(F.max("error").alias("error"), F.count("topic_id").alias("topics"), F.max("refs").alias("refs"))
    per_chunks = chunks.groupBy("manual_key", "snapshot_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("document_id").alias("documents"))
    manuals = meta.select("manual_key", "snapshot_id").join(per_topics, ["manual_key", "snapshot_id"], "left").join(per_chunks, ["manual_key", "snapshot_id"], "left")
    error = F.coalesce("error", F.when(F.coalesce("chunks", F.lit(0)) == 0, "no chunks to index"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("refs", "topics", "documents", "chunks")]
    manuals = written(manuals.select("manual_key", "snapshot_id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error"), *counts), "manuals")
    if fail_fast and (bad := manuals.filter("status = 'failed'").orderBy("manual_key").first()):
        raise RuntimeError(f"{bad['manual_key']}: {bad['error']}")

    good = chunks.join(manuals.filter("status = 'completed'").select("manual_key", "snapshot_id"), ["manual_key", "snapshot_id"], "left_semi")
    good = written(good.withColumn("shown", embedding_text(F.col("text"))), "current")
    cache = spark.createDataFrame([], CACHE) if cache is None or force_embed else cache
    kind = good.schema["chunk_id"].dataType.simpleString()
    stored = spark.createDataFrame([], f"chunk_id {kind}, content_hash string, manual_id string, snapshot_id string") if stored is None else stored
    pending = good if force_embed else index.pending(good, stored)
    name = f"{settings.embedder}:{settings.dimension}"
    vectors, fresh = index.embed_through_cache(pending, cache, embed, name, settings.dimension, "shown")
    vectors, fresh = written(vectors.drop("shown"), "vectors"), written(fresh, "fresh-vectors")
    gone = written(index.stale(stored, good, SCOPE).select("chunk_id"), "stale")
    rest = stored.join(gone, "chunk_id", "left_anti").join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    after = vectors.unionByName(rest, allowMissingColumns=True) if "embedding" in rest.columns else vectors
    states = index.sync_states(spark.createDataFrame([], "chunk_id string, content_hash string") if force_embed else stored, good, cache, name, "shown")
    told = reports.ingestion_report(states.select("topic_id", "state", F.lit(False).alias("stale"))).drop("stale")
    total = manuals.agg(F.sum("topics").alias("found"), F.sum("documents").alias("documents"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    report = told.crossJoin(F.broadcast(gone.agg(F.count(F.lit(1)).alias("stale")))).crossJoin(F.broadcast(total))  # one row each
    return Ingestion(good.drop("shown"), written(after, "index"), vectors, gone, fresh, manuals, written(report, "ingest-report"))

