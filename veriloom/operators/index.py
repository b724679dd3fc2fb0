"""Index maintenance: upsert, incremental difference, stale rows, embedding cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import embedding_key


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """stored with new rows in place of those with equal keys."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new.select(stored.columns))


def pending(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that are not stored with the same content hash."""
    return current.join(stored.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


def stale(stored: DataFrame, current: DataFrame, scope: tuple[str, ...] = ("manual_id", "snapshot_id")) -> DataFrame:
    """Stored chunks of the current rows' scopes that are no longer among them.

    scope ("snapshot_id",) alone lets manuals that share a snapshot id remove each other's chunks.
    """
    scopes = current.select(*scope).distinct()
    return stored.join(scopes, list(scope), "left_semi").join(current.select("chunk_id"), "chunk_id", "left_anti")


def synced(stored: DataFrame, current: DataFrame, scope: tuple[str, ...] = ("manual_id", "snapshot_id")) -> DataFrame:
    """The index after an ingestion: stale rows gone, changed and new ones in."""
    return upsert(stored.join(stale(stored, current, scope).select("chunk_id"), "chunk_id", "left_anti"), pending(current, stored))


def sync_states(stored: DataFrame, current: DataFrame, cached_keys: DataFrame, embedder: str, text: str = "text") -> DataFrame:
    """current with state: reused (stored unchanged), cached (vector known) or embedded."""
    same = stored.select("chunk_id", "content_hash").withColumn("same", F.lit(True))
    known = cached_keys.select("cache_key").distinct().withColumn("known", F.lit(True))
    rows = current.withColumn("cache_key", embedding_key(embedder, F.col(text))).join(same, ["chunk_id", "content_hash"], "left").join(known, "cache_key", "left")
    return rows.withColumn("state", F.when(F.col("same"), "reused").when(F.col("known"), "cached").otherwise("embedded")).drop("same", "known", "cache_key")


def cached_vectors(cache: DataFrame, dimension: int) -> DataFrame:
    """Usable cache rows: (cache_key, vector); rows whose vector has another size are ignored."""
    return cache.filter((F.col("dimension") == dimension) & (F.size("vector") == dimension)).select("cache_key", "vector")


def cache_misses(chunks: DataFrame, cache: DataFrame, embedder: str, dimension: int, text: str = "text") -> DataFrame:
    """(cache_key, text): each text without a vector once, however many chunks hold it."""
    wanted = chunks.select(embedding_key(embedder, F.col(text)).alias("cache_key"), F.col(text).alias("text")).groupBy("cache_key").agg(F.min("text").alias("text"))
    return wanted.join(cached_vectors(cache, dimension), "cache_key", "left_anti")


def embed_through_cache(chunks: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], embedder: str, dimension: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """chunks with embedding, and the rows to append to the cache.

    embed: (id, text) -> (id, embedding ARRAY<FLOAT>). Vectors of another size raise. Only texts
    that no chunk has seen are embedded; vectors are FLOAT on either path.
    """
    missing = cache_misses(chunks, cache, embedder, dimension, text)
    made = embed(missing.select(F.col("cache_key").alias("id"), "text")).select(F.col("id").alias("cache_key"), F.col("embedding").cast("array<float>").alias("vector"))
    made = made.filter(F.assert_true(F.size("vector") == dimension, F.lit("embedding size does not match")).isNull())
    every = cached_vectors(cache, dimension).unionByName(made)
    out = chunks.withColumn("cache_key", embedding_key(embedder, F.col(text))).join(every, "cache_key").withColumnRenamed("vector", "embedding").drop("cache_key")
    return out, made.select("cache_key", F.lit(dimension).alias("dimension"), "vector")


def refuse_empty(chunks: DataFrame) -> DataFrame:
    if chunks.isEmpty():
        raise RuntimeError("no chunks to index")
    return chunks


def by_manual(chunks: DataFrame) -> DataFrame:
    """Per manual: chunks and whether any row failed (a non-null error); failures don't stop others."""
    return chunks.groupBy("manual_key").agg(F.count_if(F.col("error").isNull()).alias("chunks"), F.count("error").alias("errors"), F.when(F.count("error") > 0, "failed").otherwise("completed").alias("status"))
