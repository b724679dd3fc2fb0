"""Stored postings with block maxima: BM25 top-k from an index on a folder, documents not read.

An index is a folder of segments, each complete or not there. A segment's chunks are cut into
ranges of RANGE chunks of like length; a block holds the postings of one token in one range, packed, with
its largest term frequency and smallest length. From these a block's weight is bounded for any
k1, b, average length and document frequency, so that appended segments need no rewrite of older ones.

A search prunes by ranges. Per question and range the bounds of the asked blocks are summed; the
PROBES ranges of the largest sums are scored first; the k-th best score found there is a threshold, and
of all other ranges only those whose sum reaches it are scored. What is left out cannot be among the
first k, so the result is that of scoring everything.

Scale: building shuffles blocks, not occurrences: a range lies in one task, which packs a few ranges at a time. Blocks are written by token
bucket, balanced by size, so that a token of every range is no single file or task; searches read only
the buckets of asked tokens and, for bounds, not the packed columns. Asked blocks are shuffled once, by range,
whatever the number of questions, and each range is scored where it lies. The work of a search is in
proportion to the asked blocks, its scoring to those that are left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import batch_rows, file_system, written
from .lexical import BATCH_ROWS, K1, B, query_tokens, ranked, term_weight

RANGE = 32
PROBES = 4
#: Token buckets of a segment: one per so many chunks, between a least and a most.
BUCKET_CHUNKS, BUCKETS_LEAST, BUCKETS_MOST = 50_000, 8, 4096
#: Scores are rounded and sums are in floating point: bounds within this of the threshold still count.
SLACK = 1e-5


def _blocks(kind: pa.DataType, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            ids, ordinals, lengths, lists = batch.columns
            owner = np.repeat(np.arange(batch.num_rows), lengths.to_numpy())
            told = lists.flatten().dictionary_encode()
            key, tf = np.unique(told.indices.to_numpy().astype(np.int64) * max(batch.num_rows, 1) + owner, return_counts=True)
            token, row = np.divmod(key, max(batch.num_rows, 1))
            at = row // size
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(token) != 0) | (np.diff(at) != 0)])) if len(key) else np.zeros(0, np.int64)
            ends = pa.array(np.append(starts, len(key)).astype(np.int32))
            dl = lengths.to_numpy()[row].astype(np.int64)
            packed = lambda x: pa.ListArray.from_arrays(ends, x)  # noqa: B023, E731
            over = lambda f, x: pa.array(f(x, starts) if len(starts) else x[:0])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                told.dictionary.take(pa.array(token[starts])), pa.array(part + first + at[starts]), pa.array(np.diff(np.append(starts, len(key)))),
                over(np.add.reduceat, tf.astype(np.int64)), over(np.maximum.reduceat, tf.astype(np.int64)), over(np.minimum.reduceat, dl),
                packed(ids.take(pa.array(row))), packed(ordinals.take(pa.array(row))), packed(pa.array(tf.astype(np.int64))), packed(pa.array(dl)),
            ], ["token", "range", "n", "cf", "most_tf", "least_dl", "chunk_ids", "ordinals", "tfs", "dls"])
            first += -(-batch.num_rows // size)

    return run


def blocks(chunks: DataFrame, text: str = "text", size: int = RANGE) -> DataFrame:
    """One row per token and range of chunks, with packed postings."""
    rows = chunks.select("chunk_id", F.col("ordinal").cast("long").alias("ordinal"), tokens(F.col(text)).alias("ts"))
    rows = rows.select("chunk_id", "ordinal", F.size("ts").alias("dl"), "ts").sortWithinPartitions("dl")
    many = lambda t: T.ArrayType(t)
    long = ("range", "n", "cf", "most_tf", "least_dl")
    schema = T.StructType([T.StructField("token", T.StringType()), *(T.StructField(c, T.LongType()) for c in long), T.StructField("chunk_ids", many(chunks.schema["chunk_id"].dataType)), *(T.StructField(c, many(T.LongType())) for c in ("ordinals", "tfs", "dls"))])
    return rows.mapInArrow(_blocks(pa.string(), size), schema)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")


@dataclass
class Found:
    """hits: query_id, chunk_id, ordinal, score, rank. report: per question the blocks asked for and scored."""

    hits: DataFrame
    report: DataFrame


class PostingIndex:
    """Segments of posting blocks under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, chunks: DataFrame, text: str = "text", size: int = RANGE) -> PostingIndex:
        """A new segment of chunks whose ids the index does not have yet. It counts when all of it is written."""
        at = f"{self.path}/s{uuid.uuid4().hex}"
        n = chunks.count()
        buckets = min(BUCKETS_MOST, max(BUCKETS_LEAST, n // BUCKET_CHUNKS))
        rows = blocks(chunks, text, size).withColumn("bucket", _bucket(buckets)).hint("rebalance", F.col("bucket"))
        with batch_rows(self.spark, max(1, BATCH_ROWS // size) * size):  # whole ranges
            rows.sortWithinPartitions("bucket", "token", "range").write.partitionBy("bucket").parquet(f"{at}/blocks")
        held = self.spark.read.parquet(f"{at}/blocks") if self._dirs(f"{at}/blocks") else None
        terms = held.groupBy("token").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.count(F.lit(1)).alias("blocks")) if held is not None else self.spark.createDataFrame([], "token string, df long, cf long, blocks long")
        terms.write.parquet(f"{at}/tokens")
        total = self.spark.read.parquet(f"{at}/tokens").agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("length"))
        total.withColumn("n", F.lit(n).cast("long")).withColumn("buckets", F.lit(buckets)).write.parquet(f"{at}/stats")
        return self

    def _dirs(self, path: str) -> list[str]:
        fs, at = file_system(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at(path)) if s.isDirectory()) if fs.exists(at(path)) else []

    def segments(self) -> list[str]:
        fs, at = file_system(self.spark, self.path)
        return [f"{self.path}/{s}" for s in self._dirs(self.path) if fs.exists(at(f"{self.path}/{s}/stats/_SUCCESS"))]

    def _read(self, table: str) -> list[DataFrame]:
        paths = self.segments()
        if not paths:
            raise ValueError(f"no postings at {self.path}")
        return [self.spark.read.parquet(f"{s}/{table}") for s in paths]

    def _held(self, terms: DataFrame) -> DataFrame | None:
        """The blocks in the buckets of some tokens, None if no segment has a token."""
        out = None
        for i, (path, stats) in enumerate(zip(self.segments(), self._read("stats"), strict=True)):
            if not self._dirs(f"{path}/blocks"):
                continue
            rows, buckets = self.spark.read.parquet(f"{path}/blocks"), stats.first().buckets
            wanted = [r.bucket for r in terms.select(_bucket(buckets).alias("bucket")).distinct().collect()]
            if len(wanted) < buckets:
                rows = rows.filter(F.col("bucket").isin(wanted))
            rows = rows.withColumn("segment", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
        return out

    def tokens(self) -> DataFrame:
        """(token, df, cf, blocks) over all segments."""
        return reduce(DataFrame.unionByName, self._read("tokens")).groupBy("token").agg(*(F.sum(c).alias(c) for c in ("df", "cf", "blocks")))

    def stats(self) -> DataFrame:
        """One row: n chunks and their average length, 1 where that would be 0."""
        n, length = F.sum("n"), F.sum("length")
        return reduce(DataFrame.unionByName, self._read("stats")).agg(n.alias("n"), F.when(length > 0, length / n).otherwise(1.0).alias("avgdl"))

    def drop(self) -> None:
        fs, at = file_system(self.spark, self.path)
        fs.delete(at(self.path), True)

    def search(self, queries: DataFrame, k: int | None = 10, k1: float = K1, b: float = B, digits: int | None = None, probes: int = PROBES) -> Found:
        """BM25 as in lexical.bm25(); without k every block is scored."""
        n, avgdl = self.stats().first()
        terms = query_tokens(queries)
        # written, so that the joins below know how small it is
        asked, held = written(terms.join(self.tokens().select("token", "df"), "token"), "asked"), self._held(terms)
        if held is None:  # segments of chunks without any token
            hits = queries.select("query_id").limit(0)
            empty = hits.withColumn("chunk_id", F.lit(None).cast("long")).withColumn("ordinal", F.lit(0).cast("long")).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
            return Found(empty, hits.select("query_id", F.lit(0).alias("asked"), F.lit(0).alias("scored")))
        weigh = lambda tf, dl: F.col("qtf") * term_weight(F.lit(n), F.col("df"), F.col(tf), F.col(dl), F.lit(avgdl), k1, b)
        where = ["segment", "range"]
        met = held.select("token", *where, "most_tf", "least_dl").join(asked, "token")
        sums = written(met.groupBy("query_id", *where).agg(F.sum(weigh("most_tf", "least_dl")).alias("bound"), F.count(F.lit(1)).alias("blocks")), "range-bounds")
        packed = held.select("token", *where, "chunk_ids", "ordinals", "tfs", "dls").join(asked.select("token").distinct(), "token", "left_semi")

        def scored(ranges: DataFrame, few: bool = False) -> DataFrame:
            # blocks meet the list of a range's questions once; then all of a chunk's scores are sums within its range's task
            asking = ranges.groupBy(*where).agg(F.collect_set("query_id").alias("asking"))
            met = packed.join(asking if few else asking.hint("merge"), where).join(asked, "token")
            needed = met.filter(F.array_contains("asking", F.col("query_id")))
            postings = F.inline(F.arrays_zip("chunk_ids", "ordinals", "tfs", "dls")).alias("chunk_id", "ordinal", "tf", "dl")
            score = F.sum(weigh("tf", "dl"))
            hits = needed.select("query_id", *where, "qtf", "df", postings).groupBy("query_id", *where, "chunk_id", "ordinal").agg((F.round(score, digits) if digits is not None else score).alias("score"))
            return hits.filter(F.col("score") > 0).drop(*where)

        best = [F.col("score").desc(), F.col("ordinal").desc()]
        if k is None:
            return Found(ranked(scored(sums), None, *best), sums.groupBy("query_id").agg(F.sum("blocks").alias("asked"), F.sum("blocks").alias("scored")))
        first = written(ranked(sums, probes, F.col("bound").desc(), *where).select("query_id", *where, "blocks"), "first-ranges")
        found = written(ranked(scored(first, few=True), k, *best), "first-hits")
        threshold = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
        rest = sums.join(first, ["query_id", *where], "left_anti").join(threshold, "query_id", "left")
        rest = written(rest.filter(F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - SLACK)).select("query_id", *where, "blocks"), "more-ranges")
        hits = ranked(found.drop("rank").unionByName(scored(rest)), k, *best)
        used = first.select("query_id", "blocks").unionByName(rest.select("query_id", "blocks"))
        report = sums.groupBy("query_id").agg(F.sum("blocks").alias("asked")).join(used.groupBy("query_id").agg(F.sum("blocks").alias("scored")), "query_id")
        return Found(hits, report)


def build(chunks: DataFrame, path: str, text: str = "text", size: int = RANGE) -> PostingIndex:
    """An index of one segment."""
    return PostingIndex(chunks.sparkSession, path).append(chunks, text, size)
