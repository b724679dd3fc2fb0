"""Reciprocal rank fusion: two retrievers, or many sub-queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import ranked

RRF_K = 60


def rrf(hits: DataFrame, k: int | None = None, rrf_k: float = RRF_K, by: str = "query_id", digits: int | None = None) -> DataFrame:
    """hits: by, chunk_id, source (0, 1, ...), rank. Score: sum of 1 / (rrf_k + rank).

    Equal scores keep the order of first appearance: by source, then rank.
    """
    score = F.sum(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank")))
    fused = hits.groupBy(by, "chunk_id").agg((F.round(score, digits) if digits is not None else score).alias("score"), F.min(F.struct("source", "rank")).alias("first_seen"), F.count(F.lit(1)).alias("n_sources"))
    return ranked(fused, k, F.col("score").desc(), F.col("first_seen"), by=by)


def hybrid(dense: DataFrame, lexical: DataFrame, k: int | None = None, rrf_k: float = RRF_K, digits: int | None = None) -> DataFrame:
    """Two rankings fused; each source's rank and contribution are told (null where it has none)."""
    both = dense.select("query_id", "chunk_id", "rank", F.lit(0).alias("source")).unionByName(lexical.select("query_id", "chunk_id", "rank", F.lit(1).alias("source")))
    fused = rrf(both, k, rrf_k, digits=digits)
    ranks = both.groupBy("query_id", "chunk_id").agg(F.max(F.when(F.col("source") == 0, F.col("rank"))).alias("dense_rank"), F.max(F.when(F.col("source") == 1, F.col("rank"))).alias("bm25_rank"))
    out = fused.join(ranks, ["query_id", "chunk_id"])
    share = lambda c: (F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(c)))
    return out.select("query_id", "chunk_id", "score", "rank", "dense_rank", "bm25_rank", share("dense_rank").alias("dense_contribution"), share("bm25_rank").alias("bm25_contribution"))


def multi_query(runs: DataFrame, rrf_k: float = RRF_K, digits: int | None = None) -> DataFrame:
    """Rankings of sub-queries fused per question; not truncated.

    runs: query_id, query_index, chunk_id, rank.
    """
    return rrf(runs.withColumnRenamed("query_index", "source"), None, rrf_k, digits=digits).drop("n_sources", "first_seen")


def sub_queries(plans: DataFrame) -> DataFrame:
    """One row per sub-query of a plan: query_id, query_index, text."""
    return plans.select("query_id", F.posexplode("queries").alias("query_index", "text"))


def merge_best(*rounds: DataFrame, k: int | None = None) -> DataFrame:
    """Rounds of hits merged by chunk: the higher score stays, the earlier round on equal ones; ranked anew."""
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "chunk_id", "score", "rank", F.lit(i).alias("round")) for i, r in enumerate(rounds)])
    best = rows.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min(F.struct("round", "rank")).alias("seen"))
    return ranked(best, k, F.col("score").desc(), F.col("seen")).drop("seen")
