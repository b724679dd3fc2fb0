"""Diversified evidence: a stateful greedy choice in rank order, as one fold per question.

A row that the topic limit rejects does not reserve its hash, so chained row numbers would not do.
The folded array holds a question's candidates, of which there are candidate_k at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REASONS = ("below_min_score", "duplicate_content_hash", "topic_limit_exceeded", "evidence_top_k_reached", "selected")


def select_evidence(hits: DataFrame, top_k: int = 3, min_score: float = 0.0, per_topic: int = 2, candidate_k: int = 100) -> DataFrame:
    """hits: query_id, chunk_id, rank, score, topic_id, content_hash. One row per candidate with its decision.

    Candidates beyond candidate_k in rank are not considered.
    """
    row = F.struct("rank", "chunk_id", F.col("score").cast("double").alias("score"), "topic_id", "content_hash")
    held = hits.filter(F.col("rank") <= candidate_k).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    fold = f"""
      aggregate(rows,
        cast(struct(array() as hashes, array() as topics, array() as reasons) as struct<hashes: array<string>, topics: array<string>, reasons: array<string>>),
        (acc, x) -> struct_step,
        acc -> acc.reasons)
    """
    reason = f"""CASE
      WHEN x.score < {min_score!r}D THEN 'below_min_score'
      WHEN array_contains(acc.hashes, cast(x.content_hash as string)) THEN 'duplicate_content_hash'
      WHEN size(filter(acc.topics, t -> t <=> cast(x.topic_id as string))) >= {per_topic} THEN 'topic_limit_exceeded'
      WHEN size(acc.topics) >= {top_k} THEN 'evidence_top_k_reached'
      ELSE 'selected' END"""
    step = f"""named_struct(
      'hashes', IF(({reason}) = 'selected', array_append(acc.hashes, cast(x.content_hash as string)), acc.hashes),
      'topics', IF(({reason}) = 'selected', array_append(acc.topics, cast(x.topic_id as string)), acc.topics),
      'reasons', array_append(acc.reasons, {reason}))"""
    told = held.select("query_id", "rows", F.expr(fold.replace("struct_step", step)).alias("reasons"))
    out = told.select("query_id", F.explode(F.arrays_zip("rows", "reasons")).alias("z"))
    return out.select("query_id", "z.rows.*", F.col("z.reasons").alias("reason"), (F.col("z.reasons") == "selected").alias("selected"))


def evidence_bundle(selected: DataFrame) -> DataFrame:
    """Per question: the chosen rows in order, and why there are none."""
    kept = F.array_sort(F.collect_list(F.when(F.col("selected"), F.struct("rank", "chunk_id", "score"))))
    out = selected.groupBy("query_id").agg(kept.alias("items"))
    return out.withColumn("rejected_reason", F.when(F.size("items") == 0, "no_evidence"))
